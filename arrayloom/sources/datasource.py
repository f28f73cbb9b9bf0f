"""Container files as a data source of Spark: one file's chunks are dealt to many tasks, each of which reads the bytes of its own.

    spark.dataSource.register(ContainerSource)
    spark.read.format("container").option("path", folder).option("dataset", "g/grid").load()

Options: path (a file or a folder, any store that pyarrow's file systems reach), dataset, kind (double, bigint or string) and slab (JSON:
start, stride, count and block by axis). Headers and chunk indexes are read once, while the scan is planned, page by page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from arrayloom.operators.selection import Hyperslab
from arrayloom.sources.container import Container, ContainerError, Dataset, Paged, decoded

#: Bytes of elements that one task decodes, about, and elements of one Arrow batch.
TASK_BYTES, BATCH = 64 << 20, 1 << 18


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def opened(path: str) -> Container:
    """A file of which only what is asked for is read."""
    store, at = located(path)
    return Container(Paged(store.open_input_file(at)))


def listed(path: str) -> list[str]:
    """The files at a path, by name; those whose names begin with _ or . are still written, or no data."""
    store, at = located(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path[: path.rindex(at)] if ":/" in path and at in path else ""
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def slab_of(options: dict) -> Hyperslab | None:
    return Hyperslab(*json.loads(options["slab"])) if "slab" in options else None


class Part(InputPartition):
    """Some of a file's chunks, as its index lists them, or rows of a dataset that lies in one piece."""

    def __init__(self, file: str, chunks: list | None, rows: tuple[int, int] | None):
        super().__init__((file, chunks, rows))


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.dataset, self.kind, self.slab = options["path"], options["dataset"], options.get("kind", "double"), slab_of(options)
        self.names = [f.name for f in schema]

    def _dataset(self, file: str) -> tuple[Container, Dataset]:
        box = opened(file)
        d = box.find(self.dataset)
        if not isinstance(d, Dataset) or len(d.shape) != len(self.names) - 2:
            raise ContainerError(f"{self.dataset} of {file} is no dataset of {len(self.names) - 2} axes")
        return box, d

    def partitions(self) -> list[Part]:
        out = []
        for file in listed(self.path):
            box, d = self._dataset(file)
            item = d.kind.dtype.itemsize
            if d.layout[0] in ("contiguous", "compact"):
                step = max(1, TASK_BYTES // max(1, item * int(np.prod(d.shape[1:])))) if d.shape else 1
                lo, hi = self.slab.hull()[0] if self.slab and d.shape else (0, (d.shape or (1,))[0] - 1)
                out += [Part(file, None, (i, min(i + step, hi + 1))) for i in range(max(lo, 0), hi + 1, step)]
                continue
            hull = self.slab.hull() if self.slab else [(0, n - 1) for n in d.shape]
            near = [e for e in box._chunks(d) if all(o < n and o <= hi and o + c > lo for n, o, c, (lo, hi) in zip(d.shape, e[0], d.layout[2], hull, strict=True))]
            step = max(1, TASK_BYTES // (item * int(np.prod(d.layout[2]))))
            out += [Part(file, near[i : i + step], None) for i in range(0, len(near), step)]
        return out or [Part("", [], None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        file, chunks, rows = partition.value
        if not file:
            return
        box, d = self._dataset(file)
        if chunks is None:
            if d.shape and d.layout[0] == "contiguous":  # the rows' bytes alone
                width = int(np.prod(d.shape[1:])) * d.kind.dtype.itemsize
                if d.layout[1] == box.nowhere:
                    return
                at = box.base + d.layout[1]
                raw = box.data[at + rows[0] * width : at + min(rows[1], d.shape[0]) * width]
                parts = [((rows[0], *[0] * (len(d.shape) - 1)), np.frombuffer(raw, d.kind.dtype).reshape(-1, *d.shape[1:]))]
            else:
                parts = [((rows[0], *o[1:]), x[rows[0] : rows[1]]) if d.shape else (o, x) for o, x in box.blocks(d)]
        else:
            parts = ((tuple(e[0]), box.chunk(d, *e)) for e in chunks)
        for offsets, part in parts:
            yield from self._batches(file, box, d, offsets, part)

    def _batches(self, file: str, box: Container, d: Dataset, offsets: tuple[int, ...], part: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.ones(part.shape, bool)
        for axis, (o, n) in enumerate(zip(offsets, part.shape, strict=True)):
            if self.slab:
                i, lo, (first, last) = np.arange(o, o + n), self.slab.start[axis], self.slab.hull()[axis]
                on = (i >= first) & (i <= last) & ((i - lo) % self.slab.stride[axis] < self.slab.block[axis])
                keep &= on.reshape([-1 if a == axis else 1 for a in range(part.ndim)])
        flat = np.flatnonzero(keep)
        for lo in range(0, len(flat), BATCH):
            at = flat[lo : lo + BATCH]
            places = np.unravel_index(at, part.shape) if part.ndim else ()
            values = part.ravel()[at]
            if self.kind == "string":
                value = pa.array(decoded(values, d.kind, box), pa.string())
            else:
                value = pa.array(values.astype("f8" if self.kind == "double" else "i8"))
            columns = [pa.array([file] * len(at), pa.string()), *(pa.array(p.astype("i8") + o) for p, o in zip(places, offsets, strict=True)), value]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> StructType:
        files = listed(self.options["path"])
        if not files:
            raise ContainerError(f"no file at {self.options['path']}")
        d = opened(files[0]).find(self.options["dataset"])
        if not isinstance(d, Dataset):
            raise ContainerError(f"{self.options['dataset']} is a group")
        out = StructType().add("file", StringType())
        for axis in range(len(d.shape)):
            out.add(f"i{axis}", LongType())
        return out.add("value", {"double": DoubleType(), "bigint": LongType(), "string": StringType()}[self.options.get("kind", "double")])

    def reader(self, schema: StructType) -> ContainerReader:
        if (slab := slab_of(self.options)) and slab.overlaps():
            raise ContainerError("blocks of a slab that is read may not overlap")
        return ContainerReader(dict(self.options), schema)
