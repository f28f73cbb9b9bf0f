"""Container files by the climate conventions: dimensions, variables, groups, attributes, and values unpacked by the file's own attributes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arrayloom.operators.cf import EPSILON, is_coordinate, match_dimensions
from arrayloom.sources.container import Container, ContainerError, Dataset, Group, _files

# Names of element types by the conventions.
TYPE_NAMES = {"i8": "NC_BYTE", "u8": "NC_UBYTE", "i16": "NC_SHORT", "u16": "NC_USHORT", "i32": "NC_INT", "u32": "NC_UINT", "i64": "NC_INT64", "u64": "NC_UINT64", "f32": "NC_FLOAT", "f64": "NC_DOUBLE", "string": "NC_STRING"}
TEXTS = ("units", "long_name", "standard_name", "calendar", "axis")
NUMBERS = {"_FillValue": "fill_value", "missing_value": "missing_value", "scale_factor": "scale_factor", "add_offset": "add_offset"}


def type_name(d: Dataset) -> str:
    text = d.kind.name == "variable" and d.kind.padding == "string"
    return "NC_STRING" if text else TYPE_NAMES.get(d.kind.name, "NC_CHAR")


def _number(value: object, listed: bool = False) -> float | None:
    """A number, or, if lists may stand for it, a list's first; texts and other things are none."""
    if listed and isinstance(value, list) and value:
        value = value[0]
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def attributes_of(told: dict[str, object]) -> dict[str, object]:
    """The attributes that the conventions name: texts, numbers, and valid_min and valid_max from valid_range, or from both of them by name."""
    out: dict[str, object] = {k: told[k] if isinstance(told.get(k), str) else None for k in TEXTS}
    for name, key in NUMBERS.items():
        out[key] = _number(told.get(name), listed=name in ("_FillValue", "missing_value"))
    span = told.get("valid_range")
    pair = [float(x) for x in span[:2]] if isinstance(span, list) and len(span) >= 2 else [_number(told.get("valid_min")), _number(told.get("valid_max"))]
    out["valid_min"], out["valid_max"] = pair if None not in pair else (None, None)
    return out


def _scales(box: Container, group: Group) -> list[tuple[str, int, bool]]:
    """(name, size, unlimited) of a group's dimensions, in the order of their dimension ids, those without one last."""
    found = []
    for name, to in sorted(group.links.items()):
        d = box.object(to)
        if isinstance(d, Dataset) and d.attributes.get("CLASS") == "DIMENSION_SCALE":
            place = _number(d.attributes.get("_Netcdf4Dimid"))
            found.append((place is None, place or 0.0, name, d.shape[0] if d.shape else 0, bool(d.most) and d.most[0] is None))
    return [(name, size, free) for _, _, name, size, free in sorted(found, key=lambda f: f[:2])]


def _groups(box: Container) -> Iterator[tuple[str, Group]]:
    return ((p, x) for p, x in box.walk() if isinstance(x, Group))


def _rows(spark: SparkSession, path: str | DataFrame, listed: Callable[[str, Container], list[dict]], shape: str) -> DataFrame:
    """What ``listed`` tells of each file; only headers are parsed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(listed(file, Container(content)), schema=schema)

    return _files(spark, path).mapInArrow(run, shape)


def dimensions(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, group, place, name, size, unlimited of the dimensions of every group."""

    def listed(file: str, box: Container) -> list[dict]:
        return [{"file": file, "group": p, "place": i, "name": n, "size": size, "unlimited": free} for p, g in _groups(box) for i, (n, size, free) in enumerate(_scales(box, g))]

    return _rows(spark, path, listed, "file string, group string, place int, name string, size long, unlimited boolean")


def variables(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, group, name, type, shape, dimensions, coordinate and the conventions' attributes of every dataset; coordinates are variables too."""

    def listed(file: str, box: Container) -> list[dict]:
        out = []
        for p, g in _groups(box):
            scales = [(n, size) for n, size, _ in _scales(box, g)]
            for name, to in sorted(g.links.items()):
                if isinstance(d := box.object(to), Dataset):
                    dims = match_dimensions(d.shape, scales)
                    out.append({"file": file, "group": p, "name": name, "type": type_name(d), "shape": list(d.shape), "dimensions": dims, "coordinate": is_coordinate(name, dims), **attributes_of(d.attributes)})
        return out

    texts, numbers = ", ".join(f"{t} string" for t in TEXTS), ", ".join(f"{n} double" for n in (*NUMBERS.values(), "valid_min", "valid_max"))
    return _rows(spark, path, listed, f"file string, group string, name string, type string, shape array<long>, dimensions array<string>, coordinate boolean, {texts}, {numbers}")


def groups(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, path, parent, depth of all groups but the root, also those in groups."""

    def listed(file: str, box: Container) -> list[dict]:
        return [{"file": file, "path": p, "parent": p.rpartition("/")[0], "depth": p.count("/") + 1} for p, _ in _groups(box) if p]

    return _rows(spark, path, listed, "file string, path string, parent string, depth int")


def attributes(spark: SparkSession, path: str | DataFrame, group: str = "") -> DataFrame:
    """file, name, value (as text) of a group's attributes; the root's are the file's own, ``_NCProperties`` among them."""

    def listed(file: str, box: Container) -> list[dict]:
        found = box.find(group)
        return [{"file": file, "name": k, "value": str(v)} for k, v in sorted(found.attributes.items())]

    return _rows(spark, path, listed, "file string, name string, value string")


def unpacked(values: np.ndarray, told: dict[str, object]) -> np.ndarray:
    """Values times scale_factor plus add_offset, fill and missing values as NaN; as they are without either of the two."""
    x = values.astype("f8")
    if told["scale_factor"] is None and told["add_offset"] is None:
        return x
    out = x * (1.0 if told["scale_factor"] is None else told["scale_factor"]) + (told["add_offset"] or 0.0)
    for sentinel in (told["fill_value"], told["missing_value"]):
        if sentinel is not None:
            out[np.isnan(x) if np.isnan(sentinel) else np.abs(x - sentinel) < EPSILON] = np.nan
    return out


def read(spark: SparkSession, path: str | DataFrame, variable: str, rank: int, raw: bool = False) -> DataFrame:
    """file, i0.., value of a variable in all files, unpacked by each file's own attributes unless raw."""
    axes = [f"i{d}" for d in range(rank)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                box = Container(content)
                d = box.find(variable)
                if not isinstance(d, Dataset) or len(d.shape) != rank:
                    raise ContainerError(f"{variable} is no variable of {rank} axes")
                told = attributes_of(d.attributes)
                for offsets, part in box.blocks(d):
                    places = [i.ravel() + o for i, o in zip(np.indices(part.shape), offsets, strict=True)]
                    values = part.ravel().astype("f8") if raw else unpacked(part.ravel(), told)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * part.size, pa.string()), *(pa.array(p.astype("i8")) for p in places), pa.array(values)], names=["file", *axes, "value"])

    return _files(spark, path).mapInArrow(run, f"file string, {', '.join(f'{a} bigint' for a in axes)}, value double")
