"""Structures of named fields as packed little-endian bytes, and back."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Mapping
from typing import get_type_hints

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayloom.model import ELEMENT_TYPES

# Element types and their numpy letters.
LETTERS = {"i8": "i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "u8": "u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "f32": "<f4", "f64": "<f8", "bool": "u1"}


class Record:
    """Fields by name, in their order: an element type, or (element type, n) for a fixed array. Nothing lies between fields."""

    def __init__(self, fields: Mapping[str, str | tuple[str, int]]):
        if not fields:
            raise ValueError("a record needs a field")
        self.fields = dict(fields)
        parts = []
        for name, told in self.fields.items():
            kind, n = told if isinstance(told, tuple) else (told, None)
            if kind not in LETTERS or (n is not None and n < 1):
                raise ValueError(f"field {name} can't be of {told}")
            parts.append((name, LETTERS[kind]) if n is None else (name, LETTERS[kind], (n,)))
        self.dtype = np.dtype(parts)

    @staticmethod
    def of(cls: type) -> Record:
        """From a dataclass whose annotations are element types by name, or tuples of them with a length, as strings: ``x: "f64"``, ``y: "i32[3]"``."""
        fields: dict[str, str | tuple[str, int]] = {}
        told = {f.name: f.type for f in dataclasses.fields(cls)} if dataclasses.is_dataclass(cls) else get_type_hints(cls)
        for name, kind in told.items():
            kind = str(kind).strip("'\"")
            base, _, n = kind.partition("[")
            fields[name] = (base, int(n.rstrip("]"))) if n else base
        return Record(fields)

    @property
    def size(self) -> int:
        return self.dtype.itemsize

    @property
    def schema(self) -> T.StructType:
        out = T.StructType()
        for name, told in self.fields.items():
            kind, n = told if isinstance(told, tuple) else (told, None)
            element = T.BooleanType() if kind == "bool" else ELEMENT_TYPES[kind]
            out.add(name, element if n is None else T.ArrayType(element, False))
        return out

    def to_bytes(self, record: Column) -> Column:
        """The bytes of a struct column; null for a null struct or one with a null field. Arrays must have their fixed length."""
        dtype, fields = self.dtype, self.fields

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                out = np.zeros(len(b), dtype)
                there = np.ones(len(b), bool) if b.null_count == 0 else b.is_valid().to_numpy(zero_copy_only=False)
                for i, (name, told) in enumerate(fields.items()):
                    column = b.field(i)
                    there &= column.is_valid().to_numpy(zero_copy_only=False)
                    values = column.to_pylist()
                    zero = [0] * told[1] if isinstance(told, tuple) else 0
                    if isinstance(told, tuple) and any(v is not None and len(v) != told[1] for v in values):
                        raise ValueError(f"{name} needs {told[1]} values")
                    out[name] = np.array([zero if v is None else v if isinstance(told, tuple) else int(v) if told[0][0] in "iub" else float(v) for v in values], dtype[name].base)
                raw = out.tobytes()
                yield pa.array([raw[k * dtype.itemsize : (k + 1) * dtype.itemsize] if ok else None for k, ok in enumerate(there)], pa.binary())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "binary")(record)

    def from_bytes(self, raw: Column) -> Column:
        """The struct of a binary column; null stays null, bytes of another number are an error."""
        dtype, schema = self.dtype, self.schema
        from pyspark.sql.pandas.types import to_arrow_type

        shape = to_arrow_type(schema)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                rows = b.to_pylist()
                if any(r is not None and len(r) != dtype.itemsize for r in rows):
                    raise ValueError(f"a record has {dtype.itemsize} bytes")
                values = np.frombuffer(b"".join(bytes(dtype.itemsize) if r is None else r for r in rows), dtype)
                parts = [pa.array([int(v) for v in values[f.name]] if pa.types.is_decimal(f.type) else values[f.name].tolist() if not pa.types.is_boolean(f.type) else (values[f.name] != 0).tolist(), f.type) for f in shape]
                yield pa.StructArray.from_arrays(parts, fields=list(shape), mask=pa.array([r is None for r in rows]))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, schema.simpleString())(raw)
