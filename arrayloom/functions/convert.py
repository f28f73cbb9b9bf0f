"""Typed reads as column expressions; where a conversion wraps, arithmetic does it (ANSI casts raise)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_f64(c: Column) -> Column:
    return c.cast("double")


def as_f32(c: Column) -> Column:
    return c.cast("float")


def wrap_signed(c: Column, bits: int = 32) -> Column:
    """The low ``bits`` bits of an integer as a signed number."""
    half, whole = F.lit(1 << (bits - 1)).cast("long"), F.lit(1 << bits).cast("long")
    return F.pmod(c + half, whole) - half


def as_i64(c: Column, element: str) -> Column:
    """A stored integer as a signed 64-bit number: its bytes are sign-extended by their width, also where the type is unsigned (u8 255 is -1). Floats are refused."""
    if element not in RANK or element[0] == "f":
        raise ValueError(f"{element} can't be read as i64")
    if element == "u64":
        d, whole = c.cast("decimal(20,0)"), F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
        return F.when(d >= F.lit(Decimal(1 << 63)).cast("decimal(20,0)"), d - whole).otherwise(d).cast("bigint")
    return wrap_signed(c.cast("bigint"), 8 * RANK[element]) if element[0] == "u" else c.cast("bigint")


def region_reference(raw: Column, size: int) -> Column:
    """Region references from the bytes of a dataset: an array of so many bytes each, as they are. Bytes that don't fill the last one are an error."""
    n = F.octet_length(raw)
    whole = F.when(F.pmod(n, F.lit(size)) != 0, F.raise_error(F.lit(f"the bytes are no multiple of {size}"))).otherwise(F.call_function("div", n, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<binary>")).when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: F.substr(raw, ((i - 1) * size + 1).cast("int"), F.lit(size))))


def zero_extend(c: Column, width: int) -> Column:
    """The unsigned value of a number's ``width`` low bytes. 8 bytes need decimal(20,0)."""
    if width == 8:
        d = c.cast("decimal(20,0)")
        return F.when(c < 0, d + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")
    return F.pmod(c, F.lit(1 << (8 * width)).cast("long"))


def byte_swap(raw: Column, size: int) -> Column:
    """The bytes of elements of so many bytes each, every element's the other way round."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = b.to_pylist()
            if any(r is not None and len(r) % size for r in rows):
                raise ValueError(f"the bytes are no multiple of {size}")
            yield pa.array([None if r is None else np.frombuffer(r, np.uint8).reshape(-1, size)[:, ::-1].tobytes() for r in rows], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(raw)


def fixed_string(c: Column, padding: str) -> Column:
    """null_term: up to the first zero; null_pad: without zeros at the end; space_pad: without spaces at the end."""
    if padding == "null_term":
        return F.substring_index(c, "\0", 1)
    return F.rtrim(c, F.lit({"null_pad": "\0", "space_pad": " "}[padding]))


def enum_name(raw: Column, names: Mapping[object, str], storage_hex: Column) -> Column:
    """The value's name, or UNKNOWN(0x..) with the stored bytes in lower-case hexadecimal."""
    known = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, raw), F.concat(F.lit("UNKNOWN(0x"), F.lower(storage_hex), F.lit(")")))


def null_reference(address: Column, width: int = 8) -> Column:
    """Null where an object reference is all ones."""
    nothing = F.lit(-1) if width == 8 else F.lit((1 << (8 * width)) - 1)
    return F.when(address != nothing, address)


RANK = {"u8": 1, "i8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "i64": 8, "u64": 8, "f32": 4, "f64": 8}


def conversion_cost(source: str, target: str) -> str:
    """None, Widening, Narrowing or Lossy, by what the target can hold."""
    if source == target:
        return "None"
    a, b = RANK[source], RANK[target]
    if source[0] == "f":
        return ("Widening" if b > a else "Narrowing") if target[0] == "f" else "Lossy"
    if target[0] == "f":
        return "Widening" if a <= 4 else "Narrowing"
    return "Widening" if b > a else "Narrowing"
