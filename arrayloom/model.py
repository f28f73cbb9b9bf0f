"""Array layouts as DataFrames.

long:   one row an element, axes i0, i1, ... (bigint) and value
chunk:  one row a chunk, chunk coordinates c0, c1, ... and its elements in row-major order
vector: one row a vector, id and array<float>
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayloom.cut import quotient

# Element types of the container and the Spark types that hold all their values.
ELEMENT_TYPES: dict[str, T.DataType] = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(),
    "opaque": T.BinaryType(), "bitfield": T.BinaryType(), "time": T.BinaryType(), "reference": T.LongType(),
}


def strides(dims: Sequence[int]) -> list[int]:
    """Row-major strides in elements: the last axis varies fastest."""
    return [prod(dims[d + 1 :]) for d in range(len(dims))]


def linear_index(axes: Sequence[Column], dims: Sequence[int]) -> Column:
    """Row-major place of an element; the sort key that restores an array's order."""
    total = F.lit(0).cast("long")
    for axis, step in zip(axes, strides(dims), strict=True):
        total = total + axis * F.lit(step).cast("long")
    return total


def vectors_to_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """i0, i1, value of vectors seen as a two-dimensional array. No shuffle."""
    return df.select(F.col(id_col).cast("long").alias("i0"), F.posexplode(vec_col).alias("p", "value")).select("i0", F.col("p").cast("long").alias("i1"), "value")


def long_to_vectors(df: DataFrame) -> DataFrame:
    """The vectors again, components in the order of i1. One shuffle, by i0."""
    ordered = F.array_sort(F.collect_list(F.struct("i1", "value")))
    return df.groupBy("i0").agg(F.transform(ordered, lambda s: s["value"]).alias("values"))


def chunk_of(axis: Column, size: int) -> Column:
    return quotient(axis, size)


def split_chunks(df: DataFrame, axes: Sequence[str], value: str, chunk: Sequence[int], fill: object = 0) -> DataFrame:
    """Chunk rows: c0.., payload, n (elements that exist). Edge chunks are filled up with ``fill``.

    A chunk's rows meet by its coordinates: groups are as large as a chunk, never as an axis.
    """
    coords = [chunk_of(F.col(a), s).alias(f"c{d}") for d, (a, s) in enumerate(zip(axes, chunk, strict=True))]
    inner = linear_index([F.pmod(F.col(a), F.lit(s)) for a, s in zip(axes, chunk, strict=True)], chunk).cast("int")
    rows = df.select(*coords, inner.alias("at"), F.col(value).alias("v"))
    kind = df.schema[value].dataType.simpleString()
    size = prod(chunk)
    grouped = rows.groupBy(*(f"c{d}" for d in range(len(axes)))).agg(F.collect_list(F.struct("at", "v")).alias("there"), F.count("*").alias("n"))
    gaps = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.transform("there", lambda s: s["at"]))
    filled = F.concat("there", F.transform(gaps, lambda i: F.struct(i.alias("at"), F.lit(fill).cast(kind).alias("v"))))
    payload = F.transform(F.array_sort(filled), lambda s: s["v"])
    return grouped.select(*(f"c{d}" for d in range(len(axes))), payload.alias("payload"), "n")


def assemble_chunks(df: DataFrame, chunk: Sequence[int], dims: Sequence[int]) -> DataFrame:
    """i0.., value from chunk rows; what lies beyond ``dims`` (edge filling) is left out. No shuffle."""
    steps = strides(chunk)
    rows = df.select(*(f"c{d}" for d in range(len(chunk))), F.posexplode("payload").alias("at", "value"))
    axes = [(F.col(f"c{d}") * s + F.pmod(quotient(F.col("at"), steps[d]), F.lit(s))).cast("long") for d, s in enumerate(chunk)]
    out = rows.select(*(a.alias(f"i{d}") for d, a in enumerate(axes)), "value")
    for d, n in enumerate(dims):
        out = out.where(F.col(f"i{d}") < n)
    return out


def implicit_chunks(spark, base: int, dims: Sequence[int], chunk: Sequence[int], element_size: int) -> DataFrame:
    """c0.., offset0.., address of all chunks of an array whose chunks lie one after another."""
    counts = [-(-n // c) for n, c in zip(dims, chunk, strict=True)]
    step = strides(counts)
    df = spark.range(prod(counts))
    coord = [F.pmod(quotient(F.col("id"), step[d]), F.lit(counts[d])).cast("long") for d in range(len(dims))]
    return df.select(*(c.alias(f"c{d}") for d, c in enumerate(coord)), *((c * chunk[d]).alias(f"offset{d}") for d, c in enumerate(coord)), (F.lit(base) + F.col("id") * prod(chunk) * element_size).alias("address"))
