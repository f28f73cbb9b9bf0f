"""Selections: all, none, hyperslabs and points, as predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.cut import quotient


@dataclass(frozen=True)
class Hyperslab:
    """Per axis the indexes start + b * stride + j with b < count and j < block."""

    start: Sequence[int]
    stride: Sequence[int]
    count: Sequence[int]
    block: Sequence[int]

    @staticmethod
    def slice(*ranges: tuple[int, int]) -> Hyperslab:
        ones = [1] * len(ranges)
        return Hyperslab([a for a, _ in ranges], ones, [max(0, b - a) for a, b in ranges], ones)

    def hull(self) -> list[tuple[int, int]]:
        """First and last index by axis; (0, -1) if an axis selects nothing."""
        return [(s, s + (c - 1) * t + b - 1) if c and b else (0, -1) for s, t, c, b in zip(self.start, self.stride, self.count, self.block, strict=True)]

    @property
    def shape(self) -> list[int]:
        return [c * b for c, b in zip(self.count, self.block, strict=True)]

    @property
    def size(self) -> int:
        return prod(self.shape)

    def overlaps(self) -> bool:
        return any(t < b and c > 1 for t, c, b in zip(self.stride, self.count, self.block, strict=True))


def predicate(axes: Sequence[Column], slab: Hyperslab) -> Column:
    """The hull as plain ranges, which Parquet can skip row groups by, and the stride's gaps."""
    parts = []
    for axis, (lo, hi), start, stride, block in zip(axes, slab.hull(), slab.start, slab.stride, slab.block, strict=True):
        parts.append(axis.between(lo, hi))
        if stride > block:
            parts.append(F.pmod(axis - start, F.lit(stride)) < block)
    return reduce(lambda a, b: a & b, parts)


def select(df: DataFrame, axes: Sequence[str], slab: Hyperslab) -> DataFrame:
    """The slab's rows. Where blocks overlap (stride < block) an element comes as often as it is selected."""
    rows = df.where(predicate([F.col(a) for a in axes], slab))
    if not slab.overlaps():
        return rows
    for axis, start, stride, count, block in zip(axes, slab.start, slab.stride, slab.count, slab.block, strict=True):
        # The blocks that cover i are those b with b * stride <= i - start < b * stride + block.
        first = F.greatest(F.lit(0), quotient(F.col(axis) - start - block, stride) + 1).cast("long")
        last = F.least(F.lit(count - 1), quotient(F.col(axis) - start, stride)).cast("long")
        rows = rows.withColumn("__b", F.explode(F.sequence(first, last))).drop("__b")
    return rows


def none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


#: Different indexes of an axis that are listed in a filter; more are given by their hull.
LISTED = 100


def points(df: DataFrame, axes: Sequence[str], coords: Sequence[Sequence[int]]) -> DataFrame:
    """pos, the axes and the columns of df for each point, in the order asked (sort by pos), repeats kept.

    A point outside the array gives nulls. The points are a literal list that is broadcast to the array, which is
    only filtered; what is found, at most a row a point, meets the list again.
    """
    shape = ", ".join(f"__{a} long" for a in axes)
    different = sorted({tuple(map(int, c)) for c in coords})
    asked = df.sparkSession.createDataFrame([(i, *map(int, c)) for i, c in enumerate(coords)], f"pos int, {shape}")
    rest = [c for c in df.columns if c not in axes]
    near = df
    for d, a in enumerate(axes):
        held = sorted({c[d] for c in different})
        near = near.where(F.col(a).isin(held) if len(held) <= LISTED else F.col(a).between(held[0], held[-1]))
    on = reduce(lambda a, b: a & b, [F.col(f"__{a}") == F.col(a) for a in axes])
    found = near.join(F.broadcast(df.sparkSession.createDataFrame(different, shape)), on).drop(*(f"__{a}" for a in axes))
    return asked.join(found, on, "left").select("pos", *(F.col(f"__{a}").alias(a) for a in axes), *rest)


def intersects_chunk(offsets: Sequence[Column], chunk: Sequence[int], slab: Hyperslab) -> Column:
    """Whether a chunk meets the slab's hull (strided gaps count as selected, as a superset test may)."""
    return reduce(lambda a, b: a & b, [(o <= hi) & (o + c > lo) for o, c, (lo, hi) in zip(offsets, chunk, slab.hull(), strict=True)])


def local_range(offset: Column, size: int, lo: int, hi: int) -> tuple[Column, Column]:
    """[from, to) of the hull within a chunk."""
    start = F.greatest(F.lit(lo), offset) - offset
    return start, F.greatest(start, F.least(F.lit(hi + 1), offset + size) - offset)


def write(df: DataFrame, axes: Sequence[str], value: str, new: DataFrame) -> DataFrame:
    """df with the values that new (axes, value) has in place of its own: a left join, null never overwrites."""
    fresh = new.select(*(F.col(a).alias(f"__{a}") for a in axes), F.col(value).alias("__new"))
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__{a}") for a in axes])
    return df.join(fresh, on, "left").select(*(F.coalesce("__new", c).alias(c) if c == value else c for c in df.columns))
