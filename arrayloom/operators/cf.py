"""Climate conventions: packed values, missing values, dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Double precision's epsilon: a value this near to the sentinel is the sentinel.
EPSILON = 2.220446049250313e-16


def is_missing(v: Column, *sentinels: float | None) -> Column:
    """Whether a value is one of the sentinels (null sentinels are none); NaN is the sentinel NaN."""
    out = F.lit(False)
    for s in sentinels:
        if s is not None:
            out = out | (F.isnan(v) if s != s else F.abs(v - F.lit(float(s))) < EPSILON)
    return out


def unpack(v: Column, scale: float | None = None, offset: float | None = None, fill: float | None = None, missing: float | None = None, mask_always: bool = False) -> Column:
    """v * scale + offset, missing values as NaN. Without scale and offset values stay as they are, sentinels too, unless mask_always."""
    x = v.cast("double")
    packed = scale is not None or offset is not None
    y = x * F.lit(float(1 if scale is None else scale)) + F.lit(float(0 if offset is None else offset)) if packed else x
    return F.when(is_missing(x, fill, missing), F.lit(float("nan"))).otherwise(y) if packed or mask_always else y


def in_range(v: Column, low: float, high: float) -> Column:
    return v.between(low, high)


def dimensions(scales: DataFrame) -> DataFrame:
    """Dimension scales in the order of their dimension ids, those without one last. scales: name, size, dimid."""
    return scales.orderBy(F.col("dimid").asc_nulls_last(), "name")


def match_dimensions(shape: Sequence[int], known: Sequence[tuple[str, int]], given: Sequence[str] | None = None) -> list[str]:
    """A name for each axis: given ones, else the first unused dimension of that size, else dim_<size>."""
    if given is not None:
        return list(given)
    left, out = list(known), []
    for n in shape:
        found = next((d for d in left if d[1] == n), None)
        out.append(found[0] if found else f"dim_{n}")
        if found:
            left.remove(found)
    return out


def is_coordinate(name: str, dims: Sequence[str]) -> bool:
    return len(dims) == 1 and dims[0] == name


def with_coordinates(df: DataFrame, axis: str, coordinate: DataFrame, name: str) -> DataFrame:
    """df and the coordinate's value at each axis index. coordinate: i0, value."""
    c = coordinate.select(F.col("i0").alias("__i"), F.col("value").alias(name))
    return df.join(c, F.col(axis) == F.col("__i"), "left").drop("__i")
