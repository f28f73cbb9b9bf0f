"""Dictionary encoding, lanes and sub-files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.cut import numbered, quotient


def dictionary(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, code): codes from 0 in the order of first appearance (position: a number). One row a distinct value, numbered part by part."""
    first = df.groupBy(F.col(value).alias("value")).agg(F.min(position).alias("first"))
    return numbered(first, "first", "value", name="code").select("value", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, value: str, position: str) -> DataFrame:
    """df and code. Spark broadcasts the dictionary if its measured size allows it."""
    d = dictionary(df, value, position).withColumnRenamed("value", "__v")
    return df.join(d, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def decode(codes: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    d = dictionary.withColumnRenamed("code", "__c")
    return codes.join(d, F.col(code) == F.col("__c"), "left").drop("__c")


def ratio(df: DataFrame, value: str) -> DataFrame:
    """n, distinct, raw and encoded bytes, ratio (1 if nothing is there) and whether encoding pays: one row.

    One pass by value, one over the distinct values.
    """
    by = df.groupBy(value).agg(F.count("*").alias("c")).select("c", F.octet_length(F.col(value)).cast("long").alias("b"))
    t = by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("distinct_values"), F.coalesce(F.sum(F.col("c") * F.col("b")), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("b"), F.lit(0)).alias("d"))
    t = t.withColumn("encoded_bytes", F.col("d") + 4 * F.col("n")).drop("d")
    t = t.withColumn("ratio", F.when(F.col("encoded_bytes") == 0, F.lit(1.0)).otherwise(F.col("raw_bytes") / F.col("encoded_bytes")))
    return t.withColumn("beneficial", (F.col("n") >= 4) & (F.col("distinct_values") / F.col("n") <= 0.75) & (F.col("ratio") > 1))


def lane(index: Column, lanes: int, seed: int = 0) -> Column:
    """A lane for each item by hash: the same for the same seed, of no even size."""
    return F.pmod(F.xxhash64(F.lit(seed), index), F.lit(lanes)).cast("int")


def even_lanes(df: DataFrame, index: str, lanes: int, seed: int = 0, parts: int = 1024) -> DataFrame:
    """df and lane: items in the order of their hashed lanes, cut anew so that sizes differ by one at most.

    A lane's items are ordered by a second hash first: they are counted and numbered in so many parts a lane, from offsets of the parts.
    """
    own = df.withColumn("__l", lane(F.col(index), lanes, seed)).withColumn("__s", lane(F.col(index), parts, seed + 1))
    totals = own.groupBy("__l", "__s").agg(F.count("*").alias("__n"))
    # One row a part of a lane.
    offsets = totals.select(F.col("__l").alias("__k"), F.col("__s").alias("__j"), (F.sum("__n").over(Window.orderBy("__l", "__s")) - F.col("__n")).alias("__o"), F.sum("__n").over(Window.partitionBy()).alias("__t"))
    at = F.row_number().over(Window.partitionBy("__l", "__s").orderBy(index)) - 1
    out = own.withColumn("__r", at).join(F.broadcast(offsets), (F.col("__l") == F.col("__k")) & (F.col("__s") == F.col("__j")))
    return out.withColumn("lane", F.call_function("div", (F.col("__o") + F.col("__r")) * lanes, F.col("__t")).cast("int")).drop("__l", "__s", "__r", "__k", "__j", "__o", "__t", "__n")


def lane_statistics(lanes: DataFrame, stored: str, whole: str, number: int) -> DataFrame:
    """lane, chunks, stored_bytes, whole_bytes of every lane (also of empty ones), and most and least, the largest and smallest number of chunks of a lane."""
    by = lanes.groupBy("lane").agg(F.count("*").alias("c"), F.sum(stored).alias("s"), F.sum(whole).alias("w"))
    every = lanes.sparkSession.range(number).select(F.col("id").cast("int").alias("lane")).join(by, "lane", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = every.select("lane", zero("c").alias("chunks"), zero("s").alias("stored_bytes"), zero("w").alias("whole_bytes"))
    ends = Window.partitionBy()  # one row a lane
    return rows.select("*", F.max("chunks").over(ends).alias("most"), F.min("chunks").over(ends).alias("least"))


def subfile(offset: Column, stripe: int, files: int) -> tuple[Column, Column]:
    """(sub-file, offset in it) of a logical offset in stripes dealt round."""
    block = quotient(offset, stripe)
    return F.pmod(block, F.lit(files)).cast("int"), (quotient(block, files) * stripe + F.pmod(offset, F.lit(stripe))).cast("long")


def subfile_range(offset: Column, length: Column, stripe: int) -> Column:
    """Array of the stripes that [offset, offset + length) touches."""
    return F.sequence(quotient(offset, stripe), quotient(offset + F.greatest(length, F.lit(1)) - 1, stripe))


def pieces(offset: Column, data: Column, stripe: int, files: int) -> Column:
    """What goes where when bytes are written at a logical offset: an array of (subfile, local_offset, piece), a piece a stripe. Empty data: an empty array."""
    def one(block: Column) -> Column:
        start = F.greatest(offset, block * stripe)
        end = F.least(offset + F.octet_length(data), (block + 1) * stripe)
        file, local = subfile(start, stripe, files)
        return F.struct(file.alias("subfile"), local.alias("local_offset"), F.substr(data, (start - offset + 1).cast("int"), (end - start).cast("int")).alias("piece"))

    return F.when(F.octet_length(data) > 0, F.transform(subfile_range(offset, F.octet_length(data).cast("long"), stripe), one)).otherwise(F.array().cast("array<struct<subfile:int,local_offset:bigint,piece:binary>>"))


def read_back(written: DataFrame, key: str) -> DataFrame:
    """(key, data): the pieces of each key joined in their order. written: key, part (the piece's number) and piece."""
    ordered = F.array_sort(F.collect_list(F.struct("part", F.hex("piece").alias("h"))))
    return written.groupBy(key).agg(F.unhex(F.array_join(F.transform(ordered, lambda s: s["h"]), "")).alias("data"))


def aligned(x: Column, line: int = 64) -> Column:
    return (quotient(x + (line - 1), line) * line).cast("long")
