"""Access patterns: sweeps, predictions, cache statistics and replays of caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def steps(df: DataFrame, group: Sequence[str], order: str, axes: Sequence[str]) -> DataFrame:
    """df and step_<axis>: the difference to the group's access before (null at its first)."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.select("*", *((F.col(a) - F.lag(a).over(w)).alias(f"step_{a}") for a in axes))


def sweep(df: DataFrame, group: Sequence[str], order: str, axes: Sequence[str]) -> DataFrame:
    """The group and pattern of its accesses: RowMajor, ColumnMajor, SliceMajor(d), Random, or null under three.

    The fastest axis must change in at least half of the steps and twice as often as the next; among equals
    the last axis is the fastest. One axis only: RowMajor.
    """
    moved = steps(df, group, order, axes)
    changed = [F.sum(F.coalesce((F.col(f"step_{a}") != 0).cast("int"), F.lit(0))).alias(f"c{d}") for d, a in enumerate(axes)]
    g = moved.groupBy(*group).agg(F.count("*").alias("n"), *changed)
    last = len(axes) - 1
    most = F.greatest(*(F.col(f"c{d}") for d in range(len(axes)))) if last else F.col("c0")
    fastest = reduce(lambda rest, d: F.when(F.col(f"c{d}") == most, F.lit(d)).otherwise(rest), range(len(axes)), F.lit(last))
    g = g.withColumn("fastest", fastest).withColumn("most", most)
    second = F.greatest(F.lit(0), *(F.when(F.col("fastest") == d, F.lit(0)).otherwise(F.col(f"c{d}")) for d in range(len(axes))))
    clear = (F.col("most") > 0) & (2 * F.col("most") >= F.col("n")) & (F.col("most") >= 2 * second)
    name = F.when(F.col("fastest") == last, F.lit("RowMajor")).when(F.col("fastest") == 0, F.lit("ColumnMajor")).otherwise(F.concat(F.lit("SliceMajor("), F.col("fastest").cast("string"), F.lit(")")))
    return g.select(*group, F.when(F.col("n") < 3, F.lit(None)).when(clear, name).otherwise(F.lit("Random")).alias("pattern"))


def predict(df: DataFrame, group: Sequence[str], order: str, axis: str, ahead: int) -> DataFrame:
    """The next ``ahead`` indexes of each group: the last one and the mean of its non-zero steps, truncated; none below 0."""
    moved = steps(df, group, order, [axis])
    step = F.when(F.col(f"step_{axis}") != 0, F.col(f"step_{axis}"))
    g = moved.groupBy(*group).agg(F.max_by(axis, order).alias("last"), F.avg(step).alias("mean"))
    g = g.withColumn("by", F.coalesce(F.col("mean").cast("long"), F.lit(0)))
    g = g.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    return g.select(*group, "k", (F.col("last") + F.col("k") * F.col("by")).alias("next")).where((F.col("next") >= 0))


def sequential(df: DataFrame, group: Sequence[str], order: str, axes: Sequence[str]) -> DataFrame:
    """One row: accesses that follow their predecessor by at most one step on one axis, and the others."""
    moved = steps(df, group, order, axes)
    far = reduce(lambda a, b: a + b, [F.abs(F.col(f"step_{a}")) for a in axes])
    return moved.agg(F.count_if(far <= 1).alias("sequential"), F.count_if(F.coalesce(far > 1, F.lit(True))).alias("random"))


#: Accesses that the sliding detector sees, chunks it names ahead; bytes and slots of a chunk cache, bytes of a metadata cache and of an entry beside its data.
SEEN, AHEAD = 12, 4
CACHE_BYTES, CACHE_SLOTS, METADATA_BYTES, ENTRY_BYTES = 16 << 20, 521, 2 << 20, 64


def sliding(df: DataFrame, group: Sequence[str], order: str, axes: Sequence[str], seen: int = SEEN, ahead: int = AHEAD) -> DataFrame:
    """df and, after each access, pattern (as :func:`sweep` names it) of the last ``seen`` accesses and next: the indexes of the axis that moves, of the chunks to fetch ahead.

    pattern is Random, and next empty, for fewer than three accesses. The moving axis steps by the mean of its non-zero steps, truncated; nothing below 0 is fetched.
    """
    last = len(axes) - 1
    every = Window.partitionBy(*group).orderBy(order)
    # A window of n accesses holds n - 1 steps: the step to its first access isn't among them.
    over = every.rowsBetween(-(seen - 2), 0)
    moved = df.select("*", *((F.col(a) - F.lag(a).over(every)).alias(f"__s{d}") for d, a in enumerate(axes)))
    step = lambda d: F.when(F.col(f"__s{d}") != 0, F.col(f"__s{d}"))
    rows = moved.select("*", F.count("*").over(every.rowsBetween(-(seen - 1), 0)).alias("__n"), *(F.count(step(d)).over(over).alias(f"__c{d}") for d in range(len(axes))), *(F.avg(step(d)).over(over).alias(f"__m{d}") for d in range(len(axes))))
    count = lambda d: F.col(f"__c{d}")
    most = F.greatest(*(count(d) for d in range(len(axes)))) if last else count(0)
    rows = rows.withColumn("__most", most)
    rows = rows.withColumn("__fast", reduce(lambda rest, d: F.when(count(d) == F.col("__most"), F.lit(d)).otherwise(rest), range(len(axes)), F.lit(last)))
    second = F.greatest(F.lit(0), F.lit(0), *(F.when(F.col("__fast") == d, F.lit(0)).otherwise(count(d)) for d in range(len(axes))))
    clear = (F.col("__n") >= 3) & (F.col("__most") > 0) & (2 * F.col("__most") >= F.col("__n")) & (F.col("__most") >= 2 * second)
    name = F.when(F.col("__fast") == last, F.lit("RowMajor")).when(F.col("__fast") == 0, F.lit("ColumnMajor")).otherwise(F.concat(F.lit("SliceMajor("), F.col("__fast").cast("string"), F.lit(")")))
    at = reduce(lambda rest, d: F.when(F.col("__fast") == d, F.col(axes[d])).otherwise(rest), range(last), F.col(axes[last]))
    by = reduce(lambda rest, d: F.when(F.col("__fast") == d, F.col(f"__m{d}")).otherwise(rest), range(last), F.col(f"__m{last}")).cast("bigint")
    after = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda k: at + k * by), lambda x: x >= 0)
    return rows.select(*df.columns, F.when(clear, name).otherwise(F.lit("Random")).alias("pattern"), F.when(clear, after).otherwise(F.array().cast("array<bigint>")).alias("next"))


def replay(df: DataFrame, group: Sequence[str], order: str, key: Sequence[str], size: str, capacity: int = CACHE_BYTES, slots: int | None = CACHE_SLOTS, entry: int = 0) -> DataFrame:
    """The group and hits, misses, evictions, bytes_hit, hit_rate (0 without accesses) of a cache that drops what was used longest ago.

    Every access asks for a key and puts it in if it isn't there; what is larger than the cache isn't put in. entry: bytes that an entry
    takes beside its size. slots: entries at most (null: any number). A group's accesses are replayed in their order in a stream of sorted rows: memory is the cache's, not the group's.
    """
    names = [*group, *key]
    rows = df.select(*names, F.col(order).alias("__o"), F.col(size).cast("long").alias("__size"))
    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*group).schema), "hits long, misses long, evictions long, bytes_hit long, hit_rate double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, used, count = None, OrderedDict(), 0, [0, 0, 0, 0]
        out = []

        def told() -> tuple:
            return (*now, *count, count[0] / (count[0] + count[1]))

        for b in batches:
            for r in b.itertuples(index=False):
                who, what, n = tuple(None if x != x else x for x in r[: len(group)]), tuple(r[len(group) : len(names)]), int(r[-1])
                if who != now:
                    if now is not None:
                        out.append(told())
                    now, held, used, count = who, OrderedDict(), 0, [0, 0, 0, 0]
                if what in held:
                    held.move_to_end(what)
                    count[0] += 1
                    count[3] += held[what]
                    continue
                count[1] += 1
                if n + entry > capacity:
                    continue
                while held and (used + n + entry > capacity or (slots is not None and len(held) >= slots)):
                    used -= held.popitem(last=False)[1] + entry
                    count[2] += 1
                held[what] = n
                used += n + entry
            if out:
                yield pd.DataFrame(out, columns=[*group, "hits", "misses", "evictions", "bytes_hit", "hit_rate"])
                out = []
        if now is not None:
            yield pd.DataFrame([told()], columns=[*group, "hits", "misses", "evictions", "bytes_hit", "hit_rate"])

    ordered = rows.repartition(*group).sortWithinPartitions(*group, "__o").select(*names, "__size")
    return ordered.mapInPandas(run, shape)


def profile(reads: DataFrame, stored: str, whole: str, hit: str) -> DataFrame:
    """One row: reads, bytes_read, decompressed bytes, hits, misses, compression_ratio and hit_rate (0 if nothing was read).

    reads: stored and whole bytes of each chunk asked for, and whether a cache had it; a hit reads and decompresses nothing.
    """
    missed = lambda c: F.coalesce(F.sum(F.when(~F.col(hit), F.col(c))), F.lit(0))
    g = reads.agg(F.count_if(~F.col(hit)).alias("reads"), missed(stored).alias("bytes_read"), missed(whole).alias("bytes_decompressed"), F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return g.select("*", ratio(F.col("bytes_decompressed"), F.col("bytes_read")).alias("compression_ratio"), ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"))
