"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"

#: Rows and bytes of an Arrow batch handed to Python; a batch of very long texts stays small.
BATCH_ROWS = 250
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that Python memory doesn't follow the text length.

    Spark has only session settings for that. They are the same for all operators, and a smaller one of the user's own stays.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(name)).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on one machine (a test) that names none gets a temporary one."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder; it goes when the application ends.

    A table rather than checkpoint(): it is columnar and compressed, and its plan carries no
    constraints of the plan that made it, which grow without bound in a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`checkpointed` has made and that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(t._cut_at)
        place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """All input columns as one struct ``__row`` next to the named working columns, so that no name can clash."""
    return df.select(F.struct("*").alias("__row"), *(c.alias(k) for k, c in named.items()))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The struct's columns again, then the new ones; a new column replaces an input column of its name."""
    taken = {k.lower() for k in new}
    kept = [F.col("__row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *(c.alias(k) for k, c in new.items()))


def replaced(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The struct's columns in their order, with the named ones replaced."""
    by = {k.lower(): c for k, c in new.items()}
    return df.select(*(by.get(c.lower(), F.col("__row").getField(c)).alias(c) for c in columns))


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def sized(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Marked for broadcast if it has at most so many (narrow) rows; else as it is, and Spark joins by shuffling. df: cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key that meet in one task at least; a thousandth of all rows if that is more.
PART = 1000


def spread(rows: DataFrame, few: DataFrame, key: str, counts: DataFrame, total: int, salt: Column, how: str = "inner") -> DataFrame:
    """rows with their row of few by key; the rows of a frequent key meet it in parts, so that no key fills a task.

    few: one row a key at most. counts: (key, __n), the rows of (at least the frequent) keys. total: all rows. salt: a value that differs between rows of a key.
    At most some thousand keys are that frequent; they are counted before they are sent.
    """
    part = max(PART, total // 1000)
    hot = checkpointed(counts.where(F.col("__n") > part).select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / part).cast("int").alias("__parts")))
    if not hot.limit(1).count():
        return rows.join(few, key, how)
    hot = sized(hot)
    rows = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("__parts")).cast("int"), F.lit(0))).drop("__hot", "__parts")
    few = few.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop("__hot", "__parts")
    return rows.join(few, [key, "__salt"], how).drop("__salt")


def below(h: Column, wanted: int, total: int | Column) -> Column:
    """Whether a 64-bit hash is so small that about ``wanted`` of ``total`` rows are: a sample whose tasks all send little, whatever their number."""
    total = F.lit(total) if isinstance(total, int) else total
    return (h.cast("double") + float(1 << 63)) / float(1 << 64) <= F.lit(float(wanted)) / F.greatest(total, F.lit(1))
