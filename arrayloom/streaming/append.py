"""Growing arrays: append-only chunk files read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def tail(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """The chunk files of a folder and those that come; a bounded number of files each time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; run again to go on after it, without repeats."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Count and sum by key and window; rows later than the watermark are left out, so state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(stream: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Count and sum by key and each of the windows, a step apart, that hold the row's time."""
    w = F.window(time, width, step).alias("w")
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, value: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Count and sum of each session: a key's rows with less than the gap between neighbours. end: the last row's time and the gap."""
    w = F.session_window(time, gap).alias("w")
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def refreshed(spark: SparkSession, path: str, schema: T.StructType, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the files that are new, all files now): a reader that comes again sees what a writer has added. known: the files it saw, (path, length).

    A file that a writer is still at is one whose name begins with _ or ., which Spark doesn't list.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    new = files if known is None else files.join(known.select("path", "length"), ["path", "length"], "left_anti")
    paths = [r.path for r in new.collect()]  # the names of new files only
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows, files
