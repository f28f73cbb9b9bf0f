"""Cutting lineage, and numbering rows without a single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine (a test) that names none gets a temporary one."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder; what made them isn't run again when an executor is lost."""
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def quotient(a: Column, b: int) -> Column:
    """Integer division, rounded down, exact for all 64-bit numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b)).cast("long")


def numbered(df: DataFrame, first: str, *more: str, name: str = "n", parts: int = 256) -> DataFrame:
    """df and a number from 0 in the order of a numeric column and then others.

    Rows are parted at percentiles of the first column, counted by part, and numbered within their part
    from the part's offset: no task sorts more than a part, but where one value of ``first`` has more rows.
    """
    bounds = df.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], 100 * parts).alias("__bounds"))
    rows = df.join(F.broadcast(bounds)).withColumn("__part", F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(first))), F.lit(0))).drop("__bounds")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__c"))
    # One row a part: a few hundred at most.
    offsets = counts.select(F.col("__part").alias("__p"), (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__o"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(first, *more)) - 1
    return rows.withColumn("__w", within).join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("__o") + F.col("__w")).drop("__part", "__p", "__o", "__w")
