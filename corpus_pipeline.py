"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, SentencePiece tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import language, line_dedup, minhash, mixing, pieces
from arrayloom.llm.common import checkpointed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell; rejected ones go. The text isn't changed."""
    told = language.identify(docs.select(F.struct("*").alias("row"), F.col("text")), language.learn(docs))
    return told.where(~F.col("rejected")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents hold."""
    return line_dedup.dedup_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and tokens of every document."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "n_tokens", "tokens")


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
