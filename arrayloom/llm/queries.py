"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import audio, language, licences, line_dedup, lm, minhash, mixing, pieces, topk, url_filter
from arrayloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors.where(F.pmod("vec_id", F.lit(50)) == 0), vectors)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.described(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.decide(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs), keep=["doc_id"]).select("doc_id", "n_tokens", "log_prob", "mean_log_prob", (F.col("n_alone") / F.greatest("n_tokens", F.lit(1))).alias("alone_share"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "digest", "licence", "notices")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_tokens", "tokens", F.col("decoded").eqNullSafe(F.col("text")).alias("restored"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_topk, op3_minhash_dedup, op4_language_id, op5_telephony_audio, op6_source_mixing, op7_pseudo_likelihood, op8_licence_scan, op9_sentencepiece, op10_url_filter)}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_exact_topk": topk.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op8_licence_scan": licences.oracle(),
    "op10_url_filter": url_filter.ORACLE,
}
