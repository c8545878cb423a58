"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chat, decontam, jaccard, quality, secrets, suffixes, toxicity, warc
from tessera.llm.common import fold_bucket, table
from tessera.llm.oracles import ORACLES


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return judged(toxicity.score(docs, net), 3, 1, 0.7)


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.rotate(table(spark, sf_dir, "conversations")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.round_trip(table(spark, sf_dir, "pages")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.scan(docs, secrets.train(secrets.samples(docs))))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.report(suffixes.cleaned(suffixes.removed_spans(docs)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return judged(quality.score(docs, model), 5, 0, 0.3)


def judged(scored: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    """The contract's columns of a classifier."""
    return scored.select(
        "doc_id",
        F.coalesce(fold_bucket("doc_id", modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(decontam.scan(docs, table(spark, sf_dir, "benchmark")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_perspectives": op2_perspectives,
    "op3_suffixes": op3_suffixes,
    "op4_bpe": op4_bpe,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_jaccard": op9_jaccard,
    "op10_secrets": op10_secrets,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
