"""A training corpus from documents: quality, near duplicates, decontamination, secrets, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents; ``run`` takes those five and no others. Texts that a stage changes get a new
n_chars. Null and empty texts stay and have no tokens; of repeated rows one stays, but all rows
without an id do; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard, quality, secrets
from tessera.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.3)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs, model, "__score").where(F.col("__score") >= 0.3).drop("__score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Near duplicates share 80 % or more of their shingles of five words.
    Of repeated rows (same id and text) one stays. Rows without an id cannot be named and stay.
    """
    groups = jaccard.join(docs.select("doc_id", "text"), width=5, percent=80)
    first = written(groups.where("doc_id = component_id").select("doc_id").distinct(), "pipeline-first")
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents of nothing else go."""
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    left = decontam.removed(found.where((hit == 0) | (hit < F.col("n_words"))))
    return resized(left.select(docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    ratios = secrets.train(secrets.samples(docs))
    return resized(secrets.redacted(secrets.scan(docs, ratios)).select(docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, how many, and digests of the ids and of the text they decode to."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("secrets", without_secrets), ("tokens", encoded)]

#: Trained models decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
