"""Facets and counts over the chunk and registry tables, each one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACETS = {"sources": "file_path", "languages": "language", "kinds": "kind", "chunk_types": "chunk_type"}


def facets(chunks: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(facet, value): the distinct non-empty values of each facet.

    One expansion and one grouped pass with map-side combining; rows, not arrays, so a facet may
    have any number of values.
    """
    columns = columns or FACETS
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in columns.items()])
    return chunks.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null and value <> ''").distinct()


def counts(chunks: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """(facet, value, n): rows by value of each column; a missing value counts as the given name or, with None, not at all."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("facet"), F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit(missing)).alias("value")) for c, missing in columns.items()]
    )
    return chunks.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


CHUNK_COUNTS: dict[str, str | None] = {"chunk_type": "unknown", "language": None, "kind": None, "doc_type": None}


def per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count("*").alias("chunk_count"))


def documents(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))
