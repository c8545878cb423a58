"""Filters and exact cosine top-k over the chunk table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import MOST_K, TOP_K

FIELDS = (("sources", "file_path"), ("languages", "language"), ("kinds", "kind"), ("chunk_types", "chunk_type"))


def merged_filters(filters: dict | None = None, language_filter: str | None = None, kind_filter: str | None = None, file_path_filter: str | None = None) -> dict:
    """Older arguments joined to the filters: language and kind are added, a path only if there is none."""
    out = dict(filters or {})
    for name, value in (("languages", language_filter), ("kinds", kind_filter)):
        if value:
            out[name] = [*out.get(name, []), value]
    if file_path_filter and not out.get("file_path_contains"):
        out["file_path_contains"] = file_path_filter
    return out


def predicate(filters: dict | None) -> Column | None:
    """All filters joined by AND; empty lists, empty text and 0 mean no filter; None without any.

    Rows that lack a filtered field do not match.
    """
    found = filters or {}
    parts = [F.col(column) == found[name][0] if len(found[name]) == 1 else F.col(column).isin(list(found[name])) for name, column in FIELDS if found.get(name)]
    if found.get("line_min"):
        parts.append(F.col("start_line") >= found["line_min"])
    if found.get("line_max"):
        parts.append(F.col("end_line") <= found["line_max"])
    if found.get("must_contain"):
        parts.append(F.contains("document", F.lit(found["must_contain"])))
    if found.get("file_path_contains"):
        parts.append(F.contains("file_path", F.lit(found["file_path_contains"])))
    return reduce(lambda a, b: a & b, parts) if parts else None


def unknown_sources(chunks: DataFrame, requested: list[str]) -> DataFrame:
    """Requested sources that no chunk has."""
    asked = chunks.sparkSession.createDataFrame([(s,) for s in requested], "file_path string")
    return asked.join(chunks.select("file_path").distinct(), "file_path", "left_anti")


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity in double precision; null for a zero vector or another length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(vector) == len(query)) & (norm > 0) & F.lit(length > 0), dot / (norm * length))


def top_k(chunks: DataFrame, query: list[float], k: int | None = None, filters: dict | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The nearest chunks with their score (rounded to 4 places), ties by id; k from 1 to 20, 6 by default."""
    k = max(1, min(k or TOP_K, MOST_K))
    where = predicate(filters)
    rows = chunks if where is None else chunks.where(where)
    scored = rows.withColumn("__s", cosine(F.col(vector), query)).where("__s is not null")
    best = scored.orderBy(F.desc("__s"), key).limit(k)
    return best.withColumn("score", F.round("__s", 4)).drop("__s", vector)
