"""Markdown chunking without Python: sections by a look-ahead split, packing by folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.packing import pack, paragraph_pack

HEADER = r"^(#{1,6})[^\S\n]+([^\n]+)"
SECTION = "struct<title:string,level:int,start:int,end:int,content:string>"


def sections(text: Column) -> Column:
    """Header sections of a text: title, level, first and last line (from 1) and content, header line included.

    What stands before the first header is the section "Introduction" of level 0. A section of white
    space alone is left out. Headers inside fenced code count, as they do for the reference.
    """
    # the line break before a header parts sections and belongs to neither; only "\n" ends a line
    parts = F.split(text, r"(?U)\n(?=#{1,6}[^\S\n]+[^\n])", -1)
    start = F.struct(F.lit(1).alias("line"), F.array().cast(f"array<{SECTION}>").alias("out"))

    def add(a, p):
        last = a["line"] + X.newlines(p)
        title = F.trim(F.regexp_extract(p, f"(?U){HEADER}", 2))
        level = F.length(F.regexp_extract(p, f"(?U){HEADER}", 1)).cast("int")
        section = F.struct(F.when(level > 0, title).otherwise("Introduction").alias("title"), level.alias("level"), a["line"].alias("start"), last.alias("end"), p.alias("content"))
        return F.struct((last + 1).alias("line"), F.when(p.rlike(r"(?U)\S"), F.concat(a["out"], F.array(section))).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, start, add, lambda a: a["out"])


def chunks(docs: DataFrame, capacity: int, text: str = "text") -> DataFrame:
    """One row a chunk: the other columns, ordinal (from 0), text and the section metadata.

    Sections are packed to ``capacity``; one of over 1.5 capacities is split by paragraphs, each
    part carrying the whole section's lines. Blank texts have no chunks.
    """
    listed = docs.withColumn("__s", sections(F.col(text)))
    ranges = pack(F.transform("__s", lambda s: F.length(s["content"])), capacity, oversize=1.5)
    listed = listed.withColumn("__r", ranges)

    def whole(r):
        some = F.slice(F.col("__s"), r["first"], r["last"] - r["first"] + 1)
        one = F.get(some, F.lit(0))
        meta = F.struct(
            F.array_join(F.transform(some, lambda s: s["content"]), "\n\n").alias("text"),
            one["title"].alias("section_title"),
            one["level"].alias("section_level"),
            F.array_join(F.transform(some, lambda s: s["title"]), " > ").alias("section_hierarchy"),
            F.array_join(F.transform(some, lambda s: s["level"].cast("string")), ",").alias("header_levels"),
            one["start"].alias("start_line"),
            F.element_at(some, -1)["end"].alias("end_line"),
            F.lit(None).cast("boolean").alias("is_partial"),
        )
        parts = F.transform(
            paragraph_pack(X.paragraphs(one["content"]), capacity),
            lambda t: F.struct(
                t.alias("text"),
                one["title"].alias("section_title"),
                one["level"].alias("section_level"),
                one["title"].alias("section_hierarchy"),
                one["level"].cast("string").alias("header_levels"),
                one["start"].alias("start_line"),
                one["end"].alias("end_line"),
                F.lit(True).alias("is_partial"),
            ),
        )
        return F.when(r["split"], parts).otherwise(F.array(meta))

    rows = listed.select(*[c for c in docs.columns if c != text], F.posexplode(F.flatten(F.transform("__r", whole))).alias("ordinal", "__c"))
    flat = rows.select(*[c for c in docs.columns if c != text], "ordinal", "__c.*")
    return flat.withColumns(X.markdown(F.col("text")))
