"""The semantic header that precedes a chunk's text before embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.symbols import short_enclosing, shortened


def filled(c: Column) -> Column:
    """Null for empty text: absent and empty are alike in headers."""
    return F.when(c != "", c)


def labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), filled(value))


def code_header(c=F.col) -> Column:
    summary = F.trim(F.substring_index(c("documentation"), "\n", 1))
    lines = (
        ("// File     : ", c("file_name")),
        ("// Language : ", c("language")),
        ("// Symbol   : ", c("display_name")),
        ("// Kind     : ", c("kind")),
        ("// In       : ", short_enclosing(c("enclosing"))),
        ("// Summary  : ", summary),
        ("// Calls    : ", shortened(c("callees"))),
        ("// Called by: ", shortened(c("callers"))),
    )
    return F.concat_ws("\n", *[labelled(a, b) for a, b in lines])


def document_header(c=F.col) -> Column:
    level = F.coalesce(c("section_level"), F.lit(1))
    section = F.when(filled(c("section_title")).isNotNull(), F.concat(F.lit("[Section: "), F.repeat(F.lit("#"), level), F.lit(" "), c("section_title"), F.lit("]")))
    part = lambda name, value: F.concat(F.lit(f"[{name}: "), filled(value), F.lit("]"))
    return F.concat_ws(" ", part("Document", c("file_name")), part("Type", c("doc_type")), section)


def structured_header(c=F.col) -> Column:
    return F.concat_ws("\n", labelled("// File: ", c("file_name")), labelled("// JSON Path: ", c("json_path")), labelled("// XML Path: ", c("xml_path")))


def embed_text(text: Column, chunk_type: Column, c=F.col) -> Column:
    """Header by chunk type, a blank line, the text; runs of blank lines become one. Split types get no header."""
    header = F.when(chunk_type == "code", code_header(c)).when(chunk_type == "document", document_header(c)).when(chunk_type == "structured", structured_header(c)).otherwise(F.lit(""))
    return F.regexp_replace(F.concat_ws("\n\n", filled(header), text), r"\n{3,}", "\n\n")
