"""Markdown counts, lines and hashes. Patterns use Unicode classes, as the reference's do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"```[\s\S]*?```"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"
BOX = r"(?m)^[ \t]*- \[([ xX])\] "
CHECKED = r"(?m)^[ \t]*- \[[xX]\] "
TABLE_RULE = r"(?m)^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*$"


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def words(text: Column) -> Column:
    """How many words white space parts the text into."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("int")


def paragraphs(text: Column) -> Column:
    return F.split(text, r"(?U)\n\s*\n", -1)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_span(full: Column, chunk: Column) -> Column:
    """(start_line, end_line), from 1, of a chunk's first occurrence; (1, 1) where there is none."""
    at = F.position(chunk, full)
    start = newlines(full.substr(F.lit(1), at - 1)) + 1
    found = at > 0
    return F.struct(
        F.when(found, start).otherwise(1).cast("int").alias("start_line"),
        F.when(found, start + newlines(chunk)).otherwise(1).cast("int").alias("end_line"),
    )


def markdown(text: Column) -> dict[str, Column]:
    """The rich metadata of a Markdown chunk, by column name."""
    boxes, checked = occurrences(text, BOX), occurrences(text, CHECKED)
    counts = {
        "code_block_count": occurrences(text, FENCED),
        "checkbox_count": boxes,
        "link_count": occurrences(text, LINK),
        "image_count": occurrences(text, IMAGE),
        "table_count": occurrences(text, TABLE_RULE),
    }
    flags = {
        "has_code_blocks": counts["code_block_count"] > 0,
        "has_checkboxes": boxes > 0,
        "has_links": counts["link_count"] > 0,
        "has_images": counts["image_count"] > 0,
        "has_tables": counts["table_count"] > 0,
    }
    return {"word_count": words(text), **counts, "checked_count": checked, "unchecked_count": boxes - checked, **flags}


def path_id(path: Column) -> Column:
    return F.sha2(path, 256)


def content_hash(content: Column) -> Column:
    """The first 16 hexadecimal digits of the content's SHA-256; empty where it cannot be read."""
    return F.coalesce(F.substring(F.sha2(content, 256), 1, 16), F.lit(""))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
