"""Batches between the JVM and Python whose memory does not grow with the table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

#: Of an Arrow batch to a Python worker; Spark's own default allows 64 MiB, of which parsing makes many copies.
BATCH_BYTES = "4m"
#: Characters of text that a worker gathers before it hands rows back.
OUT_CHARS = 2 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, which from now on sends texts to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def pieces(rows: Iterable[dict], text: str = "text", chars: int = OUT_CHARS) -> Iterator[list[dict]]:
    """Rows in order, in lists of about ``chars`` characters of ``text``; no list is empty."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row.get(text) or "") + 100  # the other columns
        if held > chars:
            yield some
            some, held = [], 0
    if some:
        yield some
