"""Benchmark decontamination with one Aho-Corasick automaton (operator 7).

Text is normalised byte-wise: A-Z become lower case and every other ASCII character that is no
digit or letter becomes a space, so that words are runs of digits, letters and non-ASCII bytes.
An item's patterns are all its windows of ``width`` consecutive words (the whole item if it has
fewer). One automaton over all patterns scans each normalised text once; hits are mapped back to
word numbers and to offsets in the original text.

The automaton is sized by the benchmark, whose text is measured first. Beyond
``automaton_bytes`` of it the items are dealt into several automata that scan in turn, so no
worker holds more than a bounded automaton and no item is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, once, with_text

# What is lowered, kept and turned to a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
SPANS = "array<struct<first:int,last:int,start:int,end:int>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """All windows of all items; each pattern stands between spaces, so only whole words match."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.machine = ahocorasick.Automaton()
        owners: dict[str, set[str]] = {}
        lengths: dict[str, int] = {}
        for item, text in items:
            found = words(text)
            for k in range(max(len(found) - width + 1, 1 if found else 0)):
                window = found[k : k + width]
                pattern = " " + b" ".join(window).decode("latin-1") + " "
                owners.setdefault(pattern, set()).add(item)
                lengths[pattern] = len(window)
        for pattern, who in owners.items():
            self.machine.add_word(pattern, (lengths[pattern], tuple(sorted(i for i in who if i is not None))))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs as (first, last) word, items that occur."""
        found = text.translate(FOLD).split()
        if self.empty or not found:
            return len(found), [], set()
        line = " " + b" ".join(found).decode("latin-1") + " "
        hits = list(self.machine.iter(line))
        if not hits:
            return len(found), [], set()
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        lasts = np.searchsorted(spaces, [end for end, _ in hits]) - 1
        items: set[str] = set()
        for _, (_, who) in hits:
            items.update(who)
        return len(found), merged([(int(b) - n + 1, int(b)) for b, (_, (n, _)) in zip(lasts, hits, strict=True)]), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of inclusive runs, in order; touching runs become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of words."""
    raw = np.frombuffer(text, np.uint8)
    kept = np.concatenate([[False], np.frombuffer(text.translate(FOLD), np.uint8) != 0x20, [False]])
    starts = np.flatnonzero(kept[1:-1] & ~kept[:-2])
    ends = np.flatnonzero(kept[1:-1] & ~kept[2:]) + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in runs]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    automaton_bytes: int = 512 << 10,
) -> DataFrame:
    """Add ``n_words`` (long), ``items`` (array<string>, sorted) and ``spans`` to every row.

    A span is a maximal run of hit words: its first and last word (from 0) and its start and end in
    the original text (code points, end exclusive). Null or empty texts have no words. Items
    without words have no windows; repeated items count once; items with a null id hit, but are not listed. An empty benchmark hits
    nothing. Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    bench = benchmark.where(F.col(item_text).isNotNull()).select(
        F.col(item).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")
    )
    total = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-total // automaton_bytes))
    kept = docs.drop("n_words", "items", "spans")
    out = kept.withColumns(
        {"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast(SPANS)}
    )
    for shard in range(shards):
        part = bench.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == shard) if shards > 1 else bench
        items = [(r.i, bytes(r.t)) for r in part.collect()]  # at most about automaton_bytes
        out = _scanned(out, spark.sparkContext.broadcast(items), text, width)
    return out


def _scanned(docs: DataFrame, items, text: str, width: int) -> DataFrame:
    schema = docs.schema
    names = schema.names
    source = with_text(docs, F.coalesce(F.col(text).cast("string"), F.lit("")))
    key = f"decontam:{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = once(key, lambda: Automaton(items.value, width))
        for batch in batches:
            rest = batch.select(names[:-3])
            counts, found, spans = [], [], []
            for raw, had, runs in zip(
                binaries(batch.column(batch.num_columns - 1)),
                batch.column("items").to_pylist(),
                batch.column("spans").to_pylist(),
                strict=True,
            ):
                n, hit, who = machine.scan(raw)
                if runs:
                    hit = merged([*hit, *((r["first"], r["last"]) for r in runs)])
                at = offsets(raw, hit) if hit else []
                counts.append(n)
                found.append(sorted(who.union(had)) if who or had else [])
                spans.append([{"first": a, "last": b, "start": s, "end": e} for (a, b), (s, e) in zip(hit, at, strict=True)])
            columns = [
                pa.array(counts, pa.int64()),
                pa.array(found, pa.list_(pa.string())),
                pa.array(spans, batch.schema.field("spans").type),
            ]
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=names)

    return source.mapInArrow(run, schema)


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return scanned.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def removed(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by what lies outside the hit spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text)))
