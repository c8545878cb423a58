"""Removal of repeated byte strings by suffix arrays (operator 3).

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else in the corpus.

Every window of ``length`` bytes elects an anchor: the block of ``BLOCK`` bytes inside it that
hashes lowest, the leftmost of equals. Equal windows elect equal blocks at the same offset, so only
windows with equal anchors need be compared, and windows next to each other that share an anchor
form one segment. Segments are counted by digest. An anchor seen once has no repeats; an anchor
whose segments are all equal is repeated throughout; the segments of other anchors meet in one task
for each anchor and are sorted by a suffix array, in which equal windows are neighbours.

The suffix array is built by grouping (``suffix_array``): suffixes are grouped by their Lyndon
prefixes in descending order, following previous-smaller pointers, and each group is then emitted
in order from its suffixes' successors. In its text a segment's anchor block is one symbol, as all
windows of the segment contain it whole.

An anchor with more than ``most_segments`` distinct segments (a passage amid ever new surroundings)
is left to an exact way without a bound on groups: all windows of its segments are counted by
digest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, written

LENGTH, BLOCK = 200, 128
#: Bytes hashed at a time, so that the arrays stay in the processor's cache.
BUFFER = 256 << 10
BROADCAST_BYTES = 48 << 20
#: The bitmap of repeated anchors beyond that has 2 ** MARK_BITS bits.
MARK_BITS = 28
#: Symbols that one suffix array holds, unless a single anchor has more.
TEXT_SYMBOLS = 1 << 16
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95]


# ---------------------------------------------------------------- suffix array


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol is its only 0; other symbols are positive."""
    n = len(text)
    size: dict[int, int] = {}
    for c in text:
        size[c] = size.get(c, 0) + 1
    first, at = {}, 0
    for c in sorted(size):
        first[c] = at
        at += size[c]
    group = [first[c] for c in text]  # where a suffix's group starts in the order
    members = [0] * n
    place = [0] * n
    count = [0] * n  # of the group that starts here
    for i, g in enumerate(group):
        k = g + count[g]
        members[k], place[i] = i, k
        count[g] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[members[end - 1]]
        if end - start == 1:
            s = members[start]
            j = s - 1
            while j >= 0 and group[j] > start:
                j = smaller[j]
            smaller[s] = j
            if j >= 0:
                g = group[j]
                c = count[g]
                if c > 1:
                    last = g + c - 1
                    k, other = place[j], members[last]
                    members[k], place[other] = other, k
                    members[last], place[j] = j, last
                    count[g], count[last], group[j] = c - 1, 1, last
        else:
            times: dict[int, int] = {}
            for s in sorted(members[start:end]):
                j = s - 1
                while j >= 0 and group[j] >= start:
                    j = smaller[j]
                smaller[s] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, m in times.items():
                by_times.setdefault(m, []).append(j)
            # more repetitions of this group's prefix sort higher: they take the end of their group first
            for m in sorted(by_times, reverse=True):
                moved: dict[int, int] = {}
                for j in by_times[m]:
                    g = group[j]
                    last = g + count[g] - 1 - moved.get(g, 0)
                    k, other = place[j], members[last]
                    members[k], place[other] = other, k
                    members[last], place[j] = j, last
                    moved[g] = moved.get(g, 0) + 1
                for g, m_moved in moved.items():
                    left = count[g] - m_moved
                    if left:
                        fresh = g + left
                        count[g], count[fresh] = left, m_moved
                        for k in range(fresh, fresh + m_moved):
                            group[members[k]] = fresh
        end = start
    # emission: a suffix's group and what follows its Lyndon prefix give its place
    order = [-1] * n
    order[0] = n - 1
    free = group
    done = [False] * n
    done[n - 1] = True
    filled = [0] * n
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not done[j]:
            g = free[j]
            order[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = smaller[j]
    return order


# ---------------------------------------------------------------- anchors


@functools.lru_cache(maxsize=1)
def tables(n: int):
    """For both bases: a random value a byte, powers and inverse powers of the base."""
    out, one = [], np.ones(1, np.uint64)
    for k, base in enumerate(BASES):
        values = np.array([int.from_bytes(hashlib.sha256(bytes([k, b])).digest()[:8], "little") | 1 for b in range(256)], np.uint64)
        powers = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]))
        inverse = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
        out.append((values, powers, inverse))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Segments:
    """Segments of a buffer of texts: first window, end of windows, anchor, anchor hash, two digests, owner."""

    def __init__(self, texts: list[bytes], length: int, block: int):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n, width = len(raw), length - block + 1
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        empty = np.zeros(0, np.int64)
        self.first = self.end = self.anchor = self.owner = empty
        self.hash = self.low = self.high = np.zeros(0, np.uint64)
        if n < length:
            return
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(v[raw] * p[:n], dtype=np.uint64)]) for v, p, _ in (t for t in tables(max(n, 2 * (BUFFER + length))))]
        inverse = [t[2] for t in tables(max(n, 2 * (BUFFER + length)))]
        m = n - block + 1
        kgram = mixed((sums[0][block:] - sums[0][:m]) * inverse[0][:m])
        keys = kgram & np.uint64(0xFFFFFFFFFF000000) | np.arange(m, dtype=np.uint64)
        most = np.iinfo(np.uint64).max
        grid = np.concatenate([keys, np.full(-m % width, most, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - length + 1
        chosen = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        valid = owner[:windows] == owner[length - 1 :]
        change = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1]) | (owner[1:windows] != owner[: windows - 1])]))
        ends = np.concatenate([change[1:], [windows]])
        keep = valid[change]
        self.first, self.end = change[keep], ends[keep]
        self.anchor, self.owner = chosen[self.first], owner[self.first]
        self.hash = kgram[self.anchor]
        stop = self.end + length - 1
        offset = (self.anchor - self.first).astype(np.uint64) << np.uint64(32) | (stop - self.first).astype(np.uint64)
        self.low, self.high = (mixed((s[stop] - s[self.first]) * i[self.first] + offset * np.uint64(b)) for s, i, b in zip(sums, inverse, BASES, strict=True))


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Buffers of texts of about BUFFER bytes, with each text's number and offset; long texts come in overlapping pieces."""
    held: list[bytes] = []
    place: list[tuple[int, int]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 1), BUFFER):
            piece = text[at : at + BUFFER + length - 1]
            held.append(piece)
            place.append((k, at))
            size += len(piece)
            if size >= BUFFER:
                yield held, place
                held, place, size = [], [], 0
    if held:
        yield held, place


# ---------------------------------------------------------------- Spark


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, text): rows that agree in id and text are alike, and get alike results."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(t).alias("digest"), t.alias("text"))


def counts(rows: DataFrame, length: int, block: int) -> DataFrame:
    """(hash, even): anchors that occur twice or more; even if all their segments are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, _ in pieces(binaries(batch.column("text")), length):
                s = Segments(texts, length, block)
                if not len(s.hash):
                    continue
                order = np.lexsort((s.high, s.low, s.hash))
                h, low = s.hash[order], s.low[order]
                high = s.high[order]
                start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
                times = np.diff(np.concatenate([start, [len(h)]]))
                yield pa.RecordBatch.from_pydict({"hash": h[start].view(np.int64), "low": low[start].view(np.int64), "high": high[start].view(np.int64), "times": pa.array(times, pa.int32())})

    seen = rows.select("text").mapInArrow(run, "hash long, low long, high long, times int")
    total = seen.groupBy("hash").agg(F.sum("times").alias("n"), F.min("low").alias("a"), F.max("low").alias("b"), F.min("high").alias("c"), F.max("high").alias("d"))
    return total.where("n > 1").select("hash", ((F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))).alias("even"))


OCCURRENCES = "key long, digest long, first int, end int, hash long, low long, high long, even boolean, anchor int, segment binary"


def bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """One bit for the first ``bits`` bits of each hash: 2 ** bits bits, however many hashes there are."""
    side = 1 << min(bits, 19)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            place = np.unique((batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            np.bitwise_or.at(on, place >> 3, (1 << (place & 7)).astype(np.uint8))
        for k in range(0, len(on), side >> 3):
            if (part := on[k : k + (side >> 3)]).any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "marks": [part.tobytes()]})

    def together(group: pa.Table) -> pa.Table:
        marks = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["marks"].to_pylist()])
        return pa.table({"chunk": group["chunk"].slice(0, 1), "marks": pa.array([marks.tobytes()], pa.binary())})

    tasks = 2 * repeated.sparkSession.sparkContext.defaultParallelism  # each sends all marks
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in repeated.select("hash").coalesce(tasks).mapInArrow(mark, "chunk int, marks binary").groupBy("chunk").applyInArrow(together, "chunk int, marks binary").collect():
        out[r.chunk : r.chunk + len(r.marks)] = np.frombuffer(r.marks, np.uint8)
    return out


def occurrences(rows: DataFrame, repeated: DataFrame, length: int, block: int) -> DataFrame:
    """Segments of repeated anchors. Runs of even ones are merged; others have their bytes once a task.

    The repeated anchors are broadcast if they fit in BROADCAST_BYTES; else a bitmap of fixed size
    passes over most others, and what it lets through is joined by anchor.
    """
    small = repeated.count() * 9 <= BROADCAST_BYTES
    if small:
        found = repeated.toArrow()
        hashes = found["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        sent = rows.sparkSession.sparkContext.broadcast((hashes[order], found["even"].to_numpy(zero_copy_only=False)[order]))
    else:
        marks = rows.sparkSession.sparkContext.broadcast(bitmap(repeated, MARK_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if small else None
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            names, digests = batch.column("key").to_pylist(), batch.column("digest").to_pylist()
            for texts, places in pieces(binaries(batch.column("text")), length):
                s = Segments(texts, length, block)
                if known is not None:
                    if not len(known[0]):
                        continue
                    at = np.minimum(np.searchsorted(known[0], s.hash), len(known[0]) - 1)
                    pick = np.flatnonzero(known[0][at] == s.hash)
                    even = known[1][at[pick]]
                else:
                    place = (s.hash >> np.uint64(64 - MARK_BITS)).astype(np.int64)
                    pick = np.flatnonzero(marks.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    even = np.zeros(len(pick), bool)
                out = []
                last = -1
                for k, flat in zip(pick.tolist(), even.tolist(), strict=True):
                    owner = int(s.owner[k])
                    base = int(s.starts[owner])
                    number, shift = places[owner]
                    a, b = int(s.first[k]) - base + shift, int(s.end[k]) - base + shift
                    if flat:
                        if last == number and out[-1][7] and out[-1][3] == a:
                            out[-1] = (*out[-1][:3], b, *out[-1][4:])
                        else:
                            out.append((names[number], digests[number], a, b, 0, 0, 0, True, 0, None))
                        last = number
                        continue
                    last = -1
                    low, high = int(s.low[k]), int(s.high[k])
                    raw = None
                    if (low, high) not in seen:
                        if len(seen) < 500_000:
                            seen.add((low, high))
                        raw = texts[owner][int(s.first[k]) - base : int(s.end[k]) - base + length - 1]
                    out.append((names[number], digests[number], a, b, int(s.hash[k].view(np.int64)), int(s.low[k].view(np.int64)), int(s.high[k].view(np.int64)), False, int(s.anchor[k]) - base + shift - a, raw))
                for at in range(0, len(out), 20_000):
                    columns = list(zip(*out[at : at + 20_000], strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in OCCURRENCES.split(", ")])

    found = rows.mapInArrow(run, OCCURRENCES)
    return found if small else found.drop("even").join(repeated.select("hash", F.lit(False).alias("even")), "hash").select(*[c.split()[0] for c in OCCURRENCES.split(", ")])


def compared(group: list[tuple[int, int, int, bytes]], length: int, block: int) -> list[tuple[int, int, int, int]]:
    """(low, high, a, b): runs [a, b) of repeated windows of segments (low, high, anchor, bytes) of some anchors."""
    half = (length - block) // 2
    around: dict[bytes, int] = {}
    for _, _, m, raw in group:
        for near in (b"L" + raw[m - half : m + block] if m >= half else b"", b"R" + raw[m : m + block + length - block - half]):
            around[near] = around.get(near, 0) + 1
    text: list[int] = []
    spots: list[int] = []
    owners: list[tuple[int, int]] = []
    names: dict[bytes, int] = {}
    for k, (_, _, m, raw) in enumerate(group):
        left, right = (b"L" + raw[m - half : m + block] if m >= half else b""), b"R" + raw[m : m + block + length - block - half]
        if not (left and around[left] > 1) and around[right] < 2:
            continue  # a repeated window would reach half of the rest to one side of its anchor
        windows = len(raw) - length + 1
        symbol = names.setdefault(raw[m : m + block], 258 + len(names))
        spots += range(len(text), len(text) + windows)
        owners += [(k, w) for w in range(windows)]
        text += [b + 2 for b in raw[:m]]
        text.append(symbol)
        text += [b + 2 for b in raw[m + block :]]
        text.append(1)
    if not spots:
        return []
    order = suffix_array([*text, 0])
    wide = length - block + 1
    rank = {p: k for k, p in enumerate(spots)}
    sorted_spots = np.array([p for p in order if p in rank], np.int64)
    symbols = np.array(text, np.int32)
    same = np.ones(len(sorted_spots) - 1, bool)
    for d in range(wide):
        same &= symbols[sorted_spots[1:] + d] == symbols[sorted_spots[:-1] + d]
    hit = np.zeros(len(sorted_spots), bool)
    hit[1:] |= same
    hit[:-1] |= same
    found = sorted(owners[rank[p]] for p in sorted_spots[hit].tolist())
    out: list[tuple[int, int, int, int]] = []
    runs: list[list[int]] = []
    for k, w in found:
        if runs and runs[-1][0] == k and runs[-1][2] == w:
            runs[-1][2] = w + 1
        else:
            runs.append([k, w, w + 1])
    for k, a, b in runs:
        out.append((group[k][0], group[k][1], a, b))
    return out


RUNS = "low long, high long, a int, b int"


def repeats(found: DataFrame, length: int, block: int, most_segments: int) -> DataFrame:
    """(low, high, a, b): runs of repeated windows of the distinct segments of uneven anchors."""
    distinct = (
        found.where("not even")
        .groupBy("hash", "low", "high")
        .agg(F.count("*").alias("n"), F.first("segment", ignorenulls=True).alias("segment"), F.first("anchor").alias("anchor"))
    )
    distinct = written(distinct, "suffixes-distinct")
    many = written(distinct.groupBy("hash").count().where(F.col("count") > most_segments).select("hash"), "suffixes-many")
    crowded = not many.isEmpty()
    whole = distinct.where("n > 1").select("low", "high", F.lit(0).alias("a"), (F.length("segment") - length + 1).alias("b"))
    sorted_ = distinct.join(many, "hash", "left_anti") if crowded else distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for h, low, high, raw, m in zip(*(batch.column(c).to_pylist() for c in ("hash", "low", "high", "segment", "anchor")), strict=True):
                if h != last and size >= TEXT_SYMBOLS:
                    yield from answer(held)
                    held, size = [], 0
                last = h
                held.append((low, high, m, raw))
                size += len(raw) - block + 2
        if held:
            yield from answer(held)

    def answer(held: list) -> Iterator[pa.RecordBatch]:
        if out := compared(held, length, block):
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["low", "high", "a", "b"])

    arranged = sorted_.select("hash", "low", "high", "segment", "anchor").repartition("hash").sortWithinPartitions("hash", "low", "high")
    out = arranged.mapInArrow(run, RUNS).unionByName(whole)
    if not crowded:
        return out

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "segment")), strict=True):
                n = len(raw) - length + 1
                yield pa.RecordBatch.from_pydict(
                    {"low": [low] * n, "high": [high] * n, "a": pa.array(range(n), pa.int32()), "window": [xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(n)]}
                )

    windows = written(distinct.join(many, "hash", "left_semi").select("low", "high", "segment").mapInArrow(digests, "low long, high long, a int, window binary"), "suffixes-windows")
    again = written(windows.groupBy("window").count().where("count > 1").select("window"), "suffixes-again")
    return out.unionByName(windows.join(again, "window", "left_semi").select("low", "high", "a", (F.col("a") + 1).alias("b")))


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK, most_segments: int = 4096) -> DataFrame:
    """(key, text, spans): each row's UTF-8 bytes and the maximal runs (start, end) of bytes to remove.

    Null texts are empty; texts below ``length`` bytes have no strings to repeat. Matches do not
    cross rows; repeated rows repeat each other. Null keys are kept. Other columns are ignored.
    """
    rows = keyed(docs, key, text)
    repeated = written(counts(rows, length, block), "suffixes-repeated")
    found = written(occurrences(rows, repeated, length, block), "suffixes-found")
    runs = written(repeats(found, length, block, most_segments), "suffixes-runs")
    flat = found.where("even").select("key", "digest", F.col("first").alias("start"), (F.col("end") + length - 1).alias("stop"))
    uneven = (
        found.where("not even")
        .select("key", "digest", "first", "low", "high")
        .join(runs, ["low", "high"])
        .select("key", "digest", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") + length - 1).alias("stop"))
    )
    spans = flat.unionByName(uneven).groupBy("key", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    spans = spans.select(F.col("key").alias("k"), F.col("digest").alias("d"), "spans")
    joined = rows.join(spans, (F.col("digest") == F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left")
    return joined.select(F.col("key").alias(key), F.col("text").alias("text"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))


def cleaned(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): the remaining bytes, and what was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            removed, number, kept = [], [], []
            for raw, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                parts, at, gone, n = [], 0, 0, 0
                for s in spans:
                    a, b = s["start"], s["stop"]
                    if a > at or not n:
                        parts.append(raw[at:a])
                        n += 1
                        gone += b - a
                    elif b > at:
                        gone += b - at
                    at = max(at, b)
                parts.append(raw[at:])
                removed.append(gone)
                number.append(n)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_pydict(
                {key: batch.column(key), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(number, pa.int64()), "kept": pa.array(kept, pa.binary())}
            )

    return marked.mapInArrow(run, f"{key} long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return done.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
