"""N-gram Jaccard join by filtering under several global orders (operator 9).

A document is its set of distinct word shingles, as 64-bit hashes. Two sets link when
100 * intersection >= percent * union. A set's prefix under a global order of all shingles is its
first n - ceil(percent * n / 100) + 1; sets that link share a shingle of their prefixes under every
order. The first order puts rarer shingles first, by a frequency class from one counting sketch of
all documents (of fixed size, so its broadcast is bounded), and then goes by a hash; the others go
by other hashes. Candidates come from posting lists of the first order; a pair is verified only if
its prefixes meet under the other orders too.

Work is on distinct sets, so copies cost nothing. Candidates are first compared by size and by
parity sketches, whose differing bits never exceed the sets' difference. What is asked for is which
sets are connected, so not every pair need be verified. Lists of at most ``SHORT`` sets give their
pairs; in longer ones each set is paired with a pivot. The nearest pairs of each set are verified
first, which gives most components. What may still join two components is then found: candidates of
short lists as they are, and of long lists, inside the task of a tile of bounded size, pairs that
span the graph of its candidates. Connected by these, sets form clusters. Every cluster is verified
in tiles, where a pair is passed over only if its sets are connected already, so no link is lost and
each step gives fewer pairs than it has sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, binaries, portions, tidy, written

#: Counters of the frequency sketch; 4 bytes each.
COUNTERS = 1 << 22
CHUNK = 1 << 16
#: Longest list whose pairs are compared at once; longer ones go through pivots and blocks.
SHORT = 96
#: Sets of a block; a task compares two blocks.
BLOCK = 1024
#: Tokens of a block whose sets are verified in a task.
TILE_TOKENS = 1 << 19
#: Nearest pairs of each set that are verified first.
NEAREST = 2
BROADCAST_BYTES = 48 << 20
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray, which: int) -> np.ndarray:
    """One of several bijections of 64-bit numbers."""
    x = (x ^ x >> np.uint64(32)) * MIX[which]
    x = (x ^ x >> np.uint64(29)) * MIX[(which + 1) % len(MIX)]
    return x ^ x >> np.uint64(32)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; remembers word hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > 120_000:
            self.known = {}
        known, hashed = self.known, xxhash.xxh3_64_intdigest
        flat: list[int] = []
        ends = []
        for text in texts:
            words = text.translate(LOWER).split()
            for w in words:
                if w not in known:
                    known[w] = hashed(w)
            flat += [known[w] for w in words]
            ends.append(len(flat))
        h = np.array(flat, np.uint64)
        n = self.width
        rolled = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n):
            rolled = mixed(rolled + h[k : k + len(rolled)], 0)
        out, start = [], 0
        for end in ends:
            if end - start >= n:
                out.append(np.unique(rolled[start : end - n + 1]))
            elif end > start:
                short = np.full(1, end - start, np.uint64)
                for x in h[start:end]:
                    short = mixed(short + x, 1)
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
            start = end
        return out


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits; four bits or more a token, 512 at least."""
    bits = max(512, 1 << int(4 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: np.ndarray, size: int) -> np.ndarray:
    while len(raw) > size:
        raw = raw[: len(raw) // 2] ^ raw[len(raw) // 2 :]
    return raw


def least_shared(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


SETS = "n int, sid binary, tokens binary, parity binary"


def sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, sid, tokens, parity) of every row; sid is null where the set is empty."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            at = 0
            for part in portions(binaries(batch.column("text"))):
                found = shingler.sets(part)
                raw = [t.tobytes() for t in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column("key").slice(at, len(part)),
                        "n": pa.array([len(t) for t in found], pa.int32()),
                        "sid": pa.array([xxhash.xxh3_128_digest(r) if r else None for r in raw], pa.binary()),
                        "tokens": pa.array(raw, pa.binary()),
                        "parity": pa.array([sketch(t) if len(t) else b"" for t in found], pa.binary()),
                    }
                )
                at += len(part)

    return source.mapInArrow(tidy(run), f"key long, {SETS}")


def frequencies(table: DataFrame) -> np.ndarray:
    """A counting sketch of all tokens: ``COUNTERS`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in portions(batch.column("tokens").to_pylist()):
                place, times = np.unique((np.frombuffer(b"".join(part), np.uint64) >> np.uint64(42)).astype(np.int32), return_counts=True)
                total[place] += np.minimum(times, (1 << 32) - 1 - total[place]).astype(np.uint32)
        for k in range(0, COUNTERS, CHUNK):
            part = total[k : k + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": [part.tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in group["counts"].to_pylist())
        return pa.table({"chunk": group["chunk"].slice(0, 1), "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, np.uint32)
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism  # each sends all counters
    for r in table.select("tokens").coalesce(tasks).mapInArrow(tidy(count), "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.counts, np.uint32)
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Frequency classes from counters: 0 up to about twice the mean, then by powers of two."""
    base = 2 * counts.mean() + 2
    return np.clip(np.floor(np.log2(np.maximum(counts / base, 1))) + (counts > base), 0, 63).astype(np.uint8)


LISTS = "token long, block int, blocks int, sid binary, n int"


def postings(table: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Posting lists of the first order's prefixes, without lists of one set. Long lists come in blocks."""
    sent = table.sparkSession.sparkContext.broadcast((classes(counts), counts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, seen_times = sent.value
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for sid, raw in zip(batch.column("sid").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if sid in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(sid)
                tokens = np.frombuffer(raw, np.uint64)
                p = prefix(len(tokens), percent)
                place = (tokens >> np.uint64(42)).astype(np.int64)
                order = kind[place].astype(np.uint64) << np.uint64(58) | mixed(tokens, 2) >> np.uint64(6)
                first = np.argpartition(order, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
                blocks = np.where(kind[place[first]] > 0, -(-seen_times[place[first]].astype(np.int64) // BLOCK), 1)
                out.append((tokens[first], blocks, int.from_bytes(sid[:4], "little") % blocks, sid, len(tokens)))
            if out:
                sizes = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": np.concatenate([o[0] for o in out]).view(np.int64),
                        "block": pa.array(np.concatenate([o[2] for o in out]), pa.int32()),
                        "blocks": pa.array(np.concatenate([o[1] for o in out]), pa.int32()),
                        "sid": pa.array([o[3] for o in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), sizes))),
                        "n": pa.array(np.repeat([o[4] for o in out], sizes), pa.int32()),
                    }
                )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by token, block and set: distinct ones, of lists with two sets or more."""
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now]).combine_chunks()
            token, block = now["token"].to_numpy(), now["block"].to_numpy()
            cut = np.flatnonzero((token != token[-1]) | (block != block[-1]))
            done = cut[-1] + 1 if len(cut) else 0
            rest = now.slice(done)
            if done:
                yield from shared(now.slice(0, done))
        if rest is not None:
            yield from shared(rest)

    def shared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, block, size = rows["token"].to_numpy(), rows["block"].to_numpy(), rows["blocks"].to_numpy()
        sid = np.array(rows["sid"].to_pylist(), dtype="S16") if len(rows) else np.zeros(0, "S16")
        fresh = np.ones(len(token), bool)
        same = (token[1:] == token[:-1]) & (block[1:] == block[:-1])
        fresh[1:] = ~(same & (sid[1:] == sid[:-1]))
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        keep = fresh & ((np.bincount(group, fresh)[group] > 1) | (size > 1))
        yield from rows.filter(pa.array(keep)).to_batches()

    rows = table.where("sid is not null").select("sid", "tokens").mapInArrow(tidy(emit), LISTS)
    return rows.repartition("token", "block").sortWithinPartitions("token", "block", "sid").mapInArrow(tidy(lists), LISTS)


def wanted(table: DataFrame, needed: DataFrame, *columns: str) -> DataFrame:
    """One row of ``columns`` for each needed sid; a needed set of checked size is broadcast."""
    needed = written(needed.select("sid").distinct(), "jaccard-needed", light=True)
    if needed.count() * 40 <= BROADCAST_BYTES:
        needed = F.broadcast(needed)
    return table.select("sid", *columns).join(needed, "sid", "left_semi").groupBy("sid").agg(*[F.first(c).alias(c) for c in columns])


def verified(table: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Which pairs (a, b) link: prefixes must meet under the other orders, then the sets are intersected."""
    arrays = written(wanted(table, pairs.select(F.explode(F.array("a", "b")).alias("sid")), "tokens"), "jaccard-sets")
    both = pairs.join(arrays.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a").join(arrays.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                yes.append(meet(x, y, percent) and shared_count(x, y) >= least_shared(len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], names=["a", "b", "linked"])

    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a binary, b binary, linked boolean")


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    place = np.searchsorted(y, x)
    return int((y[np.minimum(place, len(y) - 1)] == x).sum())


def meet(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do the prefixes share a token under each of the further orders?"""
    for which in (3, 4):
        first = [np.sort(mixed(t, which))[: prefix(len(t), percent)] for t in (x, y)]
        if not shared_count(*first):
            return False
    return True


def components(links: DataFrame) -> DataFrame:
    """(sid, comp): the smallest sid reachable, for every sid in a link. Labels spread and jump until they rest."""
    with Scratch() as s:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = written(links.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct(), "jaccard-edges", light=True)
        label = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("comp"), F.col("a").alias("was")), "jaccard-labels", light=True)
        resting = label.isEmpty()
        while not resting:
            now = label.select("sid", "comp")
            spread = edges.join(now, edges.b == now.sid).groupBy("a").agg(F.min("comp").alias("near"))
            moved = now.join(spread, now.sid == spread.a).select("sid", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
            hop = now.select(F.col("sid").alias("via"), F.col("comp").alias("far"))
            label = written(moved.join(hop, F.col("next") == F.col("via"), "left").select("sid", F.least("next", F.coalesce("far", "next")).alias("comp"), "was"), "jaccard-labels", light=True)
            resting = label.where("comp <> was").isEmpty()
        return s.keep(label).select("sid", "comp")


TILE = "tile struct<i:int,j:int>"


def tiles(rows: DataFrame, by: str, weight: Column, most: int) -> DataFrame:
    """Deal the rows (``by``, sid, comp, ...) of each group to tiles, pairs of blocks of bounded weight; adds tile and block.

    Two rows of a group and of different components meet in some tile. A group's largest component
    is passive: its rows meet only those of other components, which are active, so what is dealt is
    in proportion to the group while its other components fit in a block.
    """
    sums = rows.groupBy(by, "comp").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    total = sums.groupBy(by).agg(F.max_by("comp", F.struct("w", "comp")).alias("passive"), F.max("w").alias("w_passive"), (F.sum("w") - F.max("w")).alias("w_active"), F.count("*").alias("comps"))
    size = lambda w: F.greatest(F.ceil(F.col(w) / most), F.lit(1)).cast("int")
    total = written(total.where("comps > 1").select(by, "passive", size("w_active").alias("actives"), size("w_passive").alias("passives")), "jaccard-dealt", light=True)
    one = F.pmod(F.xxhash64("sid", F.lit(by)), F.when(F.col("comp") == F.col("passive"), F.col("passives")).otherwise(F.col("actives"))).cast("int")
    block = F.when(F.col("comp") == F.col("passive"), F.col("actives") + one).otherwise(one)
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(F.col("actives") + F.col("passives")), lambda j: tile(F.least(F.col("block"), j), F.greatest(F.col("block"), j)))
    across = F.transform(upto(F.col("actives")), lambda i: tile(i, F.col("block")))
    dealt = rows.join(total, by).withColumn("block", block)
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("block") < F.col("actives"), among).otherwise(across)))
    return dealt.drop("passive", "actives", "passives")


class Tile:
    """The rows of a tile: which pairs may link, and how far they are merged."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.sid = rows["sid"].combine_chunks()
        self.comp = np.unique(np.array(rows["comp"].to_pylist(), "S16"), return_inverse=True)[1]
        self.n, self.block = rows["n"].to_numpy().astype(np.int64), rows["block"].to_numpy()
        self.across = bool(len(self.block)) and rows["tile"][0].as_py()["i"] != rows["tile"][0].as_py()["j"]
        self.a: list[int] = []
        self.b: list[int] = []

    def sketches(self, raw: list[bytes]) -> None:
        raw = [np.frombuffer(x, np.uint8) for x in raw]
        sizes = np.array([len(r) for r in raw], np.int64)
        self.by_size = []
        for size in np.unique(sizes):
            # a set with a shorter sketch cannot meet one of more than twice the length
            here = np.flatnonzero((sizes >= size) & (sizes <= 2 * size))
            words = np.stack([folded(raw[k], size) for k in here]).view(np.uint64)
            self.by_size.append((here, sizes[here], int(size), words))

    def near(self, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each row, and the rows of other components and other groups that size and sketch allow it to link with."""
        for here, sizes, size, words in self.by_size:
            for a in np.flatnonzero(sizes == size).tolist():
                k = here[a]
                others = ((sizes > size) | (np.arange(len(here)) > a)) & (group[here] != group[k]) & (self.comp[here] != self.comp[k])
                if self.across:
                    others &= self.block[here] != self.block[k]
                b = np.flatnonzero(others)
                total = self.n[here[b]] + self.n[k]
                least = -(-self.percent * total // (100 + self.percent))
                able = np.minimum(self.n[here[b]], self.n[k]) >= least
                b, total, least = b[able], total[able], least[able]
                if len(b):
                    d = np.bitwise_count(words[b] ^ words[a]).sum(axis=1).astype(np.int64)
                    b = b[d <= total - 2 * least]
                if len(b):
                    yield int(k), here[b]

    def merge(self, group: np.ndarray, k: int, others: np.ndarray) -> None:
        """Join the groups of ``others`` to that of ``k``, by one link to each."""
        found, first = np.unique(group[others], return_index=True)
        self.a += [k] * len(first)
        self.b += others[first].tolist()
        group[np.isin(group, found)] = group[k]

    def links(self) -> pa.Table:
        sid = self.sid
        return pa.table({"a": sid.take(pa.array(self.a, pa.int64())), "b": sid.take(pa.array(self.b, pa.int64()))})


def may_link(lists: DataFrame, label: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that span the graph of the sets of long lists whose sizes and sketches allow a link across components.

    A tile of n sets gives n - 1 pairs at most. What may link is connected by them.
    """
    known = lists.select("token", "sid", "n").join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    many = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    rows = written(known.join(many, "token", "left_semi"), "jaccard-open")
    parity = written(wanted(table, rows.select("sid"), "parity"), "jaccard-open-parity")
    dealt = tiles(rows, "token", F.lit(1), BLOCK).join(parity, "sid")

    def run(group: pa.Table) -> pa.Table:
        tile = Tile(group.sort_by("sid"), percent)
        tile.sketches(group.sort_by("sid")["parity"].to_pylist())
        merged = np.arange(len(tile.n))
        for k, others in tile.near(merged):
            tile.merge(merged, k, others)
        return tile.links()

    return dealt.select("token", "tile", "block", "sid", "n", "comp", "parity").groupBy("token", "tile").applyInArrow(run, "a binary, b binary")


def linked(clusters: DataFrame, label: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each cluster (sid, cluster) as far as links go.

    In a tile, pairs of components that are not joined yet must agree in size and sketch, then meet
    in their prefixes under each of the further orders; those left are verified by intersection. A
    tile of n sets gives n - 1 links at most.
    """
    members = clusters.join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    tokens = written(wanted(table, members.select("sid"), "n", "tokens"), "jaccard-members")
    rows = members.join(tokens.select("sid", "n"), "sid")
    dealt = tiles(rows, "cluster", F.greatest(F.col("n").cast("long"), F.lit(TILE_TOKENS // BLOCK)), TILE_TOKENS).join(tokens.select("sid", "tokens"), "sid")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("sid")
        tile = Tile(group, percent)
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        tile.sketches([sketch(t) for t in sets])
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        whole = Members(sets, numbers)
        orders = [Members([np.sort(mixed(t, which))[: prefix(len(t), percent)] for t in sets]) for which in (3, 4)]
        merged = tile.comp.copy()
        for k, others in tile.near(merged):
            for order in orders:
                others = others[order.shared(k, others) > 0]
            if len(others):
                total = tile.n[others] + tile.n[k]
                others = others[whole.shared(k, others) >= -(-percent * total // (100 + percent))]
                if len(others):
                    tile.merge(merged, k, others)
        return tile.links()

    return dealt.select("cluster", "tile", "block", "sid", "n", "comp", "tokens").groupBy("cluster", "tile").applyInArrow(run, "a binary, b binary")


class Members:
    """Sets of small numbers, end to end."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray | None = None):
        self.numbers = np.unique(np.concatenate(sets), return_inverse=True)[1] if numbers is None else numbers
        self.size = np.array([len(t) for t in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.mark = np.zeros(int(self.numbers.max(initial=0)) + 1, bool)

    def shared(self, k: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set ``k`` with the others."""
        own = self.numbers[self.start[k] : self.start[k] + self.size[k]]
        self.mark[own] = True
        size = self.size[others]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(self.start[others] - (ends - size), size)
        out = np.add.reduceat(self.mark[self.numbers[place]], ends - size, dtype=np.int64)
        self.mark[own] = False
        return out


def short_pairs(lists: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, d) of lists of at most ``SHORT`` sets whose sizes and sketches allow a link; d bits differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now]).combine_chunks()
            token = now["token"].to_numpy()
            cut = np.flatnonzero(token != token[-1])
            done = cut[-1] + 1 if len(cut) else 0
            rest = now.slice(done)
            if done:
                yield from pairs(now.slice(0, done))
        if rest is not None:
            yield from pairs(rest)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, n, sid = rows["token"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["sid"].combine_chunks()
        for d in range(1, SHORT):
            i = np.flatnonzero(token[d:] == token[:-d]) if d < len(token) else np.zeros(0, np.int64)
            if not len(i):
                break
            low, high = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
            i = i[low * 100 >= high * percent]
            if len(i):
                yield pa.RecordBatch.from_arrays([sid.take(pa.array(i)), sid.take(pa.array(i + d))], names=["a", "b"])

    # sets come in order within a list, so a < b
    dealt = lists.select("token", "sid", "n").repartition("token").sortWithinPartitions("token", "sid")
    found = written(dealt.mapInArrow(tidy(run), "a binary, b binary").distinct(), "jaccard-candidates")
    parity = written(wanted(table, found.select(F.explode(F.array("a", "b")).alias("sid")), "n", "parity"), "jaccard-parity")
    both = found.join(parity.select(F.col("sid").alias("a"), F.col("n").alias("n"), F.col("parity").alias("x")), "a").join(
        parity.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y")), "b"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            bits = np.empty(len(total), np.int32)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if len(x) == len(y):
                    bits[k] = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
                else:
                    size = min(len(x), len(y))
                    u, v = (folded(np.frombuffer(z, np.uint8), size) for z in (x, y))
                    bits[k] = int(np.bitwise_count(u ^ v).sum())
            keep = pa.array(bits <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(bits).filter(keep)], names=["a", "b", "d"])

    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(tidy(compare), "a binary, b binary, d int")


def crossing(near: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose sets are in different components by now."""
    side = lambda k: label.select(F.col("sid").alias(k), F.col("comp").alias("c_" + k))
    both = near.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(~F.coalesce("c_a", "a").eqNullSafe(F.coalesce("c_b", "b"))).select("a", "b", "d")


def pivots(lists: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) for each set: with the first set of its list that it shares most lists with."""
    head = lists.groupBy("token", "block").agg(F.min(F.struct("sid", "n")).alias("p"))
    pairs = lists.join(written(head, "jaccard-heads", light=True), ["token", "block"]).where("sid <> p.sid")
    low, high = F.least("n", "p.n"), F.greatest("n", "p.n")
    pairs = pairs.where(low * 100 >= high * percent).groupBy(F.col("p.sid").alias("a"), F.col("sid").alias("b")).agg(F.count("*").alias("times"))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: ``key``, n_shingles (long), component_id (long).

    component_id is the smallest key that links reach, the row's own included. Null, empty and blank
    texts have the empty set, which links with nothing: they are components of their own. Rows with
    a null key take part, but give no component_id unless alone, where it is null. Repeated rows
    each get their row. Texts are whole. Other columns are ignored.
    """
    with Scratch() as all_:
        table = all_.keep(written(sets(docs, key, text, width), "jaccard-table"))
        lists = written(postings(table, frequencies(table), percent), "jaccard-postings")
        long_tokens = lists.groupBy("token").agg(F.count("*").alias("size"), F.max("blocks").alias("most")).where((F.col("size") > SHORT) | (F.col("most") > 1))
        long_tokens = written(long_tokens.select("token"), "jaccard-long", light=True)
        crowded = not long_tokens.isEmpty()
        with Scratch() as s:
            near = short_pairs(lists.join(long_tokens, "token", "left_anti") if crowded else lists, table, percent)
            if crowded:
                lists = s.keep(written(lists.join(long_tokens, "token", "left_semi"), "jaccard-long-lists"))
                near = near.unionByName(pivots(lists, percent).withColumn("d", F.lit(0)))
            near = s.keep(written(near.groupBy("a", "b").agg(F.min("d").alias("d")), "jaccard-near"))
        with Scratch() as s:
            sides = near.select("a", "b", "d", F.explode(F.array("a", "b")).alias("sid"))
            nearest = Window.partitionBy("sid").orderBy("d", "a", "b")
            chosen = sides.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= NEAREST).select("a", "b").distinct()
            done = s.keep(written(verified(table, written(chosen, "jaccard-pairs", light=True), percent), "jaccard-verified", light=True))
        label = components(done.where("linked").select("a", "b"))
        # what may still join two components
        with Scratch() as s:
            left = crossing(near, label).select("a", "b").join(done.select("a", "b"), ["a", "b"], "left_anti")
            if crowded:
                left = left.unionByName(may_link(lists, label, table, percent))
            left = s.keep(written(left, "jaccard-left", light=True))
        if not left.isEmpty():
            with Scratch() as s:
                clusters = components(left).withColumnRenamed("comp", "cluster")
                more = linked(clusters, label, table, percent)
                side = lambda k: label.select(F.col("sid").alias(k), F.col("comp").alias("c_" + k))
                more = more.join(side("a"), "a", "left").join(side("b"), "b", "left")
                over = components(more.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
                all_sids = label.unionByName(over.select("sid", F.col("sid").alias("comp")).join(label.select("sid"), "sid", "left_anti"))
                joined = all_sids.join(over.select(F.col("sid").alias("comp"), F.col("comp").alias("least")), "comp", "left")
                label = s.keep(written(joined.select("sid", F.coalesce("least", "comp").alias("comp")), "jaccard-label", light=True))
        own = table.where("sid is not null").groupBy("sid").agg(F.min("key").alias("least"))
        joined = written(own.join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "jaccard-own", light=True)
        roots = written(joined.groupBy("comp").agg(F.min("least").alias("root")), "jaccard-roots", light=True)
        final = all_.keep(written(joined.join(roots, "comp").select("sid", "root"), "jaccard-final", light=True))
    rows = table.select("key", "n", "sid").join(final, "sid", "left")
    return rows.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("key")).otherwise(F.col("root")).alias("component_id"))
