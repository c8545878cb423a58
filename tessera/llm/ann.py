"""Approximate nearest neighbours on shifted space-filling curves, with completion (operator 5).

Vectors are projected to a few dimensions, several times and each time shifted; a Hilbert curve
turns each projection into a key. Every ordering is range-partitioned by key in Spark and cut into
windows of ``window`` rows; a query merges its own window with the two beside it and reranks their
rows by the measure on the original vectors, in double precision.

What the windows find gives each query a bound: its k-th best so far. On vectors without structure
windows of a fixed size find a smaller share the more rows there are, so completion, an option, then
visits the other windows of the first ordering, skips those whose centre and radius prove that they
hold nothing as near, and reranks the rest: full recall whatever the data. Queries are sent to it in
blocks of at most ``BLOCK_BYTES``, a job each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

BLOCK_BYTES = 32 << 20
#: Rows that the projections' scale is fitted on (those first by a hash of the id).
FIT_ROWS = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with integer coordinates of ``bits`` bits (rows x dimensions)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | x[:, i] >> b & 1
    return key


class Curves:
    """Projections, scales and shifts of all orderings."""

    def __init__(self, sample: np.ndarray, orderings: int, dimensions: int, bits: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bits = bits
        width = sample.shape[1]
        k = min(dimensions, width)
        self.parts = []
        each = max(1, width // k)
        for r in range(orderings):
            if r % each == 0:  # the orderings of one turn see sides of the vectors at right angles
                turn = np.linalg.qr(rng.normal(0, 1, (width, width)))[0]
            axes = turn[:, r % each * k : (r % each + 1) * k]
            seen = sample @ axes
            self.parts.append((axes, seen.mean(axis=0), seen.std(axis=0) + 1e-12, rng.random(k)))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for axes, mean, scale, shift in self.parts:
            z = (vectors @ axes - mean) / scale
            place = (1 / (1 + np.exp(-1.7 * np.clip(z, -30, 30))) + shift) / 2  # in [0, 1), shifted
            out.append(hilbert(np.minimum((place * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): one row an id, of vectors that take part.

    Left out are null ids and vectors that are null, zero or hold null or non-finite components, and
    vectors of another length than the most common one. Of repeated ids the smallest vector counts.
    """
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & good).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    return np.cumsum(x * y, axis=1)[:, -1]


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, ties to the smaller row."""
    order = np.lexsort((row, -score, query))
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - first < k]


def result(query: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(row, pa.int64()), "score": pa.array(score, pa.float64())})


FOUND = "query_id long, vec_id long, score double"


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    orderings: int = 16,
    dimensions: int = 8,
    bits: int = 7,
    window: int = 1024,
    complete: bool = True,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows by inner product of each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. A query is not its
    own candidate; with fewer candidates than ``k`` all are returned, with none the query has no
    row. See ``usable`` for what takes part. Without ``complete`` only the windows are searched.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, vector), "ann-rows")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = Curves(matrix(sample), orderings, dimensions, bits)
    kind = rows.schema["v"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column("vec_id"), batch.column("v")
            for r, keys in enumerate(curves.keys(matrix(v))):
                yield pa.RecordBatch.from_pydict({"ordering": pa.array(np.full(len(keys), r), pa.int32()), "key": keys, "vec_id": ids, "v": v})

    parts = max(orderings, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(keyed, f"ordering int, key long, vec_id long, v {kind}").repartitionByRange(parts, "ordering", "key", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            place = np.empty(len(batch), np.int64)
            for j, r in enumerate(batch.column("ordering").to_pylist()):
                at = 0 if r != last else at + 1
                last = r
                place[j] = at
            columns = [*batch.columns, pa.array(np.full(len(batch), part), pa.int32()), pa.array(place // window, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "block"])

    ordered = written(
        dealt.sortWithinPartitions("ordering", "key", "vec_id").mapInArrow(cut, f"ordering int, key long, vec_id long, v {kind}, part int, block int"), "ann-ordered"
    )
    # windows get numbers that follow each other; a row a partition and ordering reaches the driver
    offsets, total = {}, 0
    for r in ordered.groupBy("ordering", "part").agg((F.max("block") + 1).alias("n")).orderBy("ordering", "part").collect():
        offsets[(r.ordering, r.part)] = total
        total += r.n
    first = F.create_map(*[F.lit(x) for (r, p), at in offsets.items() for x in (r * parts + p, at)])
    numbered = ordered.withColumn("number", F.col("block") + F.element_at(first, F.col("ordering") * parts + F.col("part")))
    is_query = F.col("vec_id") % every == 0
    asking = numbered.where(is_query).select(F.explode(F.array(F.col("number") - 1, F.col("number"), F.col("number") + 1)).alias("number"), F.lit(1).alias("asks"), "vec_id", "v", F.col("ordering"))
    standing = numbered.select("number", F.lit(0).alias("asks"), "vec_id", "v", "ordering")

    def rerank(group: pa.Table) -> pa.Table:
        asks, ids = group["asks"].to_numpy(), group["vec_id"].to_numpy()
        order = group["ordering"].to_numpy()
        v = matrix(group["v"].combine_chunks())
        here = np.flatnonzero(asks == 0)
        out = []
        if len(here):
            q = np.flatnonzero((asks == 1) & (order == order[here[0]]))
            for part in range(0, len(q), 256):
                some = q[part : part + 256]
                score = v[some] @ v[here].T
                score[ids[some][:, None] == ids[here]] = -np.inf
                take = np.argsort(-score, axis=1)[:, : k + 4] if len(here) > k + 4 else np.tile(np.arange(len(here)), (len(some), 1))
                a, b = np.repeat(some, take.shape[1]), here[take.ravel()]
                keep = ids[a] != ids[b]
                a, b = a[keep], b[keep]
                s = exact(v[a], v[b])
                top = best(ids[a], ids[b], s, k)
                out.append(result(ids[a][top], ids[b][top], s[top]))
        return pa.Table.from_batches(out, result(np.zeros(0), np.zeros(0), np.zeros(0)).schema)

    near = asking.unionByName(standing).groupBy("number").applyInArrow(rerank, FOUND)
    found = written(ranked(near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k), "ann-found")
    if not complete:
        return found
    bounds = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
    queries = written(
        rows.where(is_query)
        .join(bounds, F.col("vec_id") == F.col("query_id"), "left")
        .select("vec_id", "v", F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("-inf"))).alias("bound")),
        "ann-queries",
    )
    count, width = queries.count(), len(sample[0])
    portions = max(1, -(-count * width * 8 // BLOCK_BYTES))
    every_row = ordered.where("ordering = 0").select("vec_id", "v")
    answers: list[DataFrame] = []
    for portion in range(portions):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(portions)) == portion).toArrow()
        sent = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), matrix(block["v"].combine_chunks()), block["bound"].to_numpy()))
        done = ranked(every_row.mapInArrow(completion(sent, window), FOUND), k)
        if portions == 1:
            return done
        # a query's answer is in one portion; each portion is a job of its own
        answers.append(written(done, "ann-done"))
    return functools.reduce(DataFrame.unionByName, answers)


def completion(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, bound = sent.value
        if not len(q_ids):
            return
        reach = np.linalg.norm(q, axis=1)
        for batch in batches:
            all_ids, all_v = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            for at in range(0, len(all_ids), window):
                ids, v = all_ids[at : at + window], all_v[at : at + window]
                centre = v.mean(axis=0)
                radius = np.linalg.norm(v - centre, axis=1).max()
                slack = 1e-9 * (1 + reach * (np.linalg.norm(centre) + radius))
                active = np.flatnonzero(q @ centre + reach * radius + slack >= bound)
                for part in range(0, len(active), 512):
                    some = active[part : part + 512]
                    a, b = np.nonzero(q[some] @ v.T >= (bound - slack)[some][:, None])
                    a = some[a]
                    keep = q_ids[a] != ids[b]
                    a, b = a[keep], b[keep]
                    s = exact(q[a], v[b]) if len(a) else np.zeros(0)
                    keep = s >= bound[a]
                    if keep.any():
                        yield result(q_ids[a[keep]], ids[b[keep]], s[keep])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
