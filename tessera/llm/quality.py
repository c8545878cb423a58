"""Quality classifier on supervised subword embeddings (operator 6).

A document is a bag of hashed features: each word, the character n-grams of the word (with its
boundaries) and word n-grams. Word n-grams are written with back-references, as a compressor would:
a bigram of one word twice, and a trigram that the document has had before, each become one shared
feature, so what is learned of repetition carries over to unseen words. Each feature has a learned
vector; a document is their average, and a softmax over two classes reads the average. Training is
numpy stochastic gradient descent on the driver, over at most ``train_rows`` labelled documents
whose feature counts the executors have summed.

As the read-out is linear before the softmax, a worker multiplies the vectors with it once; scoring
sums one number a feature over the whole text.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, bounded, fold_bucket, once, portions, released, with_text

BUCKETS = 1 << 15
WORD_PAIRS = 1 << 15
REPEATED_WORD, REPEATED_TRIGRAM, FEATURES = BUCKETS + WORD_PAIRS, BUCKETS + WORD_PAIRS + 1, BUCKETS + WORD_PAIRS + 2
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Words that a worker remembers; its memory starts anew beyond it, between documents.
REMEMBERED = 200_000
#: Bytes of words whose character n-grams are taken at once.
PIECE = 1 << 19


class Words:
    """Numbers for words, remembered, with the words not yet looked into."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.new: list[bytes] = []

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers, and where each text ends."""
        known, new = self.known, self.new
        found: list[int] = []
        ends = []
        for text in texts:
            for w in (words := text.split()):
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
            found += [known[w] for w in words]
            ends.append(len(found))
        return np.array(found, np.int64), np.array(ends, np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w, 11) | zlib.crc32(w, 13) << 32 for w in words], np.uint64)


def subwords(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of all words and their n-grams, and the word (by place) that each belongs to.

    Words are read whole, whatever their length; what is at hand at once is bounded by ``PIECE``.
    """
    yield (word_hashes(words) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) % BUCKETS, np.arange(len(words))
    line = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for start in range(0, len(line), PIECE):
        # n-grams that start in this piece
        raw = line[start : start + PIECE + max(GRAMS) - 1].astype(np.uint64)
        owner = np.searchsorted(ends, np.arange(start, start + len(raw)), "right")
        for n in GRAMS:
            many = min(PIECE, len(raw) - n + 1)
            if many < 1:
                continue
            whole = owner[:many] == owner[n - 1 : n - 1 + many]
            gram = np.zeros(many, np.uint64)
            for k in range(n):
                gram = gram << np.uint64(8) | raw[k : k + many]
            gram = (gram[whole] + np.uint64(n << 40)) * np.uint64(0xD6E8FEB86659FD93)
            yield (gram >> np.uint64(44)).astype(np.int64) % BUCKETS, owner[:many][whole]


def word_grams(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of bigrams and of trigrams that a text repeats, and the text each belongs to."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = text[1:] == text[:-1]
    pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pair ^= pair >> np.uint64(32)
    grams = (pair * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % WORD_PAIRS + BUCKETS
    grams[hashes[:-1] == hashes[1:]] = REPEATED_WORD
    inside = text[2:] == text[:-2]
    place = text[2:][inside]
    triple = (pair[:-1] * np.uint64(0xBF58476D1CE4E5B9) + hashes[2:])[inside] + place.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(triple, kind="stable")
    same = np.flatnonzero((triple[order][1:] == triple[order][:-1]) & (place[order][1:] == place[order][:-1]))
    again = place[order][1:][same]
    return np.concatenate([grams[within], np.full(len(again), REPEATED_TRIGRAM)]), np.concatenate([text[:-1][within], again])


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their share of all."""
    words = Words()
    numbers, _ = words.numbers([text])
    if not len(numbers):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    times = np.bincount(numbers)
    counts = np.zeros(FEATURES)
    for features, owners in subwords(words.new):
        counts += np.bincount(features, times[owners], FEATURES)
    counts += np.bincount(word_grams(word_hashes(words.new)[numbers], np.zeros(len(numbers), np.int64))[0], minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / counts.sum()).astype(np.float32)


def packed(ids: np.ndarray, part: np.ndarray) -> bytes:
    """What ``counted`` gives, in under a third of its bytes: features are in order, and their shares are few."""
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).astype(np.int32).tobytes() + part.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, part = np.frombuffer(zlib.decompress(data), np.int32).reshape(2, -1)
    return np.cumsum(ids, dtype=np.int32), part.view(np.float32)


class Packed(Sequence):
    """Rows to train on (features, shares, label), in order of their ids; each is unpacked when it is read."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        times = Counter(i for i, _, _ in rows)
        rows = sorted(rows, key=lambda r: (r[0], unpacked(r[1])[0].tobytes() if times[r[0]] > 1 else b""))
        self.data, self.labels = [d for _, d, _ in rows], [y for _, _, y in rows]

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        return *unpacked(self.data[k]), self.labels[k]


class Model:
    """Feature vectors and a softmax read-out."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias

    @classmethod
    def untrained(cls) -> Model:
        return cls(np.zeros((FEATURES, 1), np.float32), np.zeros((1, 2), np.float32), np.zeros(2, np.float32))

    @classmethod
    def trained(cls, rows: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int, rate: float, seed: int = 5) -> Model:
        if not rows:
            return cls.untrained()
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1, 1, (FEATURES, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        out = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
        share = (1 + sum(y for _, _, y in rows)) / (2 + len(rows))
        bias = np.log(np.array([1 - share, share], np.float32))
        steps = epochs * len(rows)
        done = 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                ids, part, y = rows[k]
                now = rate * (1 - done / steps)
                done += 1
                mean = part @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
                error = softmax(mean @ out + bias)
                error[y] -= 1
                back = out @ error
                out -= now * 0.1 * np.outer(mean, error)
                bias -= now * 0.01 * error
                if len(ids):
                    vectors[ids] -= (now * len(ids) ** 0.5) * part[:, None] * back
        return cls(vectors, out, bias)

    def weights(self) -> np.ndarray:
        """What one occurrence of each feature adds to the log odds of label 1, before the average."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Scorer:
    """Whole texts to scores."""

    def __init__(self, model: Model):
        self.weights = model.weights()
        self.bias = float(model.bias[1] - model.bias[0])
        self.start()

    def start(self) -> None:
        self.words = Words()
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def catch_up(self) -> None:
        if new := self.words.new:
            sums, counts = np.zeros(len(new)), np.zeros(len(new))
            for features, owners in subwords(new):
                sums += np.bincount(owners, self.weights[features], len(new))
                counts += np.bincount(owners, minlength=len(new))
            self.sums, self.counts = np.concatenate([self.sums, sums]), np.concatenate([self.counts, counts])
            self.hashes = np.concatenate([self.hashes, word_hashes(new)])
            self.words.new = []

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.words.known) > REMEMBERED:
            self.start()
        numbers, ends = self.words.numbers(texts)
        self.catch_up()
        place = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        grams, owner = word_grams(self.hashes[numbers], place)
        n = len(texts)
        total = np.bincount(place, self.sums[numbers], n) + np.bincount(owner, self.weights[grams], n)
        count = np.bincount(place, self.counts[numbers], n) + np.bincount(owner, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -60, 60)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: tuple[int, int] = (5, 0),
    train_rows: int = 4000,
    epochs: int = 8,
    rate: float = 2.0,
) -> Model:
    """Train on labelled rows whose crc32(doc_id) modulo ``held_out[0]`` is not ``held_out[1]``.

    At most ``train_rows`` of them are used: those first by a hash of doc_id, whatever the size of
    the input. The driver holds them packed, and gives their memory back to the system. Rows without a label or id are not used; without any row the model says one half.
    """
    bounded(docs.sparkSession)
    marks = (
        labels.select("doc_id", F.col(label).cast("int").alias("__y"))
        .where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_bucket("doc_id", held_out[0]) != held_out[1]))
        .groupBy("doc_id")
        .agg(F.max("__y").alias("__y"))
    )
    chosen = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [packed(*counted(text)) for text in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"i": batch.column("doc_id").cast(pa.int64()), "y": batch.column("__y"), "data": pa.array(data, pa.binary())})

    found = rows.mapInArrow(run, "i long, y int, data binary").toArrow()
    parts = Packed(list(zip(found["i"].to_pylist(), found["data"].to_pylist(), found["y"].to_pylist(), strict=True)))
    model = Model.trained(parts, epochs, rate)
    del found, parts
    released()
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row.

    Null and empty texts get the score of the bias alone. Whole texts are read, of any length; a
    column named ``column`` is replaced.
    """
    kept = docs.drop(column)
    names = kept.columns
    schema = kept.withColumn(column, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = f"quality:{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(key, lambda: Scorer(sent.value))
        for batch in batches:
            found = np.concatenate([scorer.scores(part) for part in portions(binaries(batch.column(batch.num_columns - 1)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*names, column])

    return with_text(kept, F.coalesce("text", F.lit(""))).mapInArrow(run, schema)
