"""Toxicity: a bidirectional gated recurrent network with attention pooling (operator 1).

Each word enters as the sum of a learned word vector (hashed) and the mean of learned vectors of
its character n-grams (hashed). Two gated recurrent units read a window of words forwards and
backwards; attention over their states pools the window, and a logistic unit scores it. A document
is read whole, as overlapping windows of ``WINDOW`` words every ``STRIDE`` words; its score is the
largest window score.

Training is numpy back-propagation (Adam) on the driver, over at most ``train_rows`` labelled
documents: negatives give windows drawn at random and their currently worst window, positives their
currently best one, as only some windows of a long document need hold what made it toxic.

Gates are linear in a word's vector before the recurrence, so a worker computes them once a word
and then only runs the recurrence over batches of windows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, fold_bucket, once, portions, with_text

WORDS, GRAMS_AT, GRAM_BUCKETS = 1 << 13, 1 << 13, 1 << 14
ROWS = WORDS + GRAM_BUCKETS
SIZES = (3, 4, 5)
INPUT, HIDDEN = 12, 8
WINDOW, STRIDE = 48, 24
#: Words that a worker remembers; its memory starts anew beyond it, between groups of texts.
REMEMBERED = 200_000
#: A word of over ``LONGEST`` bytes is read as words of ``PIECE`` bytes that overlap, so that no n-gram is lost.
LONGEST, PIECE = 96, 48
OVERLAP = max(SIZES) - 1
BATCH = 1024
LEAST_STEPS = 400
#: From the third epoch on, positives whose best window has a lower logit are taken for mislabelled.
DOUBT = -2.0


def normal(text: bytes) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and non-ASCII bytes, in lower case; long ones in pieces."""
    words = text.translate(FOLD).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONGEST else pieces(w))]


def pieces(word: bytes) -> list[bytes]:
    return [word[k : k + PIECE] for k in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


# ASCII letters in lower case, digits and non-ASCII bytes stay; the rest parts words.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of words, the word of each row, and its weight (1 for the word, 1/n for n-grams)."""
    cut = [b"<" + w + b">" for w in words]
    raw = np.frombuffer(b"".join(cut), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    owner = np.repeat(np.arange(len(cut)), sizes)
    rows = [np.array([zlib.crc32(w) % WORDS for w in words], np.int64)]
    owners = [np.arange(len(words))]
    for n in SIZES:
        if len(raw) < n:
            continue
        whole = owner[: len(raw) - n + 1] == owner[n - 1 :]
        gram = np.zeros(len(raw) - n + 1, np.uint64)
        for k in range(n):
            gram = gram << np.uint64(8) | raw[k : len(raw) - n + 1 + k]
        gram = (gram[whole] + np.uint64(n << 44)) * np.uint64(0xD6E8FEB86659FD93)
        rows.append((gram >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS + GRAMS_AT)
        owners.append(owner[: len(whole)][whole])
    at, who = np.concatenate(rows), np.concatenate(owners)
    grams = np.maximum(np.bincount(who, minlength=len(words)) - 1, 1)
    weight = np.where(at < WORDS, 1.0, 1.0 / grams[who]).astype(np.float32)
    return at, who, weight


def windows(n: int) -> list[int]:
    """Where the windows over n words start; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, the forward pass and its gradient. Word 0 is padding."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        part = lambda *s: (rng.normal(0, 1, s) / s[-2] ** 0.5).astype(np.float32)
        self.p = {
            "E": rng.normal(0, 0.3, (ROWS, INPUT)).astype(np.float32),
            "W": part(2, INPUT, 3 * HIDDEN),
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "U": part(2, HIDDEN, 3 * HIDDEN),
            "A": part(2 * HIDDEN, HIDDEN),
            "a": part(HIDDEN, 1)[:, 0],
            "o": part(2 * HIDDEN, 1)[:, 0],
            "c": np.zeros(1, np.float32),
        }

    def vectors(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """One input vector a word."""
        rows, who, weight = features(words)
        order = np.argsort(who, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))[:-1]])
        terms = self.p["E"][rows[order]] * weight[order, None]
        return np.add.reduceat(terms, starts, axis=0), (rows, who, weight)

    def gates_of(self, words: list[bytes]) -> np.ndarray:
        """Gates of many words, some thousands at a time."""
        return np.concatenate([self.gates(self.vectors(words[k : k + 4096])[0]) for k in range(0, len(words), 4096)])

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions: words x 2 x 3 HIDDEN."""
        return (vectors[None] @ self.p["W"] + self.p["b"]).transpose(1, 0, 2)

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows (ids: windows x WINDOW, 0 is padding)."""
        n, length = ids.shape
        U, H = self.p["U"], HIDDEN
        mask = (ids > 0).astype(np.float32)
        h = np.zeros((2, n, H), np.float32)
        states = np.empty((2, length, n, H), np.float32)
        trace = []
        for t in range(length):
            both = (t, length - 1 - t)
            x = np.stack([gates[ids[:, both[0]], 0], gates[ids[:, both[1]], 1]])
            m = np.stack([mask[:, both[0]], mask[:, both[1]]])[:, :, None]
            rec = h @ U
            zr = sigmoid(x[:, :, : 2 * H] + rec[:, :, : 2 * H])
            z, r = zr[:, :, :H], zr[:, :, H:]
            new = np.tanh(x[:, :, 2 * H :] + r * rec[:, :, 2 * H :])
            before = h
            h = h + m * (1 - z) * (new - h)
            states[0, both[0]], states[1, both[1]] = h[0], h[1]
            if keep:
                trace.append((before, rec, z, r, new, m))
        flat = np.concatenate([states[0], states[1]], axis=2)
        u = np.tanh(flat @ self.p["A"])
        score = u @ self.p["a"] + (mask.T - 1) * 1e4
        score -= score.max(axis=0)
        weight = np.exp(score)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, flat)
        return pooled @ self.p["o"] + self.p["c"][0], (flat, u, weight, pooled, trace, mask)

    def gradient(self, gates: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the parameters behind the gates, and of the gates."""
        logit, (flat, u, weight, pooled, trace, _) = self.forward(gates, ids, keep=True)
        n, length = ids.shape
        p, H = self.p, HIDDEN
        prob = sigmoid(logit)
        loss = -np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))
        d = (prob - y)[:, None] / n
        g = {"c": d.sum(axis=0), "o": (pooled * d).sum(axis=0)}
        d_pool = d * p["o"]
        d_weight = np.einsum("nh,tnh->tn", d_pool, flat)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", d_score, u)
        d_u = d_score[:, :, None] * p["a"] * (1 - u * u)
        g["A"] = np.einsum("tnh,tnk->hk", flat, d_u)
        d_flat = weight[:, :, None] * d_pool + d_u @ p["A"].T
        d_states = np.stack([d_flat[:, :, :H], d_flat[:, :, H:]])
        g["U"] = np.zeros_like(p["U"])
        d_gates = np.zeros_like(gates)
        d_h = np.zeros((2, n, H), np.float32)
        for t in reversed(range(length)):
            both = (t, length - 1 - t)
            before, rec, z, r, new, m = trace[t]
            d_h = d_h + np.stack([d_states[0, both[0]], d_states[1, both[1]]])
            d_new = d_h * m * (1 - z) * (1 - new * new)
            d_z = d_h * m * (before - new) * z * (1 - z)
            d_r = d_new * rec[:, :, 2 * H :] * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=2)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=2)
            g["U"] += before.transpose(0, 2, 1) @ d_rec
            d_h = d_h * (1 - m * (1 - z)) + d_rec @ p["U"].transpose(0, 2, 1)
            for k in (0, 1):
                np.add.at(d_gates[:, k], ids[:, both[k]], d_x[k])
        return float(loss), g, d_gates


def train(texts: list[tuple[bytes, int]], epochs: int = 5, rate: float = 0.01, seed: int = 11) -> Network:
    """Fit a network to (text, label) pairs; small sets get more epochs, for ``LEAST_STEPS`` steps in all."""
    net = Network()
    if not texts:
        net.p["o"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {b"": 0}
    docs: list[tuple[np.ndarray, int]] = []
    for text, y in texts:
        words = normal(text)
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        docs.append((np.stack([np.pad(ids[s : s + WINDOW], (0, max(0, WINDOW - len(ids)))) for s in windows(len(ids))]), y))
    vocabulary = list(known)
    share = min(0.9, max(0.1, sum(y for _, y in docs) / len(docs)))
    net.p["c"][0] = np.log(share / (1 - share))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    counts = np.array([len(w) for w, _ in docs])
    place = np.repeat(np.arange(len(docs)), counts)
    stacked = np.concatenate([w for w, _ in docs])
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    epochs = max(epochs, -(-LEAST_STEPS * 64 // (2 * len(docs))))
    for epoch in range(epochs):
        gates = net.gates_of(vocabulary)
        logits = np.concatenate([net.forward(gates, stacked[k : k + BATCH])[0] for k in range(0, len(stacked), BATCH)])
        order = np.lexsort((-logits, place))
        best = order[firsts]
        drawn = firsts + (rng.random(len(docs)) * counts).astype(np.int64)
        labels = np.array([y for _, y in docs])
        trusted = (labels == 0) | (epoch < 2) | (logits[best] > DOUBT)
        pick = np.concatenate([drawn if epoch == 0 else best[trusted], drawn[labels == 0]])
        mark = labels[place[pick]]
        shuffled = rng.permutation(len(pick))
        for k in range(0, len(pick), 64):
            some = shuffled[k : k + 64]
            step += 1
            _step(net, vocabulary, stacked[pick[some]], mark[some].astype(np.float32), moments, step, rate * (1 - 0.8 * epoch / epochs))
    return net


def _step(net: Network, vocabulary: list[bytes], ids: np.ndarray, y: np.ndarray, moments: dict, step: int, rate: float) -> None:
    used, local = np.unique(np.append(ids.ravel(), 0), return_inverse=True)
    local = local[:-1].reshape(ids.shape)
    vectors, (rows, who, weight) = net.vectors([vocabulary[k] for k in used])
    _, g, d_gates = net.gradient(net.gates(vectors), local, y)
    d_gates[0] = 0
    by = d_gates.transpose(1, 0, 2)
    g["b"] = by.sum(axis=1, keepdims=True)
    g["W"] = vectors.T[None] @ by
    d_vectors = (by @ net.p["W"].transpose(0, 2, 1)).sum(axis=0)
    touched, at = np.unique(rows, return_inverse=True)
    d_E = np.zeros((len(touched), INPUT), np.float32)
    np.add.at(d_E, at, d_vectors[who] * weight[:, None])
    norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
    fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    for k, v in [*g.items(), ("E", d_E)]:
        index = touched if k == "E" else slice(None)
        m, s = moments[k]
        m[index] = 0.9 * m[index] + 0.1 * v / norm
        s[index] = 0.999 * s[index] + 0.001 * (v / norm) ** 2
        net.p[k][index] -= rate * fix * m[index] / (np.sqrt(s[index]) + 1e-7)


class Scorer:
    """Whole texts to scores; remembers the gates of words."""

    def __init__(self, net: Network):
        self.net = net
        self.start()

    def start(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.gates = np.zeros((1, 2, 3 * HIDDEN), np.float32)
        self.filled = 1

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.start()
        known = self.known
        new: list[bytes] = []
        ids: list[int] = []
        lines: list[np.ndarray] = []
        place: list[int] = []
        at = 0
        for k, text in enumerate(texts):
            words = normal(text)
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
            ids += [known[w] for w in words]
            n = len(words)
            if n <= WINDOW:
                ids += [0] * (WINDOW - n)
                n = WINDOW
            starts = np.array(windows(n), np.int64) + at
            lines.append(starts)
            place += [k] * len(starts)
            at += n
        if new:
            self.add(new)
        flat = np.array(ids, np.int32)
        starts = np.concatenate(lines)
        logits = np.empty(len(starts), np.float32)
        step = np.arange(WINDOW)
        for k in range(0, len(starts), BATCH):
            logits[k : k + BATCH] = self.net.forward(self.gates, flat[starts[k : k + BATCH, None] + step])[0]
        out = np.full(len(texts), -np.inf, np.float64)
        np.maximum.at(out, np.array(place), logits)
        return sigmoid(np.clip(out, -60, 60))

    def add(self, new: list[bytes]) -> None:
        need = self.filled + len(new)
        if need > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros((2 * need - len(self.gates), 2, 3 * HIDDEN), np.float32)])
        self.gates[self.filled : need] = self.net.gates_of(new)
        self.filled = need


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (3, 1), train_rows: int = 2500, train_bytes: int = 12 << 20) -> Network:
    """Train on labelled rows whose crc32(doc_id) modulo ``held_out[0]`` is not ``held_out[1]``.

    Used are those first by a hash of doc_id, up to ``train_rows`` rows; of their texts, in that
    order, those that fit in ``train_bytes`` together. Rows without a label or id are not used;
    without any row every score is one half. From the third epoch on, positives whose best window
    has a logit below ``DOUBT`` are taken for mislabelled and passed over.
    """
    marks = (
        labels.select("doc_id", F.col(label).cast("int").alias("__y"))
        .where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_bucket("doc_id", held_out[0]) != held_out[1]))
        .groupBy("doc_id")
        .agg(F.max("__y").alias("__y"))
    )
    chosen = marks.join(docs.select("doc_id", F.octet_length("text").alias("__n")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    most, kept = 0, []
    for r in chosen.collect():
        if most + (r["__n"] or 0) <= train_bytes:
            most += r["__n"] or 0
            kept.append((r.doc_id, r["__y"]))
    if not kept:
        return train([])
    small = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(kept)), "doc_id long, __y int"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small, "doc_id").collect()
    return train([(r.text.encode(), r["__y"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))])


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """Add the probability of label 1, of the most toxic window, to every row.

    Null and empty texts are one window of padding and get the score of the bias. Texts are read
    whole, whatever their length; a column named ``column`` is replaced.
    """
    kept = docs.drop(column)
    names = kept.columns
    schema = kept.withColumn(column, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(net)
    key = f"toxicity:{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(key, lambda: Scorer(sent.value))
        for batch in batches:
            found = np.concatenate([scorer.scores(part) for part in portions(binaries(batch.column(batch.num_columns - 1)), 256 << 10)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*names, column])

    return with_text(kept, F.coalesce("text", F.lit(""))).mapInArrow(run, schema)
