"""Byte-level BPE encoding and decoding (operator 4).

Encoding keeps the symbols of a pre-token in a doubly linked list and the possible merges in a
priority queue of (rank, position). An entry whose symbols have changed since it was queued is
stale and skipped. Decoding concatenates the vocabulary's strings.

The vocabulary file is a parameter. The driver reads it and sends its text (checked to be below
``MAX_VOCABULARY_BYTES``) with the task, so executors need no local copy.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import OUT_BYTES, binaries, once, with_text

MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens whose ids a worker remembers; the memory starts anew beyond it.
REMEMBERED = 300_000
#: Longer pre-tokens are encoded but not remembered.
REMEMBERED_CHARS = 64

# Fixed value: the split pattern of byte-level BPE; white space is the Unicode property.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        values = {c: b for b, c in letters.items()}
        self.first = [vocab.get(letters[b]) for b in range(256)]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.split_added = (
            regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
            if self.added
            else None
        )
        self.known: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [i for b in piece if (i := self.first[b]) is not None]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        queue = [(rank, k, new, a, b) for rank, new, k, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, k, new, a, b = heapq.heappop(queue)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue  # stale
            ids[k], ids[right] = new, -1
            after[k] = far = after[right]
            if far >= 0:
                before[far] = k
                if m := merges.get((new, ids[far])):
                    heapq.heappush(queue, (m[0], k, m[1], new, ids[far]))
            near = before[k]
            if near >= 0 and (m := merges.get((ids[near], new))):
                heapq.heappush(queue, (m[0], near, m[1], ids[near], new))
        return [i for i in ids if i >= 0]

    def learn(self, piece: str) -> bytes:
        packed = array("i", self.merged(piece.encode())).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def plain(self, text: str) -> bytes:
        known, learn = self.known, self.learn
        return b"".join([known.get(p) or learn(p) for p in PIECES.findall(text)])

    def encode(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.plain(text)
        return b"".join(
            np.int32(self.added[s]).tobytes() if s in self.added else self.plain(s) for s in self.split_added.split(text) if s
        )

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, np.int32).tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> str:
    found = Path(path)
    if found.stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of over {MAX_VOCABULARY_BYTES} bytes: {path}")
    return found.read_text("utf-8")


def encode(docs: DataFrame, path: str, text: str | Column = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` (array<int>) and ``decoded`` (the text that the ids decode to) to every row.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded
    whole. Repeated rows each get their result; other columns pass through, and columns named like
    the new ones are replaced.
    """
    spec = vocabulary(path)
    key = "bpe:" + hashlib.sha256(spec.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    kept = docs.drop(ids, decoded)
    source = with_text(kept, F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string"))
    schema = kept.withColumns({ids: F.lit(None).cast("array<int>"), decoded: F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(key, lambda: Codec(sent.value))
        for batch in batches:
            texts = binaries(batch.column(batch.num_columns - 1))
            rest = batch.select(batch.schema.names[:-1])
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < OUT_BYTES:
                    size += 64 + 4 * len(texts[upto])
                    upto += 1
                packed = [codec.encode(t.decode("utf-8", "replace")) for t in texts[at:upto]]
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                texts_again = pa.array([codec.decode(p) for p in packed], pa.string())
                columns = [*rest.slice(at, upto - at).columns, lists, texts_again]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, ids, decoded])
                at = upto

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns, from the real ids and the decoded text."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
