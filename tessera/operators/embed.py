"""Embedders: an offline one by feature hashing, an HTTP one, and the batched operator."""

from __future__ import annotations

import http.client
import json
import logging
import math
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings

log = logging.getLogger(__name__)


class Embedder(Protocol):
    """Texts to vectors. ``model_id`` and ``dimensions`` are stored with a table and must agree at query time."""

    model_id: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Words and word pairs hashed into signed buckets, L2-normalised. Deterministic and offline."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.model_id = f"hashed-words-{dimensions}"
        self._known: dict[str, tuple[int, bytes]] = {}

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        known, words = self._known, re.findall(r"\w+", text.lower())
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode()), b" " + w.encode()
        found = [known[w] for w in words]
        # the checksum of a pair goes on from that of its first word
        hashes = [h for h, _ in found] + [zlib.crc32(tail, head) for (head, _), (_, tail) in zip(found, found[1:])]
        h = np.array(hashes, np.int64)
        out = np.bincount(h % self.dimensions, np.where(h >> 31, 1.0, -1.0), self.dimensions).tolist()
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class HttpEmbedder:
    """An embedding server with an ``/api/embed`` route. A connection is kept open while the server allows it.

    Without ``dimensions`` the server is asked once, on first use.
    """

    def __init__(self, base_url: str, model: str, dimensions: int | None = None, timeout: float = 120):
        self.base_url, self.model_id, self.timeout, self._dimensions = base_url.rstrip("/"), model, timeout, dimensions
        self._open = None

    def __getstate__(self):
        return {**self.__dict__, "_open": None}

    @property
    def dimensions(self) -> int:
        if self._dimensions is None:
            self._dimensions = len(self.embed(["dimensions"])[0])
        return self._dimensions

    def _answer(self, body: bytes) -> dict:
        at = urllib.parse.urlsplit(self.base_url)
        for fresh in (False, True):
            if self._open is None or fresh:
                kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
                self._open = kind(at.netloc, timeout=self.timeout)
            try:
                self._open.request("POST", f"{at.path}/api/embed", body, {"Content-Type": "application/json"})
                answer = self._open.getresponse()
                said = answer.read()
                break
            except (http.client.HTTPException, ConnectionError):  # the server closed a kept connection
                if fresh:
                    raise
        if answer.status != 200:
            raise OSError(f"status {answer.status}: {said[:200]!r}")
        return json.loads(said)

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model_id, "input": texts}).encode()
        try:
            return self._answer(body)["embeddings"]
        except Exception:
            log.error("embedding of %d texts failed at %s with model %s", len(texts), self.base_url, self.model_id)
            raise


def from_settings(settings: Settings) -> Embedder:
    """The embedder that the settings name: the server, or the offline one."""
    if settings.embedder == "server":
        return HttpEmbedder(settings.ollama_base_url, settings.ollama_embedding_model)
    return HashEmbedder()


def embedded(df: DataFrame, embedder: Embedder, text: str = "document", out: str = "embedding", batch: int = 50) -> DataFrame:
    """Add ``out`` by batches of ``batch`` texts, in Arrow batches on the executors."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = [t or "" for t in s]
            found: list = []
            for k in range(0, len(texts), batch):
                found += embedder.embed(texts[k : k + batch])
            yield pd.Series(found)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))
