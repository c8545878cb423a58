"""The chunk and registry tables on disk: append-only Parquet, with the registry as the commit log.

Every change is one version. Its chunk rows are written first, under ``chunks/version=V``; then its
registry rows, one for each file that was put or removed, are staged and renamed to
``registry/version=V``. That rename is the only commit: a file's live chunks are those of its last
version in the registry, so a run that dies in between leaves rows that nobody reads, and readers
see a change whole or not at all. A change writes what it brings and rewrites nothing; ``compact``
drops what is no longer live. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.schema import CHUNK, REGISTRY, conform

_VERSION = T.StructField("version", T.LongType())
_GONE = T.StructField("gone", T.BooleanType())


def chunk_id(path="file_path", ordinal="ordinal", text="text"):
    """A deterministic id, so that a task that runs again writes the same row."""
    return F.sha2(F.concat_ws("\x1f", F.col(path), F.col(ordinal).cast("string"), F.col(text)), 256)


class ModelMismatch(ValueError):
    """The store's vectors come from another model than the one at hand."""


class Registry:
    """The commit log: file_path, what is registered of it, its version."""

    def __init__(self, store: Store):
        self.store, self.path = store, f"{store.folder}/registry"

    def log(self) -> DataFrame:
        if not self.store.exists(self.path):
            return self.store.spark.createDataFrame([], T.StructType([*REGISTRY.fields, _GONE, _VERSION]))
        return self.store.spark.read.schema(T.StructType([*REGISTRY.fields, _GONE, _VERSION])).parquet(self.path)

    def live(self) -> DataFrame:
        """The last row of each file, with its version; removed files are left out."""
        last = F.max_by(F.struct(*[f.name for f in REGISTRY.fields], "gone", "version"), "version").alias("last")
        return self.log().groupBy("file_path").agg(last).select("last.*").where("not gone").drop("gone")

    def read(self) -> DataFrame:
        return self.live().drop("version")

    def count(self) -> int:
        return self.live().count()


class Chunks:
    """The chunks of live versions."""

    def __init__(self, store: Store):
        self.store, self.path = store, f"{store.folder}/chunks"

    def all(self) -> DataFrame:
        if not self.store.exists(self.path):
            return self.store.spark.createDataFrame([], T.StructType([*CHUNK.fields, _VERSION]))
        return self.store.spark.read.schema(T.StructType([*CHUNK.fields, _VERSION])).parquet(self.path)

    def read(self) -> DataFrame:
        live = self.store.registry.live().select("file_path", "version")
        return self.all().join(live, ["file_path", "version"], "left_semi").select(*[f.name for f in CHUNK.fields])

    def count(self) -> int:
        """From the registry alone."""
        return self.store.registry.live().agg(F.sum("chunk_count")).first()[0] or 0


class Store:
    """Chunks and registry of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.registry, self.chunks = Registry(self), Chunks(self)

    # ------------------------------------------------------------ files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _commit(self, rows: DataFrame, version: int) -> None:
        """Stage the registry rows, then rename them into the log."""
        staging = f"{self.folder}/.staging-{uuid.uuid4().hex}"
        rows.write.parquet(staging)
        fs, source = self._fs(staging)
        _, parent = self._fs(self.registry.path)
        fs.mkdirs(parent)
        if not fs.rename(source, self._fs(f"{self.registry.path}/version={version}")[1]):
            raise OSError(f"cannot commit version {version}")

    # ------------------------------------------------------------ changes

    def registered(self, paths: DataFrame) -> DataFrame:
        return paths.join(self.registry.live().select("file_path"), "file_path", "left_semi")

    def save(self, chunks: DataFrame, files: DataFrame) -> int:
        """Replace the chunks and registry rows of ``files`` (file_path, file_name, length, file_hash); how many chunks there are now."""
        return self.put(chunks, files)[1]

    def put(self, chunks: DataFrame, files: DataFrame) -> tuple[int, int]:
        """``save``; also the version that it made."""
        version = time.time_ns()
        where = f"{self.chunks.path}/version={version}"
        conform(chunks, CHUNK).write.parquet(where)
        made = self.spark.read.schema(CHUNK).parquet(where)
        counts = made.groupBy("file_path").agg(F.count("*").cast("int").alias("chunk_count"))
        rows = files.join(counts, "file_path", "left").select(
            X.path_id(F.col("file_path")).alias("doc_id"),
            "file_path",
            "file_name",
            F.current_timestamp().alias("indexed_at"),
            F.col("length").alias("file_size"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            "file_hash",
        )
        self._commit(conform(rows, REGISTRY).withColumn("gone", F.lit(False)), version)
        return version, made.count()

    def delete(self, paths: DataFrame) -> tuple[int, int]:
        """Remove files (file_path); how many were registered and how many chunks they had."""
        gone = self.registry.live().join(paths.select("file_path").distinct(), "file_path", "left_semi")
        n, chunks = gone.agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
        if n:
            self._commit(gone.select(*[f.name for f in REGISTRY.fields]).withColumn("gone", F.lit(True)), time.time_ns())
        return n, chunks

    def remove(self, path: str) -> tuple[bool, int]:
        n, chunks = self.delete(self.spark.createDataFrame([(path,)], "file_path string"))
        return n > 0, chunks

    def clear(self) -> tuple[int, int]:
        """Remove everything; how many files and chunks there were."""
        before = self.registry.count(), self.chunks.count()
        for path in (self.registry.path, self.chunks.path, f"{self.folder}/model.json"):
            self._delete(path)
        return before

    def compact(self) -> None:
        """Rewrite the live rows as one version and drop the others. Readers of before keep their files until the end."""
        old = [r.version for r in self.registry.log().select("version").distinct().collect()]
        stale = [r.version for r in self.chunks.all().select("version").distinct().collect()]
        files = self.registry.read()
        version = time.time_ns()
        self.chunks.read().write.parquet(f"{self.chunks.path}/version={version}")
        self._commit(files.withColumn("gone", F.lit(False)), version)
        for v in old:
            self._delete(f"{self.registry.path}/version={v}")
        for v in stale:
            self._delete(f"{self.chunks.path}/version={v}")

    # ------------------------------------------------------------ the model

    def check_model(self, embedder, record: bool = False) -> None:
        """Raise ``ModelMismatch`` unless the store's vectors are of this model; ``record`` it if none is known yet."""
        fs, path = self._fs(f"{self.folder}/model.json")
        if fs.exists(path):
            with_stream = fs.open(path)
            known = json.loads(bytes(with_stream.readAllBytes()).decode())
            with_stream.close()
            now = {"model_id": embedder.model_id, "dimensions": embedder.dimensions}
            if known != now:
                raise ModelMismatch(f"the store was made with {known}, not {now}")
        elif record:
            out = fs.create(path, True)
            out.write(bytearray(json.dumps({"model_id": embedder.model_id, "dimensions": embedder.dimensions}).encode()))
            out.close()


def export_html(chunks: DataFrame, folder: str) -> list[str]:
    """Debug reports: one HTML file a file name, chunks in order with their metadata. Same-named files overwrite each other."""
    from tessera.schema import DOC_LEVEL, SYMBOL_LEVEL

    present = [c for c in chunks.columns if c not in ("id", "ordinal", "text", "document", "embedding")]
    order = sorted(c for c in present if c in DOC_LEVEL) + sorted(c for c in present if c not in (*DOC_LEVEL, *SYMBOL_LEVEL)) + sorted(c for c in present if c in SYMBOL_LEVEL)
    cells = [F.concat(F.lit("<td>"), X.escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in order]
    number = F.concat(F.lit("<td>"), F.col("ordinal").cast("string"), F.lit("</td><td>"), F.octet_length("document").cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), number, *cells, F.lit("<td><pre>"), X.escaped(F.col("document")), F.lit("</pre></td></tr>"))
    grouped = chunks.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("file_path", "ordinal", row.alias("row")))).alias("rows"))
    head = "<tr><th>#</th><th>len</th>" + "".join(f"<th>{c}</th>" for c in order) + "<th>enriched_text</th></tr>"
    page = F.concat(F.lit("<html><body><table>"), F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("</table></body></html>"))
    Path(folder).mkdir(parents=True, exist_ok=True)
    written = []
    for r in grouped.select("file_name", page.alias("page")).toLocalIterator():
        path = Path(folder) / f"{r.file_name}.html"
        path.write_text(r.page, "utf-8")
        written.append(str(path))
    return sorted(written)
