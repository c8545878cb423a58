"""Scan, chunk, enrich, embed, store: in batches that stop at the first failure, or all batches in one pass."""

from __future__ import annotations

import itertools
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import headers
from tessera.functions import text as X
from tessera.operators import chunking, embed, graph
from tessera.operators.ordering import numbered
from tessera.sources import files, symbols
from tessera.store import Store, chunk_id, export_html

log = logging.getLogger(__name__)

#: So many batches run one by one; those of a larger tree share one pass and one commit.
FEW_BATCHES = 4
#: Files and bytes of a task of that pass, where the cluster's cores do not ask for smaller ones.
TASK_FILES, TASK_BYTES = 1000, 32 << 20


def prepared(spark: SparkSession, chunks: DataFrame, settings: Settings, embedder: embed.Embedder, indexes: list[str] | None = None) -> DataFrame:
    """Chunks to finished chunk rows: one lazy plan."""
    chunks = chunks.withColumn("id", chunk_id())
    if indexes:
        declared, seen = symbols.read(spark, indexes)
        chunks = graph.enriched(chunks, declared, symbols.spans(seen))
    text = chunks.withColumn("document", headers.embed_text(F.col("text"), F.col("chunk_type")))
    return embed.embedded(text, embedder, batch=settings.embed_batch_size)


class Pipeline:
    """Ingestion into a store."""

    def __init__(self, spark: SparkSession, store: Store, settings: Settings | None = None, embedder: embed.Embedder | None = None):
        self.spark, self.store = spark, store
        self.settings = settings or Settings()
        self.embedder = embedder or embed.from_settings(self.settings)

    def ingest_batch(self, found: DataFrame, indexes: list[str] | None) -> dict:
        """Chunk and save some files in one commit, which makes their stale chunks go.

        A file that cannot be chunked is reported in ``errors`` and keeps no chunks; the others go on.
        """
        done = self._ingest(found, indexes)
        done["errors"] = [f"Error on {path}: {error}" for path, error in done["errors"]]
        return {name: done[name] for name in ("files", "chunks_created", "scip_enriched", "errors")}

    def _ingest(self, found: DataFrame, indexes: list[str] | None) -> dict:
        """``ingest_batch`` with errors as (path, message), and the version that it made."""
        self.store.check_model(self.embedder, record=True)
        found = found.persist()
        try:
            made = chunking.chunk_files(found, self.settings).persist()
            try:
                errors = [(r.file_path, r.error) for r in made.where("error is not null").select("file_path", "error").orderBy("file_path").collect()]
                chunks = prepared(self.spark, made.where("error is null").drop("error"), self.settings, self.embedder, indexes)
                good = found.join(made.where("error is not null").select("file_path"), "file_path", "left_anti") if errors else found
                listed = good.select("file_path", "file_name", "length", X.content_hash(F.col("content")).alias("file_hash"))
                version, saved = self.store.put(chunks, listed)
                enriched = 0
                if self.settings.embed_builder_debug or indexes:
                    live = self.store.chunks.read().join(listed.select("file_path"), "file_path", "left_semi")
                    if self.settings.embed_builder_debug:
                        export_html(live, self.settings.embed_builder_debug_output_dir)
                    enriched = live.agg(F.count("symbol")).first()[0] if indexes else 0
                if errors:
                    log.error("%d files failed", len(errors))
                return {"files": listed.count(), "chunks_created": saved, "scip_enriched": enriched, "errors": errors, "version": version}
            finally:
                made.unpersist()
        finally:
            found.unpersist()

    def ingest_directory(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None, purge: bool = False) -> dict:
        """Files in order of lower path, ``ingest_batch_size`` at a time. A failing batch ends the run with status "partial".

        The directory is listed once and each file is read once, by its batch. Files that are gone or
        cannot be read or chunked are errors of their batch, which goes on. With ``purge`` registered
        files under ``root`` that are gone from the scan are removed.

        More than a few batches are one pass with one commit, so that jobs do not grow with their
        number; the reports are still each batch's own. If that pass fails, nothing of it is
        committed, and the batches run one by one, so that those before the failing one stay.
        """
        began = time.time()
        size = self.settings.ingest_batch_size
        cores = self.spark.sparkContext.defaultParallelism
        found = files.scan(self.spark, root, self.settings, include, exclude, skip=True)
        listing = found.drop("content").coalesce(4 * cores).persist()
        try:
            kinds = listing.groupBy("parser", "language").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect()
            by: dict[str, dict] = {"parser": {}, "language": {}}
            for r in kinds:
                for name in by:
                    if r[name]:
                        by[name][r[name]] = by[name].get(r[name], 0) + r.n
            n, volume = sum(r.n for r in kinds), sum(r.bytes for r in kinds)
            report = {"status": "ok", "files_processed": 0, "chunks_created": 0, "scip_enriched": 0, "errors": [], "batches": [], "batches_completed": 0, "batches_failed": 0}
            indexes = files.symbol_indexes(self.spark, root)
            whole = False
            # debug pages are written batch by batch, as those of the same name overwrite each other
            if n > FEW_BATCHES * size and not self.settings.embed_builder_debug:
                try:
                    self._ingest_all(found.coalesce(max(2 * cores, n // TASK_FILES, volume // TASK_BYTES)), listing, indexes, report)
                    whole = True
                except Exception:
                    log.exception("the pass over all batches failed; they run one by one")
            if not whole:
                self._ingest_each(listing, indexes, report)
            if purge and report["status"] == "ok":
                base = root.removeprefix("file://").rstrip("/") + "/"
                gone = self.store.registry.read().where(F.col("file_path").startswith(base)).join(listing.select("file_path"), "file_path", "left_anti").select("file_path")
                self.store.delete(gone)
        finally:
            listing.unpersist()
        elapsed = time.time() - began
        report["ingestion_stats"] = {
            "elapsed_seconds": round(elapsed, 2),
            "files_per_second": round(report["files_processed"] / elapsed, 2) if elapsed else 0.0,
            "by_parser": by["parser"],
            "by_language": by["language"],
        }
        return report | {"total_files": report["files_processed"], "total_chunks": report["chunks_created"]}

    def _ingest_each(self, listing: DataFrame, indexes: list[str] | None, report: dict) -> None:
        """Batch after batch, each in a commit of its own, until one fails."""
        size = self.settings.ingest_batch_size
        paths = (r.path for r in files.ordered(listing).select("path").toLocalIterator())
        k = 0
        while some := list(itertools.islice(paths, size)):
            try:
                done = self.ingest_batch(files.load(self.spark, some, self.settings), indexes)
                lost = done["errors"] + self._unread(some, done)
                _add(report, k, done["files"], done["chunks_created"], lost)
                report["scip_enriched"] += done["scip_enriched"]
            except Exception as error:
                log.exception("batch %d failed", k)
                report["batches"].append({"batch_index": k, "error": str(error)})
                report["batches_failed"] += 1
                report["status"] = "partial"
                break
            k += 1

    def _ingest_all(self, found: DataFrame, listing: DataFrame, indexes: list[str] | None, report: dict) -> None:
        """All files in one pass and one commit; what is reported of each batch is read off the registry."""
        done = self._ingest(found, indexes)
        ordered = numbered(listing.select(F.lower("file_path").alias("lower"), "file_path"), ["lower", "file_path"], "place")
        saved = self.store.registry.log().where(F.col("version") == done["version"]).select("file_path", "chunk_count")
        batch = F.floor((F.col("place") - 1) / self.settings.ingest_batch_size).cast("long").alias("batch")
        placed = ordered.select(batch, "file_path").join(saved, "file_path", "left").persist()
        try:
            per = placed.groupBy("batch").agg(F.count("chunk_count").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count("*").alias("n")).orderBy("batch").collect()
            said, lost = dict(done["errors"]), {}
            if any(r.files < r.n for r in per):
                for r in placed.where("chunk_count is null").orderBy("file_path").collect():
                    lost.setdefault(r.batch, []).append(r.file_path)
        finally:
            placed.unpersist()
        for r in per:
            some = sorted(lost.get(r.batch, []), key=lambda p: p not in said)  # unread files come last, as in a batch of its own
            _add(report, r.batch, r.files, r.chunks, [f"Error on {p}: {said.get(p, 'cannot be read')}" for p in some])
        report["scip_enriched"] += done["scip_enriched"]

    def _unread(self, paths: list[str], done: dict) -> list[str]:
        """Errors for files of a batch that the reader skipped, as they were gone or unreadable by then."""
        if done["files"] + len(done["errors"]) == len(paths):
            return []
        plain = self.spark.createDataFrame([(p,) for p in paths], "path string").select(files.plain_path(F.col("path")).alias("file_path"))
        known = {e.split(": ")[0] for e in done["errors"]}
        lost = [r.file_path for r in plain.join(self.store.registry.live().select("file_path"), "file_path", "left_anti").orderBy("file_path").collect()]
        return [f"Error on {p}: cannot be read" for p in lost if f"Error on {p}" not in known]

    def ingest_file(self, path: str) -> dict:
        """One file; its symbol index is looked up from its folder."""
        plain = path.removeprefix("file://")
        found = self.spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
        named = found.select(F.lit(plain).alias("file_path"), files.base_name(F.lit(plain)).alias("file_name"), files.suffix(F.lit(plain)).alias("suffix"), "length", "content")
        indexes = files.symbol_indexes(self.spark, path.rsplit("/", 1)[0])
        return {"status": "ok", **self.ingest_batch(files.classified(named, self.settings), indexes)}


def _add(report: dict, k: int, n: int, chunks: int, errors: list[str]) -> None:
    """A batch that is done."""
    report["batches"].append({"batch_index": k, "files_processed": n, "chunks_created": chunks, "errors": errors})
    report["batches_completed"] += 1
    report["files_processed"] += n
    report["chunks_created"] += chunks
    report["errors"] += errors
