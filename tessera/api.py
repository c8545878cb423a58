"""The engine's tools and resources. Each answers with a dict; errors come as {"status": "error"}."""

from __future__ import annotations

import datetime
import functools
import json
import logging
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import MOST_K, TOP_K, Settings
from tessera.ingest import Pipeline
from tessera.operators import search, stats
from tessera.operators.embed import Embedder, from_settings
from tessera.sources import files
from tessera.store import Store

# The filterable fields as the catalogue describes them.
_EQUAL, _RANGE = ["exact match", "in list"], [">=", "<="]
FILTERABLE = [
    {"name": "language", "type": "string", "description": "Programming language", "operators": _EQUAL},
    {"name": "kind", "type": "string", "description": "SCIP symbol type", "operators": _EQUAL},
    {"name": "chunk_type", "type": "string", "description": "Content type", "operators": _EQUAL},
    {"name": "file_path", "type": "string", "description": "Source file path", "operators": [*_EQUAL, "substring"]},
    {"name": "start_line", "type": "integer", "description": "Chunk start line", "operators": _RANGE},
    {"name": "end_line", "type": "integer", "description": "Chunk end line", "operators": _RANGE},
    {"name": "display_name", "type": "string", "description": "Human-readable symbol name", "operators": _EQUAL[:1]},
]


def tool(f):
    @functools.wraps(f)
    def safe(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except Exception as error:
            logging.getLogger(__name__).exception("%s failed", f.__name__)
            return {"status": "error", "message": str(error)}

    return safe


def rotating_log(path: str, level: str = "INFO", most_bytes: int = 10 << 20, backups: int = 5) -> logging.Handler:
    handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=backups, encoding="utf-8")
    handler.setLevel(level)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logging.getLogger("tessera").addHandler(handler)
    return handler


class Engine:
    """A store with its ingestion and queries."""

    def __init__(self, spark: SparkSession, folder: str | None = None, settings: Settings | None = None, embedder: Embedder | None = None, log_file: str | None = None):
        self.settings = settings or Settings()
        self.spark, self.folder = spark, folder or self.settings.persist_dir
        folder = self.folder
        self.embedder = embedder or from_settings(self.settings)
        if log_file:
            rotating_log(log_file)
        for name, level in self.settings.log_levels.items():
            logging.getLogger(name).setLevel(level.upper())
        self.store = Store(spark, folder)
        self.pipeline = Pipeline(spark, self.store, self.settings, self.embedder)
        self.last: dict | None = None
        self.tools = {
            n: getattr(self, n)
            for n in ("index_directory", "list_documents", "remove_document", "replace_document", "clear_database", "query", "list_sources", "list_filterable_fields")
        }
        self.resources = {"rag://status": self.status, "rag://supported-extensions": self.supported_extensions, "rag://stats": self.stats}

    def call(self, name: str, arguments: dict | None = None) -> str:
        """A tool by name, as JSON text."""
        found = self.tools.get(name)
        return json.dumps(found(**(arguments or {})) if found else {"error": f"unknown tool: {name}"}, indent=2, default=str)

    def read_resource(self, uri) -> str:
        found = self.resources.get(str(uri))
        return json.dumps(found() if found else {"error": f"unknown resource: {uri}"}, indent=2, default=str)

    @tool
    def index_directory(self, path: str, include_extensions: list[str] | None = None, exclude_extensions: list[str] | None = None, confirm_large: bool = False) -> dict:
        n = files.count(self.spark, path, self.settings, include_extensions)
        if n > self.settings.ingest_large_dir_threshold and not confirm_large:
            return {"status": "requires_confirmation", "file_count": n, "threshold": self.settings.ingest_large_dir_threshold, "message": "call again with confirm_large=true"}
        report = self.pipeline.ingest_directory(path, include_extensions, exclude_extensions)
        self.last = {"path": path, "at": datetime.datetime.now(datetime.UTC).isoformat(), "report": report}
        return report

    @tool
    def list_documents(self) -> dict:
        registry = self.store.registry.read()
        totals = stats.documents(registry).first()
        rows = [r.asDict() for r in registry.drop("doc_id").orderBy("file_path").toLocalIterator()]
        return {"status": "ok", "total_documents": totals.total_documents, "total_chunks": totals.total_chunks, "documents": rows}

    @tool
    def remove_document(self, file_path: str) -> dict:
        known, deleted = self.store.remove(self._plain(file_path))
        if not known and not deleted:
            return {"status": "warning", "message": f"not indexed: {file_path}", "removed": None, "chunks_deleted": 0}
        return {"status": "ok", "removed": file_path, "chunks_deleted": deleted}

    @tool
    def replace_document(self, file_path: str) -> dict:
        plain = self._plain(file_path)
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(plain)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p) or not fs.getFileStatus(p).isFile():
            return {"status": "error", "message": f"not a file: {file_path}"}
        old = self.store.chunks.read().where(F.col("file_path") == plain).count()
        done = self.pipeline.ingest_file(plain)
        return {"status": done["status"], "replaced": file_path, "old_chunks": old, "new_chunks": done["chunks_created"], "scip_enriched": done["scip_enriched"]}

    @tool
    def clear_database(self, confirm: bool = False) -> dict:
        if not confirm:
            return {"status": "rejected", "message": "confirm must be true"}
        documents, chunks = self.store.clear()
        return {"status": "ok", "documents_removed": documents, "chunks_removed": chunks}

    def search(self, question: str, top_k: int | None = None, filters: dict | None = None) -> DataFrame:
        """The ranked chunks of a question as a frame; the question is embedded by the model of the store, or refused."""
        self.store.check_model(self.embedder)
        return search.top_k(self.store.chunks.read(), self.embedder.embed([question])[0], top_k, filters)

    @tool
    def query(self, question: str, top_k: int = TOP_K, filters: dict | None = None, language_filter: str | None = None, kind_filter: str | None = None, file_path_filter: str | None = None) -> dict:
        merged = search.merged_filters(filters, language_filter, kind_filter, file_path_filter)
        chunks = self.store.chunks.read()
        if merged.get("sources"):
            bad = [r.file_path for r in search.unknown_sources(chunks, merged["sources"]).orderBy("file_path").collect()]
            if bad:
                known = [r.file_path for r in chunks.where("file_path is not null").select("file_path").distinct().orderBy("file_path").limit(20).collect()]
                return {"status": "error", "message": f"unknown sources: {bad}", "known_sources": known, "hint": "call list_sources"}
        if chunks.isEmpty():
            return {"status": "ok", "question": question, "chunks": [], "message": "nothing is indexed", "filters_applied": merged}
        found = []
        for r in self.search(question, min(top_k, MOST_K), merged).collect():
            row = r.asDict()
            found.append({"text": row.pop("document"), "score": row.pop("score"), "metadata": {k: v for k, v in row.items() if v is not None and k not in ("text", "ordinal")}})
        return {"status": "ok", "question": question, "chunks": found, "filters_applied": merged}

    @tool
    def list_sources(self) -> dict:
        out: dict[str, list] = {name: [] for name in stats.FACETS}
        for r in stats.facets(self.store.chunks.read()).orderBy("facet", "value").toLocalIterator():
            out[r.facet].append(r.value)
        return {"status": "ok", **out}

    @tool
    def list_filterable_fields(self) -> dict:
        return {"status": "ok", "fields": FILTERABLE}

    @tool
    def status(self) -> dict:
        totals = stats.documents(self.store.registry.read()).first()
        return {
            "server": "tessera",
            "version": "0.1.0",
            "status": "running",
            "database": {"persist_dir": self.folder, "total_documents": totals.total_documents, "total_chunks": self.store.chunks.count()},
            "last_indexation": self.last,
        }

    @tool
    def supported_extensions(self) -> dict:
        s = self.settings
        tools = s.scip_indexers | {"csharp": s.scip_indexers.get("dotnet")}
        return {
            "code_extensions": {x: {"parser": "structural", "language": lang, "scip": tools.get(lang)} for x, lang in s.code_extensions.items()},
            "structured_extensions": {x: {"parser": "json" if x == ".json" else "ElementTree"} for x in sorted(s.structured_extensions)},
            "document_extensions": {x: {"reader": "markdown or converter"} for x in sorted(s.document_extensions)},
            "total_extensions": len(s.supported),
        }

    @tool
    def stats(self) -> dict:
        chunks = self.store.chunks.read()
        out: dict = {"total_chunks": chunks.count(), "total_documents": self.store.registry.count(), **{f"by_{c}": {} for c in stats.CHUNK_COUNTS}}
        for r in stats.counts(chunks, stats.CHUNK_COUNTS).orderBy("facet", F.desc("n"), "value").collect():
            out[f"by_{r.facet}"][r.value] = r.n
        return out

    @staticmethod
    def _plain(path: str) -> str:
        return path.replace("\\", "/").removeprefix("file://")
