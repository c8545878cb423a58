"""Registered queries that run the store, the ingestion and the engine themselves, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.ingest import Pipeline
from tessera.operators import code, embed, graph, search
from tessera.operators.batches import bounded
from tessera.sources import files
from tessera.store import Store, chunk_id

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; a machine's own only where none is set, as in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/tessera/engine-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- store


def stored(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame, DataFrame]:
    """A store of all documents: a file a source, a chunk a document. Also its rows."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("file_path"), F.col("doc_id").cast("int").alias("ordinal"), "text", F.col("n_chars").cast("int").alias("end_line"), F.col("lang").alias("language")).withColumn("id", chunk_id())
    store = Store(spark, workspace(spark))
    store.save(chunks, listed(chunks))
    return store, chunks, docs


def listed(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.sum("end_line").alias("length")).withColumns({"file_name": files.base_name(F.col("file_path")), "file_hash": F.lit(None).cast("string")})


def seen(store: Store) -> DataFrame:
    return store.chunks.read().select(F.col("ordinal").cast("long").alias("doc_id"), F.col("file_path").alias("source"), F.col("end_line").cast("long").alias("n_chars"))


@query("""SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src3'
UNION ALL SELECT doc_id + 1000000, source, n_chars * 2 FROM documents WHERE source = 'src3'""")
def replace_document(spark, sf_dir):
    store, chunks, _ = stored(spark, sf_dir)
    new = chunks.where("file_path = 'src3'").withColumns({"ordinal": F.col("ordinal") + 1000000, "end_line": F.col("end_line") * 2})
    store.save(new, listed(new))
    return seen(store)


@query("SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN ('src0', 'none')")
def remove_document(spark, sf_dir):
    store, _, _ = stored(spark, sf_dir)
    store.delete(spark.createDataFrame([("src0",), ("none",)], "file_path string"))
    return seen(store)


@query("SELECT DISTINCT source AS file_path FROM documents WHERE source <> 'src1'")
def registered_files(spark, sf_dir):
    store, _, docs = stored(spark, sf_dir)
    store.remove("src1")
    asked = docs.select(F.col("source").alias("file_path")).unionByName(spark.createDataFrame([("nowhere",)], "file_path string")).distinct()
    return store.registered(asked)


@query("""SELECT sha256(source) AS doc_id, source AS file_path, source AS file_name, CAST(sum(n_chars) AS BIGINT) AS file_size, CAST(count(*) AS INTEGER) AS chunk_count
FROM documents GROUP BY source""")
def registry_rows(spark, sf_dir):
    store, _, _ = stored(spark, sf_dir)
    return store.registry.read().select("doc_id", "file_path", "file_name", "file_size", "chunk_count")


@query("""SELECT count(DISTINCT source) - 1 AS documents_removed, count(*) FILTER (WHERE source <> 'src2') AS chunks_removed, 0 AS documents_left, 0 AS chunks_left FROM documents""")
def clear_counts(spark, sf_dir):
    """What a clear reports: counted before it deletes."""
    store, _, _ = stored(spark, sf_dir)
    store.remove("src2")
    documents, chunks = store.clear()
    return spark.createDataFrame([(documents, chunks, store.registry.count(), store.chunks.count())], "documents_removed long, chunks_removed long, documents_left int, chunks_left int")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN ('src4')")
def compacted_store(spark, sf_dir):
    store, chunks, _ = stored(spark, sf_dir)
    store.save(chunks, listed(chunks))
    store.remove("src4")
    store.compact()
    return seen(store)


@query("SELECT doc_id, sha256(concat_ws(chr(31), source, CAST(doc_id AS VARCHAR), text)) AS id FROM documents")
def chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunk_id("source", "doc_id").alias("id"))


# ---------------------------------------------------------------- ingestion of a tree of files


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A file for each supplier, of five kinds, in a folder for each nation; its place."""
    s, name = F.col("s_suppkey"), F.col("s_name")
    kind = s % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("intro\n# "), name, F.lit("\nbody "), s.cast("string"), F.lit("\n")))
        .when(kind == 1, F.concat(F.lit('{"n": '), s.cast("string"), F.lit("}")))
        .when(kind == 2, F.concat(F.lit("<r><a>"), s.cast("string"), F.lit("</a></r>")))
        .when(kind == 3, F.concat(F.lit("\n\ndef f():\n    return "), s.cast("string"), F.lit("\n")))
        .otherwise(F.concat(F.lit("zz"), s.cast("string")))
    )
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".json", ".xml", ".py", ".dll"))), (kind + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("/S"), s, suffix).alias("path"), text.alias("text"))
    folder = f"{workspace(spark)}/tree"
    put(folder, rows)
    return folder


def put(folder: str, rows: DataFrame) -> None:
    """Write ``text`` to each ``path`` (folder/name) of the folder, by all executors; null deletes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    if store.get_file_info(f"{base}/{path}").type != fs.FileType.NotFound:  # a task that runs again
                        store.delete_file(f"{base}/{path}")
                    continue
                if (top := path.split("/")[0]) not in made:
                    store.create_dir(f"{base}/{top}", recursive=True)
                    made.add(top)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(write, "n long").agg(F.sum("n")).collect()


_FILES = """f AS (SELECT s_suppkey AS k, s_suppkey % 5 AS m, s_nationkey AS nation, 'S' || s_suppkey || ['.md', '.json', '.xml', '.py', '.dll'][s_suppkey % 5 + 1] AS file_name, s_name AS name FROM supplier),
t AS (SELECT *, CASE m WHEN 0 THEN 'intro' || chr(10) || '# ' || name || chr(10) || 'body ' || k || chr(10) WHEN 1 THEN '{"n": ' || k || '}' WHEN 2 THEN '<r><a>' || k || '</a></r>'
  WHEN 3 THEN chr(10) || chr(10) || 'def f():' || chr(10) || '    return ' || k || chr(10) END AS text FROM f WHERE m < 4)"""


@query("WITH " + _FILES + """ SELECT file_name, CAST(octet_length(encode(text)) AS BIGINT) AS length, ['document', 'structured', 'structured', 'code'][m + 1] AS file_type,
CASE WHEN m = 3 THEN 'python' END AS language, ['document', 'json', 'xml', 'code'][m + 1] AS parser FROM t""")
def scanned_tree(spark, sf_dir):
    return files.scan(spark, tree(spark, sf_dir)).select("file_name", "length", "file_type", "language", "parser")


@query("SELECT count(*) FILTER (WHERE s_suppkey % 5 < 4) AS all_files, count(*) FILTER (WHERE s_suppkey % 5 = 1) AS json_files, 0 AS missing FROM supplier")
def prescan_counts(spark, sf_dir):
    folder = tree(spark, sf_dir)
    return spark.createDataFrame([(files.count(spark, folder), files.count(spark, folder, include=[".JSON"]), files.count(spark, f"{folder}/none"))], "all_files long, json_files long, missing int")


@query("WITH " + _FILES + """, n AS (SELECT *, row_number() OVER (ORDER BY lower('n' || nation || '/' || file_name)) AS place FROM t)
SELECT (place - 1) // 40 AS batch_index, count(*) AS files_processed, count(*) AS chunks_created, 0 AS n_errors FROM n GROUP BY 1""")
def ingest_batches(spark, sf_dir):
    """The batch reports of a run of the pipeline."""
    report = Pipeline(spark, Store(spark, workspace(spark)), config.Settings(ingest_batch_size=40)).ingest_directory(tree(spark, sf_dir))
    rows = [(b["batch_index"], b["files_processed"], b["chunks_created"], len(b["errors"])) for b in report["batches"]]
    return spark.createDataFrame(rows, "batch_index long, files_processed long, chunks_created long, n_errors int")


@query("WITH " + _FILES + """ SELECT 'ok' AS status, count(*) AS total_files, count(*) AS total_chunks, count(*) FILTER (WHERE m = 3) AS python_files,
count(*) FILTER (WHERE m = 1) AS json_files, CAST(ceil(count(*) / 60) AS BIGINT) AS batches FROM t""")
def ingest_totals(spark, sf_dir):
    report = Pipeline(spark, Store(spark, workspace(spark)), config.Settings(ingest_batch_size=60)).ingest_directory(tree(spark, sf_dir))
    by = report["ingestion_stats"]
    row = (report["status"], report["total_files"], report["total_chunks"], by["by_language"].get("python", 0), by["by_parser"].get("json", 0), report["batches_completed"])
    return spark.createDataFrame([row], "status string, total_files long, total_chunks long, python_files long, json_files long, batches long")


@query("WITH " + _FILES + """ SELECT file_name, 0 AS ordinal,
CASE m WHEN 0 THEN 'intro' || chr(10) || chr(10) || '# ' || name || chr(10) || 'body ' || k WHEN 1 THEN '{' || chr(10) || '  "n": ' || k || chr(10) || '}' WHEN 2 THEN '<a>' || k || '</a>'
  ELSE 'def f():' || chr(10) || '    return ' || k END AS text,
['document', 'structured', 'structured', 'code'][m + 1] AS chunk_type, CASE WHEN m = 3 THEN 'python' WHEN m = 1 THEN 'json' WHEN m = 2 THEN 'xml' END AS language,
CASE WHEN m = 0 THEN 'md' END AS doc_type, CASE WHEN m = 0 THEN 'Introduction' END AS section_title, CASE WHEN m = 0 THEN 'Introduction > ' || name END AS section_hierarchy,
CASE WHEN m = 1 THEN '$.n' END AS json_path, CASE WHEN m = 2 THEN '/r/a' END AS xml_path, CASE m WHEN 0 THEN 1 WHEN 3 THEN 3 END AS start_line FROM t""")
def ingested_chunks(spark, sf_dir):
    """What the store holds after a run over files of all kinds."""
    store = Store(spark, workspace(spark))
    Pipeline(spark, store).ingest_directory(tree(spark, sf_dir))
    found = store.chunks.read()
    line = F.when(F.col("chunk_type") != "structured", F.col("start_line"))
    return found.select("file_name", "ordinal", "text", "chunk_type", "language", "doc_type", "section_title", "section_hierarchy", "json_path", "xml_path", line.alias("start_line"))


@query("WITH " + _FILES + """ SELECT file_name, CAST(octet_length(encode(text)) AS BIGINT) AS file_size, 1 AS chunk_count, substr(sha256(text), 1, 16) AS file_hash FROM t""")
def ingested_registry(spark, sf_dir):
    store = Store(spark, workspace(spark))
    Pipeline(spark, store).ingest_directory(tree(spark, sf_dir))
    return store.registry.read().select("file_name", "file_size", "chunk_count", "file_hash")


@query("WITH " + _FILES + """ SELECT file_name, CASE WHEN m = 0 THEN 'new words ' || k END AS text FROM t WHERE m <> 1""")
def ingested_again(spark, sf_dir):
    """Markdown files changed and JSON files gone by the second run, which purges."""
    folder = tree(spark, sf_dir)
    store = Store(spark, workspace(spark))
    pipeline = Pipeline(spark, store)
    pipeline.ingest_directory(folder)
    listed = files.scan(spark, folder, include=[".md", ".json"], content=False).select(F.substring_index("file_path", "/", -2).alias("path"), "file_name", "suffix")
    number = F.regexp_extract("file_name", r"^S(\d+)\.", 1)
    put(folder, listed.select("path", F.when(F.col("suffix") == ".md", F.concat(F.lit("new words "), number)).alias("text")))
    pipeline.ingest_directory(folder, purge=True)
    return store.chunks.read().select("file_name", F.when(F.col("doc_type") == "md", F.col("text")).alias("text"))


@query("WITH " + _FILES + """ SELECT file_name, 'ok' AS status, 1 AS chunks_created FROM t WHERE k = 3 OR k = 0""")
def ingested_file(spark, sf_dir):
    """Single files, each by its path."""
    folder = tree(spark, sf_dir)
    pipeline = Pipeline(spark, Store(spark, workspace(spark)))
    rows = []
    for r in files.scan(spark, folder, content=False).where("file_name in ('S0.md', 'S3.py')").select("path", "file_name").collect():
        done = pipeline.ingest_file(r.path)
        rows.append((r.file_name, done["status"], done["chunks_created"]))
    return spark.createDataFrame(rows, "file_name string, status string, chunks_created int")


# ---------------------------------------------------------------- embedding and query


class Counting:
    """An embedder whose vectors can be read off a text: its length, its words, and one."""

    model_id, dimensions = "counting", 3

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


_COUNTS = "v AS (SELECT doc_id, source, lang, text, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS b FROM documents)"


@query("WITH " + _COUNTS + " SELECT doc_id, a AS chars, b AS spaces, CAST(1 AS DOUBLE) AS one FROM v")
def embedded_batches(spark, sf_dir):
    out = embed.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), Counting(), "text", batch=7)
    return out.select("doc_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("chars", "spaces", "one"))])


@query("WITH " + _COUNTS + """, q AS (SELECT 40.0::DOUBLE AS a, 9.0::DOUBLE AS b), s AS (
SELECT sha256(concat_ws(chr(31), source, CAST(doc_id AS VARCHAR), text)) AS id, source AS file_path, (v.a * q.a + v.b * q.b + 1) / (sqrt(v.a * v.a + v.b * v.b + 1) * sqrt(q.a * q.a + q.b * q.b + 1)) AS c
FROM v, q WHERE lang IN ('en', 'de'))
SELECT id, file_path, round(c, 4) AS score FROM s ORDER BY c DESC, id LIMIT 9""")
def engine_query(spark, sf_dir):
    """The engine's own search over a store, by a question's vector and filters."""
    from tessera.api import Engine

    store, chunks, _ = stored(spark, sf_dir)
    store.clear()
    vectors = embed.embedded(chunks, Counting(), "text").withColumn("document", F.col("text"))
    store.save(vectors, listed(chunks))
    found = Engine(spark, store.folder, embedder=Counting()).search("x" * 31 + " " * 9, 9, {"languages": ["en", "de"], "kinds": []})
    return found.select("id", "file_path", "score")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND contains(source, 'src1')")
def merged_filters(spark, sf_dir):
    """Older arguments beside filters."""
    merged = search.merged_filters({"languages": ["en"]}, "de", None, "src1")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("file_path"))
    return docs.where(search.predicate(merged)).select("doc_id")


# ---------------------------------------------------------------- scalars and sets


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text || '<&">''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM documents""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escaped(F.concat("text", F.lit("<&\">'"))).alias("escaped"))


@query("SELECT DISTINCT p_size, CAST(round_even(p_size * 0.2, 0) AS INTEGER) AS overlap FROM part")
def chunk_overlaps(spark, sf_dir):
    sizes = [r.p_size for r in table(spark, sf_dir, "part").select("p_size").distinct().collect()]  # at most a few dozen sizes
    return spark.createDataFrame([(n, config.Settings(chunk_size=n).chunk_overlap) for n in sizes], "p_size int, overlap int")


@query("""SELECT * FROM (VALUES ('.cs'), ('.md')) t(suffix)""")
def suffix_sets(spark, sf_dir):
    kept, _ = files.wanted_suffixes(config.Settings(), [".CS", ".md", ".py"], [".Py", ".x.y"])
    return spark.createDataFrame([(s,) for s in kept], "suffix string")


_PIECES = """line AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g') AS t FROM documents),
sentence AS (SELECT doc_id, s, k FROM (SELECT doc_id, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM line) WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
word AS (SELECT doc_id, k, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS w FROM sentence),
piece AS (SELECT doc_id, k, 0 AS j, s AS p, len(w) AS n FROM word WHERE len(w) <= 64
  UNION ALL SELECT doc_id, k, j, array_to_string(w[j + 1 : j + 64], ' '), len(w[j + 1 : j + 64]) FROM (SELECT *, unnest(range(0, len(w), 64)) AS j FROM word WHERE len(w) > 64)),
doc AS (SELECT doc_id, list(p ORDER BY k, j) AS p, list(n ORDER BY k, j) AS n FROM piece GROUP BY doc_id),
sums AS (SELECT doc_id, p, n, list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1 : i]), 0)) AS c FROM doc)"""


@query("WITH RECURSIVE " + _PIECES + """, step AS (
  SELECT doc_id, 0 AS ordinal, 0 AS first, greatest(1, len(list_filter(range(1, len(n) + 1), lambda j: c[j + 1] <= 64))) AS last FROM sums
  UNION ALL
  SELECT doc_id, ordinal + 1, first, first + greatest(1, len(list_filter(range(first + 1, len(n) + 1), lambda j: c[j + 1] - c[first + 1] <= 64))) FROM (
    SELECT s.doc_id, ordinal, n, c, last - len(list_filter(range(first + 1, last), lambda b: c[last + 1] - c[b + 1] <= least(12, 64 - n[last + 1]))) AS first
    FROM step s JOIN sums USING (doc_id) WHERE last < len(n)))
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, trim(array_to_string(p[first + 1 : last], ' '), ' ' || chr(9) || chr(10) || chr(13)) AS chunk FROM step JOIN sums USING (doc_id)""")
def sentence_chunks(spark, sf_dir):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = code.sentences(text or "", 64, 12)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key] * len(found), pa.int64()), "ordinal": pa.array(range(len(found)), pa.int32()), "chunk": pa.array(found, pa.string())})

    bounded(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, ordinal int, chunk string")


# ---------------------------------------------------------------- symbol paths


def placed(spark: SparkSession, sf_dir: str, relative, index) -> tuple[DataFrame, DataFrame]:
    """Customers as chunks of files, suppliers as symbols of files."""
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/W/src/Ab"), F.col("c_custkey") % 20, F.lit(".cs")).alias("file_path"), (F.col("c_custkey") + 1).cast("int").alias("start_line"), (F.col("c_custkey") + 6).cast("int").alias("end_line"))
    symbols = table(spark, sf_dir, "supplier").select(index.cast("int").alias("index_ord"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("symbol"), (F.col("s_suppkey") * 13 % 1500).cast("int").alias("start"), relative.alias("relative_path"))
    return chunks, symbols


_BEST = """, r AS (SELECT c_custkey, y.symbol, row_number() OVER (PARTITION BY c_custkey ORDER BY y.ix,
  CASE WHEN pos BETWEEN c_custkey AND c_custkey + 5 THEN 1 WHEN pos <= c_custkey THEN 2 ELSE 3 END,
  CASE WHEN pos BETWEEN c_custkey AND c_custkey + 5 THEN pos WHEN pos <= c_custkey THEN -pos ELSE pos END, ord) AS k FROM c JOIN y ON {on})
SELECT c.c_custkey, r.symbol FROM c LEFT JOIN r ON r.c_custkey = c.c_custkey AND k = 1"""


@query("""WITH c AS (SELECT c_custkey, '/w/src/ab' || (c_custkey % 20) || '.cs' AS path, 'ab' || (c_custkey % 20) || '.cs' AS name FROM customer),
y AS (SELECT s_suppkey AS ord, s_name AS symbol, s_suppkey * 13 % 1500 AS pos, 0 AS ix, CASE WHEN s_suppkey % 3 = 0 THEN 'b' || (s_suppkey % 20) || '.cs' ELSE 'lib/xab' || (s_suppkey % 20) || '.cs' END AS rel FROM supplier)"""
       + _BEST.format(on="ends_with(c.path, y.rel) OR ends_with(y.rel, c.name)"))
def loose_paths(spark, sf_dir):
    """Paths that end in each other's names, not by whole segments."""
    s = F.col("s_suppkey")
    relative = F.when(s % 3 == 0, F.concat(F.lit("B"), s % 20, F.lit(".cs"))).otherwise(F.concat(F.lit("lib/xAb"), s % 20, F.lit(".cs")))
    chunks, symbols = placed(spark, sf_dir, relative, F.lit(0))
    return graph.lookup(chunks, symbols, strict=False).select(F.col("id").alias("c_custkey"), "symbol")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 20 AS f FROM customer),
y AS (SELECT s_suppkey AS ord, s_name AS symbol, s_suppkey * 13 % 1500 AS pos, CASE WHEN s_suppkey % 20 < 9 THEN s_suppkey % 2 ELSE 1 END AS ix, s_suppkey % 20 AS f FROM supplier)"""
       + _BEST.format(on="c.f = y.f"))
def first_index_wins(spark, sf_dir):
    """Two symbol indexes that share files: the first with a match decides."""
    s = F.col("s_suppkey")
    chunks, symbols = placed(spark, sf_dir, F.concat(F.lit("src/ab"), s % 20, F.lit(".CS")), F.when(s % 20 < 9, s % 2).otherwise(1))
    return graph.lookup(chunks, symbols).select(F.col("id").alias("c_custkey"), "symbol")
