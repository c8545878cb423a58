"""Registry of the engine's own queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import headers
from tessera.functions import symbols as X
from tessera.functions import text as T
from tessera.operators import batches, chunking, embed, graph, markdown, packing, search, stats, structured
from tessera.operators.ordering import numbered
from tessera.plans import lifecycle
from tessera.plans.oracles import CAPACITY, ORACLES
from tessera.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, headers, vectors, and the nearest chunks of a question."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("file_name"), F.col("source").alias("file_path"), "lang", "text")
    chunks = markdown.chunks(docs, CAPACITY).withColumns({"doc_type": F.lit("md"), "chunk_type": F.lit("document"), "language": F.col("lang"), "kind": F.lit(None).cast("string")})
    chunks = chunks.withColumn("id", F.concat_ws("#", "file_name", F.col("ordinal").cast("string")))
    chunks = chunks.withColumn("document", headers.embed_text(F.col("text"), F.col("chunk_type"), lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")))
    embedder = embed.HashEmbedder()
    found = search.top_k(embed.embedded(chunks, embedder), embedder.embed(["the order of the house"])[0], 6, {"languages": ["en"]})
    return found.select("id", "score", "section_title", "start_line", "end_line", "document")


# ---------------------------------------------------------------- search


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"), F.col("label").cast("string").alias("language"), F.col("vec_id").cast("int").alias("start_line"), (F.col("vec_id") + 9).cast("int").alias("end_line"))
    return rows, list(rows.where("id = 0").first().embedding)


def nearest(spark: SparkSession, sf_dir: str, filters: dict | None = None, k: int | None = None) -> DataFrame:
    rows, q = vectors(spark, sf_dir)
    return search.top_k(rows, q, k, filters).select("id", "score")


@query
def vector_topk(spark, sf_dir):
    return nearest(spark, sf_dir)


@query
def vector_topk_most(spark, sf_dir):
    return nearest(spark, sf_dir, k=50)


@query
def vector_topk_eq(spark, sf_dir):
    return nearest(spark, sf_dir, {"languages": ["3"]})


@query
def vector_topk_in(spark, sf_dir):
    return nearest(spark, sf_dir, {"languages": ["1", "4", "7"], "kinds": []})


@query
def vector_topk_lines(spark, sf_dir):
    return nearest(spark, sf_dir, {"line_min": 100, "line_max": 300})


@query
def must_contain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), F.col("source").alias("file_path"))
    return docs.where(search.predicate({"must_contain": "tion", "file_path_contains": "src1"})).select("doc_id", "file_path")


@query
def unknown_sources(spark, sf_dir):
    return search.unknown_sources(table(spark, sf_dir, "documents").select(F.col("source").alias("file_path")), ["src0", "src1", "nowhere", "elsewhere"])


# ---------------------------------------------------------------- packing and chunking


@query
def line_pack_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(packing.line_pack(F.col("text"), CAPACITY)).alias("ordinal", "chunk"))


@query
def force_line_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(packing.force_split(F.col("text"), CAPACITY)).alias("ordinal", "chunk"))


@query
def greedy_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n", -1))
    ranges = packing.pack(packing.sizes_of(F.col("l")), CAPACITY, oversize=1.5)
    return docs.select("doc_id", F.posexplode(ranges).alias("ordinal", "r")).select("doc_id", "ordinal", F.col("r.first").alias("first_item"), F.col("r.last").alias("last_item"), F.col("r.split").alias("oversized"))


@query
def paragraph_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("p", T.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return docs.select("doc_id", F.posexplode(packing.paragraph_pack(F.col("p"), CAPACITY)).alias("ordinal", "chunk"))


@query
def fixed_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n", -1))
    return docs.select("doc_id", F.posexplode(packing.groups(F.col("l"), 20)).alias("ordinal", "g")).select("doc_id", "ordinal", F.size("g").alias("n_items"), F.array_join("g", "|").alias("items"))


def headed(spark, sf_dir) -> DataFrame:
    """Documents as Markdown: every line but the first of a text becomes a header with a body."""
    body = F.replace("text", F.lit("\n"), F.lit("\n## part\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("before\n# "), "source", F.lit("\n"), body).alias("text"))


@query
def md_sections(spark, sf_dir):
    found = headed(spark, sf_dir).select("doc_id", F.posexplode(markdown.sections(F.col("text"))).alias("ordinal", "s"))
    return found.select("doc_id", "ordinal", F.col("s.title").alias("title"), F.col("s.level").alias("level"), F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), F.col("s.content").alias("content"))


@query
def md_chunks(spark, sf_dir):
    return markdown.chunks(headed(spark, sf_dir), CAPACITY).select("doc_id", "ordinal", "text", "section_title", "section_level", "section_hierarchy", "header_levels", "start_line", "end_line", "is_partial", "word_count")


@query
def md_rich_metadata(spark, sf_dir):
    extra = F.lit("\n- [ ] open\n- [x] done\n  - [X] nested\n![pic](a.png) and [link](b)\n| a | b |\n|---|:-:|\n```\ncode\n```\n")
    rich = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", extra, F.repeat(F.lit("[more](x) "), F.col("doc_id").cast("int") % 5)).alias("text"))
    return rich.withColumns(T.markdown(F.col("text"))).drop("text")


@query
def line_numbers(spark, sf_dir):
    """Each packed chunk, and one that is nowhere, looked up in its whole text."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", "text", F.posexplode(F.concat(packing.line_pack(F.col("text"), CAPACITY), F.array(F.lit("\x02none")))).alias("ordinal", "chunk"))
    return chunks.select("doc_id", "ordinal", T.line_span(F.col("text"), F.col("chunk")).alias("s")).select("doc_id", "ordinal", "s.*")


@query
def json_array_groups(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    return users.select("user_id", F.posexplode(packing.groups(F.col("e"), structured.GROUP)).alias("ordinal", "g")).select("user_id", "ordinal", F.size("g").alias("n_items"), F.array_join(F.col("g").cast("array<string>"), ",").alias("items"))


def _parse(spark, sf_dir, texts: DataFrame, kind: str, columns: str) -> DataFrame:
    import pandas as pd

    names = [c.split()[0] for c in columns.split(", ")]

    def run(found):
        for pdf in found:
            rows = ({**c, "doc_id": d, "ordinal": k} for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for k, c in enumerate(chunking.parsed(kind, ".json", t or "", None, CAPACITY, 51)))
            for some in batches.pieces(rows):
                yield pd.DataFrame(some, columns=names).astype(object).where(lambda x: x.notna(), None)

    batches.bounded(spark)
    return texts.mapInPandas(run, columns)


@query
def json_units(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return _parse(spark, sf_dir, events, "json", "doc_id long, ordinal int, text string, json_path string, json_key string, json_type string, end_line int")


@query
def json_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", F.split("text", "\n").alias("lines"))).alias("text"))
    return _parse(spark, sf_dir, docs, "json", "doc_id long, ordinal int, text string, json_path string, chunk_type string, is_partial boolean, array_range string")


@query
def xml_chunks(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), T.escaped(x), F.lit("</p>")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<doc><lang>x</lang>"), F.array_join(lines, ""), F.lit("</doc>")).alias("text"))
    return _parse(spark, sf_dir, docs, "xml", "doc_id long, ordinal int, text string, xml_path string, xml_tag string, chunk_type string, tag_count int, is_partial boolean")


@query
def html_code_chunks(spark, sf_dir):
    chunking.register_table_functions(spark)
    table(spark, sf_dir, "pages").select("page_id", "html").createOrReplaceTempView("tessera_pages")
    return spark.sql("SELECT page_id, c.* FROM tessera_pages, LATERAL code_chunks(html, 'html', 256) c")


# ---------------------------------------------------------------- headers and names


@query
def header_code(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("file_name"), F.lit("python").alias("language"), F.col("p_brand").alias("display_name"), F.when(F.col("p_size") > 20, F.lit("class")).alias("kind"),
        F.concat(F.lit("pkg/mod/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("#")).alias("enclosing"), F.concat(F.col("p_type"), F.lit(" \nmore")).alias("documentation"),
        F.concat_ws(", ", F.concat(F.lit("a b/"), F.col("p_type"), F.lit(".")), F.lit("x"), F.lit("q/y z."), F.lit("d"), F.lit("e"), F.lit("f")).alias("callees"), F.lit("").alias("callers"),
    )
    return parts.select("id", headers.embed_text(F.lit("body\n\n\n\nend"), F.lit("code"), lambda c: F.col(c) if c in parts.columns else F.lit(None).cast("string")).alias("document"))


@query
def header_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id")).alias("file_name"), F.when(F.col("doc_id") % 2 == 0, "md").alias("doc_type"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("section_title"), (F.col("doc_id") % 7).cast("int").alias("section_level"))
    return named.select("doc_id", headers.document_header().alias("header"))


@query
def header_structured(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_name"), F.when(F.col("page_id") % 2 == 0, "$.a").otherwise("").alias("json_path"), F.when(F.col("page_id") % 3 == 0, "/r/b").alias("xml_path"))
    return pages.select("page_id", headers.structured_header().alias("header"))


def named_symbols(spark, sf_dir) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    tail = F.element_at(F.array(*map(F.lit, ("#", "#Name.", "#name.", "#run().", "#run(+1).", "/"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("scip py pkg 1 `"), name, F.lit("`/Cls"), tail).alias("symbol"), (F.col("p_size") + 0).cast("int").alias("kind"))


@query
def symbol_names(spark, sf_dir):
    s = F.col("symbol")
    return named_symbols(spark, sf_dir).select("p_partkey", X.display_name(s).alias("display_name"), X.inferred_kind(s).alias("inferred"), X.kind_label(F.col("kind")).alias("label"), X.short_enclosing(s).alias("enclosing"))


@query
def classify_files(spark, sf_dir):
    path = F.concat(F.lit("/src/"), F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.element_at(F.array(*map(F.lit, (".py", ".CS", ".json", ".csproj", ".md", "", ".zzz"))), (F.col("page_id") % 7 + 1).cast("int")))
    paths = table(spark, sf_dir, "pages").select("page_id", path.alias("p")).select("page_id", files.suffix(F.col("p")).alias("suffix"), files.base_name(F.col("p")).alias("file_name"))
    return files.classified(paths).select("page_id", "suffix", "file_name", "file_type", "language", "parser")


# ---------------------------------------------------------------- symbol joins


def events_as_occurrences(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).alias("index_ord"), F.col("user_id").alias("doc_ord"), F.unix_timestamp("ts").alias("start"), F.col("event_id").alias("idx"), F.concat(F.col("event_type"), F.lit("-"), F.col("event_id") % 97).alias("symbol"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("symbol_roles"))


@query
def enclosing_definition(spark, sf_dir):
    return graph.enclosing_definitions(events_as_occurrences(spark, sf_dir)).select(F.col("doc_ord").alias("user_id"), F.col("idx").alias("event_id"), "symbol", "caller")


def declared(spark, sf_dir) -> DataFrame:
    return events_as_occurrences(spark, sf_dir).where("idx % 97 < 60").select("index_ord", "symbol").distinct()


@query
def call_graph_edges(spark, sf_dir):
    edges = graph.call_edges(events_as_occurrences(spark, sf_dir), declared(spark, sf_dir))
    return edges.select("caller", "callee", F.col("pos.doc_ord").alias("first_doc"), F.col("pos.idx").alias("first_idx"))


@query
def callers_top10(spark, sf_dir):
    _, callers = graph.relations(graph.call_edges(events_as_occurrences(spark, sf_dir), declared(spark, sf_dir)))
    return callers.select("symbol", "callers")


@query
def symbol_range_lookup(spark, sf_dir):
    """Orders are chunks of a customer's file; their lines are date spans. Line items of a supplier file are symbols."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/w/C"), F.col("o_custkey") % 50, F.lit(".cs")).alias("file_path"), (day("o_orderdate") + 1).alias("start_line"), F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(day("o_orderdate") + 30).cast("int").alias("end_line"))
    items = table(spark, sf_dir, "customer").select(F.lit(0).alias("index_ord"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("symbol"), ((F.col("c_custkey") * 7919) % 3000).cast("int").alias("start"), F.concat(F.lit("c"), F.col("c_custkey") % 50, F.lit(".CS")).alias("relative_path"))
    return graph.lookup(chunks, items).select(F.col("id").alias("o_orderkey"), "symbol")


@query
def symbol_definitions(spark, sf_dir):
    occurrences = events_as_occurrences(spark, sf_dir).withColumn("end", F.col("start") + 1)
    symbols = occurrences.where("idx % 3 = 0").select("index_ord", "doc_ord", F.col("idx").alias("ord"), "symbol")
    return graph.definitions(symbols, occurrences).select("symbol", "doc_ord", "ord", "start", "end")


# ---------------------------------------------------------------- catalogue and life cycle


def chunk_like(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("file_path"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("language"), F.when(F.col("doc_id") % 5 == 0, "class").otherwise("").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "code").alias("chunk_type"), F.lit(None).cast("string").alias("doc_type"))


@query
def list_sources(spark, sf_dir):
    return stats.facets(chunk_like(spark, sf_dir))


@query
def stats_counts(spark, sf_dir):
    return stats.counts(chunk_like(spark, sf_dir), stats.CHUNK_COUNTS)


@query
def chunks_per_file(spark, sf_dir):
    return stats.per_file(chunk_like(spark, sf_dir))


@query
def list_documents(spark, sf_dir):
    return stats.documents(stats.per_file(chunk_like(spark, sf_dir)))


@query
def lower_path_batches(spark, sf_dir):
    pages = numbered(table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("p")), ["p", "page_id"], "k")
    return pages.groupBy(F.floor((F.col("k") - 1) / 100).cast("long").alias("batch_index")).agg(F.count("*").alias("files_processed"), F.min("page_id").alias("first_page"))


@query
def registry_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.path_id(F.col("url")).alias("doc_id"), T.content_hash(F.col("html").cast("binary")).alias("file_hash"), F.octet_length("html").alias("file_size"))


@query
def retrieval(spark, sf_dir):
    return flagship(spark, sf_dir)


def queries():
    return QUERIES | lifecycle.QUERIES


def oracle_sql():
    return ORACLES | lifecycle.ORACLES
