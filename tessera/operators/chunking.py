"""Files to chunks: documents by Catalyst, code and structured files by Arrow batches of Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Settings
from tessera.operators import code, markdown, structured
from tessera.operators.batches import bounded, pieces
from tessera.schema import CHUNK_META, conform
from tessera.sources import converters, files

_OUT = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType()), *CHUNK_META.fields, T.StructField("error", T.StringType())])


def parsed(kind: str, suffix: str, content: str, language: str | None, capacity: int, overlap: int, splitter: code.Splitter = code.structural) -> list[dict]:
    """Chunks of one file that is no Markdown, by parser name."""
    if kind == "code":
        return code.code_chunks(content, language, capacity, splitter)
    if kind == "json":
        return structured.json_chunks(content, capacity)
    if kind == "xml":
        return structured.xml_chunks(content, capacity)
    rows = code.fallback_chunks(content, capacity, overlap)
    return [{**r, "doc_type": suffix.lstrip("."), "parser_fallback": None} for r in rows] if kind == "document" else rows


def chunk_files(found: DataFrame, settings: Settings | None = None, splitter: code.Splitter = code.structural) -> DataFrame:
    """Chunks (ordinal, text, metadata) of scanned files; one pass over each kind, no shuffle.

    Plain documents and those a converter turns into Markdown are chunked natively; other text
    documents fall back to sentences, as do unknown files. A file that cannot be chunked, or is
    binary and cannot be converted, gives one row with ``error`` instead of chunks.
    """
    bounded(found.sparkSession)
    settings = settings or Settings()
    capacity, overlap = settings.chunk_size, settings.chunk_overlap
    plain = F.col("suffix").isin(list(converters.PLAIN))
    doc = F.col("parser") == "document"
    ready = found.where(doc & plain).select("file_path", "file_name", "suffix", files.text(F.col("content")).alias("text"), F.lit(None).cast("boolean").alias("converted"))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [converters.convert(s, bytes(c)) for s, c in zip(pdf["suffix"], pdf["content"], strict=True)]
            yield pdf[["file_path", "file_name", "suffix"]].assign(text=texts, converted=[t is not None for t in texts], raw=pdf["content"])

    turned = found.where(doc & ~plain).select("file_path", "file_name", "suffix", "content").mapInPandas(turn, "file_path string, file_name string, suffix string, text string, converted boolean, raw binary")
    documents = ready.unionByName(turned.where("converted").drop("raw"))
    # the line break that ends a file's last line begins no line of its own
    native = markdown.chunks(documents.withColumn("text", F.regexp_replace("text", r"\n\z", "")), capacity).withColumns(
        {
            "doc_type": F.when(F.col("converted"), "md").otherwise(F.substring("suffix", 2, 20)),
            "chunk_type": F.lit("document"),
            "markitdown_converted": F.when(F.col("converted"), True),
            "original_doc_type": F.when(F.col("converted"), F.substring("suffix", 2, 20)),
        }
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in pieces(row for r in pdf.itertuples(index=False) for row in of_file(r)):
                yield pd.DataFrame(some).reindex(columns=_OUT.names).astype(object).where(lambda x: x.notna(), None)

    def of_file(r) -> list[dict]:
        own = {"file_path": r.file_path, "file_name": r.file_name}
        try:
            if r.parser == "document" and r.suffix in converters.BINARY:
                raise ValueError(f"cannot be converted: {r.suffix}")
            found = parsed(r.parser, r.suffix, r.text or "", r.language, capacity, overlap, splitter)
            return [{**chunk, **own, "ordinal": k} for k, chunk in enumerate(found)]
        except Exception as problem:  # one file must not end the batch
            return [{**own, "error": str(problem) or type(problem).__name__}]

    rest = found.where(~doc).select("file_path", "file_name", "suffix", "parser", "language", files.text(F.col("content")).alias("text"))
    failed = turned.where("not converted").select("file_path", "file_name", "suffix", F.lit("document").alias("parser"), F.lit(None).cast("string").alias("language"), files.text(F.col("raw")).alias("text"))
    python = rest.unionByName(failed).mapInPandas(parse, _OUT)
    return conform(native, _OUT).unionByName(conform(python, _OUT))


def register_table_functions(spark) -> None:
    """The chunkers as SQL table functions: json_chunks, xml_chunks and code_chunks."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ordinal int, text string, path string")
    class JsonChunks:
        def eval(self, text: str, capacity: int):
            for k, c in enumerate(structured.json_chunks(text or "", capacity)):
                yield k, c["text"], c.get("json_path")

    @udtf(returnType="ordinal int, text string, path string")
    class XmlChunks:
        def eval(self, text: str, capacity: int):
            for k, c in enumerate(structured.xml_chunks(text or "", capacity)):
                yield k, c["text"], c.get("xml_path")

    @udtf(returnType="ordinal int, text string, start_line int, end_line int")
    class CodeChunks:
        def eval(self, text: str, language: str, capacity: int):
            for k, c in enumerate(code.code_chunks(text or "", language, capacity)):
                yield k, c["text"], c["start_line"], c["end_line"]

    for name, function in (("json_chunks", JsonChunks), ("xml_chunks", XmlChunks), ("code_chunks", CodeChunks)):
        spark.udtf.register(name, function)
