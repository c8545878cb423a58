"""Symbol indexes (SCIP protobuf) as relations, decoded field by field without generated code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the public format.
INDEX_DOCUMENTS = 2
DOCUMENT_PATH, DOCUMENT_OCCURRENCES, DOCUMENT_SYMBOLS = 1, 2, 3
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES = 1, 2, 3
SYMBOL_NAME, SYMBOL_DOCUMENTATION, SYMBOL_KIND, SYMBOL_DISPLAY, SYMBOL_ENCLOSING = 1, 3, 5, 6, 8

SYMBOLS = "index_ord int, doc_ord int, ord int, relative_path string, symbol string, kind int, display_name string, documentation array<string>, enclosing_symbol string"
OCCURRENCES = "index_ord int, doc_ord int, idx int, relative_path string, range array<int>, symbol string, symbol_roles int"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) pairs of a message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def packed(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = varint(value, at)
        out.append(x)
    return out


def decode(content: bytes) -> tuple[list[dict], list[dict]]:
    """Symbols and occurrences of an index; of two declarations in a document both are kept, in order."""
    symbols, occurrences = [], []
    documents = [v for f, v in message(content) if f == INDEX_DOCUMENTS]
    for d, raw in enumerate(documents):
        fields = list(message(raw))
        path = next((v.decode() for f, v in fields if f == DOCUMENT_PATH), "")
        for k, v in enumerate(v for f, v in fields if f == DOCUMENT_SYMBOLS):
            row = {"doc_ord": d, "ord": k, "relative_path": path, "symbol": "", "kind": 0, "display_name": "", "documentation": [], "enclosing_symbol": ""}
            for f, x in message(v):
                if f == SYMBOL_NAME:
                    row["symbol"] = x.decode()
                elif f == SYMBOL_DOCUMENTATION:
                    row["documentation"].append(x.decode())
                elif f == SYMBOL_KIND:
                    row["kind"] = x
                elif f == SYMBOL_DISPLAY:
                    row["display_name"] = x.decode()
                elif f == SYMBOL_ENCLOSING:
                    row["enclosing_symbol"] = x.decode()
            symbols.append(row)
        for k, v in enumerate(v for f, v in fields if f == DOCUMENT_OCCURRENCES):
            row = {"doc_ord": d, "idx": k, "relative_path": path, "range": [], "symbol": "", "symbol_roles": 0}
            for f, x in message(v):
                if f == OCCURRENCE_RANGE:
                    row["range"] += packed(x)
                elif f == OCCURRENCE_SYMBOL:
                    row["symbol"] = x.decode()
                elif f == OCCURRENCE_ROLES:
                    row["symbol_roles"] = x
            occurrences.append(row)
    return symbols, occurrences


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(symbols, occurrences) of index files; index_ord is a file's place in path order. A broken file gives no rows."""
    if not paths:
        return spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], OCCURRENCES)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def rows(which: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path, content in zip(pdf["path"], pdf["content"], strict=True):
                    try:
                        found = decode(bytes(content))[which]
                    except (ValueError, IndexError, UnicodeDecodeError, AttributeError):
                        continue
                    if found:
                        yield pd.DataFrame(found).assign(index_ord=ranked(path))

        return run

    names = sorted(p.split(":", 1)[-1].lstrip("/") for p in paths)

    def ranked(path: str) -> int:
        return names.index(path.split(":", 1)[-1].lstrip("/"))

    select = lambda schema: [c.split()[0] for c in schema.split(", ")]
    symbols = files.mapInPandas(lambda it: (p[select(SYMBOLS)] for p in rows(0)(it)), SYMBOLS)
    occurrences = files.mapInPandas(lambda it: (p[select(OCCURRENCES)] for p in rows(1)(it)), OCCURRENCES)
    return symbols, occurrences


def spans(occurrences: DataFrame) -> DataFrame:
    """Add start and end lines (0-based): ranges of three numbers end on their first line."""
    r = F.col("range")
    return occurrences.withColumns({"start": F.get(r, F.lit(0)), "end": F.when(F.size(r) == 4, F.get(r, F.lit(2))).otherwise(F.get(r, F.lit(0)))})
