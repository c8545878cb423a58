"""The chunk and registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

DOC_LEVEL = ("file_path", "file_name", "language", "doc_type")
SYMBOL_LEVEL = ("symbol", "display_name", "kind", "enclosing", "documentation", "callers", "callees")

CHUNK_META = T.StructType(
    [
        T.StructField(n, t)
        for t, names in (
            (_S, "file_path file_name language doc_type chunk_type"),
            (_B, "parser_fallback markitdown_converted"),
            (_S, "original_doc_type"),
            (_I, "start_line end_line"),
            (_B, "is_partial"),
            (_S, "section_title"),
            (_I, "section_level"),
            (_S, "section_hierarchy header_levels"),
            (_B, "has_code_blocks has_checkboxes has_links has_images has_tables"),
            (_I, "code_block_count word_count checkbox_count checked_count unchecked_count link_count image_count table_count"),
            (_S, "json_path json_key keys json_type is_array is_object array_range xml_path xml_tag xml_root"),
            (_I, "tag_count child_count"),
            (_B, "is_grouped"),
            (_S, "symbol display_name kind enclosing documentation callers callees"),
        )
        for n in names.split()
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("ordinal", _I),
        T.StructField("text", _S),
        *CHUNK_META.fields,
        T.StructField("document", _S),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
REGISTRY = T.StructType(
    [
        T.StructField("doc_id", _S),
        T.StructField("file_path", _S),
        T.StructField("file_name", _S),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("chunk_count", _I),
        T.StructField("file_hash", _S),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, absent ones null."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
