"""Directory scans as binary-file relations."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import MAX_FILE_BYTES, Settings


def plain_path(path: Column) -> Column:
    """A path without its scheme and with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^file:/*(?=/)", "")


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^./]+)$", 1))


def wanted_suffixes(settings: Settings, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> tuple[set[str], set[str]]:
    """(kept, left out), all in lower case: ``include`` (or all supported) without ``exclude``."""
    left_out = {x.lower() for x in exclude} if exclude else {x.lower() for x in settings.exclude_extensions}
    return {x.lower() for x in (include or settings.supported)} - left_out, left_out


def _in_tree(df: DataFrame, root: str, kept: set[str], left_out: set[str], dirs: Iterable[str]) -> DataFrame:
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    path = plain_path(F.col("path"))
    inner = F.substring(path, len(base) + 2, 1 << 30)
    parents = F.slice(F.split(inner, "/"), 1, F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    good = suffix(path).isin(sorted(kept)) & ~F.arrays_overlap(parents, F.array(*map(F.lit, sorted(dirs))).cast("array<string>"))
    for x in left_out:
        if x.count(".") > 1:  # compound suffixes exclude too
            good = good & ~F.lower(path).endswith(x)
    return df.where(good).withColumn("file_path", path)


def scan(
    spark: SparkSession,
    root: str,
    settings: Settings | None = None,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    content: bool = True,
    skip: bool = False,
) -> DataFrame:
    """Files under ``root``: file_path, file_name, suffix, file_type, language, length (and content).

    Empty files and those of over 10 MiB are left out by a length predicate that reaches the scan.
    A missing directory raises ``FileNotFoundError``. With ``skip`` files that are gone or unreadable
    by the time they are read are left out. Use ``ordered`` for the order by lower path.
    """
    settings = settings or Settings()
    _require_dir(spark, root)
    kept, left_out = wanted_suffixes(settings, include, exclude)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if skip:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    found = reader.load(root).where(F.col("length").between(1, MAX_FILE_BYTES))
    named = _in_tree(found, root, kept, left_out, settings.exclude_dirs)
    columns = ["path", "file_path", base_name(F.col("file_path")).alias("file_name"), suffix(F.col("file_path")).alias("suffix"), "length"]
    return classified(named.select(*columns, *(["content"] if content else [])), settings)


def load(spark: SparkSession, paths: list[str], settings: Settings | None = None) -> DataFrame:
    """Named files as ``scan`` gives them, without a listing of their folders. Those that are gone or unreadable by then are skipped."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        found = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    else:
        found = reader.load([_literal(p) for p in there])
    found = found.withColumn("file_path", plain_path(F.col("path")))
    named = found.select("path", "file_path", base_name(F.col("file_path")).alias("file_name"), suffix(F.col("file_path")).alias("suffix"), "length", "content")
    return classified(named, settings or Settings())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _literal(path: str) -> str:
    """A path whose characters with a meaning in globs stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def ordered(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower("file_path"), "file_path")


def count(spark: SparkSession, root: str, settings: Settings | None = None, include: Iterable[str] | None = None) -> int:
    """Matching files of any size but empty ones, from the listing alone; 0 if ``root`` is no directory."""
    settings = settings or Settings()
    try:
        _require_dir(spark, root)
    except FileNotFoundError:
        return 0
    kept, left_out = wanted_suffixes(settings, include, exclude=())
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return _in_tree(found, root, kept, set(), settings.exclude_dirs).count()


def _require_dir(spark: SparkSession, root: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"not a directory: {root}")


def classified(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Add file_type (code, structured, document, unknown), language and parser by suffix."""
    settings = settings or Settings()
    s = F.col("suffix")
    language = F.lit(None).cast("string")
    for ext, name in settings.code_extensions.items():
        language = F.when(s == ext, name).otherwise(language)
    kind = (
        F.when(s.isin(list(settings.code_extensions)), "code")
        .when(s.isin(list(settings.structured_extensions)), "structured")
        .when(s.isin(list(settings.document_extensions)), "document")
        .otherwise("unknown")
    )
    out = files.withColumns({"file_type": kind, "language": language})
    parser = F.when(kind == "structured", F.when(s == ".json", "json").otherwise("xml")).when(kind == "code", "code").when(kind == "document", "document").otherwise("fallback")
    return out.withColumn("parser", parser)


def text(content: Column) -> Column:
    """Bytes as UTF-8 text, malformed bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def symbol_indexes(spark: SparkSession, root: str, parents: int = 3) -> list[str]:
    """Symbol index files: in ``root``, else anywhere below, else in up to three parents; the first level with hits, sorted."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def here(path) -> list[str]:
        hits = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*index.scip"))
        return sorted(str(h.getPath()) for h in hits or [])

    if found := here(top):
        return found
    # level by level in the JVM: a call from here for each of many files would take longer than the listing
    below, level = [], jvm.org.apache.hadoop.fs.Path(_literal(root), "*")
    while len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(level, "*")) or []):
        hits = fs.globStatus(jvm.org.apache.hadoop.fs.Path(level, "*index.scip"))
        below += [str(h.getPath()) for h in hits or [] if h.isFile()]
        level = jvm.org.apache.hadoop.fs.Path(level, "*")
    if below:
        return sorted(below)
    for _ in range(parents):
        top = top.getParent()
        if top is None:
            break
        if found := here(top):
            return found
    return []
