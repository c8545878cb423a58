"""Shared plumbing: where intermediate tables go, Arrow batches, table reading."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of output that a Python stage gathers before it hands a batch to the JVM, in bytes.
OUT_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, local mode) is a folder of our own used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    here = spark.sparkContext.getCheckpointDir()
    if not here:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        here = spark.sparkContext.getCheckpointDir()
    return here.rstrip("/")


#: Bytes of an Arrow batch to a Python worker; Spark's own default counts rows first and allows 64 MiB.
BATCH_BYTES = "4m"
#: Files of a table by cores of the cluster: enough to keep them busy, and no file for each of many small partitions.
FILES_A_CORE = 4
#: Partitions of the session's shuffles that one file may hold, unless the table is light.
PARTITIONS_A_FILE = 4
#: So many files are never too many.
FEW_FILES = 64
#: Row groups of intermediate tables: what a writing task holds in memory.
ROW_GROUP_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, which from now on sends texts to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def written(df: DataFrame, tag: str, light: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    A light table, of a few numbers a row, has as many files as the cluster can write at once, a few
    times over; others have a file for every few partitions at least.
    Spark removes the shuffle files as soon as the table is there; see ``Scratch`` for the table itself.
    """
    spark = bounded(df.sparkSession)
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        files = FILES_A_CORE * spark.sparkContext.defaultParallelism
        if not light:
            files = max(files, FEW_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE)
        df.coalesce(files).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratch:
        _scratch[-1].made[path] = out
    return out


_scratch: list[Scratch] = []


class Scratch:
    """Within ``with Scratch() as s``, tables made by ``written`` are deleted at the end, but for those given to ``s.keep``.

    What is kept must not read the others any more; it belongs to the scratch around this one, if any.
    """

    def __init__(self):
        self.made: dict[str, DataFrame] = {}
        self.kept: set[int] = set()

    def __enter__(self) -> Scratch:
        _scratch.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(id(df))
        return df

    def __exit__(self, *_) -> None:
        _scratch.remove(self)
        for path, df in self.made.items():
            if id(df) in self.kept:
                if _scratch:
                    _scratch[-1].made[path] = df
                continue
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``text`` as its last column, under a name that no other column has."""
    taken, name = {c.lower() for c in docs.columns}, "__text"
    while name in taken:
        name += "_"
    return docs.select("*", text.alias(name))


def binaries(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Consecutive texts, about ``most`` bytes at a time."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and size < most:
            size += len(texts[upto])
            upto += 1
        yield texts[at:upto]
        at = upto


def gathered(schema: pa.Schema, rows: Iterable[tuple[tuple, int]], most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches from (row, its size in bytes), each of about ``most`` bytes."""
    held: list[tuple] = []
    size = 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= most:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_made: dict[str, object] = {}


def released() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, on a worker without leftovers.

    Objects that other operators keep in the worker go before it starts, and memory that it has
    freed goes back to the system when it ends, as idle workers live on beside the busy ones.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _made.clear()
        try:
            yield from run(batches)
        finally:
            released()

    return tidied


def once(key: str, make: Callable[[], object]) -> object:
    """One object per Python worker and key; a new key of the same kind replaces the old object."""
    kind = key.split(":")[0]
    if key not in _made:
        for old in [k for k in _made if k.split(":")[0] == kind]:
            del _made[old]
        _made[key] = make()
    return _made[key]


def fold_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: how rows are held out of training."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
