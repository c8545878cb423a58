"""New files of a folder, a bounded number a micro-batch, into the store.

The checkpoint remembers which files are done: a failed batch stops the stream and runs again at
the next start, and the batches before it stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import MAX_FILE_BYTES
from tessera.ingest import Pipeline
from tessera.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def source(pipeline: Pipeline, root: str) -> DataFrame:
    stream = pipeline.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", pipeline.settings.ingest_batch_size)
    return stream.load(root).where(F.col("length").between(1, MAX_FILE_BYTES))


def start(pipeline: Pipeline, root: str, checkpoint: str) -> StreamingQuery:
    """Process all files that are there and not done, then stop."""
    settings = pipeline.settings
    kept, left_out = files.wanted_suffixes(settings)
    indexes = files.symbol_indexes(pipeline.spark, root)

    def save(batch: DataFrame, _: int) -> None:
        found = files._in_tree(batch, root, kept, left_out, settings.exclude_dirs)
        named = found.select("file_path", files.base_name(F.col("file_path")).alias("file_name"), files.suffix(F.col("file_path")).alias("suffix"), "length", "content")
        pipeline.ingest_batch(files.classified(named, settings), indexes)

    return source(pipeline, root).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
