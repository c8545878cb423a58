"""Row numbers over a whole relation without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Add each row's place (from 1) by the columns of ``order``, which should tell rows apart.

    Rows are range-partitioned and numbered within partitions; the partitions' sizes, one number
    each, shift them. The sizes are counted once more from the same partitioning, so the input is
    kept in between.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    before, total = {}, 0
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():
        before[r["__part"]] = total
        total += r["count"]
    if not before:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("__part")
    shift = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("__part"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, (within + shift).cast("long")).drop("__part")
