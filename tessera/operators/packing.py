"""Packing kernels: folds over the sizes of a row's items, all in Catalyst.

A fold keeps the open bucket and the ranges that are closed, not their text, so it copies little;
the text is joined afterwards from the ranges. Ranges count items from 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<first:int,last:int,split:boolean>"


def _range(first: Column, last: Column, split: bool = False) -> Column:
    return F.array(F.struct(first.alias("first"), last.alias("last"), F.lit(split).alias("split")))


def pack(sizes: Column, capacity: int, oversize: float | None = None, extra: int = 0) -> Column:
    """Greedy ranges of items whose sizes add up to ``capacity`` at most.

    An item that does not fit closes the bucket. With ``oversize`` an item of over that many
    capacities closes the bucket and stands alone, marked as split. With ``extra`` each item costs
    that much more, except the one that opens a bucket after another was closed.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("first"), F.lit(0).cast("int").alias("size"), F.array().cast(f"array<{RANGE}>").alias("out"))

    def add(a, raw):
        k = a["at"] + 1
        n = raw + extra
        open_ = a["first"] < k
        closed = F.when(open_, F.concat(a["out"], _range(a["first"], a["at"]))).otherwise(a["out"])
        state = lambda first, size, out: F.struct(k.alias("at"), first.alias("first"), size.cast("int").alias("size"), out.alias("out"))
        result = F.when(open_ & (a["size"] + n > capacity), state(k, raw, closed)).otherwise(state(a["first"], a["size"] + n, a["out"]))
        if oversize is not None:
            alone = state(k + 1, F.lit(0), F.concat(closed, _range(k, k, True)))
            result = F.when(n > capacity * oversize, alone).otherwise(result)
        return result

    return F.aggregate(sizes, start, add, lambda a: F.when(a["first"] <= a["at"], F.concat(a["out"], _range(a["first"], a["at"]))).otherwise(a["out"]))


def joined(items: Column, ranges: Column, separator: str) -> Column:
    """The text of each range."""
    return F.transform(ranges, lambda r: F.array_join(F.slice(items, r["first"], r["last"] - r["first"] + 1), separator))


def sizes_of(items: Column) -> Column:
    return F.transform(items, F.length)


def line_pack(text: Column, capacity: int) -> Column:
    """Chunks of whole lines; line breaks cost nothing."""
    lines = F.split(text, "\n", -1)
    return joined(lines, pack(sizes_of(lines), capacity), "\n")


def force_split(text: Column, capacity: int) -> Column:
    """Chunks of whole lines, for one paragraph that is too large; a break costs one, but not for the first line after a cut."""
    lines = F.split(text, "\n", -1)
    return joined(lines, pack(sizes_of(lines), capacity, extra=1), "\n")


def paragraph_pack(paragraphs: Column, capacity: int) -> Column:
    """Chunks of paragraphs; a chunk begins with the last paragraph of the one before if both fit.

    A paragraph of over ``capacity`` is split by lines, each piece a chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).cast("int").alias("size"), F.array().cast("array<string>").alias("out"))

    def add(a, p):
        n = F.length(p)
        flushed = F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], "\n\n")))).otherwise(a["out"])
        state = lambda cur, size, out: F.struct(cur.alias("cur"), size.cast("int").alias("size"), out.alias("out"))
        last = F.element_at(a["cur"], -1)
        fits = F.length(last) + n <= capacity
        fresh = state(F.when(fits, F.array(last, p)).otherwise(F.array(p)), F.when(fits, F.length(last) + n).otherwise(n), flushed)
        more = state(F.concat(a["cur"], F.array(p)), a["size"] + n, a["out"])
        large = state(F.array().cast("array<string>"), F.lit(0), F.concat(flushed, force_split(p, capacity)))
        return F.when(n > capacity, large).when((a["size"] + n > capacity) & (F.size(a["cur"]) > 0), fresh).otherwise(more)

    return F.aggregate(paragraphs, start, add, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], "\n\n")))).otherwise(a["out"]))


def groups(items: Column, size: int) -> Column:
    """Consecutive groups of a fixed size."""
    return F.transform(F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>")), lambda k: F.slice(items, k, F.lit(size)))
