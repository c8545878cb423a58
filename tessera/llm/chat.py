"""Multi-party perspective rotation of dialogues (operator 2), in DataFrame functions only.

For every participant of a conversation, the dialogue is rendered with that speaker as the
assistant: their turns are marked as the assistant's and are to be learned (mask 1), system turns
stay system turns, and every other speaker is a named user (mask 0).

A dialogue is rendered in sections of ``section_turns`` turn numbers, and a section that has more
than ``part_turns`` turns (turn numbers that repeat or are missing) in parts of so many, so that a
row stays bounded whatever the length of a conversation; sections and parts in order are the
dialogue. Repeated turns are counted before the shuffle and divided among the parts as numbers. A
section is numbered by a running sum over its sorted rows, which spills; the join with the
participants, one row each, is an inner equi-join, whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"


def rotate(turns: DataFrame, section_turns: int = 64, part_turns: int = 256) -> DataFrame:
    """Render conversations (conv_id, turn, role, text) once for each participant.

    One row for each conversation, participant, section and part: conv_id, perspective, section and
    part (long, from 0), n_turns (long, at most ``part_turns``), rendered (string), mask_spans (array
    of start, end: the code points of ``rendered`` to learn from, end exclusive) and masks
    (array<int>, one a turn).

    Turns are ordered by turn number, then role, then text; repeated rows are all rendered. Null
    texts are empty, a null role is the speaker "unknown", null turn numbers form a section of
    their own (null) after the others; a null conv_id is a conversation of its own. System turns
    have no perspective: a conversation of system turns alone, and an empty table, give no rows.
    Extra columns are ignored.
    """
    clean = turns.select(
        "conv_id",
        F.floor(F.col("turn") / section_turns).cast("long").alias("section"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    counted = clean.groupBy("conv_id", "section", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    order = Window.partitionBy("conv_id", "section").orderBy(F.coalesce("turn", F.lit(0)), "role", "text")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("at", F.col("upto") - F.col("n"))
    last = F.floor((F.col("upto") - 1) / part_turns).cast("long")
    cut = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / part_turns).cast("long"), last)))
    within = F.least("upto", (F.col("part") + 1) * part_turns) - F.greatest("at", F.col("part") * part_turns)
    sections = cut.groupBy("conv_id", "section", "part").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text", within.cast("int").alias("n")))).alias("turns")
    )
    speakers = clean.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    joined = sections.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    every = F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["n"])))

    def line(t):
        own = t["role"] == F.col("perspective")
        head = F.when(own, F.lit("<|assistant|>\n")).when(t["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(t["text"], F.lit("<|end|>\n")).alias("body"), F.when(own, 1).otherwise(0).alias("mask"))

    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )

    def add(a, x):
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        # what is learned is the turn's text and its end mark, without the line break
        span = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(x["mask"] == 1, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return (
        joined.withColumn("lines", F.transform(every, line))
        .select(
            "conv_id",
            "perspective",
            "section",
            "part",
            F.size("lines").cast("long").alias("n_turns"),
            F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
            F.aggregate("lines", start, add, lambda a: a["spans"]).alias("mask_spans"),
            F.transform("lines", lambda x: x["mask"]).alias("masks"),
        )
    )


def report(rotated: DataFrame) -> DataFrame:
    """Flat columns: the rendering, the masks as text, and how many characters are learned."""
    return rotated.select(
        "conv_id",
        "perspective",
        "section",
        "part",
        "n_turns",
        "rendered",
        F.array_join(F.col("masks").cast("array<string>"), ",").alias("masks"),
        F.array_join(F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("mask_spans"),
    )
