"""Chat formatting by rotating the perspective: each participant of a dialogue is the assistant once.

For every participant the dialogue is rendered with that speaker's messages as the assistant's, the
others' as messages of named users, and those of SYSTEM speakers as the system's. Only the
assistant's words and their end marker are masked in, that is, trained on.

A result row is one message of one rendering: its text with markers and its character range in the
whole rendering, which is the rows' `rendered` in order of `seq`. Dialogues are not gathered: messages are
dealt by ranges of dialogue and place, so that a long dialogue has many ranges; offsets are running sums
within a range, and totals of ranges are added. Participants meet the ranges of their dialogue before its
messages, so that a range of messages is all that a task joins.

Defined cases: a null speaker is named "unknown"; a null text is empty; "<|" in names and texts
becomes "<\\|", so that texts hold no markers; a null dialogue id is a dialogue; null turns come first;
rows of one turn are in order of speaker and the text's MD5, and repeated rows are messages of their own; a
dialogue of system messages alone has no rendering; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.shared import checkpointed

SYSTEM = ("system",)
END = "<|end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(df: DataFrame, *, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(dialogue, perspective, seq, turn, speaker, rendered, start, mask_start, mask_end) for each message and participant.

    mask_start and mask_end are character positions in the whole rendering, null for messages of others.
    """
    said = df.select(
        F.col(dialogue).alias("d"),
        F.col(turn).cast("long").alias("t"),
        _plain(F.coalesce(F.col(speaker), F.lit("unknown"))).alias("s"),
        _plain(F.coalesce(F.col(text), F.lit(""))).alias("x"),
    )
    said = said.withColumns({"digest": F.md5(F.col("x").cast("binary")), "size": F.length("x")})
    # the partition read splits messages that are equal in all else; ranges are drawn anew each time they are asked for
    said = checkpointed(said.repartitionByRange("d", "t", "s", "digest", F.spark_partition_id()).withColumn("chunk", F.spark_partition_id()))
    said = said.withColumn("k", F.row_number().over(Window.partitionBy("d", "chunk").orderBy("t", "s", "digest")))

    # positions are found on rows without texts, which are joined in the end
    light = said.select("d", "chunk", "k", "s", "size")
    people = light.where(~F.col("s").isin(*SYSTEM)).select(F.col("d").alias("pd"), F.col("s").alias("p")).distinct()
    ranges = light.select(F.col("d").alias("rd"), F.col("chunk").alias("rc")).distinct()
    ranges = ranges.join(people, F.col("rd").eqNullSafe(F.col("pd"))).drop("pd")
    rows = light.join(ranges, F.col("d").eqNullSafe(F.col("rd")) & (F.col("chunk") == F.col("rc"))).drop("rd", "rc")
    rows = rows.withColumn("width", (F.length(_head(F.col("s"), F.col("p"))) + F.col("size") + len(END) + 1).cast("long"))
    totals = rows.groupBy("d", "p", "chunk").agg(F.sum("width").alias("chars"), F.count("*").alias("n"))
    earlier = Window.partitionBy("d", "p").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("d").alias("bd"), F.col("p").alias("bp"), F.col("chunk").alias("bc"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("char0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seq0"))
    before = Window.partitionBy("d", "p", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("width").over(before), F.lit(0)))
    rows = rows.join(bases, F.col("d").eqNullSafe(F.col("bd")) & (F.col("p") == F.col("bp")) & (F.col("chunk") == F.col("bc")))
    placed = rows.select(F.col("d").alias("rd"), F.col("chunk").alias("rc"), F.col("k").alias("rk"), "p", (F.col("seq0") + F.col("k") - 1).alias("seq"), (F.col("char0") + F.col("at")).alias("start"))

    out = said.select("d", "t", "s", "x", "chunk", "k").join(placed, F.col("d").eqNullSafe(F.col("rd")) & (F.col("chunk") == F.col("rc")) & (F.col("k") == F.col("rk")))
    head, own = _head(F.col("s"), F.col("p")), F.col("s") == F.col("p")
    first = F.col("start") + F.length(head)
    return out.select(
        F.col("d").alias("dialogue"),
        F.col("p").alias("perspective"),
        "seq",
        F.col("t").alias("turn"),
        F.col("s").alias("speaker"),
        F.concat(head, "x", F.lit(f"{END}\n")).alias("rendered"),
        "start",
        F.when(own, first).alias("mask_start"),
        F.when(own, first + F.length("x") + len(END)).alias("mask_end"),
    )


def _head(speaker: Column, perspective: Column) -> Column:
    """What stands before a message."""
    name = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    return F.when(speaker == perspective, F.lit("<|assistant|>\n")).when(speaker.isin(*SYSTEM), F.lit("<|system|>\n")).otherwise(name)
