"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform draw u from MD5 and the score -ln(u) / weight; a record goes to
the shard with the smallest score. A shard that is added changes no score of the others, so records
move only into it, and a shard of weight w gets a share w / sum(w) of the keys.

Defined cases: a null key is the key "" and goes where that key goes; a null text has no bytes and
CRC 0; repeated rows share a shard and get slots of their own; an empty table gives an empty result;
only the key and text columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.shared import checkpointed

#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16
#: Slots are counted within chunks of a shard, so that no task sorts a whole shard: at least CHUNKS, and so many
#: that one has about CHUNK_ROWS.
CHUNKS, CHUNK_ROWS = 256, 50_000
#: Equal rows are counted, not kept apart; they are written out again in runs of this length.
RUN = 10_000


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that depends on the key and the shard id alone: 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), shard.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def scores(key: Column, weights: Sequence[float]) -> Column:
    """An array of (score, id) for shards of these weights, in order of id; the least one gets the key."""
    shards = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)))
    return F.transform(shards, lambda s: F.struct((-F.log(draw(key, s["id"])) / s["weight"]).alias("score"), s["id"].alias("id")))


def assign(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, shard i having weights[i]; equal scores go to the smaller shard."""
    return F.array_min(scores(key, weights))["id"]


def chunk_of(key: Column, crc: Column, chunks: int) -> Column:
    """Spreads rows of one key by their text, and rows of one text by their key."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") + crc, F.lit(chunks)).cast("int")


def shard_rows(df: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", added: float = 1.0) -> DataFrame:
    """Each row's key, size, text CRC, shard, slot within the shard, and shard once one of weight `added` joins.

    The text itself is not shuffled. Slots count from 0 without gaps in each shard, by chunk and then
    by key, size and CRC; chunk totals give each chunk its first slot.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), (F.octet_length(body) + RECORD_OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    name = F.coalesce(F.col("k").cast("string"), F.lit(""))
    kinds = rows.groupBy("k", "size", "crc").agg(F.count("*").alias("n")).withColumn("name", name)
    own = F.array_min(F.slice("scores", 1, len(weights)))
    kinds = kinds.withColumn("scores", scores(F.col("name"), [*weights, added])).withColumn("own", own).withColumn("best", F.least("own", F.element_at("scores", -1)))
    kinds = kinds.select("k", "size", "crc", "n", "name", F.col("own.id").alias("shard"), F.col("best.id").alias("grown"))
    kinds = checkpointed(kinds)  # a few bytes a row, so that texts are read once
    chunks = max(CHUNKS, -(-kinds.count() // (CHUNK_ROWS * len(weights))))
    kinds = kinds.withColumn("chunk", chunk_of(F.col("name"), F.col("crc"), chunks)).drop("name")
    totals = kinds.groupBy("shard", "chunk").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("shard", "chunk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(firsts, ["shard", "chunk"])
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    each = runs.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, last)))
    return each.select(F.col("k").alias("key"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("at") + F.col("i")).alias("slot"), F.col("grown").alias("grown_shard"))
