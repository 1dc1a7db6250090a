"""Dictionaries ("pools"): distinct values numbered by first occurrence, and references to them.

A pool is one per batch and pool id. Numbers come from the first position over all occurrences: a
grouped minimum (combined before the shuffle) and a row number over the distinct values alone, which
are few next to the rows. Nothing is collected; a reference is an equi-join on batch, pool and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(df: DataFrame, batch: Column, pool: str, key: Column, position: Column) -> DataFrame:
    """(batch, pool, key, position) of the values of one column; nulls are no entries."""
    return df.select(batch.alias("batch"), F.lit(pool).alias("pool"), key.alias("key"), position.alias("position")).where(F.col("key").isNotNull())


def shared(parts: Sequence[DataFrame]) -> DataFrame:
    """Occurrences of several columns in one pool, or of several pools."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def assign(seen: DataFrame) -> DataFrame:
    """(batch, pool, key, idx): each distinct value's number, by first position, from 0."""
    first = seen.groupBy("batch", "pool", "key").agg(F.min("position").alias("first"))
    order = Window.partitionBy("batch", "pool").orderBy("first", "key")
    return first.select("batch", "pool", "key", (F.row_number().over(order) - 1).cast("long").alias("idx"))


def reference(df: DataFrame, entries: DataFrame, batch: Column, pool: str, key: Column, name: str) -> DataFrame:
    """df with the number of a key in a pool; null for a null key."""
    own = entries.where(F.col("pool") == pool).select(F.col("batch").alias("entry_batch"), F.col("key").alias("entry_key"), F.col("idx").alias(name))
    return df.join(own, batch.eqNullSafe(F.col("entry_batch")) & (key == F.col("entry_key")), "left").drop("entry_batch", "entry_key")


def dereference(df: DataFrame, entries: DataFrame, batch: Column, pool: str, index: Column, name: str) -> DataFrame:
    """df with the key that has a number in a pool."""
    own = entries.where(F.col("pool") == pool).select(F.col("batch").alias("entry_batch"), F.col("idx").alias("entry_idx"), F.col("key").alias(name))
    return df.join(own, batch.eqNullSafe(F.col("entry_batch")) & (index == F.col("entry_idx")), "left").drop("entry_batch", "entry_idx")


def dumped(entries: DataFrame) -> DataFrame:
    """(batch, pool, keys): each pool as an array in order of its numbers. For batches that fit a task."""
    return entries.groupBy("batch", "pool").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "key"))), lambda e: e["key"]).alias("keys"))


def string_pool(df: DataFrame, batch: Column, attributes: Column, position: Column) -> DataFrame:
    """Occurrences of attribute keys and text values in a batch's string table; each key stands before its value."""
    keys = F.array_sort(F.map_keys(attributes))
    pairs = F.flatten(F.transform(keys, lambda k, i: F.array(F.struct((2 * i).alias("at"), k.alias("key")), F.struct((2 * i + 1).alias("at"), attributes[k]["s"].alias("key")))))
    rows = df.select(batch.alias("batch"), position.alias("row"), F.explode(pairs).alias("e"))
    return rows.select("batch", F.lit("strings").alias("pool"), F.col("e.key").alias("key"), F.struct("row", "e.at").alias("position")).where(F.col("key").isNotNull())
