"""Analytics over span trees (an extension): depth, self time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.shared import checkpointed

#: Why a span has no depth: an ancestor isn't there, or the span is in a circle or below one.
MISSING, CIRCLE = "missing", "circle"


def depth(spans: DataFrame, trace: str, span: str, parent: str) -> DataFrame:
    """spans with `depth`, 0 for roots, and `broken`, which tells why a span has none, else null.

    Pointers double: every span that isn't done holds an ancestor and the distance to it, and takes over
    that one's ancestor in the next round. A trace of n levels takes log n rounds, each one equi-join over
    the spans that aren't done yet, whose rows are written to the shared folder. When a round brings no
    span to its end, those that are left are in circles. Of rows that share an id the least parent
    counts (none only if none has one), and each gets the result; null ids have no depth.
    """
    keyed = spans.select(F.col(trace).alias("t"), F.col(span).alias("s"), F.col(parent).alias("p")).where("t IS NOT NULL AND s IS NOT NULL")
    nodes = keyed.groupBy("t", "s").agg(F.min("p").alias("up"))
    left = checkpointed(nodes.select("t", "s", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("d"), F.col("up").isNull().alias("done"), F.lit(None).cast("string").alias("broken")))
    done, count = [], left.count()
    while True:
        done, left = [*done, left.where("done")], left.where("NOT done")
        waiting = left.count()
        if not waiting or waiting == count and len(done) > 1:
            break
        count = waiting
        over = reduce(DataFrame.unionByName, [*done, left])
        over = over.select("t", F.col("s").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"), F.col("done").alias("end"), F.col("broken").alias("why"))
        step = left.drop("done", "broken").join(over, ["t", "up"], "left")
        left = checkpointed(step.select("t", "s", F.col("next").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.coalesce("end", F.lit(True)).alias("done"), F.when(F.col("end").isNull(), MISSING).otherwise(F.col("why")).alias("broken")))
    found = reduce(DataFrame.unionByName, done).unionByName(left.withColumn("broken", F.lit(CIRCLE)))
    found = found.select("t", "s", F.when(F.col("broken").isNull(), F.col("d")).alias("depth"), "broken")
    return spans.join(found, (spans[trace] == found["t"]) & (spans[span] == found["s"]), "left").drop("t", "s")


def self_time(spans: DataFrame, trace: str, span: str, parent: str, nanos: str) -> DataFrame:
    """(trace, span, nanos, self_nanos): a span's time less that of its children, not under 0."""
    inner = spans.where(F.col(parent).isNotNull()).groupBy(F.col(trace).alias("ct"), F.col(parent).alias("cp")).agg(F.sum(nanos).alias("inner"))
    rows = spans.join(inner, (F.col(trace) == F.col("ct")) & (F.col(span) == F.col("cp")), "left")
    return rows.select(trace, span, nanos, F.greatest(F.col(nanos) - F.coalesce("inner", F.lit(0)), F.lit(0)).alias("self_nanos"))
