"""Nested trace batches to flat tables, and back. Positions are columns, as rows have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.definition import BATCHES
from tracefold.functions.scalars import elide, restore
from tracefold.shared import checkpointed

_SCOPE_SPANS = BATCHES["resourceSpans"].dataType.elementType["scopeSpans"].dataType.elementType
SPAN: T.StructType = _SCOPE_SPANS["spans"].dataType.elementType
SPAN_KEY = ("batch_id", "rs_pos", "ss_pos", "span_pos")


def resources(batches: DataFrame) -> DataFrame:
    """One row for each resource of a batch."""
    rows = batches.select("batch_id", F.posexplode("resourceSpans").alias("rs_pos", "rs"))
    return rows.select("batch_id", "rs_pos", "rs.resource", F.col("rs.schemaUrl").alias("schemaUrl"), "rs.scopeSpans")


def scopes(batches: DataFrame) -> DataFrame:
    """One row for each scope of a resource, those without spans too."""
    rows = resources(batches).select("batch_id", "rs_pos", F.posexplode("scopeSpans").alias("ss_pos", "ss"))
    return rows.select("batch_id", "rs_pos", "ss_pos", "ss.scope", F.col("ss.schemaUrl").alias("schemaUrl"), "ss.spans")


def spans(batches: DataFrame) -> DataFrame:
    """One row for each span."""
    rows = scopes(batches).select("batch_id", "rs_pos", "ss_pos", F.posexplode("spans").alias("span_pos", "span"))
    return rows.select(*SPAN_KEY, "span.*")


def events(flat: DataFrame) -> DataFrame:
    """One row for each event of flat spans."""
    return flat.select(*SPAN_KEY, F.posexplode("events").alias("event_pos", "event")).select(*SPAN_KEY, "event_pos", "event.*")


def links(flat: DataFrame) -> DataFrame:
    """One row for each link of flat spans."""
    return flat.select(*SPAN_KEY, F.posexplode("links").alias("link_pos", "link")).select(*SPAN_KEY, "link_pos", "link.*")


def _list(position: str, *fields: str) -> Column:
    """The grouped rows as an array of structs in order of a position; only that is compared, as maps have no order."""
    pairs = F.collect_list(F.struct(F.col(position).alias("at"), F.struct(*fields).alias("held")))
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return F.transform(ordered, lambda e: e["held"])


def rebuild(batches: DataFrame, resource_rows: DataFrame, scope_rows: DataFrame, span_rows: DataFrame) -> DataFrame:
    """Batches from their flat tables; batches without resources and scopes without spans come back empty.

    Each level is grouped by its parent's key; a batch is one row in the end, so it has to fit a task.
    """
    by_scope = span_rows.groupBy("batch_id", "rs_pos", "ss_pos").agg(_list("span_pos", *SPAN.names).alias("spans"))
    whole_scopes = _left(scope_rows.drop("spans"), by_scope, ["batch_id", "rs_pos", "ss_pos"], "spans", _SCOPE_SPANS["spans"].dataType)
    by_resource = whole_scopes.groupBy("batch_id", "rs_pos").agg(_list("ss_pos", *_SCOPE_SPANS.names).alias("scopeSpans"))
    rs = BATCHES["resourceSpans"].dataType
    whole = _left(resource_rows.drop("scopeSpans"), by_resource, ["batch_id", "rs_pos"], "scopeSpans", rs.elementType["scopeSpans"].dataType)
    by_batch = whole.groupBy("batch_id").agg(_list("rs_pos", *rs.elementType.names).alias("resourceSpans"))
    return _left(batches.select("batch_id"), by_batch, ["batch_id"], "resourceSpans", rs)


def _left(parents: DataFrame, children: DataFrame, key: list[str], name: str, kind: T.DataType) -> DataFrame:
    return parents.join(children, key, "left").withColumn(name, restore(F.col(name), kind))


def compact(flat: DataFrame) -> DataFrame:
    """Spans with null in place of what a message leaves out."""
    kept = {"traceId", "name", "startTimeUnixNano", "endTimeUnixNano", "status"}
    return flat.withColumns({f.name: elide(F.col(f.name), f.dataType) for f in SPAN.fields if f.name not in kept})


def fixed_width(column: Column, size: int) -> Column:
    """An id cut or padded with zero bytes to its size."""
    return F.rpad(F.coalesce(column, F.lit(b"").cast("binary")), size, F.lit(b"\0").cast("binary"))


def to_protocol(flat: DataFrame) -> DataFrame:
    """Spans with protocol defaults in place of nulls, and ids of 16 and 8 bytes."""
    out = flat.withColumns({f.name: restore(F.col(f.name), f.dataType) for f in SPAN.fields if not isinstance(f.dataType, T.StructType)})
    return out.withColumns({"traceId": fixed_width(F.col("traceId"), 16), "spanId": fixed_width(F.col("spanId"), 8), "parentSpanId": fixed_width(F.col("parentSpanId"), 8)})


def batched(flat: DataFrame, most: int, by: str, order: tuple[str, ...]) -> DataFrame:
    """Numbers batches of at most `most` rows within each value of `by`, so that no batch outgrows a task.

    Rows are dealt by ranges of (by, order), and numbered within a range; totals of the ranges give each its
    first number. So a value of `by` that holds most rows is spread, as far as its order tells rows apart.
    """
    held = F.struct(*(F.col(f"`{c}`") for c in flat.columns))
    ranged = flat.select(F.col(by).alias("by"), F.struct(*order).alias("at"), held.alias("held")).repartitionByRange("by", "at")
    dealt = checkpointed(ranged.withColumn("part", F.spark_partition_id()))  # ranges are drawn anew each time they are asked for
    totals = dealt.groupBy("by", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(F.col("by").alias("own"), F.col("part").alias("own_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = dealt.withColumn("k", F.row_number().over(Window.partitionBy("by", "part").orderBy("at")))
    rows = placed.join(firsts, F.col("by").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")))
    return rows.select("held.*", F.floor((F.col("first") + F.col("k") - 1) / most).alias("batch_no"))
