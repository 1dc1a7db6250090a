"""Trace batches from files and to files, and batches made of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.definition import ATTRIBUTES, BATCHES, STRING
from tracefold.functions.scalars import tagged
from tracefold.operators import codec
from tracefold.sources.files import NAME, SUFFIXES
from tracefold.wire import Options


def line_id(*more: Column) -> Column:
    """batch_id of a line of a text source: by its file, its text and what else tells equal lines apart."""
    return F.xxhash64("_metadata.file_path", "value", *more).alias("batch_id")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batches of a text table, one JSON text a line: batch_id (equal lines have ids of their own), resourceSpans, error."""
    lines = spark.read.text(path).select(line_id(F.monotonically_increasing_id()), F.encode("value", "UTF-8").alias("body"))
    return codec.decode(lines, "json")


def write_json_lines(batches: DataFrame, path: str) -> None:
    """One JSON text a line."""
    codec.encode(batches, ("json",)).select(F.decode("json", "UTF-8").alias("value")).write.text(path)


def read_messages(spark: SparkSession, path: str, form: str = "dict", options: Options = Options()) -> DataFrame:
    """Batches of a folder of message files, in any of the formats."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("batch_id"), F.col("content").alias("body"))
    return codec.decode(files, form, options)


def write_messages(batches: DataFrame, folder: str, forms: tuple[str, ...] = codec.FORMATS, options: Options = Options()) -> None:
    """One file for each batch and format, <batch_id>_<suffix>; files.register(spark) comes first."""
    coded = codec.encode(batches, forms, options)
    each = F.explode(F.array(*(F.struct(F.lit(f"_{SUFFIXES[f]}").alias("suffix"), F.col(f).alias("body")) for f in forms)))
    rows = coded.where("error IS NULL").select(F.col("batch_id").cast("string").alias("id"), each.alias("e"))
    rows.select(F.concat("id", "e.suffix").alias("name"), "e.body").write.format(NAME).option("path", folder).mode("append").save()


def write_bodies(batches: DataFrame, path: str, form: str = "dict", options: Options = Options()) -> None:
    """A Parquet table (batch_id, body, error): the form for many batches."""
    codec.encode(batches, (form,), options).withColumnRenamed(form, "body").write.parquet(path)


def _id(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def _nanos(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) * 1000


def _text_map(**columns: Column) -> Column:
    parts = [x for name, column in columns.items() for x in (F.lit(name), tagged(column, STRING))]
    return F.create_map(*parts).cast(ATTRIBUTES)


def _span(**held: Column) -> Column:
    """A span struct; fields that aren't told are empty."""
    kinds = BATCHES["resourceSpans"].dataType.elementType["scopeSpans"].dataType.elementType["spans"].dataType.elementType
    return F.struct(*(held.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields))


def nest(rows: DataFrame, service: str, span: Callable[[Column], Column] = lambda e: e["span"]) -> DataFrame:
    """Batches of (batch_id, pos, what spans are made of): one resource and one scope each.

    span makes the span of a row. It does so after the shuffle, as spans are many times as large as flat rows.
    """
    pairs = F.collect_list(F.struct(*(c for c in rows.columns if c != "batch_id")))
    ordered = F.transform(F.array_sort(pairs, lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)), span)
    scope = F.struct(F.struct(F.lit("tables").alias("name"), F.lit("1").alias("version"), F.create_map().cast(ATTRIBUTES).alias("attributes"), F.lit(0).cast("long").alias("droppedAttributesCount")).alias("scope"), F.lit("").alias("schemaUrl"), F.col("spans"))
    resource = F.struct(_text_map(service=F.lit(service)).alias("attributes"), F.lit(0).cast("long").alias("droppedAttributesCount"))
    named = rows.groupBy("batch_id").agg(ordered.alias("spans"))
    whole = F.array(F.struct(resource.alias("resource"), F.lit("").alias("schemaUrl"), F.array(scope).alias("scopeSpans")))
    return named.select(F.col("batch_id").cast("long"), whole.cast(BATCHES["resourceSpans"].dataType).alias("resourceSpans"))


def event_batches(spark: SparkSession, sf_dir: str, size: int = 500) -> DataFrame:
    """Events as spans, in batches of `size` event ids; times never go back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")

    def span(r: Column) -> Column:
        return _span(
            traceId=_id(r["user_id"], 16), spanId=_id(r["pos"], 8), parentSpanId=_id(F.lit(0).cast("long"), 8), traceState=F.lit(""),
            name=r["event_type"], kind=F.lit(1), startTimeUnixNano=r["start"], endTimeUnixNano=r["start"] + r["taken"],
            attributes=_text_map(props=r["props"]), droppedAttributesCount=F.lit(0), droppedEventsCount=F.lit(0), droppedLinksCount=F.lit(0),
            events=F.array(), links=F.array(), status=F.struct(F.lit("").alias("message"), F.lit(0).cast("long").alias("code")),
        )

    taken = F.coalesce(F.col("value"), F.lit(0.0)).cast("long")
    rows = e.select(F.floor(F.col("event_id") / size).alias("batch_id"), F.col("event_id").alias("pos"), "user_id", "event_type", "props", _nanos(F.col("ts")).alias("start"), taken.alias("taken"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch_id")  # counted, as small rows that make large batches would be merged into few tasks
    return nest(dealt, "events", span)


#: A unique order of line items, as order and line number are not.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def order_batches(spark: SparkSession, sf_dir: str, size: int = 500) -> DataFrame:
    """Orders as spans with their line items as events and a link to the customer; times go back and forth."""
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    span_kind = BATCHES["resourceSpans"].dataType.elementType["scopeSpans"].dataType.elementType["spans"].dataType.elementType
    place = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:])
    none = F.create_map().cast(ATTRIBUTES)
    event = F.struct(_nanos(F.col("l_shipdate")).alias("timeUnixNano"), F.col("l_returnflag").alias("name"), _text_map(status=F.col("l_linestatus")).alias("attributes"), F.lit(0).cast("long").alias("droppedAttributesCount"))
    pairs = F.collect_list(F.struct("at", "event"))
    ordered = F.transform(F.array_sort(pairs, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda e: e["event"])
    events = items.select(F.col("l_orderkey").alias("o_orderkey"), F.row_number().over(place).alias("at"), event.alias("event")).groupBy("o_orderkey").agg(ordered.alias("events"))
    link = F.struct(_id(F.col("o_custkey"), 16).alias("traceId"), _id(F.col("o_custkey"), 8).alias("spanId"), F.lit("").alias("traceState"), none.alias("attributes"), F.lit(0).cast("long").alias("droppedAttributesCount"))
    start = _nanos(F.col("o_orderdate"))
    span = _span(
        traceId=_id(F.col("o_orderkey"), 16), spanId=_id(F.col("o_orderkey"), 8), parentSpanId=_id(F.lit(0).cast("long"), 8), traceState=F.lit(""),
        name=F.col("o_orderpriority"), kind=F.lit(2), startTimeUnixNano=start, endTimeUnixNano=start + F.floor("o_totalprice"),
        attributes=none, droppedAttributesCount=F.lit(0), droppedEventsCount=F.lit(0), droppedLinksCount=F.lit(0),
        events=F.coalesce("events", F.array().cast(span_kind["events"].dataType)), links=F.array(link), status=F.struct(F.col("o_orderstatus").alias("message"), F.lit(1).cast("long").alias("code")),
    )
    rows = orders.join(events, "o_orderkey", "left")
    return nest(rows.select(F.floor(F.col("o_orderkey") / size).alias("batch_id"), F.col("o_orderkey").alias("pos"), span.alias("span")), "orders")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their line items as flat spans (trace, pos, parent, name, start, status); times go back and forth."""
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    place = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:])
    roots = orders.select(F.col("o_orderkey").alias("trace"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("parent"), F.col("o_orderpriority").alias("name"), _nanos(F.col("o_orderdate")).alias("start"), F.col("o_orderstatus").alias("status"))
    children = items.select(F.col("l_orderkey").alias("trace"), F.row_number().over(place).alias("pos"), F.lit(0).alias("parent"), F.col("l_returnflag").alias("name"), _nanos(F.col("l_shipdate")).alias("start"), F.col("l_linestatus").alias("status"))
    return roots.unionByName(children)
