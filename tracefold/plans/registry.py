"""Queries over the driver's tables, with the SQL that they must agree with."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.definition import DOUBLE, INTEGER, NAMES, STRING, TRACE, DefinitionError, dump, load, pool_order, resolve, same
from tracefold.functions import scalars as fn
from tracefold.operators import codec, delta, dictionary, flatten, tree
from tracefold.sources import traces
from tracefold.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rows of a table that make one batch, which is the scope of dictionaries and deltas.
BATCH = 1000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _batch(column: str) -> Column:
    return F.floor(F.col(column) / BATCH).alias("batch")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their batch and time in nanoseconds."""
    rows = _table(spark, sf_dir, "events")
    return rows.withColumn("batch", _batch("event_id")).withColumn("nanos", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    return rows.withColumn("batch", _batch("o_orderkey")).withColumn("nanos", F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000)


_E = "SELECT *, event_id // 1000 AS batch, epoch_us(ts) * 1000 AS nanos FROM events"
_O = "SELECT *, o_orderkey // 1000 AS batch, epoch_us(o_orderdate) * 1000 AS nanos FROM orders"


def _varint_sql(column: str) -> str:
    cases = " ".join(f"WHEN {column} BETWEEN {-(1 << 7 * k - 1)} AND {(1 << 7 * k - 1) - 1} THEN {k}" for k in range(1, 9))
    return f"CASE {cases} WHEN {column} IS NOT NULL THEN 9 END"


def _fnv_sql(octets: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, {octets}), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


_BYTES_SQL = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda b: ('0x' || b)::BIGINT)"
_LONG_SQL = "list_transform([56, 48, 40, 32, 24, 16, 8, 0], lambda s: ({} >> s) & 255)"


def _pool_sql(source: str, batch: str, key: str, position: str) -> str:
    return f"SELECT {batch} AS batch, {key} AS key, (row_number() OVER (PARTITION BY {batch} ORDER BY min({position}))) - 1 AS idx FROM ({source}) GROUP BY {batch}, {key}"


@query(f"""WITH e AS ({_E}), p AS ({_pool_sql(_E, "batch", "event_type", "event_id")}),
d AS (SELECT *, nanos - coalesce(lag(nanos) OVER (PARTITION BY batch ORDER BY event_id), 0) AS step FROM e)
SELECT d.batch, count(*) AS spans, sum({_varint_sql("p.idx")})::BIGINT AS name_bytes, sum({_varint_sql("d.step")})::BIGINT AS time_bytes,
  any_value(t.table_bytes)::BIGINT AS table_bytes
FROM d JOIN p ON p.batch = d.batch AND p.key = d.event_type
JOIN (SELECT batch, sum(strlen(key) + 1) AS table_bytes FROM p GROUP BY batch) t ON t.batch = d.batch GROUP BY d.batch""")
def event_field_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each batch's names as references, of its times as differences, and of its table of names."""
    events = _events(spark, sf_dir)
    pool = dictionary.assign(dictionary.occurrences(events, F.col("batch"), "name", F.col("event_type"), F.col("event_id")))
    rows = dictionary.reference(events, pool, F.col("batch"), "name", F.col("event_type"), "idx")
    rows = delta.encode(rows, "nanos", ["batch"], ["event_id"], "step")
    sizes = rows.groupBy("batch").agg(F.count("*").alias("spans"), F.sum(fn.varint_length(F.col("idx"))).alias("name_bytes"), F.sum(fn.varint_length(F.col("step"))).alias("time_bytes"))
    table = pool.groupBy("batch").agg(F.sum(fn.sized_length(F.col("key"))).alias("table_bytes"))
    return sizes.join(table, "batch")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the encoded fields of the events."""
    return event_field_sizes(spark, sf_dir)


@query(_pool_sql(_E, "batch", "event_type", "event_id"))
def dict_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = dictionary.occurrences(_events(spark, sf_dir), F.col("batch"), "name", F.col("event_type"), F.col("event_id"))
    return dictionary.assign(seen).drop("pool")


@query(_pool_sql(_O, "batch", "o_orderpriority", "o_orderkey"))
def dict_order_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = dictionary.occurrences(_orders(spark, sf_dir), F.col("batch"), "name", F.col("o_orderpriority"), F.col("o_orderkey"))
    return dictionary.assign(seen).drop("pool")


@query(f"WITH p AS ({_pool_sql(_O, 'batch', 'o_orderpriority', 'o_orderkey')}) SELECT o_orderkey, o.batch, idx FROM ({_O}) o JOIN p ON p.batch = o.batch AND key = o_orderpriority")
def dict_encode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    pool = dictionary.assign(dictionary.occurrences(rows, F.col("batch"), "name", F.col("o_orderpriority"), F.col("o_orderkey")))
    return dictionary.reference(rows, pool, F.col("batch"), "name", F.col("o_orderpriority"), "idx").select("o_orderkey", "batch", "idx")


@query("SELECT event_id, event_type FROM events")
def dict_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    pool = dictionary.assign(dictionary.occurrences(rows, F.col("batch"), "name", F.col("event_type"), F.col("event_id")))
    coded = dictionary.reference(rows, pool, F.col("batch"), "name", F.col("event_type"), "idx").select("event_id", "batch", "idx")
    return dictionary.dereference(coded, pool, F.col("batch"), "name", F.col("idx"), "event_type").select("event_id", "event_type")


@query("""WITH o AS (SELECT o_orderkey // 1000 AS batch, o_custkey AS key, o_orderkey AS a, 0 AS b FROM orders
  UNION ALL SELECT o_orderkey // 1000, o_orderkey, o_orderkey, 1 FROM orders),
m AS (SELECT batch, key, min({'a': a, 'b': b}) AS first FROM o GROUP BY batch, key)
SELECT batch, key, row_number() OVER (PARTITION BY batch ORDER BY first) - 1 AS idx FROM m""")
def dict_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two id columns in one pool: in a row the parent stands before the span."""
    rows = _orders(spark, sf_dir)
    parts = [dictionary.occurrences(rows, F.col("batch"), "spanId", F.col(c), F.struct(F.col("o_orderkey").alias("a"), F.lit(k).alias("b"))) for k, c in enumerate(("o_custkey", "o_orderkey"))]
    return dictionary.assign(dictionary.shared(parts)).drop("pool")


@query("""WITH c AS (SELECT c_custkey, c_custkey // 1000 AS batch, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT batch, c_mktsegment, row_number() OVER (PARTITION BY batch ORDER BY min(c_custkey)) - 1 AS segment FROM c GROUP BY batch, c_mktsegment),
n AS (SELECT batch, n_name, row_number() OVER (PARTITION BY batch ORDER BY min(c_custkey)) - 1 AS nation FROM c GROUP BY batch, n_name),
r AS (SELECT batch, c_mktsegment, n_name, row_number() OVER (PARTITION BY batch ORDER BY min(c_custkey)) - 1 AS idx FROM c GROUP BY batch, c_mktsegment, n_name)
SELECT r.batch, r.idx, segment, nation FROM r JOIN s USING (batch, c_mktsegment) JOIN n USING (batch, n_name)""")
def dict_nested_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of resources whose entries refer to pools of segments and nations."""
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("batch", _batch("c_custkey"))
    whole = F.to_json(F.struct("c_mktsegment", "n_name"))
    at, batch = F.col("c_custkey"), F.col("batch")
    pools = dictionary.assign(dictionary.shared([dictionary.occurrences(rows, batch, "segment", F.col("c_mktsegment"), at), dictionary.occurrences(rows, batch, "nation", F.col("n_name"), at), dictionary.occurrences(rows, batch, "resource", whole, at)]))
    entries = pools.where("pool = 'resource'").select("batch", "idx", F.from_json("key", "c_mktsegment string, n_name string").alias("r")).select("batch", "idx", "r.*")
    entries = dictionary.reference(entries, pools, batch, "segment", F.col("c_mktsegment"), "segment")
    return dictionary.reference(entries, pools, batch, "nation", F.col("n_name"), "nation").select("batch", "idx", "segment", "nation")


@query("""WITH a AS (SELECT event_id // 1000 AS batch, event_id, unnest(json_keys(props)) AS k, props FROM events),
s AS (SELECT batch, event_id, 0 AS place, k AS key FROM a UNION ALL SELECT batch, event_id, 1, json_extract_string(props, '$.' || k) FROM a),
m AS (SELECT batch, key, min({'e': event_id, 'a': place}) AS first FROM s WHERE key IS NOT NULL GROUP BY batch, key)
SELECT batch, key, row_number() OVER (PARTITION BY batch ORDER BY first) - 1 AS idx FROM m""")
def string_pool_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string table of the attributes in events' props: keys and values as texts."""
    rows = _events(spark, sf_dir).withColumn("m", F.from_json("props", "map<string,string>"))
    attributes = F.transform_values("m", lambda _, v: fn.tagged(v, STRING))
    return dictionary.assign(dictionary.string_pool(rows, F.col("batch"), attributes, F.col("event_id"))).drop("pool")


@query(f"SELECT event_id, nanos - coalesce(lag(nanos) OVER (PARTITION BY batch ORDER BY event_id), 0) AS step FROM ({_E})")
def delta_encode_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.encode(_events(spark, sf_dir), "nanos", ["batch"], ["event_id"], "step").select("event_id", "step")


@query(f"SELECT o_orderkey, nanos - coalesce(lag(nanos) OVER (PARTITION BY batch ORDER BY o_orderkey), 0) AS step FROM ({_O})")
def delta_encode_orderdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.encode(_orders(spark, sf_dir), "nanos", ["batch"], ["o_orderkey"], "step").select("o_orderkey", "step")


@query(f"SELECT o_orderkey, nanos FROM ({_O})")
def delta_decode_orderdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = delta.encode(_orders(spark, sf_dir), "nanos", ["batch"], ["o_orderkey"], "step").drop("nanos")
    return delta.decode(coded, "step", ["batch"], ["o_orderkey"], "nanos").select("o_orderkey", "nanos")


_LINE = ", ".join(traces.LINE_ORDER)


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY {_LINE}) AS pos, l_orderkey // 1000 AS batch, nullif((l_discount * 100)::BIGINT, 0) AS v FROM lineitem),
k AS (SELECT batch, pos, v, lag(v) OVER (PARTITION BY batch ORDER BY pos) AS before FROM l WHERE v IS NOT NULL)
SELECT l.batch, l.pos, CASE WHEN l.v IS NOT NULL THEN l.v - coalesce(before, 0) END AS step FROM l LEFT JOIN k USING (batch, pos)""")
def delta_skip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts in hundredths, 0 left out: what is left out doesn't count as the last value."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("batch", _batch("l_orderkey"))
    place = Window.partitionBy("batch").orderBy(*traces.LINE_ORDER)
    rows = rows.withColumn("pos", F.row_number().over(place).cast("long"))
    rows = rows.withColumn("v", fn.elide(F.round(F.col("l_discount") * 100).cast("long"), T.LongType()))
    return delta.encode(rows, "v", ["batch"], ["pos"], "step").select("batch", "pos", "step")


@query("SELECT l_returnflag, count(nullif((l_discount * 100)::BIGINT, 0)) AS kept_ints, count(nullif(l_returnflag, '')) AS kept_texts, count(l_tax) AS kept_doubles FROM lineitem GROUP BY l_returnflag")
def null_elision(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fn.elide(F.round(F.col("l_discount") * 100).cast("long"), T.LongType())
    kept = [F.count(whole).alias("kept_ints"), F.count(fn.elide(F.col("l_returnflag"), T.StringType())).alias("kept_texts"), F.count(fn.elide(F.col("l_tax"), T.DoubleType())).alias("kept_doubles")]
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*kept)


@query("SELECT o_orderkey, (floor(o_totalprice)::BIGINT % 3)::BIGINT AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS s FROM orders")
def null_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was left out comes back as the default."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") % 3).alias("v"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("s"))
    out = rows.withColumn("v", fn.elide(F.col("v"), T.LongType()))
    return out.withColumn("v", fn.restore(F.col("v"), T.LongType())).withColumn("s", fn.restore(F.col("s"), T.StringType()))


@query(f"SELECT o_orderkey, ({_varint_sql('step')})::INT AS size FROM (SELECT o_orderkey, nanos - coalesce(lag(nanos) OVER (PARTITION BY batch ORDER BY o_orderkey), 0) AS step FROM ({_O}))")
def varint_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_encode_orderdate(spark, sf_dir).select("o_orderkey", fn.varint_length(F.col("step")).alias("size"))


@query(f"SELECT p_partkey, {_fnv_sql(_BYTES_SQL.format('p_name'))} AS h FROM part")
def fnv_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", fn.fnv1a_bytes(F.col("p_name")).alias("h"))


@query(f"SELECT o_orderkey, {_fnv_sql(_LONG_SQL.format('o_orderkey'))} AS h, {_fnv_sql('[(o_orderkey % 2)::BIGINT]')} AS b FROM orders")
def fnv_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", fn.fnv1a_long(F.col("o_orderkey")).alias("h"), fn.fnv1a_boolean(F.col("o_orderkey") % 2 == 1).alias("b"))


_WORD_SQL = "list_transform([0, 8, 16, 24], lambda s: ({} >> s) & 255)"


@query(f"""WITH h AS (SELECT c_custkey, {_fnv_sql(_BYTES_SQL.format("c_name"))} AS a, {_fnv_sql(_BYTES_SQL.format("c_mktsegment"))} AS b FROM customer)
SELECT c_custkey, {_fnv_sql(f"flatten([{_WORD_SQL.format('a')}, {_WORD_SQL.format('b')}, [0, 0, 0, 0]])")} AS listed,
{_fnv_sql(f"flatten([[110], {_WORD_SQL.format('a')}, [115], {_WORD_SQL.format('b')}])")} AS mapped FROM h""")
def fnv_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of an array and of an object from those of what they hold."""
    a, b = fn.fnv1a_bytes(F.col("c_name")), fn.fnv1a_bytes(F.col("c_mktsegment"))
    listed = fn.fnv1a_hashes(F.array(a, b, F.lit(None).cast("long")))
    return _table(spark, sf_dir, "customer").select("c_custkey", listed.alias("listed"), fn.fnv1a_map(F.create_map(F.lit("s"), b, F.lit("n"), a)).alias("mapped"))


@query(f"SELECT p_partkey, {_fnv_sql(_LONG_SQL.format('(p_retailprice::BIT)::BIGINT'))} AS h FROM part")
def fnv_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", fn.fnv1a_double(F.col("p_retailprice")).alias("h"))


#: Written out, so that the order is not told by the code that it checks. {r}, {s} and {x} are the paths of resources, scopes and spans.
_POOLS_SQL = """SELECT idx, replace(replace(replace(pool, '{x}', '{s} item spans item'), '{s}', '{r} item scopeSpans'), '{r}', 'resourceSpans') AS pool FROM (VALUES
(0, '{r} item resource attributes'), (1, '{r} item resource'), (2, '{r} item schemaUrl'), (3, '{s} item schemaUrl'),
(4, '{s} item scope attributes'), (5, '{s} item scope name'), (6, '{s} item scope version'), (7, '{s} item scope'),
(8, '{x} attributes'), (9, '{x} events item attributes'), (10, '{x} events item name'), (11, '{x} links item attributes'),
(12, 'spanId'), (13, 'traceId'), (14, 'traceState'), (15, '{x} links item'),
(16, '{x} name'), (17, '{x} status message'), (18, '{x} status')) t(idx, pool)"""


@query(_POOLS_SQL)
def pool_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries of a trace batch, children first."""
    return spark.createDataFrame(list(enumerate(pool_order(TRACE))), "idx int, pool string")


@query("""SELECT * FROM (VALUES ('resourceSpans', 'Array', true, false, NULL), ('resourceSpans item scopeSpans item spans item startTimeUnixNano', 'Integer', false, true, NULL),
('resourceSpans item scopeSpans item spans item kind', 'Integer', true, false, NULL), ('resourceSpans item scopeSpans item spans item traceId', 'Bytes', false, false, 'traceId'),
('resourceSpans item scopeSpans item spans item parentSpanId', 'Bytes', true, false, 'spanId'), ('spanId', 'Bytes', true, false, 'spanId'), ('traceState', 'String', true, false, 'traceState'),
('resourceSpans item scopeSpans item spans item status code', 'Integer', false, false, NULL), ('resourceSpans item scopeSpans item spans item events item timeUnixNano', 'Integer', true, true, NULL),
('resourceSpans item resource attributes', 'Object', true, false, 'resourceSpans item resource attributes'), ('no such path', NULL, NULL, NULL, NULL)) t(path, kind, nullable, diff, pool)""")
def definition_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that paths and names of shared pools resolve to, in the trace definition read back from its JSON."""
    known = load(json.dumps(dump(TRACE)))
    if not same(known, TRACE):
        raise DefinitionError("the definition isn't what its JSON says")
    spans, rows = "resourceSpans item scopeSpans item spans item", []
    wanted = ("resourceSpans", f"{spans} startTimeUnixNano", f"{spans} kind", f"{spans} traceId", f"{spans} parentSpanId", "spanId", "traceState", f"{spans} status code", f"{spans} events item timeUnixNano", "resourceSpans item resource attributes", "no such path")
    for path in wanted:
        node = resolve(known, path)
        rows.append((path, NAMES[node.type], node.nullable, node.diff, node.pool(path)) if node else (path, None, None, None, None))
    return spark.createDataFrame(rows, "path string, kind string, nullable boolean, diff boolean, pool string")


@query("SELECT event_id, event_type AS name, value FROM events WHERE value IS NOT NULL")
def required_and_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that went through the checks for null and for type; a row that fails one ends the query."""
    rows = _table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    held = fn.of_type(fn.tagged(F.col("value"), DOUBLE), DOUBLE)["d"]
    return rows.select("event_id", fn.required(F.col("event_type"), "name").alias("name"), fn.required(held, "value").alias("value"))


@query(f"SELECT batch, string_agg(key, '|' ORDER BY idx) AS keys FROM ({_pool_sql(_E, 'batch', 'event_type', 'event_id')}) GROUP BY batch")
def pool_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole dictionaries, in order."""
    seen = dictionary.occurrences(_events(spark, sf_dir), F.col("batch"), "name", F.col("event_type"), F.col("event_id"))
    return dictionary.dumped(dictionary.assign(seen)).select("batch", F.array_join("keys", "|").alias("keys"))


@query("SELECT o_orderkey, true AS other_order, o_orderstatus = o_orderpriority AS other_value, false AS other_type FROM orders")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys of attribute maps are equal: entries in another order, another value, and one of another type."""

    def key(*pairs: tuple[str, Column]) -> Column:
        return fn.attributes_key(F.create_map(*(x for name, value in pairs for x in (F.lit(name), value))))

    status, priority, number = (fn.tagged(F.col("o_orderstatus"), STRING), fn.tagged(F.col("o_orderpriority"), STRING), fn.tagged(F.col("o_orderkey"), INTEGER))
    base = key(("status", status), ("number", number))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (base == key(("number", number), ("status", status))).alias("other_order"),
        (base == key(("status", priority), ("number", number))).alias("other_value"),
        (base == key(("status", status), ("number", fn.tagged(F.col("o_orderkey").cast("string"), STRING)))).alias("other_type"),
    )


_EVENT_SPANS = "SELECT event_id // 500 AS batch_id, (event_id % 500)::INT AS span_pos, event_type AS name, epoch_us(ts) * 1000 AS start_nanos, event_id FROM events"


@query(f"SELECT batch_id, span_pos, name, start_nanos, lpad(lower(hex(event_id)), 16, '0') AS span_id FROM ({_EVENT_SPANS})")
def flatten_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten.spans(traces.event_batches(spark, sf_dir))
    return flat.select("batch_id", "span_pos", "name", F.col("startTimeUnixNano").alias("start_nanos"), F.lower(F.hex("spanId")).alias("span_id"))


@query("SELECT event_id // 500 AS batch_id, 1 AS n_resources, 1 AS n_scopes, count(*) AS n_spans, true AS same FROM events GROUP BY 1")
def rebuild_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches from their flat tables, compared with what they were made of."""
    batches = traces.event_batches(spark, sf_dir)
    again = flatten.rebuild(batches, flatten.resources(batches), flatten.scopes(batches), flatten.spans(batches))
    both = again.withColumnRenamed("resourceSpans", "now").join(batches, "batch_id")
    inner = F.col("now")[0]["scopeSpans"]
    return both.select("batch_id", F.size("now").alias("n_resources"), F.size(inner).alias("n_scopes"), F.size(inner[0]["spans"]).cast("long").alias("n_spans"), (F.to_json("now") == F.to_json("resourceSpans")).alias("same"))


@query(f"SELECT batch_id, span_pos, name, start_nanos FROM ({_EVENT_SPANS})")
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that went through messages."""
    bodies = codec.encode(traces.event_batches(spark, sf_dir))
    flat = flatten.spans(codec.decode(bodies, column="dict"))
    return flat.select("batch_id", "span_pos", "name", F.col("startTimeUnixNano").alias("start_nanos"))


@query(f"SELECT form, batch_id, span_pos, name, start_nanos FROM ({_EVENT_SPANS}), (VALUES ('dict_zstd'), ('dict_gzip')) f(form)")
def wire_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that went through compressed messages, by format."""
    bodies = codec.encode(traces.event_batches(spark, sf_dir), ("dict_zstd", "dict_gzip"))
    whole = None
    for form in ("dict_zstd", "dict_gzip"):
        flat = flatten.spans(codec.decode(bodies, form, column=form))
        part = flat.select(F.lit(form).alias("form"), "batch_id", "span_pos", "name", F.col("startTimeUnixNano").alias("start_nanos"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


_ORDER_SPANS = "SELECT o_orderkey // 500 AS batch_id, row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) - 1 AS span_pos, * FROM orders"
_ORDER_EVENTS = f"""SELECT batch_id, span_pos::INT AS span_pos, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(traces.LINE_ORDER[1:])}) - 1)::INT AS event_pos,
  epoch_us(l_shipdate) * 1000 AS nanos, l_returnflag AS name, l_linestatus AS status FROM ({_ORDER_SPANS}) JOIN lineitem ON l_orderkey = o_orderkey"""


def _event_rows(flat: DataFrame) -> DataFrame:
    return flatten.events(flat).select("batch_id", "span_pos", "event_pos", F.col("timeUnixNano").alias("nanos"), "name", F.col("attributes")["status"]["s"].alias("status"))


@query(_ORDER_EVENTS)
def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_rows(flatten.spans(traces.order_batches(spark, sf_dir)))


@query(_ORDER_EVENTS)
def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that went through messages: differences of their times are of either sign and any length."""
    bodies = codec.encode(traces.order_batches(spark, sf_dir))
    return _event_rows(flatten.spans(codec.decode(bodies, column="dict")))


@query(f"SELECT batch_id, span_pos::INT AS span_pos, lpad(lower(hex(o_custkey)), 32, '0') AS trace_id, lpad(lower(hex(o_custkey)), 16, '0') AS span_id FROM ({_ORDER_SPANS})")
def wire_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = codec.encode(traces.order_batches(spark, sf_dir))
    found = flatten.links(flatten.spans(codec.decode(bodies, column="dict")))
    return found.select("batch_id", "span_pos", F.lower(F.hex("traceId")).alias("trace_id"), F.lower(F.hex("spanId")).alias("span_id"))


@query(f"""WITH s AS ({_ORDER_SPANS}),
o AS (SELECT batch_id, span_pos, 0 AS f, o_custkey AS id FROM s UNION ALL SELECT batch_id, span_pos, 1, 0 FROM s UNION ALL SELECT batch_id, span_pos, 2, o_orderkey FROM s)
SELECT batch_id, lpad(lower(hex(id)), 16, '0') AS span_id, row_number() OVER (PARTITION BY batch_id ORDER BY min({{'p': span_pos, 'f': f}})) - 1 AS idx FROM o GROUP BY batch_id, id""")
def wire_shared_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of span ids in messages: a span's links stand before its parent, and that before itself."""
    found = codec.pools(codec.encode(traces.order_batches(spark, sf_dir)), column="dict").where("pool = 'spanId'")
    return found.select("batch_id", F.lower(F.hex(F.unbase64(F.get_json_object("key", "$[1]")))).alias("span_id"), "idx")


@query(f"SELECT batch_id, key AS name, idx FROM (SELECT batch_id, name AS key, row_number() OVER (PARTITION BY batch_id ORDER BY min(event_id)) - 1 AS idx FROM ({_EVENT_SPANS}) GROUP BY batch_id, name)")
def wire_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of span names as messages hold it."""
    found = codec.pools(codec.encode(traces.event_batches(spark, sf_dir)), column="dict").where("pool = 'resourceSpans item scopeSpans item spans item name'")
    return found.select("batch_id", F.get_json_object("key", "$[1]").alias("name"), "idx")


@query()
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every batch in each of the seven formats."""
    return codec.sizes(traces.event_batches(spark, sf_dir))


@query()
def format_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds that each format took to write and read, over all batches."""
    taken = codec.timed(traces.event_batches(spark, sf_dir))
    return taken.groupBy("format").agg(F.sum("spans").alias("spans"), F.sum("bytes").alias("bytes"), F.sum("write_nanos").alias("write_nanos"), F.sum("read_nanos").alias("read_nanos"), F.count("error").alias("errors"))


@query("SELECT event_id // 500 AS batch_id, count(*) AS spans, true AS read_back FROM events GROUP BY 1")
def formats_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of the seven formats gives the batch back that protocol buffers give."""
    found = codec.roundtrips(traces.event_batches(spark, sf_dir))
    return found.select("batch_id", "spans", functools.reduce(Column.__and__, [F.col(f) for f in codec.FORMATS]).alias("read_back"))


@query("SELECT o_orderkey AS trace, 0 AS pos, 0 AS depth FROM orders UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(traces.LINE_ORDER[1:]) + "), CASE WHEN o_orderkey IS NOT NULL THEN 1 END FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def trace_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.depth(traces.order_spans(spark, sf_dir), "trace", "pos", "parent").select("trace", F.col("pos").cast("long").alias("pos"), "depth")


@query("""WITH s AS (SELECT o_orderkey AS trace, 0 AS span, NULL AS parent, floor(o_totalprice)::BIGINT AS nanos FROM orders
UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice), 0, floor(l_quantity * 10)::BIGINT FROM lineitem),
c AS (SELECT trace, parent, sum(nanos)::BIGINT AS n FROM s WHERE parent IS NOT NULL GROUP BY ALL)
SELECT s.trace, s.span, s.nanos, greatest(s.nanos - coalesce(c.n, 0), 0) AS self_nanos FROM s LEFT JOIN c ON c.trace = s.trace AND c.parent = s.span""")
def span_self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy(*traces.LINE_ORDER[1:])
    roots = orders.select(F.col("o_orderkey").alias("trace"), F.lit(0).cast("long").alias("span"), F.lit(None).cast("long").alias("parent"), F.floor("o_totalprice").alias("nanos"))
    children = items.select(F.col("l_orderkey").alias("trace"), F.row_number().over(place).cast("long").alias("span"), F.lit(0).cast("long").alias("parent"), F.floor(F.col("l_quantity") * 10).alias("nanos"))
    return tree.self_time(roots.unionByName(children), "trace", "span", "parent", "nanos")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS name, count(*) AS spans, sum(user_id)::BIGINT AS nanos FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.col("user_id").alias("nanos"))
    return jobs.windowed(rows, "1 hour", "0 seconds").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id AS trace, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS spans FROM s GROUP BY user_id, n""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("trace"))
    found = jobs.sessions(rows, "30 minutes", "0 seconds")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
