import gzip
import json
import threading
import urllib.error
import urllib.request

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tests.test_wire import batch, span
from tracefold.definition import BATCHES, TRACE
from tracefold.functions import scalars as fn
from tracefold.operators import codec, delta, dictionary, flatten
from tracefold.operators import tree as tree_operators
from tracefold.plans import registry
from tracefold.sources import files, http, otlp, traces
from tracefold.sources.rows import pylist, row, tree
from tracefold.streaming import jobs
from tracefold.values import bits, fnv1a, value_hash
from tracefold.wire import Codec, Options, wrap


@pytest.fixture(scope="module")
def batches(spark, sf_dir):
    return traces.event_batches(spark, sf_dir, 100).cache()


def frame(spark, values):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = [{"batch_id": k, **row(x)} for k, x in enumerate(values)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(BATCHES)), BATCHES)


NESTED = batch(span(attributes={"a": [1, {"b": b"x"}], "n": None, "d": -0.0}, events=[{"timeUnixNano": 7, "name": "e", "attributes": {"k": "ü"}, "droppedAttributesCount": 2}], links=[{"traceId": b"\3" * 16, "spanId": b"\2" * 8, "traceState": "t", "attributes": {}, "droppedAttributesCount": 0}]), span(start=1))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, sf_dir, name, tmp_path):
    """Rows and types are those of the SQL, where there is one."""
    registry.QUERIES[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
    if name not in registry.ORACLE_SQL:
        return
    con = duckdb.connect()
    for table in "customer events lineitem nation orders part".split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in want.columns)} FROM '{tmp_path}/out/*.parquet'")
    assert sorted(map(repr, got.fetchall())) == sorted(map(repr, want.fetchall()))


def test_formats_agree(spark):
    both = frame(spark, [NESTED, batch(), {"resourceSpans": []}])
    coded = codec.encode(both, codec.FORMATS)
    assert coded.where("error IS NOT NULL").count() == 0
    for form in codec.FORMATS:
        back = codec.decode(coded, form, column=form)
        assert back.where("error IS NOT NULL").count() == 0
        flat = flatten.to_protocol(flatten.spans(back)).select("name", "startTimeUnixNano", F.hex("parentSpanId"), F.size("events"), F.to_json("attributes")).collect()
        assert [tuple(r)[:4] for r in flat] == [("a", 5, "00" * 8, 1), ("a", 1, "00" * 8, 0)]
    first = coded.where("batch_id = 0").first()
    assert gzip.decompress(first["dict_gzip"]) == bytes(first["dict"])
    assert set(codec.sizes(both).where("batch_id = 0").toPandas()["format"]) == set(codec.FORMATS)


def test_formats_are_compared_in_one_pass(spark, sf_dir):
    """Each batch is made once, of flat rows, and no text of a batch is shuffled or joined."""
    plan = registry.QUERIES["formats_roundtrip"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == plan.count("FileScan") == 1 and "Join" not in plan
    dealt = traces.event_batches(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("Exchange") == 1 and "collect_list" not in dealt[dealt.index("Exchange") :]


def test_formats_of_events_with_nulls_and_repeated_ids(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT CASE WHEN i % 7 > 0 THEN i // 2 END AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, CASE WHEN i % 5 > 0 THEN i END AS user_id,
      CASE WHEN i % 3 > 0 THEN 'view' END AS event_type, CASE WHEN i % 2 > 0 THEN i / 8 END AS value, CASE WHEN i % 11 > 0 THEN '{{"k": 1}}' END AS props FROM range(3000) t(i)) TO '{tmp_path}/events.parquet'""")
    want = duckdb.sql(registry.ORACLE_SQL["formats_roundtrip"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    got = [tuple(r) for r in registry.QUERIES["formats_roundtrip"](spark, str(tmp_path)).collect()]
    assert len(want) == 4 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_rows_by_columns():
    kind = to_arrow_type(BATCHES["resourceSpans"].dataType)
    values = [row(v)["resourceSpans"] for v in (NESTED, batch(), {"resourceSpans": []}, batch(span(name=None, attributes=None, links=None, status=None)))]
    values += [None, [None], values[0] + [None] + values[0]]
    array = pa.array(values, kind)
    for low in range(len(values) + 1):
        for size in range(len(values) + 1 - low):
            assert repr(pylist(array.slice(low, size))) == repr(array.slice(low, size).to_pylist())
    hidden = pa.ListArray.from_arrays(pa.array([0, 2, 3], pa.int32()), pa.array([1, 2, 3]), mask=pa.array([True, False]))  # a null that stands for two items
    bare = pa.Array.from_buffers(pa.list_(pa.int64()), 0, [None, pa.py_buffer(b"")], children=[pa.array([], pa.int64())])
    assert pylist(bare) == [] and pylist(hidden) == [None, [3]] and pylist(pa.array([{"a": 1}, None])) == [{"a": 1}, None]


def test_formats_that_differ_or_fail_are_told(spark, monkeypatch):
    bad = frame(spark, [NESTED, batch(span(name=None, traceId=None)), batch(span(attributes={"x": [None]})), batch(span(droppedAttributesCount=-1))])
    rows = {r["batch_id"]: r for r in codec.roundtrips(bad).collect()}
    assert [[rows[k][f] for f in codec.FORMATS] for k in range(4)] == [[True] * 7, [True] * 7, [True] * 4 + [None] * 3, [None] * 7]
    assert [rows[k]["spans"] for k in range(4)] == [2, 1, 1, 1] and rows[0]["error"] is None and "dict: " in rows[2]["error"] and "proto: " in rows[3]["error"]
    other = lambda f, change: lambda *a: change(f(*a))
    monkeypatch.setattr(otlp, "from_json", other(otlp.from_json, lambda v: {"resourceSpans": v["resourceSpans"] * 2}))
    found = codec.compared(NESTED, codec.FORMATS, Options())
    assert [f for f in codec.FORMATS if not found[f]] == ["json"]
    later = Codec(TRACE).encode(batch(span(start=6)))
    monkeypatch.setattr(codec, "decompressed", lambda body, method: later if method == "gzip" else b"")
    found = codec.compared(batch(span()), ("dict", "dict_gzip", "dict_zstd", "proto_zstd"), Options())
    assert (found["dict"], found["dict_gzip"], found["dict_zstd"], found["proto_zstd"]) == (True, False, None, False) and "dict_zstd: " in found["error"]


def test_broken_rows_are_told_apart(spark):
    good = Codec(TRACE).encode(NESTED)
    bodies = spark.createDataFrame([(1, good), (2, good[:-3]), (3, None), (4, b"")], "batch_id long, body binary")
    errors = {r["batch_id"]: r["error"] for r in codec.decode(bodies).collect()}
    assert errors[1] is None and all(errors[k] for k in (2, 3, 4))


def test_broken_messages_and_formats_are_rows_of_their_own(spark):
    good = Codec(TRACE).encode(NESTED)
    bodies = spark.createDataFrame([(1, good), (2, good[:-3]), (3, None)], "batch_id long, body binary")
    found = codec.pools(bodies)
    assert {r["batch_id"] for r in found.where("error IS NULL").collect()} == {1}
    assert sorted(r["batch_id"] for r in found.where("error IS NOT NULL").collect()) == [2, 3]
    bad = frame(spark, [NESTED, batch(span(name=None))])  # JSON and protocol buffers have a name that is left out, messages don't
    coded = {r["batch_id"]: r for r in codec.encode(bad, ("proto", "dict", "json")).collect()}
    assert coded[0]["error"] is None and "dict: " in coded[1]["error"] and "json: " not in coded[1]["error"]
    assert coded[1]["dict"] is None and coded[1]["proto"] and coded[1]["json"]
    rows = {(r["batch_id"], r["format"]): r for r in codec.sizes(bad).collect()}
    assert len(rows) == 14 and rows[1, "dict"]["error"] and rows[1, "dict"]["bytes"] is None and rows[1, "json"]["bytes"] > 0
    assert codec.timed(bad).where("error IS NOT NULL").count() == 3
    assert codec.sizes(frame(spark, [NESTED, NESTED]).withColumn("batch_id", F.lit(7).cast("long"))).count() == 14  # ids that repeat


def test_pools_of_columns_are_those_of_messages(spark, batches):
    flat = flatten.spans(batches)
    position = F.struct("rs_pos", "ss_pos", "span_pos")
    seen = dictionary.occurrences(flat, F.col("batch_id"), "resourceSpans item scopeSpans item spans item name", F.col("name"), position)
    ids = [dictionary.occurrences(flat, F.col("batch_id"), "spanId", F.hex(c), F.struct(position.alias("p"), F.lit(k).alias("f"))) for k, c in enumerate(("parentSpanId", "spanId"))]
    want = dictionary.assign(seen).select("batch", "pool", "idx", "key").unionByName(dictionary.assign(dictionary.shared(ids)).select("batch", "pool", "idx", "key"))
    found = codec.pools(codec.encode(batches), column="dict").where(F.col("pool").isin("spanId", "resourceSpans item scopeSpans item spans item name"))
    held = F.get_json_object("key", "$[1]")
    got = found.select(F.col("batch_id").alias("batch"), "pool", "idx", F.when(F.col("pool") == "spanId", F.hex(F.unbase64(held))).otherwise(held).alias("key"))
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_flatten_and_rebuild(spark):
    two = {"resourceSpans": [*NESTED["resourceSpans"], *batch()["resourceSpans"]]}
    df = frame(spark, [two, {"resourceSpans": []}])
    again = flatten.rebuild(df, flatten.resources(df), flatten.scopes(df), flatten.spans(df))
    want = {r["batch_id"]: r["j"] for r in df.select("batch_id", F.to_json("resourceSpans").alias("j")).collect()}
    assert {r["batch_id"]: r["j"] for r in again.select("batch_id", F.to_json("resourceSpans").alias("j")).collect()} == want
    assert flatten.events(flatten.spans(df)).count() == 1 and flatten.links(flatten.spans(df)).count() == 1
    assert flatten.compact(flatten.spans(df)).where("kind = 0").count() == 0


def test_delta_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 3), (2, 0, None), (2, 1, 7)], "b long, p long, v long")
    steps = delta.encode(df, "v", ["b"], ["p"], "s")
    assert [r["s"] for r in steps.orderBy("b", "p").collect()] == [5, None, -2, None, 7]
    back = delta.decode(steps, "s", ["b"], ["p"], "w")
    assert back.where("NOT (v <=> w)").count() == 0


def test_deltas_wrap_as_messages_do(spark):
    edge = [2**63 - 1, -(2**63), 0, None, 2**63 - 1, 2**63 - 1, -(2**63), -1, 1, 2**32, -(2**32), 2**31]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(edge)], "b long, p long, v long")
    steps = delta.encode(rows, "v", ["b"], ["p"], "s").orderBy("p").collect()
    last, want = 0, []
    for v in edge:
        want.append(None if v is None else wrap(v - last))
        last = last if v is None else v
    assert [r["s"] for r in steps] == want
    back = delta.decode(spark.createDataFrame(steps), "s", ["b"], ["p"], "w")
    assert back.where("NOT (v <=> w)").count() == 0


def test_hashes(spark):
    texts, numbers = ["", "a", "foobar", "é", None], [0.0, -0.0, 1.5, float("nan"), None]
    rows = spark.createDataFrame([(k, s, d) for k, (s, d) in enumerate(zip(texts, numbers))], "k int, s string, d double").orderBy("k")
    got = rows.select(fn.fnv1a_bytes(F.col("s")).alias("s"), fn.fnv1a_double(F.col("d")).alias("d"), fn.fnv1a_long(F.col("k")).alias("k")).collect()
    assert [r["s"] for r in got] == [None if s is None else fnv1a(s.encode()) for s in texts]
    assert [r["d"] for r in got] == [None if d is None else value_hash(d) for d in numbers]
    assert [r["k"] for r in got] == [value_hash(k) for k in range(5)]
    assert bits(1.0) == 0x3FF0000000000000


def test_elision_and_checks(spark):
    row = spark.range(1).select(
        fn.elide(F.lit(0).cast("long"), T.LongType()).alias("a"), fn.elide(F.lit(False), T.BooleanType()).alias("b"), fn.elide(F.lit(0.0), T.DoubleType()).alias("c"), fn.elide(F.lit(""), T.StringType()).alias("d"),
        fn.restore(F.lit(None).cast("binary"), T.BinaryType()).alias("e"), fn.varint_length(F.lit(-65).cast("long")).alias("f"), fn.sized_length(F.lit("é")).alias("g"),
    ).first()
    assert tuple(row) == (None, False, 0.0, None, b"", 2, 3)
    with pytest.raises(Exception, match="value is not nullable"):
        spark.range(1).select(fn.required(F.lit(None).cast("long"), "x")).collect()
    with pytest.raises(Exception, match="type conflict"):
        spark.range(1).select(fn.of_type(fn.tagged(F.lit("1"), 4), 0)).collect()


def test_attribute_keys(spark):
    one, two = (F.create_map(F.lit("a"), fn.tagged(x, t), F.lit("b"), fn.tagged(F.lit("z"), 4)) for x, t in ((F.lit(1), 0), (F.lit("1"), 4)))
    other = F.create_map(F.lit("b"), fn.tagged(F.lit("z"), 4), F.lit("a"), fn.tagged(F.lit(1), 0))
    row = spark.range(1).select(*(fn.attributes_key(c) for c in (one, two, other)), fn.tagged_key(fn.tagged(F.lit(-0.0), 2)), fn.tagged_key(fn.tagged(F.lit(0.0), 2))).first()
    assert row[0] == row[2] != row[1] and row[3] != row[4]


def test_files_and_streams(spark, tmp_path, batches):
    files.register(spark)
    spool, lines = f"{tmp_path}/spool", f"{tmp_path}/lines"
    traces.write_messages(batches, spool, ("dict",))
    assert flatten.spans(traces.read_messages(spark, spool)).count() == 1000
    assert spark.read.format(files.NAME).option("path", spool).load().count() == 10
    traces.write_json_lines(batches, lines)
    assert flatten.spans(traces.read_json_lines(spark, lines)).count() == 1000
    (tmp_path / "lines" / "bad.txt").write_text("not json\n")
    query = jobs.encode_stream(jobs.text_batches(spark, lines), f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/cp")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10 and spark.read.parquet(f"{tmp_path}/dead").count() == 1
    query = jobs.encode_stream(jobs.message_batches(spark, spool), f"{tmp_path}/out2", f"{tmp_path}/dead2", f"{tmp_path}/cp2")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 10
    one = Codec(TRACE).encode(NESTED)
    for name in ("0-late_out", "zz_out"):  # before and after all others by name, and later than they
        files.store_file(spool, name, one)
    jobs.encode_stream(jobs.message_batches(spark, spool), f"{tmp_path}/out2", f"{tmp_path}/dead2", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 12
    assert files.file_name("dict") != files.file_name("dict")
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "a.txt").write_text('{"resourceSpans": []}\n' * 3)
    assert traces.read_json_lines(spark, f"{tmp_path}/twice").select("batch_id").distinct().count() == 3


def test_bounded_batches(spark):
    rows = spark.range(25).select((F.col("id") % 2).alias("g"), F.col("id").alias("at"))
    sizes = flatten.batched(rows, 5, "g", ("at",)).groupBy("g", "batch_no").count().collect()
    assert sorted(r["count"] for r in sizes) == [2, 3, 5, 5, 5, 5]
    hot = spark.range(5000).select(F.lit("g").alias("g"), (F.lit(5000) - F.col("id")).alias("at"), F.lit(1).alias("held"))
    found = flatten.batched(hot, 100, "g", ("at",))
    assert found.columns == ["g", "at", "held", "batch_no"] and found.where("batch_no <> floor((at - 1) / 100)").count() == 0


def test_trees(spark):
    spans = spark.createDataFrame([("t", "a", None, 10), ("t", "b", "a", 4), ("t", "c", "b", 9), ("t", "x", "gone", 1), ("t", "y", "z", 1), ("t", "z", "y", 1)], "t string, s string, p string, n long").toDF("trace", "span", "parent", "nanos")
    depths = {r["span"]: r["depth"] for r in tree_operators.depth(spans, "trace", "span", "parent").collect()}
    assert depths == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    broken = {r["span"]: r["broken"] for r in tree_operators.depth(spans, "trace", "span", "parent").collect()}
    assert broken == {"a": None, "b": None, "c": None, "x": "missing", "y": "circle", "z": "circle"}
    own = {r["span"]: r["self_nanos"] for r in tree_operators.self_time(spans, "trace", "span", "parent", "nanos").collect()}
    assert own == {"a": 6, "b": 0, "c": 9, "x": 1, "y": 0, "z": 0}


def test_depths_of_long_and_wide_traces(spark):
    chain = [("chain", k, k - 1 if k else None) for k in range(1000)]
    star = [("star", k, 0 if k else None) for k in range(2000)]
    lost = [("lost", k, k - 1) for k in range(40)]
    ring = [("ring", k, (k + 1) % 7) for k in range(7)] + [("ring", k, k - 1) for k in range(7, 50)]
    spans = spark.createDataFrame(chain + star + lost + ring, "trace string, span long, parent long")
    found = tree_operators.depth(spans, "trace", "span", "parent")
    rows = {(r["trace"], r["span"]): (r["depth"], r["broken"]) for r in found.collect()}
    assert len(rows) == 3090
    for (trace, k), got in rows.items():
        assert got == {"chain": (k, None), "star": (min(k, 1), None), "lost": (None, "missing"), "ring": (None, "circle")}[trace]
    assert tree_operators.depth(spans.limit(0), "trace", "span", "parent").count() == 0


def test_console(spark, sf_dir, tmp_path, capfd):
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    jobs.console(source, f"{tmp_path}/cp").awaitTermination()


def test_http(spark, tmp_path):
    server = http.receiver(0, f"{tmp_path}/spool", dead=f"{tmp_path}/dead")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/any"
    good = Codec(TRACE).encode(NESTED)
    bodies = spark.createDataFrame([(1, good), (2, b"junk")], "batch_id long, body binary")
    assert {r["batch_id"]: r["status"] for r in http.post(bodies, url).collect()} == {1: 200, 2: 500}
    with pytest.raises(urllib.error.HTTPError) as refused:
        urllib.request.urlopen(url)
    assert refused.value.code == 405
    traces.write_json_lines(frame(spark, [NESTED]), f"{tmp_path}/lines")
    jobs.encode_stream(jobs.text_batches(spark, f"{tmp_path}/lines"), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", url=url).awaitTermination()
    assert [r["status"] for r in spark.read.parquet(f"{tmp_path}/out-posted").collect()] == [200] and spark.read.parquet(f"{tmp_path}/out").count() == 1
    server.shutdown()
    assert len(files.listed(f"{tmp_path}/spool")) == 2 and len(files.listed(f"{tmp_path}/dead")) == 1
    assert http.post(bodies, "http://127.0.0.1:1/").where("error IS NULL").count() == 0


LOGS = {"resourceLogs": [{"resource": {"attributes": [{"key": "service", "value": {"stringValue": "shop"}}]}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [
    {"timeUnixNano": "7", "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "é"}, "traceId": "01" * 16, "spanId": "02" * 8, "flags": 1},
    {"body": {"kvlistValue": {"values": [{"key": "n", "value": {"intValue": "5"}}, {"key": "a", "value": {"arrayValue": {"values": [{"boolValue": True}, {"doubleValue": 1.5}]}}}]}}},
    {"attributes": [{"key": "b", "value": {"bytesValue": "AQI="}}]},
]}]}]}


def test_logs(spark, tmp_path):
    text = otlp.logs_to_json(otlp.logs_from_json(json.dumps(LOGS)))
    records = json.loads(text)["resourceLogs"][0]["scopeLogs"][0]["logRecords"]
    for got, want in zip(records, LOGS["resourceLogs"][0]["scopeLogs"][0]["logRecords"], strict=True):
        assert got == want
    assert otlp.logs_to_json(otlp.logs_from_json(text)) == text and otlp.logs_to_json(otlp.logs_from_json("{}")) == "{}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(json.dumps(LOGS) + "\nno json\n")
    lines = spark.read.text(f"{tmp_path}/in").select(F.length("value").cast("long").alias("batch_id"), F.encode("value", "UTF-8").alias("body"))
    rows = {r["batch_id"]: r for r in codec.log_lines(lines).collect()}
    assert rows[7]["error"] and rows[7]["value"] is None and rows[len(json.dumps(LOGS))]["value"] == text
    jobs.console(jobs.log_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination()


def test_protocol_forms():
    assert otlp.from_proto(otlp.to_proto(NESTED)) == otlp.from_json(otlp.to_json(NESTED))
    assert tree(row(NESTED)) == tree(row(tree(row(NESTED))))
    for bad in ("[]", "{", '{"resourceSpans": 5}'):
        with pytest.raises(ValueError):
            otlp.from_json(bad)
    with pytest.raises(ValueError):
        otlp.from_proto(b"\xff\xff")


def test_windows_of_a_stream(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.col("user_id").alias("nanos"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = jobs.windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 hour", "10 minutes")
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    want = jobs.windowed(rows, "1 hour", "10 minutes")
    assert spark.table("hours").exceptAll(want).isEmpty() and want.exceptAll(spark.table("hours")).isEmpty()
