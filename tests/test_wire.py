import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold import values as v
from tracefold.definition import ARRAY, BOOLEAN, BYTES, DOUBLE, INTEGER, OBJECT, STRING, TRACE, Definition, validate
from tracefold.wire import Codec, Options, Reader, WireError, write_varint

CODECS = [Codec(TRACE, Options(varint=a, string_pool=b)) for a in (True, False) for b in (True, False)]


def batch(*spans, attributes=None):
    return {"resourceSpans": [{"resource": {"attributes": attributes or {}, "droppedAttributesCount": 0}, "schemaUrl": "", "scopeSpans": [{"scope": {"name": "", "version": "", "attributes": {}, "droppedAttributesCount": 0}, "schemaUrl": "", "spans": list(spans)}]}]}


def span(start=5, end=9, **more):
    return {"traceId": b"\1" * 16, "spanId": b"\2" * 8, "parentSpanId": bytes(8), "traceState": "", "name": "a", "kind": 1, "startTimeUnixNano": start, "endTimeUnixNano": end, "attributes": {}, "events": [], "links": [], "status": {"code": 0, "message": ""}} | more


def spans_of(value):
    return value["resourceSpans"][0]["scopeSpans"][0]["spans"]


def test_golden_empty_batch():
    assert CODECS[0].encode({"resourceSpans": []}).hex() == "000063707276616c00"
    assert len(Codec(TRACE, Options(varint=False)).encode({"resourceSpans": []})) == 23


def test_golden_one_span():
    body = CODECS[0].encode(batch(span()))
    assert body[body.index(b"cprval") + 6 :].hex() == "0101" "0000" "0101" "0000" "0101" "00000000" "09" "00" "0101" "00" "00" "0100" "0101" "05" "00" "00" "00"
    strings, pools, _ = CODECS[0].parts(body)
    assert strings == [] and len(pools) == 6 and pools["spanId"] == [bytes(8), b"\2" * 8]
    later = CODECS[0].encode(batch(span(), span(start=3)))
    assert [s["startTimeUnixNano"] for s in spans_of(CODECS[0].decode(later))] == [5, 3]


@pytest.mark.parametrize(("number", "hexed"), [(0, "00"), (63, "3f"), (64, "c000"), (-1, "7f"), (-2, "7e"), (-64, "40"), (-65, "bf7f")])
def test_golden_varints(number, hexed):
    assert write_varint(number).hex() == hexed


def test_varint_edges():
    for k in range(1, 9):
        edge = 1 << 7 * k - 1
        for number, size in ((edge - 1, k), (-edge, k), (edge, k + 1), (-edge - 1, k + 1)):
            data = write_varint(number)
            assert (Reader(data, Options()).integer(), len(data)) == (number, size)
    for number in (2**63 - 1, -(2**63)):
        assert Reader(write_varint(number), Options()).integer() == number


def test_fnv_vectors():
    assert v.fnv1a(b"a") == 0xE40C292C and v.fnv1a(b"foobar") == 0xBF9CF968
    assert v.value_hash(1) != v.value_hash(1.0) != v.value_hash("1") != v.value_hash(True)
    assert v.value_hash({"a": 1, "b": None}) == v.value_hash({"b": None, "a": 1}) != v.value_hash({"a": 1})


SCALARS = st.one_of(st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(), st.binary(max_size=8), st.text(st.characters(exclude_categories=["Cs"]), max_size=8))
FREE = st.recursive(SCALARS, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), st.one_of(st.none(), x), max_size=3)), max_leaves=8)
TIMES = st.integers(0, 2**63 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TIMES, TIMES, st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=5), st.one_of(st.none(), FREE), min_size=1, max_size=3), st.lists(TIMES, max_size=3)), min_size=1, max_size=4))
def test_round_trip(rows):
    spans = [span(a, b, attributes=m, events=[{"timeUnixNano": t, "name": "e", "attributes": {}} for t in ts]) for a, b, m, ts in rows]
    for codec in CODECS:
        body = codec.encode(batch(*spans))
        got = spans_of(codec.decode(body))
        for want, have in zip(spans, got, strict=True):
            assert (have["startTimeUnixNano"], have["endTimeUnixNano"]) == (want["startTimeUnixNano"], want["endTimeUnixNano"])
            assert v.equal(have["attributes"], want["attributes"])
            assert [e["timeUnixNano"] or 0 for e in have["events"] or []] == [e["timeUnixNano"] for e in want["events"]]
        assert codec.encode(batch(*spans)) == body


def test_pool_identity():
    values = [0.0, -0.0, math.nan, 1, 1.0, "1", True, [1], {"a": 1}]
    spans = [span(attributes={"x": x}) for x in values + values]
    _, pools, value = CODECS[0].parts(CODECS[0].encode(batch(*spans)))
    assert len(pools["resourceSpans item scopeSpans item spans item attributes"]) == len(values)
    got = [s["attributes"]["x"] for s in spans_of(value)]
    assert [v.canonical(x) for x in got] == [v.canonical(x) for x in values + values]


@given(st.lists(FREE, max_size=6))
def test_identity_is_that_of_canonical_texts(values):
    for one in values:
        assert v.equal(v.from_canonical(v.canonical(one)), one) and v.equal(v.from_tagged(v.to_tagged(one)), one)
        for other in values:
            assert (v.identity(one) == v.identity(other)) == v.equal(one, other)


def test_what_is_left_out_and_kept():
    out = spans_of(CODECS[0].decode(CODECS[0].encode(batch(span(kind=0, attributes={"i": 0, "s": "", "b": False, "n": None})))))[0]
    assert out["kind"] is None and out["attributes"] == {"i": 0, "s": "", "b": False, "n": None}
    assert out["parentSpanId"] == bytes(8)


def test_scope_without_spans():
    assert spans_of(CODECS[0].decode(CODECS[0].encode(batch()))) is None


@pytest.mark.parametrize("broken", [{"traceId": None}, {"name": 5}, {"attributes": {"x": [None]}}])
def test_values_that_are_refused(broken):
    with pytest.raises(WireError):
        CODECS[0].encode(batch(span(**broken)))


def test_bodies_that_are_refused():
    body = CODECS[0].encode(batch(span(attributes={"k": "v"})))
    for n in range(len(body)):
        with pytest.raises(WireError):
            CODECS[0].decode(body[:n])
    for bad in (body + b"\0", body.replace(b"cprval", b"cprvax"), body[:-1] + b"\7", b"\x7f" + body[1:]):
        with pytest.raises(WireError):
            CODECS[0].decode(bad)


def test_other_definitions():
    fields = {"a": Definition(INTEGER, nullable=True, diff=True), "b": Definition(BOOLEAN), "c": Definition(DOUBLE, nullable=True), "d": Definition(STRING, share="s"), "e": Definition(STRING, share="s"), "f": Definition(ARRAY, item=Definition(BYTES, pooled=True)), "g": Definition(OBJECT), "h": Definition(OBJECT, fields={})}
    node = Definition(OBJECT, fields=fields)
    validate(node)
    value = {"a": -(2**63), "b": False, "c": 0.0, "d": "x", "e": "x", "f": [b"", b"q", b""], "g": {"z": struct.pack(">d", 1.0)}, "h": {}}
    assert Codec(node).decode(Codec(node).encode(value)) == value
    rows = Definition(ARRAY, item=node)
    many = [value, value | {"a": 2**63 - 1}, value | {"a": None}, value | {"a": 1}]
    assert Codec(rows).decode(Codec(rows).encode(many)) == many
