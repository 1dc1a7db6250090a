import json

import pytest

from tracefold import definition as d


def test_trace_definition_survives_json():
    assert d.same(d.load(json.dumps(d.dump(d.TRACE))), d.TRACE)
    assert len(d.pool_order(d.TRACE)) == 19
    assert d.load({}) == d.Definition()


def test_pools_come_after_those_they_refer_to():
    order = d.pool_order(d.TRACE)
    spans = "resourceSpans item scopeSpans item spans item"
    assert order.index("resourceSpans item scopeSpans item scope name") < order.index("resourceSpans item scopeSpans item scope")
    assert order.index("traceId") < order.index(f"{spans} links item")
    assert order.count("spanId") == 1


def test_paths():
    assert d.resolve(d.TRACE, "resourceSpans item resource").type == d.OBJECT
    assert d.resolve(d.TRACE, "spanId").type == d.BYTES
    assert d.resolve(d.TRACE, "nothing here") is None


@pytest.mark.parametrize(
    "fields",
    [
        {"a": d.Definition(d.BYTES, share="p"), "b": d.Definition(d.BYTES, share="p", nullable=True)},
        {"a": d.Definition(d.OBJECT, share="p", fields={"b": d.Definition(d.STRING, share="p")})},
        {"a": d.Definition(d.OBJECT, pooled=True, fields={"b": d.Definition(diff=True)})},
        {"a": d.Definition(d.OBJECT, share="p", fields={"b": d.Definition(d.STRING, pooled=True)})},
        {"a b": d.Definition()},
        {"item": d.Definition()},
    ],
)
def test_definitions_that_are_refused(fields):
    with pytest.raises(d.DefinitionError):
        d.validate(d.Definition(d.OBJECT, fields=fields))


def test_spark_types_tell_pools():
    span = d.BATCHES["resourceSpans"].dataType.elementType["scopeSpans"].dataType.elementType["spans"].dataType.elementType
    assert span["parentSpanId"].metadata == {"pool": "spanId"}
    assert span["startTimeUnixNano"].metadata == {"diff": True}
