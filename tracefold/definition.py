"""Schema definitions: which fields a value tree has, and how each is encoded.

A definition is a fixed tree, loaded from JSON or built here. It is small and lives on the driver; its
Spark form is a StructType whose metadata tells pools and deltas.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

#: Ordinals of the value types, in the JSON and on the wire.
INTEGER, BOOLEAN, DOUBLE, BYTES, STRING, OBJECT, ARRAY = range(7)
NAMES = ("Integer", "Boolean", "Double", "Bytes", "String", "Object", "Array")
#: The types that dictionaries hold.
POOLABLE = (BYTES, STRING, OBJECT, ARRAY)


class DefinitionError(ValueError):
    """A definition that can't be encoded."""


@dataclass(frozen=True)
class Definition:
    """One node. fields None on an object means a free map; an item makes an array."""

    type: int = INTEGER
    nullable: bool = False
    pooled: bool = False
    share: str | None = None
    diff: bool = False
    fields: Mapping[str, Definition] | None = field(default=None, hash=False)
    item: Definition | None = None

    @property
    def names(self) -> list[str]:
        """Field names in wire order."""
        return sorted(self.fields or ())

    def pool(self, path: str) -> str | None:
        """The dictionary of this node, or None: the shared one, or one of its own path."""
        if self.type not in POOLABLE:
            return None
        return self.share if self.share is not None else path if self.pooled else None

    def children(self) -> Iterator[tuple[str, Definition]]:
        """Steps of a path and the nodes they lead to, in wire order."""
        if self.type == OBJECT:
            yield from ((name, self.fields[name]) for name in self.names)
        elif self.type == ARRAY and self.item is not None:
            yield "item", self.item


def load(source: str | Path | Mapping) -> Definition:
    """A validated definition from a JSON text, a file, or a parsed mapping."""
    if not isinstance(source, Mapping):
        text = Path(source).read_text() if isinstance(source, Path) or not source.lstrip().startswith("{") else source
        source = json.loads(text)
    found = _from_json(source)
    validate(found)
    return found


def _from_json(node: Mapping) -> Definition:
    kind = node.get("Type", INTEGER)
    if kind not in range(7):
        raise DefinitionError(f"unknown type {kind!r}")
    fields, item = node.get("Fields"), node.get("ItemDefinition")
    return Definition(
        type=kind,
        nullable=bool(node.get("Nullable")),
        pooled=bool(node.get("Pooled")),
        share=node.get("SharePoolId", "") if node.get("SharePooled") else None,
        diff=bool(node.get("DiffEncode")),
        fields=None if fields is None else {name: _from_json(sub) for name, sub in fields.items()},
        item=None if item is None else _from_json(item),
    )


def dump(node: Definition) -> dict:
    """The JSON form; load(dump(d)) == d."""
    out: dict = {"Type": node.type, "Nullable": node.nullable, "Pooled": node.pooled}
    if node.share is not None:
        out |= {"SharePooled": True, "SharePoolId": node.share}
    if node.diff:
        out["DiffEncode"] = True
    if node.fields is not None:
        out["Fields"] = {name: dump(node.fields[name]) for name in node.names}
    if node.item is not None:
        out["ItemDefinition"] = dump(node.item)
    return out


def same(one: Definition | None, other: Definition | None) -> bool:
    """Structural equality."""
    return (dump(one) if one else None) == (dump(other) if other else None)


def validate(root: Definition) -> None:
    """Raises DefinitionError unless the tree can be encoded and decoded.

    A shared dictionary may not be inside itself, and all its users must be defined alike and hold no
    dictionaries of their own; deltas may not stand under a dictionary; steps of a path must be clear.
    """
    users: dict[str, Definition] = {}

    def visit(node: Definition, path: str, above: tuple[str, ...], in_pool: bool) -> None:
        if node.share is not None:
            if node.share in above:
                raise DefinitionError(f"shared pool {node.share!r} inside itself at {path!r}")
            if not same(users.setdefault(node.share, node), node):
                raise DefinitionError(f"different definitions share pool {node.share!r}")
            above = (*above, node.share)
        if node.diff and in_pool:
            raise DefinitionError(f"delta under a pooled value at {path!r}")
        pooled = in_pool or node.pool(path) is not None
        for step, child in node.children():
            if node.type == OBJECT and (" " in step or step == "item"):
                raise DefinitionError(f"field name {step!r} can't be addressed")
            if node.share is not None and any(n.pool("x") for _, n in walk(child)):
                raise DefinitionError(f"pool inside the shared pool {node.share!r}")
            visit(child, f"{path} {step}".strip(), above, pooled)

    visit(root, "", (), False)


def walk(node: Definition, path: str = "") -> Iterator[tuple[str, Definition]]:
    """Every node with its path, children first, siblings in wire order."""
    for step, child in node.children():
        yield from walk(child, f"{path} {step}".strip())
    yield path, node


def pool_order(root: Definition) -> list[str]:
    """Dictionary ids so that each one comes after those that its entries refer to; shared ids once."""
    return list(dict.fromkeys(p for path, node in walk(root) if (p := node.pool(path)) is not None))


def resolve(root: Definition, path: str) -> Definition | None:
    """The node at a path of steps parted by spaces, or else the first user of the shared pool of that name."""
    node: Definition | None = root
    for step in path.split(" "):
        node = dict(node.children()).get(step) if node else None
    return node or next((n for _, n in walk(root) if n.share == path), None)


#: Attribute values: t is the type's ordinal, and the value is in the column of that type; nested
#: objects and arrays are typed JSON in n.
ATTRIBUTE = T.StructType([T.StructField("t", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("b", T.BooleanType()), T.StructField("d", T.DoubleType()), T.StructField("y", T.BinaryType()), T.StructField("s", T.StringType()), T.StructField("n", T.StringType())])
ATTRIBUTES = T.MapType(T.StringType(), ATTRIBUTE)
_SCALARS = {INTEGER: T.LongType(), BOOLEAN: T.BooleanType(), DOUBLE: T.DoubleType(), BYTES: T.BinaryType(), STRING: T.StringType()}


def spark_type(node: Definition) -> T.DataType:
    """The Spark type of a node; free maps are attribute maps."""
    if node.type == OBJECT:
        return ATTRIBUTES if node.fields is None else T.StructType([_spark_field(name, sub) for name, sub in node.fields.items()])
    if node.type == ARRAY:
        return T.ArrayType(spark_type(node.item) if node.item else ATTRIBUTE)
    return _SCALARS[node.type]


def _spark_field(name: str, node: Definition) -> T.StructField:
    told = {"pooled": node.pooled, "diff": node.diff} | ({"pool": node.share} if node.share is not None else {})
    return T.StructField(name, spark_type(node), True, {k: v for k, v in told.items() if v})


def _attributes() -> Definition:
    return Definition(OBJECT, nullable=True, pooled=True)


def _count() -> Definition:
    return Definition(INTEGER, nullable=True)


def _text(**more) -> Definition:
    return Definition(STRING, nullable=True, **({"pooled": True} | more))


def _record(fields: dict[str, Definition], **more) -> Definition:
    return Definition(OBJECT, fields=fields, **more)


def _records(fields: dict[str, Definition], **more) -> Definition:
    return Definition(ARRAY, nullable=True, item=_record(fields, **more))


def trace_definition() -> Definition:
    """The definition of a trace batch. The names of fields and shared pools, and their flags."""
    ids = {"traceId": Definition(BYTES, share="traceId"), "spanId": Definition(BYTES, nullable=True, share="spanId")}
    state = Definition(STRING, nullable=True, share="traceState")
    held = {"attributes": _attributes(), "droppedAttributesCount": _count()}
    when = Definition(INTEGER, diff=True)
    event = {"timeUnixNano": Definition(INTEGER, nullable=True, diff=True), "name": _text(), **held}
    link = {**ids, "traceState": state, **held}
    span = {
        **ids,
        "traceState": state,
        "parentSpanId": ids["spanId"],
        "name": Definition(STRING, pooled=True),
        "kind": _count(),
        "startTimeUnixNano": when,
        "endTimeUnixNano": when,
        **held,
        "events": _records(event),
        "droppedEventsCount": _count(),
        "links": _records(link, pooled=True),
        "droppedLinksCount": _count(),
        "status": _record({"message": _text(), "code": Definition(INTEGER)}, pooled=True),
    }
    scope = _record({"name": _text(), "version": _text(), **held}, pooled=True)
    scope_spans = _records({"scope": scope, "schemaUrl": _text(), "spans": _records(span)})
    return _record({"resourceSpans": _records({"resource": _record(held, pooled=True), "schemaUrl": _text(), "scopeSpans": scope_spans})})


def log_definition() -> Definition:
    """The definition of a batch of logs but for the records' bodies, which are of any type. The names of fields."""
    held = {"attributes": _attributes(), "droppedAttributesCount": _count()}
    ids = {"traceId": Definition(BYTES, nullable=True), "spanId": Definition(BYTES, nullable=True)}
    record = {"timeUnixNano": _count(), "observedTimeUnixNano": _count(), "severityNumber": _count(), "severityText": _text(), **held, "flags": _count(), **ids}
    scope = _record({"name": _text(), "version": _text(), **held}, pooled=True)
    scope_logs = _records({"scope": scope, "schemaUrl": _text(), "logRecords": _records(record)})
    return _record({"resourceLogs": _records({"resource": _record(held, pooled=True), "schemaUrl": _text(), "scopeLogs": scope_logs})})


TRACE = trace_definition()
LOGS = log_definition()
#: A table of batches: one row each.
BATCHES = T.StructType([T.StructField("batch_id", T.LongType()), *spark_type(TRACE).fields])
