"""The public trace protocol's own formats: batches as JSON and as protocol buffers, to value trees and back.

Numbers of fields and names are those of the public protocol. A reader sets every field, with the
protocol's default where the source has none; flags of spans and links aren't carried.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from typing import Any

from tracefold.definition import ARRAY, BYTES, INTEGER, LOGS, OBJECT, TRACE, Definition
from tracefold.values import kind

#: Message, then name:number:type of its fields; * marks repeated ones.
MESSAGES = """
TracesData resourceSpans:1:*ResourceSpans
ResourceSpans resource:1:Resource scopeSpans:2:*ScopeSpans schemaUrl:3:string
Resource attributes:1:*KeyValue droppedAttributesCount:2:uint32
ScopeSpans scope:1:Scope spans:2:*Span schemaUrl:3:string
Scope name:1:string version:2:string attributes:3:*KeyValue droppedAttributesCount:4:uint32
Span traceId:1:bytes spanId:2:bytes traceState:3:string parentSpanId:4:bytes name:5:string kind:6:int32 startTimeUnixNano:7:fixed64 endTimeUnixNano:8:fixed64 attributes:9:*KeyValue droppedAttributesCount:10:uint32 events:11:*Event droppedEventsCount:12:uint32 links:13:*Link droppedLinksCount:14:uint32 status:15:Status
Event timeUnixNano:1:fixed64 name:2:string attributes:3:*KeyValue droppedAttributesCount:4:uint32
Link traceId:1:bytes spanId:2:bytes traceState:3:string attributes:4:*KeyValue droppedAttributesCount:5:uint32
Status message:2:string code:3:int32
KeyValue key:1:string value:2:AnyValue
AnyValue stringValue:1:string boolValue:2:bool intValue:3:int64 doubleValue:4:double arrayValue:5:ArrayValue kvlistValue:6:KeyValueList bytesValue:7:bytes
ArrayValue values:1:*AnyValue
KeyValueList values:1:*KeyValue
"""
#: The member of an attribute's value for each type's ordinal.
MEMBERS = ("intValue", "boolValue", "doubleValue", "bytesValue", "stringValue", "kvlistValue", "arrayValue")
_ID_SIZES = {"traceId": 16, "spanId": 8, "parentSpanId": 8}


@lru_cache(maxsize=1)
def _classes() -> dict[str, type]:
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    field = descriptor_pb2.FieldDescriptorProto
    scalars = {n: getattr(field, f"TYPE_{n.upper()}") for n in ("string", "bytes", "bool", "double", "int32", "int64", "uint32", "fixed64")}
    file = descriptor_pb2.FileDescriptorProto(name="tracefold.proto", package="tracefold", syntax="proto3")
    for line in MESSAGES.split("\n"):
        name, *fields = line.split() or [""]
        if not name:
            continue
        message = file.message_type.add(name=name)
        if name == "AnyValue":
            message.oneof_decl.add(name="value")
        for part in fields:
            label, number, type_name = part.split(":")
            added = message.field.add(name=label, number=int(number), label=field.LABEL_REPEATED if type_name[0] == "*" else field.LABEL_OPTIONAL)
            type_name = type_name.lstrip("*")
            if type_name in scalars:
                added.type = scalars[type_name]
            else:
                added.type, added.type_name = field.TYPE_MESSAGE, f".tracefold.{type_name}"
            if name == "AnyValue":
                added.oneof_index = 0
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return {m.name: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"tracefold.{m.name}")) for m in file.message_type}


def _set_any(value: Any, to: Any) -> None:
    if value is None:
        return
    shape = kind(value)
    if shape == OBJECT:
        to.kvlistValue.SetInParent()
        _set_pairs(value, to.kvlistValue.values)
    elif shape == ARRAY:
        to.arrayValue.SetInParent()
        for item in value:
            _set_any(item, to.arrayValue.values.add())
    else:
        setattr(to, MEMBERS[shape], value)


def _set_pairs(attributes: dict, to: Any) -> None:
    for key, value in attributes.items():
        pair = to.add(key=key)
        pair.value.SetInParent()
        _set_any(value, pair.value)


def _any(message: Any) -> Any:
    member = message.WhichOneof("value")
    if member == "kvlistValue":
        return {pair.key: _any(pair.value) for pair in message.kvlistValue.values}
    if member == "arrayValue":
        return [_any(item) for item in message.arrayValue.values]
    return getattr(message, member) if member else None


def _fill(value: dict, node: Definition, to: Any) -> None:
    for name, sub in node.fields.items():
        held = value.get(name)
        if held is None:
            continue
        if sub.type == OBJECT and sub.fields is None:
            _set_pairs(held, getattr(to, name))
        elif sub.type == OBJECT:
            getattr(to, name).SetInParent()
            _fill(held, sub, getattr(to, name))
        elif sub.type == ARRAY:
            for item in held:
                _fill(item, sub.item, getattr(to, name).add())
        else:
            setattr(to, name, held & (1 << 64) - 1 if name.endswith("UnixNano") else held)


def _taken(message: Any, node: Definition) -> dict:
    out: dict[str, Any] = {}
    for name, sub in node.fields.items():
        held = getattr(message, name)
        if sub.type == OBJECT and sub.fields is None:
            out[name] = {pair.key: _any(pair.value) for pair in held}
        elif sub.type == OBJECT:
            out[name] = _taken(held, sub)
        elif sub.type == ARRAY:
            out[name] = [_taken(item, sub.item) for item in held]
        else:
            out[name] = _id(name, held) if sub.type == BYTES else _signed(held) if sub.type == INTEGER else held
    return out


def _id(name: str, held: bytes) -> bytes:
    """An id cut or padded with zeros to its size."""
    return held[: _ID_SIZES[name]].ljust(_ID_SIZES[name], b"\0")


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def to_proto(value: dict) -> bytes:
    """A batch as a protocol buffer."""
    message = _classes()["TracesData"]()
    _fill(value, TRACE, message)
    return message.SerializeToString(deterministic=True)


def from_proto(body: bytes) -> dict:
    """The batch of a protocol buffer; a broken one raises ValueError."""
    from google.protobuf.message import DecodeError

    message = _classes()["TracesData"]()
    try:
        message.ParseFromString(body)
    except DecodeError as error:
        raise ValueError("not a protocol buffer") from error
    return _taken(message, TRACE)


def _json_any(value: Any) -> dict:
    if value is None:
        return {}
    shape = kind(value)
    if shape == OBJECT:
        held: Any = {"values": _json_pairs(value)}
    elif shape == ARRAY:
        held = {"values": [_json_any(x) for x in value]}
    elif shape == BYTES:
        held = base64.b64encode(value).decode()
    else:
        held = str(value) if shape == INTEGER else value
    return {MEMBERS[shape]: held}


def _json_pairs(attributes: dict) -> list[dict]:
    return [{"key": key, "value": _json_any(value)} for key, value in attributes.items()]


def _from_any(node: dict) -> Any:
    for member, held in node.items():
        if member == "intValue":
            return int(held)
        if member == "doubleValue":
            return float(held)
        if member == "bytesValue":
            return base64.b64decode(held)
        if member == "kvlistValue":
            return _from_pairs(held.get("values") or [])
        if member == "arrayValue":
            return [_from_any(x) for x in held.get("values") or []]
        return held
    return None


def _from_pairs(pairs: list[dict]) -> dict:
    return {pair["key"]: _from_any(pair.get("value") or {}) for pair in pairs}


def _to_json(value: dict, node: Definition) -> dict:
    out: dict[str, Any] = {}
    for name, sub in node.fields.items():
        held = value.get(name)
        if held is None or (not held and sub.type != OBJECT):
            continue
        if sub.type == OBJECT and sub.fields is None:
            if held:
                out[name] = _json_pairs(held)
        elif sub.type == OBJECT:
            out[name] = _to_json(held, sub)
        elif sub.type == ARRAY:
            out[name] = [_to_json(item, sub.item) for item in held]
        elif sub.type == BYTES:
            out[name] = held.hex()
        else:
            out[name] = str(held) if name.endswith("UnixNano") else held
    return out


def _read_json(source: dict, node: Definition) -> dict:
    out: dict[str, Any] = {}
    for name, sub in node.fields.items():
        held = source.get(name)
        if sub.type == OBJECT and sub.fields is None:
            out[name] = _from_pairs(held or [])
        elif sub.type == OBJECT:
            out[name] = _read_json(held or {}, sub)
        elif sub.type == ARRAY:
            out[name] = [_read_json(item, sub.item) for item in held or []]
        elif sub.type == BYTES:
            out[name] = _id(name, bytes.fromhex(held or ""))
        elif sub.type == INTEGER:
            out[name] = int(held or 0)
        else:
            out[name] = held or ""
    return out


def to_json(value: dict) -> str:
    """A batch in the protocol's JSON form: ids in hex, long integers as texts."""
    return json.dumps(_to_json(value, TRACE), ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> dict:
    """The batch of a JSON text; anything else raises ValueError."""
    try:
        return _read_json(json.loads(text), TRACE)
    except (AttributeError, KeyError, TypeError) as error:
        raise ValueError("not a trace batch") from error


def completed(value: Any, node: Definition = TRACE, name: str = "") -> Any:
    """A batch with the protocol's default for each field that it lacks; what it holds stays as it is."""
    if node.type == OBJECT and node.fields is not None:
        return {n: completed((value or {}).get(n), sub, n) for n, sub in node.fields.items()}
    if node.type == ARRAY:
        return [completed(item, node.item) for item in value or []]
    if value is not None:
        return value
    return {} if node.type == OBJECT else bytes(_ID_SIZES[name]) if node.type == BYTES else 0 if node.type == INTEGER else ""


def _records(value: dict) -> list[dict]:
    """All log records of a batch, in order."""
    return [x for r in value.get("resourceLogs") or [] for s in r.get("scopeLogs") or [] for x in s.get("logRecords") or []]


def logs_to_json(value: dict) -> str:
    """A batch of logs in the protocol's JSON form; the body of a record is any value."""
    out = _to_json(value, LOGS)
    for made, held in zip(_records(out), _records(value)):
        if held.get("body") is not None:
            made["body"] = _json_any(held["body"])
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def logs_from_json(text: str) -> dict:
    """The batch of logs of a JSON text; anything else raises ValueError."""
    try:
        source = json.loads(text)
        out = _read_json(source, LOGS)
        for made, held in zip(_records(out), _records(source)):
            made["body"] = _from_any(held.get("body") or {})
            for name in ("traceId", "spanId"):
                made[name] = made[name] if any(made[name]) else b""
        return out
    except (AttributeError, KeyError, TypeError) as error:
        raise ValueError("not a batch of logs") from error
