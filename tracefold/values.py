"""Value trees in Python: None, int, bool, float, bytes, str, dict and list, told apart by type."""

from __future__ import annotations

import base64
import functools
import json
import math
import struct
from typing import Any

from tracefold.definition import ARRAY, BOOLEAN, BYTES, DOUBLE, INTEGER, OBJECT, STRING

#: FNV-1a with 32 bits.
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193
_KINDS = {int: INTEGER, bool: BOOLEAN, float: DOUBLE, bytes: BYTES, str: STRING, dict: OBJECT, list: ARRAY}
_COLUMNS = {INTEGER: "i", BOOLEAN: "b", DOUBLE: "d", BYTES: "y", STRING: "s", OBJECT: "n", ARRAY: "n"}


def kind(value: Any) -> int:
    """The ordinal of a value's type; TypeError for what no tree may hold."""
    found = _KINDS.get(type(value))
    if found is None or (found == INTEGER and not -(1 << 63) <= value < 1 << 63):
        raise TypeError(f"not a value: {value!r}")
    return found


def fnv1a(data: bytes, start: int = FNV_START) -> int:
    """FNV-1a of some bytes."""
    return functools.reduce(lambda h, x: (h ^ x) * FNV_PRIME & 0xFFFFFFFF, data, start)


def bits(number: float) -> int:
    """The IEEE bits of a double, as an unsigned number."""
    return struct.unpack(">Q", struct.pack(">d", number))[0]


def value_hash(value: Any) -> int:
    """The hash of a tree: scalars by their bytes, objects and arrays by the hashes of what they hold."""
    shape = kind(value)
    if shape == OBJECT:
        return fnv1a(b"".join(key.encode() + struct.pack("<I", 0 if value[key] is None else value_hash(value[key])) for key in sorted(value)))
    if shape == ARRAY:
        return fnv1a(b"".join(struct.pack("<I", 0 if x is None else value_hash(x)) for x in value))
    if shape == STRING:
        return fnv1a(value.encode())
    if shape == BYTES:
        return fnv1a(value)
    return fnv1a(struct.pack({INTEGER: ">q", BOOLEAN: ">B", DOUBLE: ">d"}[shape], value))


def identity(value: Any) -> Any:
    """A hashable key that is equal for equal trees only, by the same rules as the canonical text."""
    shape = type(value)
    if shape is str or shape is bytes or value is None:
        return value
    if shape is dict:
        return OBJECT, tuple([(key, identity(value[key])) for key in sorted(value)])
    if shape is list:
        return ARRAY, tuple([identity(x) for x in value])
    if shape is float:
        return DOUBLE, None if value != value else bits(value)
    return kind(value), value


def canonical(value: Any) -> str:
    """A text that is equal for equal trees only: typed, keys sorted, doubles by bits, all NaNs alike."""
    return json.dumps(_typed(value), ensure_ascii=False, separators=(",", ":"))


def _typed(value: Any) -> Any:
    if value is None:
        return None
    shape = kind(value)
    if shape == OBJECT:
        return [shape, [[key, _typed(value[key])] for key in sorted(value)]]
    if shape == ARRAY:
        return [shape, [_typed(x) for x in value]]
    if shape == BYTES:
        return [shape, base64.b64encode(value).decode()]
    if shape == DOUBLE:
        return [shape, "NaN" if math.isnan(value) else f"{bits(value):016x}"]
    return [shape, value]


def from_canonical(text: str) -> Any:
    """The tree of a canonical text."""
    return _untyped(json.loads(text))


def _untyped(node: Any) -> Any:
    if node is None:
        return None
    shape, held = node
    if shape == OBJECT:
        return {key: _untyped(sub) for key, sub in held}
    if shape == ARRAY:
        return [_untyped(sub) for sub in held]
    if shape == BYTES:
        return base64.b64decode(held)
    if shape == DOUBLE:
        return math.nan if held == "NaN" else struct.unpack(">d", bytes.fromhex(held))[0]
    return held


def equal(one: Any, other: Any) -> bool:
    """Whether two trees are one dictionary entry."""
    return canonical(one) == canonical(other)


def to_tagged(value: Any) -> dict | None:
    """The attribute struct of a value."""
    if value is None:
        return None
    shape = kind(value)
    out: dict[str, Any] = dict.fromkeys("tibdysn") | {"t": shape}
    out[_COLUMNS[shape]] = canonical(value) if shape in (OBJECT, ARRAY) else value
    return out


def from_tagged(tagged: dict | None) -> Any:
    """The value of an attribute struct."""
    if tagged is None:
        return None
    held = tagged[_COLUMNS[tagged["t"]]]
    return from_canonical(held) if tagged["t"] in (OBJECT, ARRAY) else held


def empty(value: Any) -> bool:
    """Whether a nullable field of this value is left out: 0, and empty bytes, texts, objects and arrays."""
    return value is None or (type(value) in (int, bytes, str, dict, list) and not value)
