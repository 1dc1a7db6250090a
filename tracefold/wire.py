"""The compact message of a value tree, and its strict reader.

    message := strings pools "cprval" value
    strings := n, n x (length, bytes)
    pools   := m, m x (length, id, k, k x body)

A definition is compiled to writers and readers once; a message's dictionaries, deltas and strings are
its own. Entries of a pool are bodies without a flag, and a pool stands after those it refers to.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple

from tracefold.definition import ARRAY, BOOLEAN, BYTES, DOUBLE, INTEGER, OBJECT, STRING, Definition, pool_order, walk
from tracefold.values import empty, identity, kind

#: Fixed value: stands between the dictionaries and the tree.
MAGIC = b"cprval"


class WireError(ValueError):
    """A value that can't be written, or bytes that aren't a message."""


@dataclass(frozen=True)
class Options:
    """varint: integers in 1 to 9 bytes, else 8. string_pool: texts in free maps go to the string table."""

    varint: bool = True
    string_pool: bool = True


def write_varint(number: int) -> bytes:
    """Signed groups of 7 bits, lowest first; after eight of them the rest is one plain byte."""
    out = bytearray()
    while len(out) < 8:
        low, number = number & 0x7F, number >> 7
        if number == -(low >> 6):  # only copies of the sign are left
            out.append(low)
            return bytes(out)
        out.append(low | 0x80)
    out.append(number & 0xFF)
    return bytes(out)


_SMALL = [bytes([n]) for n in range(64)]


def wrap(number: int) -> int:
    """A number modulo 2 ** 64, as a signed one."""
    return (number + (1 << 63) & (1 << 64) - 1) - (1 << 63)


class Reader:
    """Takes parts off the front of some bytes; WireError where they end too soon."""

    def __init__(self, data: bytes, options: Options):
        self.data, self.at, self.options = data, 0, options

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise WireError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def integer(self) -> int:
        if not self.options.varint:
            return struct.unpack("<q", self.take(8))[0]
        if self.at < len(self.data) and (byte := self.data[self.at]) < 0x80:
            self.at += 1
            return byte - (byte << 1 & 0x80)
        total = 0
        for shift in range(0, 56, 7):
            byte = self.take(1)[0]
            total |= (byte & 0x7F) << shift
            if byte < 0x80:
                return total - (1 << shift + 7 if byte & 0x40 else 0)
        return wrap(total | self.take(1)[0] << 56)

    def size(self) -> int:
        """A count or length: not negative, and no more than the bytes that are left."""
        n = self.integer()
        if not 0 <= n <= len(self.data) - self.at:
            raise WireError(f"count {n} at {self.at}")
        return n

    def text(self) -> str:
        try:
            return self.take(self.size()).decode()
        except UnicodeDecodeError as error:
            raise WireError("text that isn't UTF-8") from error

    def flag(self) -> bool:
        return self.take(1) != b"\0"


class _Found(NamedTuple):
    """What a message that is being read has told so far."""

    source: Reader
    strings: list[str]
    pools: dict[str, list]
    last: dict[str, int]


class Message:
    """The dictionaries, strings and last integers of one message that is being written."""

    def __init__(self, options: Options):
        self.options = options
        self.pools: dict[str, dict[Any, int]] = {}
        self.bodies: dict[str, list[bytes]] = {}
        self.strings: dict[str, int] = {}
        self.last: dict[str, int] = {}

    def integer(self, number: int) -> bytes:
        if not self.options.varint:
            return struct.pack("<q", number)
        return _SMALL[number] if 0 <= number < 64 else write_varint(number)

    def sized(self, data: bytes) -> bytes:
        return self.integer(len(data)) + data

    def string(self, text: str) -> bytes:
        return self.integer(self.strings.setdefault(text, len(self.strings)))

    def entry(self, pool: str, value: Any, body: Callable[[Any, Message], bytes]) -> bytes:
        """The index of a value in a pool, which takes it in on first sight."""
        known, key = self.pools.setdefault(pool, {}), identity(value)
        index = known.get(key)
        if index is None:
            index = known[key] = len(known)
            self.bodies.setdefault(pool, []).append(b"")
            self.bodies[pool][index] = body(value, self)
        return self.integer(index)


def _free_body(value: Any, to: Message) -> bytes:
    """A free value after its tag."""
    shape = kind(value)
    if shape == OBJECT:
        parts = [to.integer(len(value))]
        for key in sorted(value):
            parts.append(to.string(key))
            parts.append(b"\0" if value[key] is None else b"\1" + to.integer(kind(value[key])) + _free_body(value[key], to))
        return b"".join(parts)
    if shape == ARRAY:
        if any(x is None for x in value):
            raise WireError("a null in a free array can't be written")
        return to.integer(len(value)) + b"".join(to.integer(kind(x)) + _free_body(x, to) for x in value)
    if shape == STRING:
        return to.string(value) if to.options.string_pool else to.sized(value.encode())
    return _scalar(shape, value, to)


def _scalar(shape: int, value: Any, to: Message) -> bytes:
    if shape == INTEGER:
        return to.integer(value)
    if shape == BOOLEAN:
        return b"\1" if value else b"\0"
    if shape == DOUBLE:
        return struct.pack("<d", value)
    return to.sized(value if shape == BYTES else value.encode())


def _read_free(shape: int, source: Reader, strings: list[str]) -> Any:
    if shape == OBJECT:
        out = {}
        for _ in range(source.size()):
            key = _pick(strings, source.integer(), "string")
            out[key] = _read_free(source.integer(), source, strings) if source.flag() else None
        return out
    if shape == ARRAY:
        return [_read_free(source.integer(), source, strings) for _ in range(source.size())]
    if shape == STRING:
        return _pick(strings, source.integer(), "string") if source.options.string_pool else source.text()
    return _read_scalar(shape, source)


def _read_scalar(shape: int, source: Reader) -> Any:
    if shape == INTEGER:
        return source.integer()
    if shape == BOOLEAN:
        return source.flag()
    if shape == DOUBLE:
        return struct.unpack("<d", source.take(8))[0]
    if shape == BYTES:
        return source.take(source.size())
    if shape == STRING:
        return source.text()
    raise WireError(f"unknown type {shape}")


def _pick(held: list, index: int, what: str) -> Any:
    if not 0 <= index < len(held):
        raise WireError(f"{what} {index} of {len(held)}")
    return held[index]


class Codec:
    """Writes and reads the messages of one definition."""

    def __init__(self, definition: Definition, options: Options = Options()):
        self.definition, self.options = definition, options
        self.order = pool_order(definition)
        self._write, self._read = self._writer(definition, ""), self._reader(definition, "")
        places = {node.pool(path): (node, path) for path, node in walk(definition) if node.pool(path) is not None}
        self._pool_readers = {pool: self._body_reader(*place) for pool, place in places.items()}

    def encode(self, value: Any) -> bytes:
        """The message of a tree; equal trees give equal messages."""
        to = Message(self.options)
        data = self._write(value, to)
        head = [to.integer(len(to.strings)), *(to.sized(s.encode()) for s in to.strings)]
        used = [p for p in self.order if p in to.bodies]
        head.append(to.integer(len(used)))
        for pool in used:
            head += [to.sized(pool.encode()), to.integer(len(to.bodies[pool])), *to.bodies[pool]]
        return b"".join(head) + MAGIC + data

    def decode(self, body: bytes) -> Any:
        """The tree of a message; fields that were left out are None."""
        return self.parts(body)[2]

    def parts(self, body: bytes) -> tuple[list[str], dict[str, list], Any]:
        """The strings, the dictionaries and the tree of a message."""
        source = Reader(body, self.options)
        found = _Found(source, [source.text() for _ in range(source.size())], {}, {})
        for _ in range(source.size()):
            name = source.text()
            read_body = self._pool_readers.get(name)
            if read_body is None:
                raise WireError(f"unknown pool {name!r}")
            entries = found.pools.setdefault(name, [])
            for _ in range(source.size()):
                entries.append(read_body(found))
        if source.take(len(MAGIC)) != MAGIC:
            raise WireError("no magic after the dictionaries")
        value = self._read(found)
        if source.at != len(body):
            raise WireError(f"{len(body) - source.at} bytes after the message")
        return found.strings, found.pools, value

    def _writer(self, node: Definition, path: str) -> Callable[[Any, Message], bytes]:
        body, pool = self._body_writer(node, path), node.pool(path)
        payload = body if pool is None else lambda value, to: to.entry(pool, value, body)

        def checked(value: Any, to: Message) -> bytes:
            if value is None:
                raise WireError(f"null at {path!r}, which isn't nullable")
            if kind(value) != node.type:
                raise WireError(f"a value of another type at {path!r}")
            return payload(value, to)

        if node.nullable:
            return lambda value, to: b"\0" if empty(value) else b"\1" + checked(value, to)
        return checked

    def _body_writer(self, node: Definition, path: str) -> Callable[[Any, Message], bytes]:
        if node.type == OBJECT and node.fields is not None:
            parts = [(name, self._writer(sub, f"{path} {name}".strip())) for name, sub in node.children()]
            return lambda value, to: b"".join(write(value.get(name), to) for name, write in parts)
        if node.type == ARRAY and node.item is not None:
            write_item = self._writer(node.item, f"{path} item".strip())
            return lambda value, to: to.integer(len(value)) + b"".join([write_item(x, to) for x in value])
        if node.type in (OBJECT, ARRAY):
            return _free_body
        if node.type == INTEGER and node.diff:

            def delta(value: int, to: Message) -> bytes:
                before, to.last[path] = to.last.get(path, 0), value
                return to.integer(wrap(value - before))

            return delta
        return lambda value, to: _scalar(node.type, value, to)

    def _reader(self, node: Definition, path: str) -> Callable[[_Found], Any]:
        body, pool = self._body_reader(node, path), node.pool(path)
        if pool is not None:

            def body(found: _Found) -> Any:
                return _pick(found.pools.get(pool, []), found.source.integer(), pool)

        if node.nullable:
            return lambda found: body(found) if found.source.flag() else None
        return body

    def _body_reader(self, node: Definition, path: str) -> Callable[[_Found], Any]:
        if node.type == OBJECT and node.fields is not None:
            parts = [(name, self._reader(sub, f"{path} {name}".strip())) for name, sub in node.children()]
            return lambda found: {name: read(found) for name, read in parts}
        if node.type == ARRAY and node.item is not None:
            read_item = self._reader(node.item, f"{path} item".strip())
            return lambda found: [read_item(found) for _ in range(found.source.size())]
        if node.type in (OBJECT, ARRAY):
            return lambda found: _read_free(node.type, found.source, found.strings)
        if node.type == INTEGER and node.diff:

            def total(found: _Found) -> int:
                now = found.last[path] = wrap(found.last.get(path, 0) + found.source.integer())
                return now

            return total
        return lambda found: _read_scalar(node.type, found.source)
