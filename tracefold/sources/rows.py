"""Between Arrow rows of nested batches and value trees, by definition."""

from __future__ import annotations

from typing import Any

import pyarrow as pa

from tracefold.definition import ARRAY, OBJECT, TRACE, Definition
from tracefold.values import from_tagged, to_tagged


def pylist(array: pa.Array) -> list:
    """What to_pylist gives, made by columns: a third of its time where rows hold many small values."""
    if not len(array):
        return []  # its offsets may be missing
    if pa.types.is_struct(array.type) and array.type.num_fields:
        names = [f.name for f in array.type]
        out: list = [dict(zip(names, held)) for held in zip(*map(pylist, array.flatten()))]
    elif pa.types.is_list(array.type) or pa.types.is_map(array.type):
        ends = array.offsets.to_pylist()
        first, size = ends[0], ends[-1] - ends[0]
        if pa.types.is_map(array.type):
            items: list = list(zip(pylist(array.keys.slice(first, size)), pylist(array.items.slice(first, size))))
        else:
            items = pylist(array.values.slice(first, size))
        out = [items[low - first : high - first] for low, high in zip(ends, ends[1:])]
    else:
        return array.to_pylist()
    return [held if there else None for held, there in zip(out, array.is_valid().to_pylist())] if array.null_count else out


def tree(value: Any, node: Definition = TRACE) -> Any:
    """The value tree of a row as Arrow gives it (maps are lists of pairs)."""
    if value is None:
        return None
    if node.type == OBJECT:
        if node.fields is None:
            return {key: from_tagged(held) for key, held in value}
        return {name: tree(value.get(name), sub) for name, sub in node.fields.items()}
    if node.type == ARRAY and node.item is not None:
        return [tree(item, node.item) for item in value]
    return value


def row(value: Any, node: Definition = TRACE) -> Any:
    """The inverse of tree."""
    if value is None:
        return None
    if node.type == OBJECT:
        if node.fields is None:
            return [(key, to_tagged(held)) for key, held in value.items()]
        return {name: row(value.get(name), sub) for name, sub in node.fields.items()}
    if node.type == ARRAY and node.item is not None:
        return [row(item, node.item) for item in value]
    return value
