"""Column functions of the codec: hashes, sizes, elision, canonical keys. All run in the JVM but for doubles' bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.definition import ARRAY, BOOLEAN, BYTES, DOUBLE, INTEGER, OBJECT, STRING
from tracefold.values import FNV_PRIME, FNV_START

#: Longest number in groups of seven bits.
GROUPS = 8


def _fold(octets: Column) -> Column:
    """FNV-1a of an array of numbers from 0 to 255."""
    return F.aggregate(octets, F.lit(FNV_START).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def _octets(hexed: Column) -> Column:
    """The bytes of a hex text as numbers."""
    return F.transform(F.sequence(F.lit(1), F.shiftright(F.length(hexed), 1)), lambda k: F.conv(F.substr(hexed, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a_bytes(column: Column) -> Column:
    """FNV-1a with 32 bits over the bytes of a text or binary column; null stays null."""
    data = column.cast("binary")
    return F.when(F.octet_length(data) == 0, F.lit(FNV_START).cast("long")).when(column.isNotNull(), _fold(_octets(F.hex(data))))


def fnv1a_long(column: Column) -> Column:
    """FNV-1a over the eight bytes of an integer, highest first."""
    whole = column.cast("long")
    octets = F.array(*(F.shiftright(whole, s).bitwiseAND(F.lit(0xFF)) for s in range(56, -1, -8)))
    return F.when(column.isNotNull(), _fold(octets))


def fnv1a_boolean(column: Column) -> Column:
    """FNV-1a over one byte, 1 or 0."""
    return F.when(column.isNotNull(), _fold(F.array(column.cast("long"))))


@F.pandas_udf(T.LongType())
def double_bits(column: pd.Series) -> pd.Series:
    """The IEEE bits of a double as a long; Spark SQL has no expression for them."""
    return pd.Series(column.to_numpy("float64").view("int64"))


def fnv1a_double(column: Column) -> Column:
    """FNV-1a over the IEEE bytes of a double, highest first."""
    return F.when(column.isNotNull(), fnv1a_long(double_bits(column)))


def _word(number: Column) -> Column:
    """The four bytes of a hash, lowest first."""
    return F.array(*(F.shiftright(number, s).bitwiseAND(F.lit(0xFF)) for s in (0, 8, 16, 24)))


def fnv1a_hashes(hashes: Column) -> Column:
    """The hash of an array from those of its items; 0 stands for a null item."""
    return F.when(hashes.isNotNull(), _fold(F.flatten(F.transform(hashes, lambda h: _word(F.coalesce(h, F.lit(0).cast("long")))))))


def fnv1a_map(hashes: Column) -> Column:
    """The hash of an object from a map of its keys to their values' hashes."""
    entries = F.transform(F.array_sort(F.map_keys(hashes)), lambda k: F.concat(F.when(F.length(k) == 0, F.array().cast("array<bigint>")).otherwise(_octets(F.hex(k.cast("binary")))), _word(F.coalesce(hashes[k], F.lit(0).cast("long")))))
    return F.when(hashes.isNotNull(), _fold(F.flatten(entries)))


def varint_length(column: Column) -> Column:
    """Bytes that an integer takes as a varint: 1 to 9; null stays null."""
    size = F.lit(GROUPS + 1)
    for groups in range(GROUPS, 0, -1):
        edge = 1 << 7 * groups - 1
        size = F.when(column.between(-edge, edge - 1), groups).otherwise(size)
    return F.when(column.isNotNull(), size)


def sized_length(column: Column) -> Column:
    """Bytes that a text or binary takes with its length."""
    size = F.octet_length(column)
    return size + varint_length(size.cast("long"))


def elide(column: Column, kind: T.DataType) -> Column:
    """Null for what a nullable field leaves out: 0, and empty bytes, texts, maps and arrays. False and 0.0 stay."""
    if isinstance(kind, T.IntegralType):
        return F.when(column != 0, column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.when(F.octet_length(column) > 0, column)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(column) > 0, column)
    return column


def restore(column: Column, kind: T.DataType) -> Column:
    """The default in place of null."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(column, F.lit(0).cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(column, F.lit(""))
    if isinstance(kind, T.BinaryType):
        return F.coalesce(column, F.lit(b"").cast("binary"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(column, (F.array() if isinstance(kind, T.ArrayType) else F.create_map()).cast(kind))
    return column


def required(column: Column, name: str) -> Column:
    """The column; an error where it is null."""
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.lit(f"value is not nullable: {name}")))


def of_type(tagged: Column, kind: int) -> Column:
    """An attribute struct; an error where its type is another than asked."""
    return F.when(tagged.isNull() | (tagged["t"] == kind), tagged).otherwise(F.raise_error(F.lit("value & definition type conflict")))


def tagged(column: Column, kind: int) -> Column:
    """The attribute struct of a scalar column."""
    places = {INTEGER: "i", BOOLEAN: "b", DOUBLE: "d", BYTES: "y", STRING: "s", OBJECT: "n", ARRAY: "n"}
    types = {"i": "bigint", "b": "boolean", "d": "double", "y": "binary", "s": "string", "n": "string"}
    held = [(column.cast(t) if places[kind] == name else F.lit(None).cast(t)).alias(name) for name, t in types.items()]
    return F.when(column.isNotNull(), F.struct(F.lit(kind).cast("tinyint").alias("t"), *held))


def tagged_key(value: Column) -> Column:
    """A text that is equal for equal attribute values only: typed; 0.0 and -0.0 apart, all NaNs alike."""
    held = F.coalesce(value["i"].cast("string"), value["b"].cast("string"), value["d"].cast("string"), F.hex(value["y"]), value["s"], value["n"])
    return F.when(value.isNotNull(), F.concat(value["t"].cast("string"), F.lit(":"), held))


def attributes_key(attributes: Column) -> Column:
    """The same for a whole attribute map, whatever the order of its keys; null values are told from absent ones."""
    pairs = F.transform(F.array_sort(F.map_keys(attributes)), lambda k: F.struct(k.alias("k"), tagged_key(attributes[k]).alias("v")))
    return F.when(attributes.isNotNull(), F.to_json(pairs, {"ignoreNullFields": "false"}))
