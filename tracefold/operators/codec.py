"""Whole batches to bytes and back, as columns: one row is one batch, so no rows are shuffled.

What can't be written or read is null, with a text in `error`; it never fails the job, and a format that
fails leaves the row's others as they are.
"""

from __future__ import annotations

import gzip
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracefold.definition import BATCHES, TRACE, Definition
from tracefold.shared import bounded_batches
from tracefold.sources import otlp
from tracefold.sources.rows import pylist, row, tree
from tracefold.values import canonical, identity
from tracefold.wire import Codec, Options

#: Names of the formats, in which a batch can be written.
FORMATS = ("proto", "proto_zstd", "proto_gzip", "json", "dict", "dict_zstd", "dict_gzip")
#: Bytes of Arrow rows that are Python objects at a time; single larger rows aside.
PIECE_BYTES = 1 << 20
_NESTED = to_arrow_type(BATCHES["resourceSpans"].dataType)


@lru_cache(maxsize=8)
def _trace_codec(options: Options) -> Codec:
    return Codec(TRACE, options)


def compressed(body: bytes, method: str) -> bytes:
    """A whole zstd or gzip frame of some bytes; gzip without a time, so that equal bytes stay equal."""
    if method == "gzip":
        return gzip.compress(body, mtime=0)
    import zstandard

    return zstandard.ZstdCompressor().compress(body)


def decompressed(body: bytes, method: str) -> bytes:
    if method == "gzip":
        return gzip.decompress(body)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(body)


def written(value: dict, form: str, options: Options) -> bytes:
    """A batch in one of the formats."""
    base, _, method = form.partition("_")
    if base == "json":
        body = otlp.to_json(value).encode()
    else:
        body = otlp.to_proto(value) if base == "proto" else _trace_codec(options).encode(value)
    return compressed(body, method) if method else body


def read(body: bytes, form: str, options: Options) -> dict:
    """The batch of some bytes."""
    base, _, method = form.partition("_")
    body = decompressed(body, method) if method else body
    if base == "json":
        return otlp.from_json(body.decode())
    return otlp.from_proto(body) if base == "proto" else _trace_codec(options).decode(body)


def _each(batches: Iterator[pa.RecordBatch], work: Callable[[dict], dict], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes))
        for low in range(0, batch.num_rows, step):
            rows = []
            for held in pylist(batch.slice(low, step).to_struct_array()):
                made: dict = {"batch_id": held["batch_id"]}
                try:
                    made |= work(held)
                except Exception as error:  # a row's own fault is that row's result
                    made["error"] = f"{type(error).__name__}: {error}"
                rows.append(made)
            columns = {"batch_id": pa.int64(), **dict(zip(names, types)), "error": pa.string()}
            yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], t) for n, t in columns.items()})


def _tried(work: Callable[[], object]) -> tuple[object, str | None]:
    """What some work gave, or else its error."""
    try:
        return work(), None
    except Exception as error:  # a format's own fault is its result
        return None, f"{type(error).__name__}: {error}"


def encode(batches: DataFrame, forms: tuple[str, ...] = ("dict",), options: Options = Options()) -> DataFrame:
    """(batch_id, one binary column for each format, error)."""

    def work(held: dict) -> dict:
        value = tree(held)
        made = {form: _tried(lambda: written(value, form, options)) for form in forms}
        faults = [f"{form}: {error}" for form, (_, error) in made.items() if error]
        return {form: body for form, (body, _) in made.items()} | {"error": "; ".join(faults) or None}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(rows, work, list(forms), [pa.binary()] * len(forms))

    return batches.select(*BATCHES.names).mapInArrow(run, "batch_id long, " + "".join(f"{f} binary, " for f in forms) + "error string")


def decode(bodies: DataFrame, form: str = "dict", options: Options = Options(), column: str = "body") -> DataFrame:
    """(batch_id, resourceSpans, error) of a binary column. A null body is an error."""

    def work(held: dict) -> dict:
        return {"resourceSpans": row(read(held["body"], form, options))["resourceSpans"]}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(rows, work, ["resourceSpans"], [_NESTED])

    schema = T.StructType([*BATCHES.fields, T.StructField("error", T.StringType())])
    return bodies.select("batch_id", F.col(column).alias("body")).mapInArrow(run, schema)


def _spans(value: dict) -> int:
    return sum(len(s["spans"] or ()) for r in value["resourceSpans"] or () for s in r["scopeSpans"] or ())


def compared(value: dict, forms: tuple[str, ...], options: Options) -> dict:
    """For each format, whether it gives the batch back that protocol buffers give: None, and a text in `error`, if it can't be written or read."""
    plain, error = _tried(lambda: written(value, "proto", options))
    given, error = _tried(lambda: read(plain, "proto", options)) if error is None else (None, error)
    if error:
        return {"error": f"proto: {error}"}
    shown, bases = repr(given), {"proto": (plain, True)}

    def same(body: bytes, base: str) -> bool:
        got = read(body, base, options)
        got = otlp.completed(got) if base == "dict" else got
        return repr(got) == shown or identity(got) == identity(given)  # texts differ by the order of attributes too

    def based(base: str) -> tuple[bytes, bool]:
        """A plain format's bytes, and whether they give the batch; once for all formats that compress them."""
        if base not in bases:
            body = written(given if base == "dict" else value, base, options)
            bases[base] = body, same(body, base)
        return bases[base]

    def kept(form: str) -> bool:
        base, _, method = form.partition("_")
        body, good = based(base)
        again = decompressed(compressed(body, method), method) if method else body
        return good if again == body else same(again, base)

    made = {form: _tried(lambda: kept(form)) for form in forms}
    faults = [f"{form}: {error}" for form, (_, error) in made.items() if error]
    return {form: good for form, (good, _) in made.items()} | {"error": "; ".join(faults) or None}


def roundtrips(batches: DataFrame, forms: tuple[str, ...] = FORMATS, options: Options = Options()) -> DataFrame:
    """(batch_id, spans, one boolean column for each format, error): whether it gives the batch back that protocol buffers give.

    Messages are made of the batch that protocol buffers give, as nulls can't be in them, and what they leave
    out is the protocol's default. A batch is written, read and compared in one place, so that nothing but the
    outcome leaves the task.
    """
    bounded_batches(batches.sparkSession)

    def work(held: dict) -> dict:
        value = tree(held)
        return {"spans": _spans(value)} | compared(value, forms, options)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(rows, work, ["spans", *forms], [pa.int64(), *[pa.bool_()] * len(forms)])

    return batches.select(*BATCHES.names).mapInArrow(run, "batch_id long, spans long, " + "".join(f"{f} boolean, " for f in forms) + "error string")


_TAKEN = pa.list_(pa.struct([("format", pa.string()), ("bytes", pa.int64()), ("write_nanos", pa.int64()), ("read_nanos", pa.int64()), ("error", pa.string())]))


def _measured(batches: DataFrame, options: Options, back: bool) -> DataFrame:
    """(batch_id, spans, plain, format, bytes, write_nanos, read_nanos, error): a row for each batch and format.

    plain is the size as plain protocol buffers. A batch that is no batch has a row without a format.
    """

    def work(held: dict) -> dict:
        value, out = tree(held), []
        for form in FORMATS:
            began = time.perf_counter_ns()
            body, error = _tried(lambda: written(value, form, options))
            done = time.perf_counter_ns()
            if back and error is None:
                error = _tried(lambda: read(body, form, options))[1]
            out.append({"format": form, "bytes": None if body is None else len(body), "write_nanos": done - began, "read_nanos": time.perf_counter_ns() - done if back else None, "error": error})
        return {"spans": _spans(value), "plain": out[FORMATS.index("proto")]["bytes"], "taken": out}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(rows, work, ["spans", "plain", "taken"], [pa.int64(), pa.int64(), _TAKEN])

    taken = batches.select(*BATCHES.names).mapInArrow(run, "batch_id long, spans long, plain long, taken array<struct<format: string, bytes: bigint, write_nanos: bigint, read_nanos: bigint, error: string>>, error string")
    each = taken.select("batch_id", "spans", "plain", F.col("error").alias("fault"), F.explode_outer("taken").alias("e"))
    return each.select("batch_id", "spans", "plain", "e.format", "e.bytes", "e.write_nanos", "e.read_nanos", F.coalesce("fault", "e.error").alias("error"))


def timed(batches: DataFrame, options: Options = Options()) -> DataFrame:
    """(batch_id, format, bytes, write_nanos, read_nanos, spans, error): what each format takes, whole frames flushed. For measurement; times vary."""
    return _measured(batches, options, True).select("batch_id", "format", "bytes", "write_nanos", "read_nanos", "spans", "error")


def sizes(batches: DataFrame, options: Options = Options()) -> DataFrame:
    """(batch_id, spans, format, bytes, bytes_per_span, ratio, error): each format's size against plain protocol buffers."""
    rows = _measured(batches, options, False)
    return rows.select("batch_id", "spans", "format", "bytes", (F.col("bytes") / F.nullif("spans", F.lit(0))).alias("bytes_per_span"), (F.col("plain") / F.nullif("bytes", F.lit(0))).alias("ratio"), "error")


_ENTRIES = pa.list_(pa.struct([("pool", pa.string()), ("idx", pa.int64()), ("key", pa.string())]))


def pools(bodies: DataFrame, options: Options = Options(), column: str = "body") -> DataFrame:
    """(batch_id, pool, idx, key, error) of the dictionaries in messages, the string table as pool "strings".

    A message that can't be read has one row with its error; one without entries has none.
    """

    def work(held: dict) -> dict:
        strings, found, _ = _trace_codec(options).parts(held["body"])
        return {"entries": [{"pool": p, "idx": i, "key": canonical(v)} for p, vs in [("strings", strings), *found.items()] for i, v in enumerate(vs)]}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(rows, work, ["entries"], [_ENTRIES])

    found = bodies.select("batch_id", F.col(column).alias("body")).mapInArrow(run, "batch_id long, entries array<struct<pool: string, idx: bigint, key: string>>, error string")
    each = found.select("batch_id", "error", F.explode_outer("entries").alias("e")).where("error IS NOT NULL OR e IS NOT NULL")
    return each.select("batch_id", "e.pool", "e.idx", "e.key", "error")


def log_lines(lines: DataFrame, column: str = "body") -> DataFrame:
    """(batch_id, value, error): batches of logs, read from JSON texts and written in the protocol's JSON form again."""

    def work(held: dict) -> dict:
        return {"value": otlp.logs_to_json(otlp.logs_from_json(held["body"].decode()))}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(rows, work, ["value"], [pa.string()])

    return lines.select("batch_id", F.col(column).alias("body")).mapInArrow(run, "batch_id long, value string, error string")
