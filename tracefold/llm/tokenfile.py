"""Token ids in a binary format: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the corpus (0 is the most frequent; ties go to the smaller id).
A rank takes 1 to 4 bytes, low byte first; two bits of a control byte tell each length, four ranks to
a control byte, and each document starts a new one. A segment, the unit that is written, is

    magic "TKF2", documents n (8 bytes), of those without a key (8), control bytes c (8), data bytes d (8),
    n keys (8 each; 0 for the first ones, which have none), n token counts (8 each), c control bytes, d data bytes

and is decoded by a lookup of each control byte in a table of four lengths. Segments are rows of a
Parquet table, so that Spark's committers and any store it knows hold them; beside it stands the
table of ids by rank.

Keys are written in ascending order over the whole table: rows are dealt by ranges of the key (and a
digest of the text, and the partition read, which split a key that many rows share) and sorted. Texts are tokenised once; their plain
ids are kept in a written table while ranks are counted.

Defined cases: null and empty texts have the end id alone; a null key comes first and is returned as
null; rows of one key are in order of the CRC of their texts; an empty table writes no segment and
gives an empty result; other columns are not read. Ids are read from the tokenizer file that a
parameter names; each executor needs that file. A single text is worked on whole, in about 25 bytes of
memory a byte.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import textblocks as tb
from tracefold.llm.graph import bounded_batches
from tracefold.shared import remove, shared_folder

MAGIC = b"TKF2"
#: Bytes of text in a segment, and in a range of keys.
SEGMENT_TEXT, RANGE_BYTES = 4 << 20, 16 << 20
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000
#: White space that no token of a word tokenizer reaches across.
_BREAKS = tb.byte_class((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
#: The four lengths that a control byte tells.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Kinds of bytes: other, letters (every byte of a Latin-1 letter in UTF-8 too), digits.
_KIND = np.zeros(256, np.int8)
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[0x30:0x3A] = 2
#: Units that are encoded as one line.
LINE_UNITS = 500


class Encoder:
    """A tokenizer file and the ids of units that were encoded before.

    Units are what the tokenizer splits texts into where that can be told from bytes: in stretches of
    ASCII and Latin-1 letters without apostrophes, the runs of letters, the single digits, and the runs
    of other characters. Any other stretch between white space is a unit, and is encoded as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.ids, self.at = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.word_end[i] = piece.endswith("</w>")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and each text's offsets; the same as encoding each whole text."""
        body, offsets = tb.flat(column)
        body, starts, ends = units(body, offsets)
        codes, distinct = tb.distinct_words(body, starts, ends)
        place = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        fresh = distinct.take(pa.array(new))
        ids, sizes = self._encode_units(fresh)
        place[new] = len(self.words) + np.arange(len(new))
        known, at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        if len(self.words) < CACHE_WORDS:
            self.words, self.ids, self.at = pa.concat_arrays([self.words, fresh]), known, at
        ids, word_at = tb.laid_out(known, at, place[codes])
        return ids, word_at[np.searchsorted(starts, offsets)]

    def _encode_units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some units end to end, and the number of each one's ids."""
        odd = odd_bytes(*tb.flat(words))
        plain, single = np.flatnonzero(~odd), np.flatnonzero(odd)
        names = words.take(pa.array(plain)).to_pylist()
        parts, sizes = [], np.zeros(len(words), np.int64)
        lines = [names[k : k + LINE_UNITS] for k in range(0, len(names), LINE_UNITS)]
        # units that the tokenizer keeps whole, a line of them at a time; word ends part the ids again
        for k, found in enumerate(self._encoded([b" ".join(line) for line in lines])):
            own = slice(k * LINE_UNITS, k * LINE_UNITS + len(lines[k]))
            ends = np.flatnonzero(self.word_end[found]) + 1
            if len(ends) != len(lines[k]) or ends[-1] != len(found):
                each = self._encoded(lines[k])
                found, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            parts.append(found)
            sizes[plain[own]] = np.diff(ends, prepend=0)
        each = self._encoded(words.take(pa.array(single)).to_pylist())
        sizes[single] = [len(e) for e in each]
        order = np.concatenate([plain, single])
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return tb.gathered(np.concatenate([*parts, *each, np.zeros(0, np.uint32)]), begin, sizes)[0], sizes

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]


def _odd(body: np.ndarray) -> np.ndarray:
    """Bytes whose stretch isn't split by bytes: all but printable ASCII and Latin-1 letters, and ' and <."""
    odd = (body >= 0x80) | (body == 0x27) | (body == 0x3C) | (body < 0x20) | (body == 0x7F)
    odd[(body >= 0x09) & (body <= 0x0A) | (body == 0x0D)] = False
    lead = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7))
    odd[lead] = odd[lead + 1] = False
    return odd


def odd_bytes(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has an odd byte."""
    return np.diff(np.concatenate([[0], np.cumsum(_odd(body))])[offsets]) > 0


def units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, lower-cased where they are split by bytes, and the starts and ends of the units."""
    starts, ends, _ = tb.words(body, offsets, _BREAKS)
    seen = np.concatenate([[0], np.cumsum(_odd(body), dtype=np.int32)])
    odd = seen[ends] > seen[starts]
    kind = _KIND[body]
    begin = np.zeros(len(body) + 1, bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inside = np.zeros(len(body) + 1, np.int8)
    inside[starts[~odd]] += 1
    inside[ends[~odd]] -= 1
    begin[:-1] &= np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    begin[starts] = True
    first = np.flatnonzero(begin[:-1])
    # a unit ends where the next begins, or with its stretch
    last = np.minimum(np.append(first[1:], len(body)), ends[np.searchsorted(starts, first, "right") - 1]) if len(first) else first
    out = tb.lower(body)
    for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):
        out[a:b] = body[a:b]
    return out, first, last


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each tokenizer file in a worker."""
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))


def pack(ranks: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of documents with the offsets `at`."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.int8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    counts = np.diff(at)
    control_at = np.concatenate([[0], np.cumsum(-(-counts // 4))])
    two = np.zeros(4 * int(control_at[-1]), np.uint8)
    two[np.repeat(4 * control_at[:-1] - at[:-1], counts) + np.arange(len(ranks))] = sizes - 1
    return (two.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack(counts: np.ndarray, control: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all documents end to end, and each document's offsets."""
    at = np.concatenate([[0], np.cumsum(counts)])
    control_at = np.concatenate([[0], np.cumsum(-(-counts // 4))])
    sizes = _LENGTHS[control].ravel()[np.repeat(4 * control_at[:-1] - at[:-1], counts) + np.arange(at[-1])]
    low = np.cumsum(sizes) - sizes
    data = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    ranks = data[low]
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        ranks[more] |= data[low[more] + k] << np.uint32(8 * k)
    return ranks, at


def segment(keys: bytes, nulls: int, counts: bytes, control: bytes, data: bytes) -> bytes:
    """The bytes of a segment."""
    return MAGIC + struct.pack("<qqqq", len(keys) // 8, nulls, len(control), len(data)) + keys + counts + control + data


def read_segment(image: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Keys, how many of the first ones are null, the ranks of all documents end to end, and their offsets. Damaged images raise ValueError."""
    if image[:4] != MAGIC or len(image) < 36:
        raise ValueError("not a token segment")
    n, nulls, c, d = struct.unpack("<qqqq", image[4:36])
    if min(n, nulls, n - nulls, c, d) < 0 or len(image) != 36 + 16 * n + c + d:
        raise ValueError("a token segment of the wrong length")
    whole = np.frombuffer(image, np.uint8)[36:]
    keys, counts = whole[: 8 * n].view("<i8"), whole[8 * n : 16 * n].view("<i8")
    ranks, at = unpack(counts, whole[16 * n : 16 * n + c], whole[16 * n + c :])
    return keys, nulls, ranks, at


def rank_table(tokens: DataFrame, size: int) -> np.ndarray:
    """Ids below `size` by falling frequency in the column `ids`; only the vocabulary's counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for image in batch.column(0):
                total += np.bincount(np.frombuffer(image.as_buffer(), _width(size)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.asarray(found.column("id")), np.asarray(found.column("n"))
    return ids[np.lexsort((ids, -n))].astype(np.int64)


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def write(df: DataFrame, folder: str, path: str, end: int, *, key: str = "doc_id", text: str = "text") -> None:
    """Writes folder/segments (part, before, tokens, image) and folder/ranks (rank, id).

    Texts are sorted, tokenised once and written as plain ids to folder/plain; ranks are counted there,
    and each run of plain ids becomes a segment in place. The plain ids are deleted at the end.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("digest", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    placed = rows.repartitionByRange(max(4, -(-total // RANGE_BYTES)), "key", "digest", F.spark_partition_id()).sortWithinPartitions("key", "digest", "text")
    size = max(end + 1, len(Encoder(path).word_end))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = tb.flat(batch.column(1))
            for low, high in tb.pieces(offsets, SEGMENT_TEXT):
                ids, at = with_end(*encoder(path).encode(batch.column(1).slice(low, high - low)), end)
                keys = batch.column(0).slice(low, high - low)
                nulls, keys = keys.null_count, np.asarray(keys.fill_null(0), "<i8")
                made = {"part": part, "before": before, "tokens": len(ids), "nulls": nulls, "keys": keys.tobytes(), "counts": np.diff(at).astype("<i8").tobytes(), "ids": ids.astype(_width(size)).tobytes()}
                yield pa.RecordBatch.from_pylist([made])
                before += len(ids)

    plain = "part long, before long, tokens long, nulls long, keys binary, counts binary, ids binary"
    placed.select("key", "text").mapInArrow(tokenise, plain).write.option("compression", "zstd").parquet(f"{folder}/plain")
    tokens = spark.read.schema(plain).parquet(f"{folder}/plain")
    table = rank_table(tokens, size)
    spark.createDataFrame(pa.table({"rank": np.arange(len(table)), "id": table})).write.parquet(f"{folder}/ranks")
    rank = np.zeros(size, np.uint32)
    rank[table] = np.arange(len(table))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, n, nulls, keys, counts, ids = (batch.column(k)[row].as_py() for k in range(7))
                at = np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<i8"))])
                image = segment(keys, nulls, counts, *pack(rank[np.frombuffer(ids, _width(size))], at))
                yield pa.RecordBatch.from_pylist([{"part": part, "before": before, "tokens": n, "image": image}])

    tokens.mapInArrow(pack_rows, "part long, before long, tokens long, image binary").write.parquet(f"{folder}/segments")
    remove(spark, f"{folder}/plain")


def read(spark: SparkSession, folder: str, *, ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, in files' order by start; with `ids` the ids too."""
    found = spark.read.parquet(f"{folder}/ranks").toArrow()
    table = np.zeros(found.num_rows, np.uint32)
    table[np.asarray(found.column("rank"))] = np.asarray(found.column("id"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys, nulls, ranks, at = read_segment(image)
                own = table[ranks].astype("<u4")
                data = own.tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                out = {"key": pa.array(keys, mask=np.arange(len(keys)) < nulls), "part": pa.array(np.full(len(keys), part)), "at": pa.array(before + at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    segments = spark.read.schema("part long, before long, tokens long, image binary").parquet(f"{folder}/segments")
    held = segments.groupBy("part").agg(F.sum("tokens").alias("held"))  # one row a range of keys
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    rows = segments.select("part", "before", "image").mapInArrow(decode, "key long, part long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return rows.join(firsts, "part").select("key", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def scratch(spark: SparkSession) -> str:
    """A new folder for token files among the session's shared ones."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
