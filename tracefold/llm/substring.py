"""Substring dedup with difference-cover anchors.

COVER is a perfect difference set modulo PERIOD: for any two positions i and j there is a shift below
PERIOD after which both stand on cover positions. Anchors, hashes of `length - PERIOD + 1` words, are
taken at cover positions only, so any two equal windows of `length` words share an aligned anchor.
Anchors that occur in two documents are then extended: the windows of `length` words around them are
compared by hash, and a word goes if such a window also starts in a document with a smaller id.

Documents are dealt into blocks of bounded size by id, text and the partition they are read in, which
spreads rows that repeat both. A block sends each distinct anchor
(or window) once, packed by hash bucket, and gets a bit for each in return; a hash that a third of all
documents hold is therefore one entry a block. Nothing is collected to the driver but the byte count.
Text is shuffled once and tokenised in three passes. A hash has 64 bits, and its bucket comes from an
independent one, so that hashes meet in the same bucket only: as buckets grow with the input, so do
the bits that tell windows apart. With 10**13 windows and 10**7 buckets, less than one accidental match
of any two is expected.

Defined cases: null and empty texts have no words and the digest of the empty string; texts shorter
than `length` words lose nothing; a null id ranks as 2 ** 63 - 1, after every other, and is never an
earlier copy of another null; rows of the same id do not remove each other's words; an empty table gives an empty
result; other columns are not read unless carried. A single text is worked on whole,
in up to 30 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import textblocks as tb
from tracefold.llm.columns import carried

PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text in a block, and bytes of text whose hashes fill a bucket: least and most. Between those they grow with
#: the text, so that packets of few hashes come late: about 200 a packet at 1 TB, 3 at 100 TB.
BLOCK_BYTES, BUCKET_BYTES = (4 << 20, 32 << 20), (16 << 20, 256 << 20)
#: Parts of the text that blocks and buckets are, between those bounds.
BLOCKS, BUCKETS = 30_000, 5_000
LEAST_BLOCKS = 48
NULL_ID = np.iinfo(np.int64).max
#: Makes the hashes that tell buckets.
_OTHER = np.uint64(0xA0761D6478BD642F)

_PACKET = "block int, bucket int, plain binary, owners binary"
_REPLY = "block int, bucket int, kind int, bits binary"


class _Kinds(NamedTuple):
    """Distinct windows by bucket and hash: where each occurrence is and its kind; of each kind the least and largest id."""

    at: np.ndarray
    hashes: np.ndarray
    cuts: np.ndarray  # of the buckets among the hashes
    kind: np.ndarray
    least: np.ndarray
    most: np.ndarray


class _Block:
    """The words of one block of documents, in numpy arrays, by position."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        ids = table.column("id").combine_chunks()
        self.ids = np.asarray(ids.fill_null(NULL_ID), np.int64) if len(table) else np.zeros(0, np.int64)
        self.null = np.asarray(ids.is_null()) if len(table) else np.zeros(0, bool)
        self.body, self.offsets = tb.flat(table.column("text"))
        self.starts, self.ends, self.firsts = tb.words(self.body, self.offsets, tb.NOT_SPACE)
        self.hashes = tb.word_hashes(self.body, self.starts, self.ends)
        counts = np.diff(self.firsts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.left = np.repeat(self.firsts[1:], counts) - np.arange(len(self.doc))  # words from here to the text's end
        self.place = np.arange(len(self.doc)) - np.repeat(self.firsts[:-1], counts)

    def anchors(self) -> _Kinds:
        """Anchors at all cover positions."""
        size = self.length - PERIOD + 1
        at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[self.place % PERIOD] & (self.left >= size))
        return self.kinds(at, size)

    def kinds(self, at: np.ndarray, size: int) -> _Kinds:
        """The distinct windows of `size` words that begin at some positions."""
        hashes = tb.window_hashes(self.hashes, at, size)
        bucket = (tb.window_hashes(tb.mixed(self.hashes ^ _OTHER), at, size) % np.uint64(self.buckets)).astype(np.int32)
        order = np.lexsort((hashes, bucket))
        ranked, dealt = hashes[order], bucket[order]
        first = np.ones(len(ranked), bool)
        first[1:] = (ranked[1:] != ranked[:-1]) | (dealt[1:] != dealt[:-1])
        kind = np.empty(len(ranked), np.int64)
        kind[order] = np.cumsum(first) - 1
        heads, ids = np.flatnonzero(first), self.ids[self.doc[at]][order]
        least = np.minimum.reduceat(ids, heads) if len(heads) else ids
        most = np.maximum.reduceat(ids, heads) if len(heads) else ids
        return _Kinds(at, ranked[heads], np.searchsorted(dealt[heads], np.arange(self.buckets + 1)), kind, least, most)

    @staticmethod
    def packets(block: int, found: _Kinds, owned: bool) -> pa.Table:
        """One row for each bucket: its hashes, and with `owned` the least id of each."""
        cuts, hashes = found.cuts, found.hashes
        owners = found.least if owned else found.least[:0]
        full = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "block": pa.array(np.full(len(full), block, np.int32)),
                "bucket": pa.array(full.astype(np.int32)),
                "plain": pa.array([hashes[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                "owners": pa.array([owners[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
            }
        )

    @staticmethod
    def answers(replies: pa.Table, kind: int, found: _Kinds) -> np.ndarray:
        """The bit that came back for each distinct window; no reply from a bucket means no bit set."""
        out = np.zeros(len(found.hashes), bool)
        for row in replies.to_pylist():
            if row["kind"] == kind:
                low, high = found.cuts[row["bucket"]], found.cuts[row["bucket"] + 1]
                out[low:high] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=high - low)
        return out

    def candidates(self, replies: pa.Table) -> np.ndarray:
        """Starts of the windows that hold an anchor which occurs in two documents."""
        found = self.anchors()
        shared = self.answers(replies, 0, found) | (found.least != found.most)
        p = found.at[shared[found.kind]]
        change = np.zeros(len(self.doc) + 1, np.int32)
        np.add.at(change, np.maximum(p - (PERIOD - 1), self.firsts[self.doc[p]]), 1)
        np.add.at(change, p + 1, -1)
        return np.flatnonzero((np.cumsum(change[:-1]) > 0) & (self.left >= self.length))

    def windows(self, replies: pa.Table) -> _Kinds:
        """Whole windows around shared anchors."""
        return self.kinds(self.candidates(replies), self.length)

    def removed(self, replies: pa.Table) -> np.ndarray:
        """For each word, whether a window over it also starts in a document with a smaller id."""
        found = self.windows(replies)
        gone = found.at[(self.ids[self.doc[found.at]] > found.least[found.kind]) | self.answers(replies, 1, found)[found.kind]]
        change = np.zeros(len(self.doc) + 1, np.int32)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.length, -1)
        return np.cumsum(change[:-1]) > 0

    def kept(self, gone: np.ndarray) -> Iterator[bytes]:
        """Each text's kept words joined by one space; joining takes 20 bytes of memory a byte, so texts are taken in pieces."""
        for low, high in tb.pieces(self.offsets):
            first, last, base = self.firsts[low], self.firsts[high], self.offsets[low]
            firsts, stay = self.firsts[low : high + 1] - first, ~gone[first:last]
            body, offsets = self.body[base : self.offsets[high]], self.offsets[low : high + 1] - base
            out, starts, ends = tb.joined(body, offsets, self.starts[first:last] - base, self.ends[first:last] - base, firsts, stay)
            data, kept = out.tobytes(), np.flatnonzero(stay)
            cuts = np.searchsorted(kept, firsts).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield data[starts[kept[a]] : ends[kept[b - 1]]] if b > a else b""


def _unpacked(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a bucket's packets, the packet of each hash, the hashes, and their owners."""
    rows = sorted(table.select(["block", "plain", "owners"]).to_pylist(), key=lambda r: r["block"])
    sizes = [len(r["plain"]) // 8 for r in rows]
    hashes = np.frombuffer(b"".join(r["plain"] for r in rows), np.uint64)
    owners = np.frombuffer(b"".join(r["owners"] for r in rows), np.uint8)
    return [r["block"] for r in rows], np.repeat(np.arange(len(rows)), sizes), hashes, owners


def _replies(bucket: int, kind: int, blocks: list[int], packet: np.ndarray, bits: np.ndarray) -> pa.Table:
    cuts = np.searchsorted(packet, np.arange(len(blocks) + 1))
    some = [k for k in range(len(blocks)) if bits[cuts[k] : cuts[k + 1]].any()]
    return pa.table(
        {
            "block": pa.array([blocks[k] for k in some], pa.int32()),
            "bucket": pa.array([bucket] * len(some), pa.int32()),
            "kind": pa.array([kind] * len(some), pa.int32()),
            "bits": pa.array([np.packbits(bits[cuts[k] : cuts[k + 1]]).tobytes() for k in some], pa.binary()),
        }
    )


def _by_value(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by value, the heads of equal runs in it, and the run of each place."""
    order = np.argsort(hashes, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = hashes[order][1:] != hashes[order][:-1]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket's anchors, those that two blocks hold."""
    blocks, packet, hashes, _ = _unpacked(table)
    order, heads, run = _by_value(hashes)
    bits = np.empty(len(hashes), bool)
    bits[order] = (np.diff(np.append(heads, len(hashes))) > 1)[run]
    return _replies(key[0].as_py(), 0, blocks, packet, bits)


def _earlier(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket's windows, those that a block with a smaller least id holds too."""
    blocks, packet, hashes, owners = _unpacked(table)
    least = owners.view(np.int64)
    order, heads, run = _by_value(hashes)
    bits = np.empty(len(hashes), bool)
    bits[order] = least[order] > np.minimum.reduceat(least[order], heads)[run]
    return _replies(key[0].as_py(), 1, blocks, packet, bits)


def remove_repeats(df: DataFrame, *, length: int = 50, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), spans: bool = False, block_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256; with `spans` also the removed word ranges and `clean`, the text without them.

    `block_bytes` and `bucket_bytes` are derived from the size of the text if they are not told; a task
    takes about 30 bytes of memory for each byte of a block.

    A word goes if it lies in a window of `length` words whose sequence also starts in a row with a
    smaller id. Kept words are joined by one space. `length` must be over 30.
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    rows, kinds, own_columns = carried(df.withColumn(key, F.col(key).cast("long")), key, text, carry)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = block_bytes or min(max(BLOCK_BYTES[0], total // BLOCKS), BLOCK_BYTES[1])
    bucket_bytes = bucket_bytes or min(max(BUCKET_BYTES[0], total // BUCKETS), BUCKET_BYTES[1])
    n_blocks, buckets = max(LEAST_BLOCKS, -(-total // block_bytes)), max(16, -(-total // bucket_bytes))
    docs = rows.withColumn("block", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(n_blocks)).cast("int"))

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(table, length, buckets)
        return block.packets(key[0].as_py(), block.anchors(), owned=False)

    def windows(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(table, length, buckets)
        return block.packets(key[0].as_py(), block.windows(replies), owned=True)

    def results(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(table, length, buckets)
        gone = block.removed(replies)
        total = np.concatenate([[0], np.cumsum(gone)])
        found = {
            **own_columns(table),
            "n_words": pa.array(np.diff(block.firsts), pa.int64()),
            "n_removed": pa.array(np.diff(total[block.firsts]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in block.kept(gone)], pa.string()),
        }
        if spans:
            head = gone.copy()
            head[1:] &= ~gone[:-1] | (block.doc[1:] != block.doc[:-1])
            tail = gone.copy()
            tail[:-1] &= ~gone[1:] | (block.doc[1:] != block.doc[:-1])
            low, high = np.flatnonzero(head), np.flatnonzero(tail) + 1
            by_doc = np.searchsorted(low, block.firsts)
            first = block.firsts[block.doc[low]]
            ranges = pa.StructArray.from_arrays([pa.array(low - first, pa.int64()), pa.array(high - first, pa.int64())], ["start", "end"])
            found["removed"] = pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), ranges)
            whole = table.column("text").combine_chunks()
            found["clean"] = tb.cut(whole, block.starts[low], block.ends[high - 1], by_doc)
        return pa.table(found)

    by_block = docs.groupBy("block")
    asked = by_block.applyInArrow(anchors, _PACKET).groupBy("bucket").applyInArrow(_shared, _REPLY)
    held = by_block.cogroup(asked.groupBy("block")).applyInArrow(windows, _PACKET)
    told = held.groupBy("bucket").applyInArrow(_earlier, _REPLY)
    more = ", removed array<struct<start: bigint, end: bigint>>, clean string" if spans else ""
    return by_block.cogroup(asked.unionAll(told).groupBy("block")).applyInArrow(results, f"{kinds}, n_words long, n_removed long, kept_sha256 string{more}")
