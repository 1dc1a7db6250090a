"""Benchmark decontamination by an FM-index of each training shard.

Test phrases are all windows of `window` words of the benchmark items (an item of fewer words is one
phrase). A shard of training texts is written as a sequence of symbols, one for each word of the
phrases; all other words only separate, and stretches shorter than the shortest phrase, which hold no
phrase, are left out. Backward search through the wavelet matrix counts every phrase at once, sampled
suffix positions locate its occurrences, and overlapping occurrences merge to removal spans.

Shards are slices of a partition, bounded in bytes (a single longer text aside); texts aren't shuffled,
and a lost task rebuilds its own shards. A shard is indexed once. The benchmark's distinct words are sent
to every executor as 8 bytes each; its phrases are broadcast in blocks of at most BLOCK_BYTES of text, of
which the driver makes, and a task loads, one at a time, so that their number does not bound the method.

Defined cases: null and empty texts have no words; null and empty items give no phrases; a null item
id reads as ""; rows that repeat an item count once by id; an empty benchmark marks nothing; repeated
rows are each marked; other columns are not read unless carried; a single text is worked on whole, in some
15 bytes of memory a byte and 60 for each of its words that are indexed. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import textblocks as tb
from tracefold.llm.columns import carried
from tracefold.llm.fmindex import FMIndex

#: Bytes of benchmark text in one broadcast, and of training text in one index.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 4 << 20
#: Occurrences that are located at a time.
ROWS = 200_000
SEPARATOR = 1


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    body, offsets = tb.flat(column)
    starts, ends, firsts = tb.words(tb.LOWER[body], offsets, tb.ALNUM)
    return body, starts, ends, firsts


class Phrases:
    """The distinct windows of some benchmark items, as word hashes, with the items of each."""

    def __init__(self, ids: Sequence[str], texts: Sequence[str | None], window: int):
        body, starts, ends, firsts = _words(pa.array(texts, pa.string()))
        hashes = tb.word_hashes(tb.LOWER[body], starts, ends)
        self.vocabulary = np.unique(hashes)
        self.names = sorted({*ids})
        place = {name: k for k, name in enumerate(self.names)}
        found: dict[bytes, set[int]] = {}
        for k, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
            for i in range(a, max(b - window, a) + 1) if b > a else ():
                found.setdefault(hashes[i : min(i + window, b)].tobytes(), set()).add(place[ids[k]])
        self.lengths = np.array([len(p) // 8 for p in found], np.int64)
        self.table = np.zeros((len(found), window), np.uint64)
        for row, p in enumerate(found):
            self.table[row, : self.lengths[row]] = np.frombuffer(p, np.uint64)
        self.items = np.array([i for s in found.values() for i in sorted(s)], np.int64)
        self.item_at = np.concatenate([[0], np.cumsum([len(s) for s in found.values()])]).astype(np.int64)


class Shard:
    """The FM-index of a shard's words that are the benchmark's; stretches of fewer than `least` of them are left out."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray, vocabulary: np.ndarray, least: int):
        self.vocabulary, self.index = vocabulary, None
        if not len(vocabulary) or not len(hashes):
            return
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[at] == hashes
        start = np.zeros(len(hashes), bool)
        start[firsts[:-1][firsts[:-1] < firsts[1:]]] = True
        head = known.copy()
        head[1:] &= ~known[:-1] | start[1:]
        tail = known.copy()
        tail[:-1] &= ~known[1:] | start[1:]
        low, high = np.flatnonzero(head), np.flatnonzero(tail) + 1
        long = high - low >= least
        low, high = low[long], high[long]
        if not len(low):
            return
        sizes = high - low + 1  # with a separator
        ends = np.cumsum(sizes)
        self.word = np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])
        seq = at[np.minimum(self.word, len(hashes) - 1)] + SEPARATOR + 1
        seq[ends - 1] = SEPARATOR
        self.index = FMIndex(seq, len(vocabulary) + SEPARATOR)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence within a text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.index is None or not len(phrases.lengths):
            return none
        symbols = np.searchsorted(self.vocabulary, phrases.table) + SEPARATOR + 1
        first, last = self.index.search(symbols, phrases.lengths)
        counts = last - first
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(phrase))
        place = [self.index.locate(rows[k : k + ROWS]) for k in range(0, len(rows), ROWS)]
        return self.word[np.concatenate(place)] if place else none[0], phrase


def _broadcasts(benchmark: DataFrame, item: str, text: str, window: int) -> tuple[list, np.ndarray, int]:
    """Phrases of blocks of items, each of bounded size; the words of all, sorted; and the words of the shortest phrase."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    found, vocabulary, least = [], np.zeros(0, np.uint64), window
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        part = own.distinct().toArrow()
        block = Phrases(part.column("item").to_pylist(), part.column("text").to_pylist(), window)
        vocabulary, least = np.union1d(vocabulary, block.vocabulary), min(least, int(block.lengths.min(initial=window)))
        found.append(benchmark.sparkSession.sparkContext.broadcast(block))
        forget(found[-1])
    return found, vocabulary, least


def forget(block) -> None:
    """Drops this process's own copy of a broadcast's value; the next use reads it from its local file again."""
    block.__dict__.pop("_value", None)


def each(blocks: Sequence) -> Iterator[Phrases]:
    """The values of broadcasts, one in memory at a time; a single one stays."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            forget(block)


def mark(df: DataFrame, benchmark: DataFrame, *, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", carry: Sequence[str] = (), clean: bool = False) -> DataFrame:
    """Per row: id, n_words, n_hit, items, items_sha256, spans (word ranges, the end not included).

    With `clean` also `clean`, the text without its removal spans: from the first hit word of a span to
    the last, with the white space after it. `carry` names columns to return as they are.
    """
    told, vocabulary, least = _broadcasts(benchmark, item, item_text, window)
    words = df.sparkSession.sparkContext.broadcast(vocabulary)
    source, kinds, kept = carried(df, key, text, carry)

    def shard(column: pa.Array) -> dict[str, pa.Array]:
        body, starts, ends, firsts = _words(column)
        hashes = tb.word_hashes(tb.LOWER[body], starts, ends)
        doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        change, items = np.zeros(len(hashes) + 1, np.int64), [set() for _ in range(len(column))]
        held = Shard(hashes, firsts, words.value, least)
        for own in each(told):
            first, phrase = held.occurrences(own)
            np.add.at(change, first, 1)
            np.add.at(change, first + own.lengths[phrase], -1)
            pairs = np.unique(np.stack([doc[first], phrase]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
            for d, p in pairs.T.tolist():
                items[d].update(own.names[i] for i in own.items[own.item_at[p] : own.item_at[p + 1]])
        hit = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        edge = hit.copy()
        edge[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
        low, high = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        by_doc = np.searchsorted(low, firsts)
        own_first = firsts[doc[low]] if len(low) else low
        spans = pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), pa.StructArray.from_arrays([pa.array(low - own_first, pa.int64()), pa.array(high - own_first, pa.int64())], ["start", "end"]))
        listed = [sorted(s) for s in items]
        found = {
            "n_words": pa.array(np.diff(firsts), pa.int64()),
            "n_hit": pa.array(np.diff(total[firsts]), pa.int64()),
            "items": pa.array(listed, pa.list_(pa.string())),
            "items_sha256": pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in listed], pa.string()),
            "spans": spans,
        }
        if clean:
            found["clean"] = tb.cut(column, starts[low], ends[high - 1], by_doc)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.flat(batch.column(1))
            for low, high in tb.pieces(offsets, SHARD_BYTES):
                part = batch.slice(low, high - low)
                found = shard(part.column(1))
                yield pa.RecordBatch.from_pydict(kept(part) | found)

    schema = f"{kinds}, n_words long, n_hit long, items array<string>, items_sha256 string, spans array<struct<start: bigint, end: bigint>>" + ", clean string" * clean
    return source.mapInArrow(run, schema)
