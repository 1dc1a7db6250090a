"""SimHash fingerprints, links between near fingerprints by pivot distance tables, and their components.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles.
Distinct fingerprints are linked at `distance` differing bits or fewer, exactly:

* The pivot table holds each fingerprint's Hamming distances to reference fingerprints: the origin, 64
  whose bits lie in one group of places each, drawn at random, and PIVOTS drawn from all places. The
  distance to a group's reference less that to the origin depends on the bits of the group alone. With
  6 groups or more (distance 4) two linked fingerprints have the same differences in all but 4 groups;
  every choice of the others makes a cell, and only fingerprints that share one are compared. More
  groups, and so smaller cells, are taken as fingerprints grow in number.
* Within a cell, pairs are discarded whose distances to any reference differ by more than `distance`
  (by the triangle inequality those can't be linked), and the rest are verified.
* A long run of one key, as a large group of near copies makes, isn't expanded into pairs: a search
  from fingerprint to fingerprint takes one edge for each that it reaches.
* Of the links that a bucket of keys has found, it emits one edge for each fingerprint, to the smallest
  of its component there.

Defined cases: a text without words (null too) has fingerprint 0, linked like any other; a text of
fewer words than a shingle is one shingle; a null id takes part but is never a component's id unless
no other is in it; repeated rows stay rows; an empty table gives an empty result; other columns are
not read. A single text is worked on whole, in about 30 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm import textblocks as tb
from tracefold.llm.graph import bounded_batches, components, release, stars, with_least
from tracefold.shared import checkpointed

SEED = 42
#: References beside the structured ones.
PIVOTS = 12
#: Rows of one key in a bucket before the search takes the place of direct comparison.
RUN = 64
#: (key, fingerprint) rows in one bucket.
BUCKET_ROWS, WIDE_BUCKET_ROWS = 100_000, 250_000
#: A set; a shingle hash (its lower half, within a bucket of the upper half) of a prefix, with its place there and its set.
SET = np.dtype([("node", "<i8"), ("root", "<i8"), ("size", "<u4")])
POSTING = np.dtype([("token", "<u4"), ("place", "<u4"), ("set", "<u2")])
TOKEN_BUCKET_ROWS = 1_000_000
#: Bits of a set's parities; slots (a bit each) of tables by remainder.
PARITIES, SLOTS = 1024, 1 << 25
#: Adds up to 255 hash bytes: bit j of a byte goes to byte j of the sum.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1).astype(np.uint64)


def shingle_hashes(body: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, and the offsets of the texts among them."""
    body = tb.LOWER[body]
    starts, ends, firsts = tb.words(body, offsets, tb.NOT_SPACE)
    out, starts, ends = tb.joined(body, offsets, starts, ends, firsts)
    counts = np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(firsts[:-1] - at[:-1], n) + np.arange(at[-1])
    last = np.minimum(first + size, np.repeat(firsts[1:], n)) - 1
    data, digest = out.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())]
    return np.array(hashes, np.uint64), at


def majority(hashes: np.ndarray, at: np.ndarray, ties: int = 0) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes; at just half, those of `ties`."""
    counts = np.diff(at)
    runs = -(-counts // 255)
    ends = np.cumsum(runs)
    run_at = np.concatenate([[0], ends])
    heads = np.repeat(at[:-1], runs) + 255 * (np.arange(run_at[-1]) - np.repeat(run_at[:-1], runs))
    if not len(heads):
        return np.zeros(len(counts), np.uint64)
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_LANES[parts[:, k]], heads) for k in range(8)], axis=1).astype("<u8").view(np.uint8).reshape(-1, 64)
    full = np.flatnonzero(runs)
    bits = np.zeros((len(counts), 64), bool)
    twice, half = 2 * np.add.reduceat(sums.astype(np.int64), run_at[full], axis=0), counts[full][:, None]
    bits[full] = twice > half
    bits[full] |= (twice == half) & np.array([bool(ties >> b & 1) for b in range(64)])
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, *, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            body, offsets = tb.flat(batch.column(1))
            found = []
            for low, high in tb.pieces(offsets):
                found.append(majority(*shingle_hashes(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["id", "fp"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


def groups_for(count: int, distance: int) -> int:
    """Groups of references, so many that keys outnumber the fingerprints where that takes at most 126 tables."""
    groups = distance + 2
    while comb(groups + 1, distance) <= 126 and 2 ** (64 * (groups - distance) // groups) < count:
        groups += 1
    return groups


def references(groups: int, pivots: int = PIVOTS) -> tuple[np.ndarray, list[slice]]:
    """The origin, references whose bits lie in one group of places each, and `pivots` of any bits; and which are each group's."""
    cuts = [64 * g // groups for g in range(groups + 1)]
    drawn = tb.mixed(np.arange(1, 65 + pivots, dtype=np.uint64) << np.uint64(20))
    for low, high in zip(cuts[:-1], cuts[1:]):
        drawn[low:high] = (drawn[low:high] & np.uint64((1 << high) - (1 << low))) | np.uint64(1) << np.arange(low, high, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), drawn]), [slice(1 + low, 1 + high) for low, high in zip(cuts[:-1], cuts[1:])]


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each reference, with its Hamming distance to every fingerprint."""
    return np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int16)


def cells(table: np.ndarray, own: list[slice], distance: int) -> np.ndarray:
    """A row for each choice of all groups but `distance`: names of the cells of equal distances to their references, less those to the origin."""
    parts = []
    for g in own:
        name = np.zeros(table.shape[1], np.uint64)
        for row in table[g]:
            name = tb.mixed(name + (row - table[0] + 64).astype(np.uint64))
        parts.append(name)
    out = []
    for k, kept in enumerate(combinations(range(len(own)), len(own) - distance)):
        name = np.full(table.shape[1], k + 1, np.uint64)
        for g in kept:
            name = tb.mixed(name + parts[g])
        out.append(name)
    return np.stack(out)


def _close(table: list[np.ndarray], fps: np.ndarray, one: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    """Of pairs, by places, those that no pivot discards and that are within the distance."""
    at = np.arange(len(one))
    for column in table:
        if not len(at):
            break
        at = at[np.abs(column[one[at]] - column[other[at]]) <= distance]
    return at[apart(fps[one[at]], fps[other[at]]) <= distance]


def apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, which are rows of words."""
    return np.bitwise_count(one ^ other).sum(-1, dtype=np.int16)


def _search(table: list[np.ndarray], fps: np.ndarray, low: int, high: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps[low:high]."""
    left, edges = np.arange(low, high), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            here = front.pop()
            hit = _close(table, fps, np.full(len(left), here), left, distance)
            reached = left[hit].tolist()
            edges += [(here, x) for x in reached]
            front += reached
            left = np.delete(left, hit)
    return edges


def links_within(keys: np.ndarray, fps: np.ndarray, names: np.ndarray, refs: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of fingerprints (rows of words) that share a key and are near; a spanning forest where a key has many.

    refs: rows of words, by which pairs are discarded. names: their order within a key.
    """
    order = np.lexsort((names, keys))
    keys, fps = keys[order], np.ascontiguousarray(fps[order])
    table = [apart(fps, r) for r in refs]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(keys)))
    end = np.repeat(heads + sizes, sizes)
    end[np.repeat(sizes > RUN, sizes)] = 0
    a, b = [], []
    for step in range(1, min(RUN, int(sizes.max(initial=1)))):
        one = np.flatnonzero(np.arange(len(keys)) + step < end)
        near = one[_close(table, fps, one, one + step, distance)]
        a.append(near)
        b.append(near + step)
    for k in np.flatnonzero(sizes > RUN):
        found = _search(table, fps, int(heads[k]), int(heads[k] + sizes[k]), distance)
        a.append(np.array([x for x, _ in found], np.int64))
        b.append(np.array([y for _, y in found], np.int64))
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
    return order[a], order[b]


def links(kinds: DataFrame, distance: int, count: int) -> DataFrame:
    """Edges (a, b) of a graph over the distinct fingerprints `fp` with the components of the full link graph."""
    refs, own = references(groups_for(count, distance))
    buckets = max(8, -(-count * comb(len(own), distance) // BUCKET_ROWS))

    def deal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            keys = cells(distances(fps, refs), own, distance)
            for row in keys:
                yield pa.record_batch([batch.column(0), pa.array(row.view(np.int64)), pa.array(((row >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))], names=["fp", "key", "bucket"])

    def near(table: pa.Table) -> pa.Table:
        fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        a, b = links_within(np.asarray(table.column("key").combine_chunks()), fps[:, None], fps, refs[::-1, None], distance)
        a, b = stars(fps[a].view(np.int64), fps[b].view(np.int64))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    dealt = kinds.select("fp").mapInArrow(deal, "fp long, key long, bucket int")
    return dealt.groupBy("bucket").applyInArrow(near, "a long, b long")


def near_copies(df: DataFrame, *, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id reachable over links."""
    prints = checkpointed(fingerprints(df, shingle=shingle, key=key, text=text))
    kinds = prints.groupBy("fp").agg(F.min("id").alias("first"))
    count = kinds.count()
    roots = components(links(kinds, distance, count))
    placed = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    by_print = with_least(placed, "root", "first", "component_id").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


#: Words of a wide fingerprint, its least keys, and the least bits of a key. Two texts of similarity 0.8 (0.9, 0.95)
#: share one of those with odds of 0.44 (0.78, 0.96); what is not found so is found by prefixes.
WORDS, KEYS, KEY_BITS = 4, 8, 16
#: Bits beyond the expected difference that a link may have, in standard deviations.
SLACK = 1.5
_TIES = 0xAAAAAAAAAAAAAAAA
_SALTS = np.concatenate([[np.uint64(0)], tb.mixed(np.arange(101, 100 + WORDS, dtype=np.uint64))])


def reach(similarity: float, bits: int = 64 * WORDS) -> int:
    """Differing bits that texts whose shingle sets have this Jaccard similarity have at most, but for few."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + SLACK * np.sqrt(bits * share * (1 - share)))


#: One in SHARE texts tells which shingles are common, by LEVELS: a shingle is of a level if it is in as many of those
#: texts as that tells times the least number, 2 or more, at which no more than COMMON_ROWS shingles are common at all.
#: Each level is a table of SLOTS bits, by remainder.
SHARE, LEVELS, COMMON_ROWS = 4, (1, 16, 256), 1_000_000


def wide_fingerprints(body: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Rows of WORDS words: SimHashes over as many hashes of each distinct shingle.

    Ties go to fixed bits, half of them ones, so that short texts aren't drawn to each other or to none.
    """
    hashes, at = distinct_hashes(body, offsets, shingle)
    return wide_majority(hashes, at)


def wide_majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([majority(tb.mixed(hashes ^ s), at, _TIES) for s in _SALTS], axis=1)


def key_shape(count: int) -> tuple[int, int]:
    """Keys and bits of a key for this many sets: so many bits that about four unrelated sets share a key, and a key more for each bit more."""
    bits = max(KEY_BITS, int(np.ceil(np.log2(max(1, count) / 4))))
    return KEYS + bits - KEY_BITS, bits


def wide_keys(fps: np.ndarray, keys: int = KEYS, size: int = KEY_BITS) -> np.ndarray:
    """One row of keys for each table: the table's bits of the fingerprint, and the table."""
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    place, out = np.arange(size, dtype=np.uint64), []
    for k in range(keys):
        own = np.sort(np.random.default_rng(k).permutation(64 * WORDS)[:size])
        out.append(tb.mixed((bits[:, own].astype(np.uint64) << place).sum(1, dtype=np.uint64) << np.uint64(8) | np.uint64(k)))
    return np.stack(out)


def distinct_hashes(body: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles, and the offsets of the texts among them."""
    hashes, at = tb.shingles(body, offsets, shingle)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes, new = hashes[order], np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def overlap(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that two sets share at least, if their sizes add up to `sizes` and their Jaccard similarity is enough."""
    return np.ceil(sizes * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)


def parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set the parities of its hashes by their remainders: PARITIES bits, of which two sets differ in no more than in elements."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    odd = np.bincount(doc * PARITIES + (hashes % np.uint64(PARITIES)).astype(np.int64), minlength=(len(at) - 1) * PARITIES) & 1
    return np.packbits(odd.astype(bool).reshape(-1, PARITIES), axis=1)


def set_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), SEED) for a, b in zip(at[:-1], at[1:])], np.uint64).view(np.int64)


def possible(pairs: DataFrame, kinds: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose parities don't tell that their sets differ in too much."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            sizes = sum(np.asarray(batch.column(c), np.int64) for c in (2, 3))
            one, other = (np.frombuffer(tb.flat(batch.column(c))[0].tobytes(), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
            keep = apart(one, other) <= sizes - 2 * overlap(sizes, similarity)
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: kinds.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    return pairs.mapInArrow(run, "a long, b long")


def row_name() -> Column:
    return F.xxhash64("id", "digest")


def alike(pairs: DataFrame, kinds: DataFrame, source: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets have this Jaccard similarity or more.

    The pairs are read three times, so they come checkpointed: a caller that has only that table lets Spark
    delete the shuffles which found them. `kinds` is (node, first) of all sets, first being the (id, digest)
    of a text in `source` that has the set; only those texts are looked at, and a set is sent once for each
    pair of it.
    """
    wanted = kinds.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.xxhash64("first.id", "first.digest").alias("name"))
    told = source.sparkSession.sparkContext.broadcast(bitmap(wanted.select(slot_of("name"))))  # 4 MB

    def sets(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in tables:
            batch = whole.filter(pa.array(has(told.value, np.asarray(whole.column(0))).astype(bool)))
            body, offsets = tb.flat(batch.column(1))
            for low, high in tb.pieces(offsets):
                hashes, at = distinct_hashes(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)
                yield pa.record_batch([pa.array(set_hashes(hashes, at)), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["node", "hashes"])

    def compare(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= int(overlap(np.array(len(x) + len(y)), similarity)))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = source.select(row_name(), "text").mapInArrow(sets, "node long, hashes binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(found.toDF("b", "y"), "b").join(found.toDF("a", "x"), "a")
    return checkpointed(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def bitmap(slots: DataFrame) -> np.ndarray:
    """SLOTS bits, packed, of which those of the column `slot` are set."""
    found = slots.groupBy(F.expr("slot div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, slot % 32)")).alias("bits")).toArrow()
    taken = np.zeros(SLOTS // 32, "<i4")
    taken[np.asarray(found.column("at").combine_chunks())] = np.asarray(found.column("bits").combine_chunks())
    return taken.view(np.uint8)


def has(taken: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)
    return taken[slot >> 3] >> (slot & 7).astype(np.uint8) & 1


def slot_of(name: str) -> Column:
    """The same of a column of longs: SLOTS is a power of two, so that a sign does not matter."""
    return F.pmod(name, F.lit(SLOTS)).cast("int").alias("slot")


def common_hashes(source: DataFrame, shingle: int) -> list[np.ndarray]:
    """Bitmaps of the shingle hashes that many texts have, for each of LEVELS; source is (id, digest, text)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            body, offsets = tb.flat(batch.column(0))
            for low, high in tb.pieces(offsets):
                hashes, n = np.unique(distinct_hashes(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)[0], return_counts=True)
                yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(n)], names=["h", "n"])

    sample = source.where(F.pmod(F.xxhash64("digest"), F.lit(SHARE)) == 0)
    counts = checkpointed(sample.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    least, total = 2, 0
    for row in sorted(counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect(), reverse=True):
        total += row["count"]
        if total > COMMON_ROWS:
            least = row["n"] + 1
            break
    return [bitmap(counts.where(F.col("n") >= least * level).select(slot_of("h"))) for level in LEVELS]


def prefixes(hashes: np.ndarray, at: np.ndarray, common: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the first hashes, in one order for all sets, of which any similar set has one; and the offsets.

    The order is by level, then by hash: which hashes are in a prefix depends on the sample, that similar
    sets share one doesn't.
    """
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(hashes), np.int8)
    for taken in common:
        rank += has(taken, hashes)
    own = hashes[np.lexsort((hashes, rank, doc))]
    length = np.where(n, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1, 0)
    ends = np.cumsum(length)
    take = np.repeat(at[:-1] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return own[take], np.concatenate([[0], ends])


def sharing(tokens: np.ndarray, sizes: np.ndarray, places: np.ndarray, roots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one token and two roots whose sets may be similar: by sizes, and by what follows the token.

    The first token that two similar sets share leaves enough of both behind it; a later one needn't.
    """
    order = np.lexsort((sizes, tokens))
    tokens, sizes, roots = tokens[order], sizes[order], roots[order]
    left = sizes - places[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(tokens)))
    a, b = [], []

    def take(one: np.ndarray, other: np.ndarray) -> None:
        ok = (roots[one] != roots[other]) & (np.minimum(left[one], left[other]) >= overlap(sizes[one] + sizes[other], similarity))
        a.append(one[ok])
        b.append(other[ok])

    end = np.repeat(heads + lengths, lengths)
    end[np.repeat(lengths > RUN, lengths)] = 0
    for step in range(1, min(RUN, int(lengths.max(initial=1)))):
        one = np.flatnonzero(np.arange(len(tokens)) + step < end)
        take(one, one + step)
    for k in np.flatnonzero(lengths > RUN):
        low, high = int(heads[k]), int(heads[k] + lengths[k])
        # the members of the root with the most aren't compared with each other
        names, of, n = np.unique(roots[low:high], return_inverse=True, return_counts=True)
        here = np.arange(low, high)
        most = of == np.argmax(n)
        for x in here[~most]:
            take(np.full(high - low, x), here)
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
    return order[a], order[b]


def one_of_each(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without near copies: of each group the row with the smallest id (then the smallest digest) stays.

    Groups are the components of links between texts whose shingle sets have a Jaccard similarity of
    `similarity` or more, all of them, in two rounds that compare the sets of each candidate pair. First
    SimHashes of 256 bits draw large groups together: candidates share one of 8 keys of 16 bits (more of
    both as sets grow in number) and are within `reach` bits (references discard next to nothing at that
    many), and for each bucket of keys a text is compared with the nearest of those before it by hash, and
    of those after it. Then a prefix filter finds the rest exactly: candidates are all pairs of two
    components so far that share a hash of their prefixes and whose sizes allow the similarity. Texts
    without words are one group; shingles, and texts by their sets, are told apart by 64-bit hashes. Rows
    with a null id come after all others; of equal rows one stays. All columns of df are returned.
    """
    bounded_batches(df.sparkSession)
    digest = F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    source = df.select(F.col(key).cast("long").alias("id"), digest.alias("digest"), F.col(text).alias("text"))
    names = [f"w{k}" for k in range(WORDS)]

    def prints(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            body, offsets = tb.flat(batch.column(2))
            for low, high in tb.pieces(offsets):
                hashes, at = distinct_hashes(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)
                columns = [pa.array(x.view(np.int64)) for x in (set_hashes(hashes, at), np.diff(at), *np.ascontiguousarray(wide_majority(hashes, at).T))]
                bits = pa.array([x.tobytes() for x in parities(hashes, at)], pa.binary())
                yield pa.record_batch([c.slice(low, high - low) for c in batch.columns[:2]] + [bits, *columns], names=["id", "digest", "bits", "node", "size", *names])

    made = source.mapInArrow(prints, "id long, digest string, bits binary, node long, size long, " + ", ".join(f"{n} long" for n in names))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    kinds = checkpointed(made.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("size", "bits", *names))))
    count = kinds.count()
    many, size = key_shape(count)
    buckets = max(6, -(-count * many // WIDE_BUCKET_ROWS))

    def deal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 2500) for whole in tables for k in range(0, whole.num_rows, 2500)):
            fps = np.stack([np.asarray(batch.column(1 + k)).view(np.uint64) for k in range(WORDS)], axis=1)
            keys, row = wide_keys(fps, many, size).ravel(), np.tile(np.arange(len(fps)), many)
            bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full, node = np.flatnonzero(np.diff(cuts)), np.asarray(batch.column(0))
            own = [order[cuts[b] : cuts[b + 1]] for b in full]
            yield pa.record_batch([pa.array(full.astype(np.int32)), *(pa.array([x[o].tobytes() if x is keys else x[row[o]].tobytes() for o in own], pa.binary()) for x in (keys, node, fps))], names=["bucket", "keys", "nodes", "fps"])

    refs = tb.mixed(np.arange(1, 2 * WORDS + 1, dtype=np.uint64) << np.uint64(20)).reshape(2, WORDS)

    def near(table: pa.Table) -> pa.Table:
        """Of each set's links in the bucket the nearest to a smaller node and the nearest to a larger one."""
        keys, node, fps = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("fps", np.uint64)))
        fps = fps.reshape(-1, WORDS)
        a, b = links_within(keys, fps, node, refs, reach(similarity))
        bits, low, high = apart(fps[a], fps[b]), np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        kept = np.zeros(len(a), bool)
        for own, other in ((low, high), (high, low)):
            order = np.lexsort((other, bits, own))
            head = np.ones(len(order), bool)
            head[1:] = own[order][1:] != own[order][:-1]
            kept[order[head]] = True
        found = np.unique(np.stack([low[kept], high[kept]], axis=1)[low[kept] != high[kept]], axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    dealt = kinds.select("node", *names).mapInArrow(deal, "bucket int, keys binary, nodes binary, fps binary")
    nearest = checkpointed(dealt.groupBy("bucket").applyInArrow(near, "a long, b long").distinct())
    release(df.sparkSession)
    early = components(alike(nearest, kinds, source, shingle=shingle, similarity=similarity))
    release(df.sparkSession)

    common = df.sparkSession.sparkContext.broadcast(common_hashes(source, shingle))  # three times 4 MB

    def post(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            body, offsets = tb.flat(batch.column(0))
            for low, high in tb.pieces(offsets):
                hashes, at = distinct_hashes(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)
                tokens, cuts = prefixes(hashes, at, common.value, similarity)
                packed = pa.array([tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.record_batch([pa.array(set_hashes(hashes, at)), pa.array(np.diff(at)), packed], names=["node", "size", "tokens"])

    posted = source.select("text").mapInArrow(post, "node long, size long, tokens binary").dropDuplicates(["node"])
    placed = posted.join(early, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "tokens")
    token_buckets = max(6, -(-count * 100 // TOKEN_BUCKET_ROWS))

    def deal_tokens(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 2500) for whole in tables for k in range(0, whole.num_rows, 2500)):
            body, cuts = tb.flat(batch.column(3))
            tokens, n = np.frombuffer(body.tobytes(), np.uint64), np.diff(cuts) // 8
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(tokens)) - np.repeat(cuts[:-1] // 8, n)
            every = np.zeros(len(n), SET)
            every["node"], every["root"], every["size"] = (np.asarray(batch.column(k)) for k in range(3))
            bucket = (tokens >> np.uint64(32)) % np.uint64(token_buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(token_buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            out: list[list[bytes]] = [[], []]
            for own in (order[edges[b] : edges[b + 1]] for b in full):
                rows, of = np.unique(row[own], return_inverse=True)
                post = np.zeros(len(own), POSTING)
                post["token"], post["place"], post["set"] = tokens[own] & np.uint64(0xFFFFFFFF), place[own], of
                out[0].append(every[rows].tobytes())
                out[1].append(post.tobytes())
            yield pa.record_batch([pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "sets", "postings"])

    def meet(table: pa.Table) -> pa.Table:
        sets, posts = (table.column(c).to_pylist() for c in ("sets", "postings"))
        base = np.cumsum([0, *(len(x) // SET.itemsize for x in sets)])
        post = np.frombuffer(b"".join(posts), POSTING)
        own = np.frombuffer(b"".join(sets), SET)
        at = post["set"] + np.repeat(base[:-1], [len(x) // POSTING.itemsize for x in posts])
        a, b = sharing(post["token"], own["size"].astype(np.int64)[at], post["place"].astype(np.int64), own["root"][at], similarity)
        found = np.unique(np.sort(np.stack([own["node"][at[a]], own["node"][at[b]]], axis=1), axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    posts = placed.mapInArrow(deal_tokens, "bucket int, sets binary, postings binary")
    meeting = checkpointed(possible(posts.groupBy("bucket").applyInArrow(meet, "a long, b long"), kinds, similarity))
    release(df.sparkSession)
    late = alike(meeting, kinds, source, shingle=shingle, similarity=similarity)
    release(df.sparkSession)
    roots = components(early.toDF("a", "b").unionByName(late)).withColumnRenamed("node", "n")
    grouped = kinds.join(roots, F.col("node") == F.col("n"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = grouped.select(F.col("first.id").alias("stay_id"), F.col("first.digest").alias("stay_digest"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(key).cast("long").alias("id"), digest.alias("digest"))
    found = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest")), "left_semi")
    return found.dropDuplicates(["id", "digest"]).select("row.*")
