"""Toxic spans and document scores by a linear-chain CRF.

Document labels first become token labels. Features of a token are its lower-cased word and the
word's first 4 to 8 bytes; features that are in toxic texts far more often than chance allows are
picked, and tokens of toxic texts that have a picked feature are labelled. The CRF learns those labels over sentences, and forward-backward marginals give
each token's probability. A logistic map of a text's largest marginal log odds, its expected number of
toxic tokens and its length, fitted on labelled texts that the CRF hasn't seen, is the score. There each
class weighs as much as it does among all labels, so that a score is a probability over the table.

The sample that is learned from is bounded by SAMPLE_ROWS rows a class and SAMPLE_BYTES of text, drawn
by a hash of the id; scoring covers all rows and whole texts, in one pass without a shuffle.

Defined cases: a null label is no label; an id that has several labels takes the largest; null and
empty texts have no tokens and the score that the map gives to none; without labelled texts of both
classes every score is the smoothed share of toxic labels; repeated rows are scored alike; an empty
table gives an empty result; other columns are not read unless carried; a single text is worked on whole,
in about 25 bytes of memory a byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm import textblocks as tb
from tracefold.llm.columns import carried
from tracefold.llm.crf import Chains, Model, marginal_log_odds
from tracefold.shared import checkpointed

SAMPLE_ROWS, SAMPLE_BYTES = 1500, 6 << 20
PREFIXES = (4, 5, 6, 7, 8)
BITS = 18
#: Runs of letters (any byte beyond ASCII counts as one), and what ends a sentence.
LETTERS = tb.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_STOPS = ~tb.byte_class((0x0A, 0x0A), (0x0D, 0x0D), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
#: A picked feature is in this many unexplained toxic texts, and in at most this share as many clean ones.
LEAST_TEXTS, CLEAN_SHARE = 3, 0.03


def held_out(key: Column) -> Column:
    """Rows whose labels are not learned: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Tokens:
    """Tokens of some texts: places in the bytes, features, and where sentences begin."""

    def __init__(self, column: pa.Array):
        self.body, self.offsets = tb.flat(column)
        low = tb.lower(self.body)
        self.starts, self.ends, self.firsts = tb.words(low, self.offsets, LETTERS)
        salts = tb.mixed(np.arange(1, len(PREFIXES) + 2, dtype=np.uint64))[:, None]
        self.features = (tb.mixed(tb.prefix_hashes(low, self.starts, self.ends, PREFIXES) ^ salts) >> np.uint64(64 - BITS)).astype(np.int32)
        stops = np.concatenate([[0], np.cumsum(_STOPS[self.body], dtype=np.int32)])
        self.first = np.ones(len(self.starts), bool)
        self.first[1:] = stops[self.starts[1:]] > stops[self.ends[:-1]]
        self.first[self.firsts[:-1][self.firsts[:-1] < self.firsts[1:]]] = True
        self.doc = np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def picked_features(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Flags of the features that mark toxic texts.

    A feature is picked if it is in toxic texts so much more often than their share that, of all features
    in toxic texts, half a one would be expected to do so by chance. Copies count once: texts are
    weighted by the number that share their least hash of three words. A greedy cover then picks features for
    toxic texts that have none so far, whole words before their prefixes.
    """
    kinds = len(tokens.features)
    pairs = [np.unique(tokens.doc << BITS | row) for row in tokens.features]
    doc = np.concatenate([p >> BITS for p in pairs])
    name = np.concatenate([(p & (1 << BITS) - 1) * kinds + k for k, p in enumerate(pairs)])
    del pairs
    weight = 1 / _copies(tokens)
    share = weight[toxic].sum() / weight.sum()
    bad = toxic[doc]
    clean = np.bincount(name[~bad], weight[doc[~bad]], minlength=kinds << BITS)
    doc, name = doc[bad], name[bad]
    count = np.bincount(name, weight[doc], minlength=kinds << BITS)
    p = (count + 0.01) / (count + clean + 0.02)
    gain = count * np.log(p / share) + clean * np.log((1 - p) / (1 - share))
    picked = (gain >= np.log(2 * max(1, np.count_nonzero(count)))) & (clean <= CLEAN_SHARE * count)
    specific = np.where(np.arange(kinds << BITS) % kinds == 0, kinds, np.arange(kinds << BITS) % kinds)
    while True:
        left = ~np.isin(doc, doc[picked[name]])
        doc, name = doc[left], name[left]
        count = np.bincount(name, weight[doc], minlength=kinds << BITS)
        good = (count >= LEAST_TEXTS) & (clean <= CLEAN_SHARE * count)
        if not good.any():
            return picked
        picked[np.argmax(np.where(good, (count - clean / CLEAN_SHARE / 2) * (kinds + 1) + specific, -np.inf))] = True


def _copies(tokens: Tokens) -> np.ndarray:
    """For each text the number of texts with its least hash of three neighbouring words."""
    word, n = tokens.features[0].astype(np.uint64), len(tokens.firsts) - 1
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for step in (1, 2):
        later = np.minimum(np.arange(len(word)) + step, tokens.firsts[1:][tokens.doc] - 1)
        word = word << np.uint64(BITS) | tokens.features[0][later].astype(np.uint64)
    np.minimum.at(least, tokens.doc, tb.mixed(word))
    _, group, copies = np.unique(least, return_inverse=True, return_counts=True)
    return copies[group]


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Whether each token is of a toxic text and has a picked feature."""
    picked, kinds = picked_features(tokens, toxic), len(tokens.features)
    return picked[tokens.features * kinds + np.arange(kinds)[:, None]].any(0) & toxic[tokens.doc]


class Scorer:
    """A fitted CRF and the map from its marginals to a score."""

    def __init__(self, texts: Sequence[str | None], toxic: np.ndarray, second: np.ndarray, counts: tuple[int, int]):
        """second: texts that fit the map; the others fit the CRF. counts: all labels of each class, drawn or not."""
        self.prior = (counts[1] + 1) / (sum(counts) + 2)
        self.model = Model(BITS)
        self.weights: np.ndarray | None = None
        seen, last = pa.array([t for t, s in zip(texts, second) if not s], pa.string()), pa.array([t for t, s in zip(texts, second) if s], pa.string())
        if min(toxic[~second].sum(), (~toxic[~second]).sum()) == 0:
            return
        tokens = Tokens(seen)
        if not len(tokens.starts):
            return
        self.model.fit(tokens.features, tokens.first, token_labels(tokens, toxic[~second]))
        y = toxic[second]
        if min(y.sum(), (~y).sum()) == 0:
            last, y = seen, toxic[~second]
        share = np.where(y, counts[1] / max(1, toxic.sum()), counts[0] / max(1, (~toxic).sum()))
        self.weights = _logistic(self.evidence(Tokens(last))[0], y, share / share.mean())

    def evidence(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """For each text its largest log odds, log expected toxic tokens and log length; and each token's log odds."""
        n = len(tokens.firsts) - 1
        out = np.full((n, 3), -LEAST)
        out[:, 2] = np.log1p(np.diff(tokens.firsts))
        if not len(tokens.starts):
            return out, np.zeros(0)
        odds = marginal_log_odds(Chains(tokens.first), self.model.emission(tokens.features), self.model.transition)
        some = np.flatnonzero(np.diff(tokens.firsts))
        out[some, 0] = np.maximum.reduceat(odds, tokens.firsts[some])
        out[some, 1] = np.log(np.add.reduceat(1 / (1 + np.exp(-np.clip(odds, -50, 50))), tokens.firsts[some]))
        return np.clip(out, -LEAST, LEAST), odds

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(evidence), self.prior)
        return 1 / (1 + np.exp(-np.clip(evidence @ self.weights[:-1] + self.weights[-1], -30, 30)))


#: Log odds and log counts are cut off here.
LEAST = 12.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias of a slightly shrunk logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.diag([0.02] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + shrink, x.T @ (weight * (y - p)) - shrink @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Scorer:
    """Learns from at most `rows` labelled texts of each class and `size` bytes, none of them held out."""
    named = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    named = named.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in named.where("y IN (0, 1)").groupBy("y").count().collect()}
    # twice the rows, as some labelled ids may have no text
    drawn = None
    for y in (0, 1):
        own = named.where(F.col("y") == y).orderBy(F.md5(F.col("id").cast("string"))).limit(2 * rows)
        drawn = own if drawn is None else drawn.unionAll(own)
    chosen = docs.sparkSession.createDataFrame(drawn.toArrow(), "id long, y int")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.octet_length("text") <= size // 2)
    # of an id that repeats the greatest text; written, so that all texts are read once
    found = checkpointed(texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text")))
    sized = found.select("id", "y", F.octet_length("text").alias("n")).toArrow().to_pylist()
    kept: list[int] = []
    for y in (0, 1):
        left, room = rows, size // 2
        for r in sorted((r for r in sized if r["y"] == y), key=lambda r: zlib.crc32(str(r["id"]).encode()[::-1])):
            if left and r["n"] <= room:
                kept, left, room = [*kept, r["id"]], left - 1, room - r["n"]
    got = found.where(F.col("id").isin(kept)).toArrow().to_pylist()
    got.sort(key=lambda r: r["id"])
    toxic = np.array([bool(r["y"]) for r in got], bool)
    second = np.array([zlib.crc32(str(r["id"]).encode()) % 5 == 1 for r in got], bool)
    return Scorer([r["text"] for r in got], toxic, second, (counts.get(0, 0), counts.get(1, 0)))


def score(df: DataFrame, scorer: Scorer, *, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: id, score, spans (character ranges of toxic words, the end not included)."""
    told = df.sparkSession.sparkContext.broadcast(scorer)  # 2 ** BITS weights
    source, kinds, kept = carried(df, key, text, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Scorer = told.value
        for batch in batches:
            _, offsets = tb.flat(batch.column(1))
            for low, high in tb.pieces(offsets):
                part = batch.slice(low, high - low)
                tokens = Tokens(part.column(1))
                evidence, odds = own.evidence(tokens)
                hit = np.flatnonzero(odds >= 0)
                chars = np.concatenate([[0], np.cumsum((tokens.body & 0xC0) != 0x80)])
                base = chars[tokens.offsets[tokens.doc[hit]]]
                spans = pa.StructArray.from_arrays([pa.array(chars[tokens.starts[hit]] - base, pa.int64()), pa.array(chars[tokens.ends[hit]] - base, pa.int64())], ["start", "end"])
                at = np.searchsorted(hit, tokens.firsts).astype(np.int32)
                yield pa.RecordBatch.from_pydict(kept(part) | {"score": pa.array(own.score(evidence)), "spans": pa.ListArray.from_arrays(pa.array(at), spans)})

    return source.mapInArrow(run, f"{kinds}, score double, spans array<struct<start: bigint, end: bigint>>")
