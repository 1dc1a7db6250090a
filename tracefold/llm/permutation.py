"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivot vectors (half the vectors, if those are
fewer), in order. Rows are dealt into shards; each shard posts its vectors in an inverted file by pivot,
with their rank there. A query reads the lists of its own pivots only and adds up 2 * (PREFIX - larger
rank), which is a constant less the footrule distance of the two prefixes (a pivot that is missing from
one counts as rank PREFIX). The nearest SHARE of a shard (k + 1 at least, and all that tie with the last)
are reranked by the cosine of the original vectors in double precision, and the best of all shards are
the result. SHARE is the same at all sizes.

Queries are a stated set of rows; they meet every shard in blocks of at most QUERY_BLOCK, so a task
holds one shard and one block. Equal vectors are indexed `k` + 1 times at most, smallest ids first,
which loses nothing: all others come after those in every result. Pivots are a sample of bounded
size, drawn by a hash of the id.

Defined cases: vectors that are null, all zero, or hold null or non-finite components, and rows with
a null id, take no part; nor do vectors of another length than most have. Rows with the query's id
are its own; an id that repeats is asked once, with the smallest of its vectors, and its rows are
candidates each. Equal scores are in order of id. With fewer candidates than `k` all are returned; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX = 512, 64
#: Share of a shard's vectors that is reranked.
SHARE = 0.15
SHARD_ROWS, LEAST_SHARDS, QUERY_BLOCK = 20_000, 6, 20_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten(), np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, exactly, so that squares neither vanish nor overflow."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q, each row on its own."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def prefixes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each row, nearest first; ties go to the earlier pivot."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T
    return np.argsort(-near, axis=1, kind="stable")[:, :PREFIX]


class InvertedFile:
    """Postings (vector, rank) of every pivot."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.width = order.shape
        sort = np.argsort(order.ravel(), kind="stable")
        self.vector, self.rank = sort // self.width, sort % self.width
        self.at = np.concatenate([[0], np.cumsum(np.bincount(order.ravel(), minlength=pivots))])

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """For each vector a constant less its footrule distance to the query's prefix."""
        total = np.zeros(self.n, np.int32)
        for rank, pivot in enumerate(order.tolist()):
            low, high = self.at[pivot], self.at[pivot + 1]
            total[self.vector[low:high]] += 2 * (self.width - np.maximum(self.rank[low:high], rank)).astype(np.int32)
        return total


def nearest(df: DataFrame, *, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fit = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fit.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = sizes[0]["n"]
    fit = fit.where(F.size("v") == sizes[0]["d"])
    pivots = _matrix(fit.orderBy(F.md5(F.col("id").cast("string")), "v").limit(min(PIVOTS, max(1, count // 2))).toArrow().column("v"))
    pivots = scaled(pivots)

    shards, blocks = max(LEAST_SHARDS, -(-count // SHARD_ROWS)), max(1, -(-(count // max(1, every)) // QUERY_BLOCK))
    same, own = Window.partitionBy("v").orderBy("id"), Window.partitionBy("v", "id").orderBy("id")
    kept = fit.withColumn("other", F.dense_rank().over(same)).withColumn("copy", F.row_number().over(own))
    kept = kept.where((F.col("other") <= k + 1) & (F.col("copy") <= k)).drop("other", "copy")
    over = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    posted = kept.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), over.alias("block"))
    asked = fit.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", F.pmod(F.xxhash64("v", "id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("id", "v", "shard", "block")

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if own.num_rows and queries.num_rows:
            ids, x = np.asarray(own.column("id"), np.int64), scaled(_matrix(own.column("v")))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            names, q = np.asarray(queries.column("id"), np.int64), scaled(_matrix(queries.column("v")))
            index = InvertedFile(prefixes(x, pivots), len(pivots))
            want = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
            for name, one, order in zip(names, q, prefixes(q, pivots)):
                close = index.closeness(order)
                last = np.partition(close, len(close) - want)[len(close) - want]
                found = np.flatnonzero((close >= last) & (ids != name))
                score = cosine(x[found], one)
                best = np.lexsort((ids[found], -score))[:k]
                out["query_id"].append(np.full(len(best), name))
                out["vec_id"].append(ids[found][best])
                out["score"].append(score[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate(v).astype(kinds[c]) if v else np.zeros(0, kinds[c]) for c, v in out.items()})

    by = ("shard", "block")
    found = posted.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
