"""The operators applied to the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import chat, decontaminate, licenses, permutation, pieces, sharding, simhash, substring, tokenfile, toxicity
from tracefold.shared import checkpointed, remove


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), [1.0] * 40)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"""

OP2_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS row, doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor({_CRC_SQL}, 4294967295) AS text_crc32, coalesce(doc_id::VARCHAR, '') AS name FROM documents, crc_table),
s AS (
  SELECT row, g.shard, -ln((('0x' || substr(md5(name || '#' || g.shard), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM d, (SELECT unnest(range(41)) AS shard) g),
p AS (SELECT row, arg_min(shard, score) FILTER (WHERE shard < 40) AS shard, arg_min(shard, score) AS grown_shard FROM s GROUP BY row)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY (('0x' || substr(md5(name), 1, 8))::BIGINT + text_crc32) % 256, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM d JOIN p USING (row)
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), length=50).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.mark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.scratch(spark)
    tokenfile.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    found = checkpointed(tokenfile.read(spark, folder).withColumnRenamed("key", "doc_id"))
    remove(spark, folder)
    return found


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations")).withColumnRenamed("dialogue", "conv_id")


OP4_SQL = """
WITH s AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\\|') AS speaker, replace(coalesce(text, ''), '<|', '<\\|') AS x FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
r AS (SELECT s.*, perspective, CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
  ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
t AS (SELECT *, head || x || '<|end|>' || chr(10) AS rendered, row_number() OVER w - 1 AS seq,
  coalesce(sum(length(head || x) + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(x)))
SELECT conv_id, perspective, seq, turn, speaker, rendered, start, CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN start + length(rendered) - 1 END AS mask_end FROM t
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_digests(spark)).withColumnRenamed("key", "doc_id")


def _license_form(column: str) -> str:
    out = f"translate(coalesce({column}, ''), '{licenses.UPPER}{licenses.MARKS}', '{licenses.LOWER}{' ' * len(licenses.MARKS)}')"
    out = f"regexp_replace({out}, '(^|\\n)[^a-z0-9\\n]*(copyright[ :]*(\\(c\\)|©|[0-9<\\[])|\\(c\\)|©|all rights reserved)[^\\n]*', chr(10), 'g')"
    for spelling, plain in licenses.SPELLINGS:
        out = f"replace({out}, '{spelling}', '{plain}')"
    return f"regexp_replace({out}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"


def _license_digest(form: str) -> str:
    out = f"trim(regexp_replace({form}, '[ \\n]+', ' ', 'g'))"
    for spelling, plain in licenses.SPELLINGS:
        if " " in spelling:
            out = f"replace({out}, '{spelling}', '{plain}')"
    return f"sha256({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP7_SQL = f"""
WITH known AS (SELECT DISTINCT name, {_license_digest(_license_form("t"))} AS digest FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)}) v(name, t)
  UNION SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, '{d}')" for n, d, _ in licenses.listed())}) w(name, digest)),
named AS (SELECT digest, string_agg(DISTINCT name, ',' ORDER BY name) AS license FROM known GROUP BY digest),
d AS (SELECT row_number() OVER () AS row, doc_id, {_license_form("text")} AS form FROM documents),
l AS (SELECT row, sha256(trim(unnest(string_split(form, chr(10))))) AS digest FROM d),
n AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM l JOIN known USING (digest) GROUP BY row),
w AS (SELECT row, doc_id, {_license_digest("form")} AS digest FROM d)
SELECT doc_id, digest, license, notices FROM w LEFT JOIN named USING (digest) LEFT JOIN n USING (row)
"""


_WORDS_SQL = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL.format("text")} AS w FROM benchmark),
q AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n),
h AS (SELECT p.doc_id, i, p.n, q.item FROM p JOIN d USING (doc_id) JOIN q ON q.phrase = array_to_string(d.w[i:i + p.n - 1], ' ') AND q.n = p.n),
g AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN g USING (doc_id)
"""

#: Window starts by their word sequence; the earliest document of each sequence keeps its words.
OP1_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT p.doc_id, i, sha256(array_to_string(d.w[i:i + 49], ' ')) AS h FROM p JOIN d USING (doc_id)),
m AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h),
g AS (SELECT doc_id, list(i) AS starts FROM h JOIN m USING (h) WHERE first_id < doc_id GROUP BY doc_id),
r AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS gone FROM g),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_sharding,
        op3_simhash,
        op4_chat_rotation,
        op5_decontamination,
        op6_token_file,
        op7_license_scan,
        op8_toxicity,
        op9_nearest,
        op10_sentencepiece,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op4_chat_rotation": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_license_scan": OP7_SQL,
}
