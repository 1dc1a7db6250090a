"""Continuous ingest: text batches to messages, messages to batches, and windows over spans.

Each micro-batch is a batch job of the same operators, so dictionaries and deltas stay within a trace
batch. Checkpoints make the jobs restartable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.operators import codec
from tracefold.sources.files import stream
from tracefold.sources.http import post
from tracefold.sources.traces import line_id
from tracefold.wire import Options


def text_batches(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of batches from JSON lines that land in a folder; equal lines of one file share a batch_id, and their messages are equal."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return codec.decode(lines.select(line_id(), F.encode("value", "UTF-8").alias("body")), "json")


def message_batches(spark: SparkSession, spool: str, options: Options = Options()) -> DataFrame:
    """A stream of batches from the spool that an HTTP receiver fills; batch_id is by file name."""
    found = stream(spark, spool)
    return codec.decode(found.select(F.xxhash64("name").alias("batch_id"), "body"), "dict", options)


def encode_stream(batches: DataFrame, out: str, dead: str, checkpoint: str, options: Options = Options(), form: str = "dict", seconds: int | None = None, url: str | None = None) -> StreamingQuery:
    """Writes each batch's message to a Parquet table, broken ones to `dead`, and posts them if a URL is told.

    What posting gave is in `<out>-posted`. Without `seconds` it takes what is there and ends. A micro-batch that is repeated overwrites its own part.
    """
    plain = batches.select("batch_id", "resourceSpans", F.col("error").alias("read_error"))

    def each(rows: DataFrame, number: int) -> None:
        rows.persist()
        coded = codec.encode(rows.where("read_error IS NULL"), (form,), options).withColumnRenamed(form, "body").persist()
        coded.where("error IS NULL").select("batch_id", "body").write.mode("overwrite").parquet(f"{out}/micro={number}")
        broken = rows.where("read_error IS NOT NULL").select("batch_id", F.col("read_error").alias("error"))
        broken.unionByName(coded.where("error IS NOT NULL").select("batch_id", "error")).write.mode("overwrite").parquet(f"{dead}/micro={number}")
        if url:
            post(coded.where("error IS NULL"), url).write.mode("overwrite").parquet(f"{out}-posted/micro={number}")
        coded.unpersist()
        rows.unpersist()

    writer = plain.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def log_lines(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream (batch_id, value, error) of batches of logs from JSON lines that land in a folder; `console` prints it."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return codec.log_lines(lines.select(line_id(), F.encode("value", "UTF-8").alias("body")))


def console(rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Rows as JSON on standard output: for logs, and to look at a stream."""
    return rows.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("console").option("truncate", "false").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(spans: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Spans (ts, name, nanos) by window and name; rows that come later than `late` are left out of a stream."""
    rows = spans.withWatermark("ts", late) if spans.isStreaming else spans
    held = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(held.alias("w"), "name").agg(F.count("*").alias("spans"), F.sum("nanos").alias("nanos")).select(F.col("w.start").alias("start"), "name", "spans", "nanos")


def sessions(spans: DataFrame, gap: str, late: str, key: str = "trace") -> DataFrame:
    """Spans (ts, key) by sessions that a pause of `gap` ends."""
    rows = spans.withWatermark("ts", late) if spans.isStreaming else spans
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("spans")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spans")
