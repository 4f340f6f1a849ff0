"""Structured Streaming: ledger months, usage totals, windows over events, de-duplicated uploads, dialog memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgermill.functions.entries import parse_entry
from ledgermill.shared import new_path


def entries(messages: DataFrame) -> DataFrame:
    """Messages (id, text, ts) that are ledger entries, as operations."""
    e = messages.withColumn("e", parse_entry(F.col("text"), F.col("ts").cast("date"))).where("e is not null")
    return e.select(F.col("id").alias("op_id"), "ts", F.col("e.kind").alias("kind"), F.col("e.amount").alias("value"), F.col("e.description").alias("description"), F.col("e.when").alias("when"))


def month_totals(ops: DataFrame) -> DataFrame:
    """Running month totals by header; late entries belong to their month however late, so there is no watermark.

    In a stream, state is one row per (header, month).
    """
    return ops.groupBy("header", F.trunc("when", "MM").alias("month")).agg(F.sum("value").cast("decimal(28,6)").alias("value"), F.count(F.lit(1)).alias("n"))


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model", "task").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fresh_files(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads (org_id, file_hash, ts) once per content within the lateness."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["org_id", "file_hash"])


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """A folder of uploads as a stream of (path, ts, file_hash, content)."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("ts"), F.sha2("content", 256).alias("file_hash"), "content")


def run_once(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain what a stream holds now into a table of the shared folder, its state beside it.

    In mode ``complete`` every batch replaces the table, in others it is appended.
    """
    spark = result.sparkSession
    path = new_path(spark, name)
    rows = f"{path}/rows"
    spark.createDataFrame([], result.schema).write.parquet(rows)
    keep = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(rows)
    query: StreamingQuery = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(rows)


def append_usage(batch: DataFrame, path: str) -> None:
    """foreachBatch sink of the usage journal: JSON lines."""
    batch.write.mode("append").json(path)
