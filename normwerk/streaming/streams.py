"""Streams: synchronisation, intake, daily traffic and activity, files processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normwerk.functions import crossval, rules
from normwerk.functions.text import is_bot, parse_access_line
from normwerk.operators.tables import outside, validated
from normwerk.sources.sinks import merge_ordered

LATE = "1 day"


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync(stream: DataFrame, path: str, key: str, updated: str, checkpoint: str, keep_if_null: tuple[str, ...] = (), deleted: str | None = None) -> StreamingQuery:
    """Upsert by key into a snapshot (see sinks.merge_ordered, read_ordered): the row with the largest (`updated`, batch) stands, also if an older one comes in a later batch or a batch runs again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_ordered(batch, path, key, updated, batch_id, keep_if_null, deleted)

    return _run(stream, each, checkpoint)


def intake(stream: DataFrame, memory_path: str, log_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Raw messages (message, classification JSON, ts): a memory row and a log row each; rows that break a constraint are kept apart.

    Each batch overwrites its own partition (`batch`), so a batch that runs again leaves no row twice.
    """

    def put(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def each(batch: DataFrame, batch_id: int) -> None:
        p = batch.select("message", "ts", crossval.parse_classification(F.col("classification"), F.col("message")).alias("c"))
        memory = p.select(F.col("message").alias("content"), F.lower("c.type").alias("content_type"), F.col("c.summary").alias("summary"), F.col("c.tags").alias("tags"), F.lower("c.priority").alias("priority"), F.lit("active").alias("status"), "ts", F.lit(batch_id).alias("batch"))
        good, bad = validated(memory, [outside("content_type", rules.CONTENT_TYPES), outside("priority", rules.PRIORITIES)])
        put(good, memory_path)
        put(bad, bad_path)
        put(memory.select(F.lit("intake").alias("agent_id"), F.col("content_type").alias("action"), F.lit("success").alias("status"), "ts", "batch"), log_path)

    return _run(stream, each, checkpoint)


def daily_traffic(lines: DataFrame, error: float = 0.01) -> DataFrame:
    """day, class, addresses (approximate, with `error` as standard error: streams can't count distinct values exactly), requests; lines later than a day are left out."""
    a = lines.select(parse_access_line("line").alias("r")).filter(F.col("r.ts").isNotNull()).select("r.*").withWatermark("ts", LATE)
    return a.groupBy(F.window("ts", "1 day").alias("w"), F.when(is_bot("ua"), "bot").otherwise("human").alias("class")).agg(F.approx_count_distinct("ip", error).alias("ips"), F.count("*").alias("requests")).select(F.to_date("w.start").alias("day"), "class", "ips", "requests")


def daily_activity(logs: DataFrame) -> DataFrame:
    """day, agent_id, total, success, error, and mean_ms where the logs have duration_ms."""
    n = lambda s: F.count_if(F.col("status") == s)
    mean = {"mean_ms": F.round(F.avg("duration_ms")).cast("int")} if "duration_ms" in logs.columns else {}
    counts = {"total": F.count("*"), "success": n("success"), "error": n("error")} | mean
    a = logs.withWatermark("created_at", LATE).groupBy(F.window("created_at", "1 day").alias("w"), "agent_id").agg(*[c.alias(k) for k, c in counts.items()])
    return a.select(F.to_date("w.start").alias("day"), "agent_id", *counts)


def once(files: DataFrame, arrived: str = "arrived") -> DataFrame:
    """Files whose content hash hasn't come within the last day; across runs, see operators.ingest.unfinished."""
    return files.withWatermark(arrived, LATE).dropDuplicatesWithinWatermark(["sha256"])


def to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there into Parquet."""
    return result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
