"""Streams over the events table, equal to their batch readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.streaming import batches as b
from rulespan.streaming import progress as p

c = F.col


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.event_stream(spark, f"{sf_dir}/events.parquet")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.progress(events(spark, sf_dir).withColumn("job_id", c("user_id") % 50), "job_id", c("event_type") != "error")


def stream_dedupe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.replay(events(spark, sf_dir).select("user_id", "event_type"), "user_id", c("event_type") == "purchase").select("user_id")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.tail(events(spark, sf_dir).select("event_id", "event_type"), "event_id", 500)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.windowed(events(spark, sf_dir), "ts", "1 day", None, "event_type")


def settled_claims(events: DataFrame) -> DataFrame:
    """Users as batches, their events as claims that are fetched and run."""
    ran = F.when(c("event_type") == "purchase", "COMPLETED").when(c("event_type") == "view", "TERMINATED_EARLY").when(c("event_type") == "signup", "INCONCLUSIVE")
    rows = events.select(c("user_id").alias("batch_id"), c("event_id").alias("claim_id"), b.claim_status(c("event_type") != "error", ran).alias("status"))
    return rows


def batch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as their stream sums them up; the first events name the batch's size."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    totals = table.groupBy(c("user_id").alias("batch_id")).agg(F.count("*").alias("total"))
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    found = b.batch_events(settled_claims(rows).join(totals, "batch_id"))
    return found.groupBy("batch_id").agg(F.count_if(c("kind") == "batch_start").alias("starts"), F.count_if(c("kind") == "claim").alias("claims"), F.max(F.when(c("kind") == "summary", c("status"))).alias("status"), F.max(F.when(c("kind") == "summary", c("completed"))).alias("completed"), F.max(F.when(c("kind") == "summary", c("failed"))).alias("failed"))


def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.batch_summaries(settled_claims(spark.read.parquet(f"{sf_dir}/events.parquet")))


_DONE = "count(*) FILTER (event_type IN ('purchase', 'view'))"
_STATUS = f"CASE WHEN {_DONE} = count(*) THEN 'COMPLETED' WHEN {_DONE} = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status"

QUERIES = {
    "batch_stream": (batch_stream, f"SELECT user_id::VARCHAR AS batch_id, 1::BIGINT AS starts, count(*) AS claims, {_STATUS}, {_DONE} AS completed, count(*) - {_DONE} AS failed FROM events GROUP BY user_id"),
    "batch_summaries": (batch_summaries, f"SELECT user_id AS batch_id, {_STATUS}, count(*) AS total, {_DONE} AS completed, count(*) - {_DONE} AS failed FROM events GROUP BY user_id"),
    "stream_progress": (stream_progress, "SELECT user_id % 50 AS job_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS queued FROM events GROUP BY 1"),
    "stream_dedupe_replay": (stream_dedupe_replay, "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'"),
    "log_tail": (log_tail, "SELECT event_id, event_type FROM events WHERE event_id > 500"),
    "event_windows": (event_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
