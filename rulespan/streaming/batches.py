"""Batches of claims as streams: each claim's events settle it once, a batch
starts with its first event and ends when all its claims are settled.

State is kept by batch: what has been counted, and which claims are settled,
so an event that comes again counts once.  It leaves when the batch ends; a
batch that stays silent for longer than ``patience`` ends as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rulespan.sources.staging import shared_folder

c = F.col

# What counts as done, and how a batch's claims make its status.
DONE = ("COMPLETED", "TERMINATED_EARLY")
COMPLETED, PARTIAL, FAILED = "COMPLETED", "PARTIAL", "FAILED"
EVENTS = "batch_id string, kind string, claim_id string, status string, total long, completed long, failed long"


def batch_status(completed: Column, failed: Column) -> Column:
    return F.when(failed == 0, COMPLETED).when(completed == 0, FAILED).otherwise(PARTIAL)


def claim_status(fetched: Column, ran: Column) -> Column:
    """How a claim's loop ends: its fetch failed, or what its run says."""
    return F.when(~fetched, "FETCH_FAILED").otherwise(F.coalesce(ran, F.lit("FAILED")))


def batch_summaries(claims: DataFrame) -> DataFrame:
    """The summary rows of finished batches (batch_id, claim_id, status), of a table."""
    done = F.count_if(c("status").isin(*DONE))
    rows = claims.groupBy("batch_id").agg(F.count("*").alias("total"), done.alias("completed"), (F.count("*") - done).alias("failed"))
    return rows.select("batch_id", batch_status(F.col("completed"), F.col("failed")).alias("status"), "total", "completed", "failed")


STATE = "total long, completed long, failed long, settled array<string>"
NAMES = [part.split()[0] for part in EVENTS.split(", ")]


def _summary(key: tuple, total: int, completed: int, failed: int) -> tuple:
    status = COMPLETED if not failed and completed == total else FAILED if not completed else PARTIAL
    return (*key, "summary", None, status, total, completed, failed)


def _settle(patience_ms: int | None):
    """Emits a start row with a batch's first event, a row for each settled claim,
    and a summary when the last one is settled or the batch has been silent."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        total, completed, failed, settled = state.get if state.exists else (None, 0, 0, [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([_summary(key, total, completed, failed)], columns=NAMES)
            return
        settled = dict.fromkeys(settled)
        for frame in frames:
            for claim, status, size in zip(frame["claim_id"], frame["status"], frame["total"]):
                if total is None:
                    total = int(size)
                    out.append((*key, "batch_start", None, "RUNNING", total, 0, 0))
                if claim not in settled:
                    settled[claim] = None
                    completed, failed = completed + (status in DONE), failed + (status not in DONE)
                    out.append((*key, "claim", claim, status, total, completed, failed))
        if total is not None and completed + failed >= total:
            out.append(_summary(key, total, completed, failed))
            if state.exists:
                state.remove()
        elif total is not None:
            state.update((total, completed, failed, list(settled)))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=NAMES)

    return run


def batch_events(claims: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """The event rows of a stream of settled claims (batch_id, claim_id, status,
    total): batch_start, claim and summary, in the order of arrival.

    Runs over all there is and reads what it wrote.  ``total`` is the number of
    claims of the batch, of which a batch's state holds the settled ones until
    it ends; an event of a batch that has ended opens it anew.
    """
    spark = claims.sparkSession
    base = shared_folder(spark)
    keyed = claims.select(c("batch_id").cast("string").alias("batch_id"), c("claim_id").cast("string").alias("claim_id"), "status", c("total").cast("long").alias("total"))
    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    stream = keyed.groupBy("batch_id").applyInPandasWithState(_settle(patience_ms), EVENTS, STATE, "append", timeout)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/out").outputMode("append").start().awaitTermination()
    return spark.read.schema(EVENTS).parquet(f"{base}/out")
