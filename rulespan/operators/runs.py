"""Queries over runs, calls and jobs: filters, pages, totals, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions.decisions import ADVERSE, CLEAN_TYPES
from rulespan.functions.values import parse_date


def filter_runs(runs: DataFrame, claim_id: str = "", claim_status: str = "", from_date: str = "", to_date: str = "") -> DataFrame:
    """Runs by part of a claim id, status class and finish date (whole last day)."""
    keep: Column = F.lit(True)
    if claim_id.strip():
        keep = keep & F.lower("claim_id").contains(claim_id.strip().lower())
    decision, status = F.col("final_decision_type"), F.col("status")
    classes = {
        "CLEAN": decision.isin(*CLEAN_TYPES),
        "DEFECT": (status == "TERMINATED_EARLY") | decision.isin(*ADVERSE),
        "INCONCLUSIVE": status.isin("FAILED", "FETCH_FAILED") | (F.upper(decision) == "INCONCLUSIVE") | (decision == ""),
        "IN_PROGRESS": status == "RUNNING",
    }
    keep = keep & classes.get(claim_status.strip().upper(), F.lit(True))
    if from_date.strip():
        first = parse_date(F.lit(from_date))
        keep = keep & (first.isNull() | (F.col("finished_at") >= first))
    if to_date.strip():
        last = parse_date(F.lit(to_date))
        keep = keep & (last.isNull() | (F.col("finished_at") < F.date_add(last, 1)))
    return runs.filter(keep)


def page(rows: DataFrame, order: list[Column], limit: int = 25, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of sorted rows; the limit is clamped to 1..``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def average_minutes(runs: DataFrame, *by: str) -> DataFrame:
    """Mean processing minutes, to one place; 0.0 where no run has both times."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return runs.groupBy(*by).agg(F.coalesce(F.round(F.avg(seconds) / 60, 1), F.lit(0.0)).alias("avg_minutes"), F.count("*").alias("total"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def call_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and time of language-model calls; missing sums are 0."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), zero("tokens_in"), zero("tokens_out"), zero("ms"))


def suspicious_runs(runs: DataFrame, evaluations: DataFrame, tools: DataFrame) -> DataFrame:
    """Finished runs without an evaluation, or with a failed save.  Children are
    counted before they are joined."""
    evs = evaluations.groupBy("run_id").agg(F.count("*").alias("n_evaluations"))
    calls = tools.groupBy("run_id").agg(F.count("*").alias("n_tools"))
    joined = runs.join(evs, "run_id", "left").join(calls, "run_id", "left").fillna(0, ["n_evaluations", "n_tools"])
    return joined.filter(((F.col("n_evaluations") == 0) & F.col("status").isin("COMPLETED", "TERMINATED_EARLY")) | F.col("error_message").startswith("persist:"))


def batch_status(ok: Column) -> Column:
    """Aggregate: COMPLETED, FAILED or PARTIAL."""
    return F.when(F.bool_and(ok), "COMPLETED").when(~F.bool_or(ok), "FAILED").otherwise("PARTIAL")


def job_status(errors: Column, processed: Column) -> Column:
    return F.when((errors > 0) & (processed == 0), "FAILED").when(errors > 0, "PARTIAL").otherwise("COMPLETED")


def build_phase(auto_build: Column, built: Column, status: Column) -> Column:
    """Aggregate: phase of a workflow's build from its flags (equal in all rows
    of a workflow) and its jobs' states; a workflow without jobs has one row
    with a null state."""
    jobs = F.count(status) > 0
    return (
        F.when(~F.bool_and(auto_build), "idle")
        .when(F.bool_and(built), "done")
        .when(jobs & F.bool_and(status == "FAILED"), "failed")
        .when(F.bool_or(status == "RUNNING"), "ingesting")
        .when(jobs & F.bool_and(status.isin("COMPLETED", "FAILED", "PARTIAL")), "building")
        .otherwise("queued")
    )


def review(runs: DataFrame, action: Column, feedback: Column, now: Column) -> DataFrame:
    """Apply review actions: in_progress sets the start, approve and reject the
    end; a rejection without feedback changes nothing."""
    ok = ~((action == "reject") & (F.coalesce(F.trim(feedback), F.lit("")) == ""))
    status = F.when(~ok, F.col("review_status")).when(action == "in_progress", "IN_PROGRESS").when(action == "approve", "APPROVED").when(action == "reject", "REJECTED").otherwise(F.col("review_status"))
    return runs.withColumns({
        "review_status": status,
        "review_started_at": F.when(ok & (action == "in_progress"), now).otherwise(F.col("review_started_at")),
        "reviewed_at": F.when(ok & action.isin("approve", "reject"), now).otherwise(F.col("reviewed_at")),
    })
