"""Rollups of rule results: nodes, steps, agents, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions import decisions as d


def _in_order(value: Column, when: Column) -> Column:
    """Distinct values where ``when`` holds, by first ``order_index``."""
    kept = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("order_index").alias("at"), value.alias("v")))))
    return F.array_distinct(F.transform(kept, lambda x: x["v"]))


def node_rollup(results: DataFrame, halting: tuple[str, ...] = d.HALTING) -> DataFrame:
    """A row for each claim and node, in the order nodes were first touched.

    The first node with a matched ``halting`` type of a claim that ended early
    is marked.  Pass all adverse types for the light summary's reading.
    """
    fired = F.col("matched") & ~F.col("skipped")
    nodes = results.groupBy("claim_id", "shape_id").agg(
        F.min("order_index").alias("first_index"),
        F.count_if(~F.col("skipped")).alias("rules_evaluated"),
        F.count_if(fired).alias("rules_matched"),
        _in_order(F.col("decision_type"), fired & (F.col("decision_type") != "")).alias("matched_types"),
        F.max(F.col("terminated_at").isNotNull()).alias("early"),
        F.bool_or(F.col("matched") & F.upper("decision_type").isin(*halting)).alias("halts"),
    )
    first_halt = F.min(F.when(F.col("halts"), F.col("first_index"))).over(Window.partitionBy("claim_id"))
    return nodes.withColumn("terminated_here", F.col("early") & (F.col("first_index") == F.coalesce(first_halt, F.lit(-1)))).drop("early", "halts")


def step_key(rule: Column, section: Column, key: Column) -> Column:
    """What evaluations of one step share: the source rule, else the section,
    else the rule key; blank values do not count."""
    return F.coalesce(F.nullif(rule, F.lit("")), F.nullif(section, F.lit("")), key)


def trace_steps(results: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """A row for each (claim, node, procedure, ``step_key``) of ``results``:
    status, codes and the order it was first seen in.

    ``tools`` (claim_id, binding_id, tool_name, ok) are those the evaluations
    name in ``tool_results_used``.  A failed coverage tool makes a step
    Not-Met, another failed tool makes it Inconclusive unless it is Not-Met.
    """
    keys = ["claim_id", "shape_id", "sop_id", "step_key"]
    steps = results.groupBy(*keys).agg(
        F.min("order_index").alias("first_index"),
        F.count("*").alias("n_rules"),
        d.step_status(F.col("skipped"), F.col("is_out_of_scope"), F.col("codes"), F.lit(""), F.col("matched"), F.col("decision_type")).alias("status"),
        F.min_by("decision_type", "order_index").alias("decision_type"),
        F.min_by("codes", "order_index").alias("codes"),
    )
    if tools is None:
        return steps
    used = results.select(*keys, F.explode("tool_results_used").alias("binding_id")).join(tools, ["claim_id", "binding_id"])
    return marked_by_tools(steps.join(named_tools(used, keys), keys, "left"))


def named_tools(used: DataFrame, keys: list[str]) -> DataFrame:
    """Names of the tools ``used`` (keys, tool_name, ok), and of those that failed."""
    return used.filter(F.coalesce("tool_name", F.lit("")) != "").groupBy(*keys).agg(
        F.array_sort(F.collect_set("tool_name")).alias("tools_used"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("tool_name")))).alias("tools_failed"),
    )


def marked_by_tools(steps: DataFrame) -> DataFrame:
    """Steps with the status that their ``tools_failed`` leave them."""
    failed = F.coalesce("tools_failed", F.array().cast("array<string>"))
    cover = F.arrays_overlap(failed, F.array(*map(F.lit, d.COVERAGE_TOOLS)))
    status = F.when(cover, "Not-Met").when((F.size(failed) > 0) & (F.col("status") != "Not-Met"), "Inconclusive").otherwise(F.col("status"))
    return steps.withColumn("status", status)


def explainability(steps: DataFrame) -> DataFrame:
    """Agents (node and procedure) of each claim: folded status, first failing step."""
    bad = ~F.col("status").isin("Met", "Skipped")
    return steps.groupBy("claim_id", "shape_id", "sop_id").agg(
        d.fold_audit_status(F.col("status")).alias("final_status"),
        F.count("*").alias("n_steps"),
        F.min_by("step_key", F.when(bad, F.col("first_index"))).alias("first_failing"),
    )


def claim_status(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """(claim_id, claim_status) of runs (claim_id, status, final_decision_type):
    run state, else the verdict, else the fold of the trace."""
    return status_of(runs.join(folded(steps), "claim_id", "left"))


def folded(steps: DataFrame) -> DataFrame:
    """(claim_id, folded): the fold of each claim's trace."""
    return steps.groupBy("claim_id").agg(d.fold_audit_status(F.col("status")).alias("folded"))


def status_of(runs: DataFrame) -> DataFrame:
    """The status of runs that hold the fold of their trace, see ``claim_status``."""
    decided = d.decision_status(F.col("final_decision_type"))
    status = (
        F.when(F.col("status") == "RUNNING", "IN_PROGRESS")
        .when(F.col("status").isin("FAILED", "FETCH_FAILED"), "INCONCLUSIVE")
        .when(F.col("status") == "TERMINATED_EARLY", "DEFECT")
        .when(decided != "", decided)
        .otherwise(F.coalesce("folded", F.lit("INCONCLUSIVE")))
    )
    return runs.select("claim_id", status.alias("claim_status"))
