"""Composed reads: one row a run, claim, batch, job or document with all that
belongs to it, in order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.plans.draft import nested

c = F.col

# Fixed value: phases of tool calls around a claim's rules.
OUTER_PHASES = ("FETCH", "PARSE")


def composed(parents: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``parents`` with a list column for each of ``parts``: name -> (rows, order).
    A list holds the rows of the parent's key, without the key, in order (rows
    that tie by their other columns); it is empty where there are none.  Each
    part is grouped once; a list is as long as what its parent owns."""
    out = parents
    for name, (rows, order) in parts.items():
        fields = [n for n in rows.columns if n != key]
        item = F.struct(*fields)
        kind = rows.select(item.alias("item")).schema["item"].dataType.simpleString()
        listed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("by"), item.alias("item")))), lambda s: s["item"]).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return out


def run_details(runs: DataFrame, evaluations: DataFrame, tools: DataFrame) -> DataFrame:
    """Runs (run_id, ...) with their evaluations by order_index and tool calls by call_id."""
    return composed(runs, "run_id", {"evaluations": (evaluations, ["order_index"]), "tool_invocations": (tools, ["call_id"])})


def claim_snapshots(headers: DataFrame, agents: DataFrame, tools: DataFrame, calls: DataFrame) -> DataFrame:
    """Headers of runs with their agents by first_index, the tool calls around the
    rules as completed or failed, and the model calls by call_id."""
    outer = tools.filter(c("phase").isin(*OUTER_PHASES)).select("run_id", "call_id", "phase", c("tool_name").alias("tool"), F.when(c("ok"), "completed").otherwise("failed").alias("status"), c("duration_ms").alias("durationMs"))
    return composed(headers, "run_id", {"agents": (agents, ["first_index"]), "outerToolInvocations": (outer, ["call_id"]), "llmCalls": (calls, ["call_id"])})


def job_sections(sops: DataFrame, steps: DataFrame, decisions: DataFrame, fields: list[str], others: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Procedures (sop_id, ...) with their steps by step_number, each with its
    decisions as nested documents, and the ``others`` (codes, limits, notes ...)
    as lists.

    ``decisions`` are (step_id, node_id, parent_id, ord, ...) with ids of their
    own; ``fields`` of them are shown.  One whose parent is not there counts as
    a top row, so no row is lost.
    """
    tops = decisions.select("node_id", "step_id", "ord")
    trees = nested(decisions, fields).select("node_id", "document").join(tops, "node_id")
    lists = trees.groupBy("step_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "document"))), lambda s: s["document"]), ",").alias("inside"))
    whole = steps.join(lists, "step_id", "left").withColumn("decisions", F.concat(F.lit("["), F.coalesce("inside", F.lit("")), F.lit("]"))).drop("inside", "step_id")
    return composed(sops, "sop_id", {"steps": (whole, ["step_number"]), **others})


def document_summaries(documents: DataFrame, steps: DataFrame, rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Documents (doc_id, ...) with how many steps, rules and codes they have."""
    out = documents
    for name, part in (("step_count", steps), ("rule_count", rows), ("code_count", codes)):
        out = out.join(part.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
