"""From rule results to the verdict of a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions.decisions import ADVERSE, COVERAGE_TOOLS, HALTING, precedence


def failed_tools(results: DataFrame, tools: DataFrame) -> DataFrame:
    """(claim_id, failed_coverage, failed_other): failed tools (claim_id,
    binding_id, tool_name, ok) that a rule not skipped relied on."""
    used = results.filter(~F.col("skipped")).select("claim_id", F.explode("tool_results_used").alias("binding_id")).distinct()
    bad = tools.filter(~F.coalesce("ok", F.lit(True))).select("claim_id", "binding_id", "tool_name")
    names = used.join(bad, ["claim_id", "binding_id"]).filter("coalesce(tool_name, '') <> ''")
    coverage = F.col("tool_name").isin(*COVERAGE_TOOLS)
    return names.groupBy("claim_id").agg(F.array_sort(F.collect_set(F.when(coverage, F.col("tool_name")))).alias("failed_coverage"), F.array_sort(F.collect_set(F.when(~coverage, F.col("tool_name")))).alias("failed_other"))


def verdict_sums(results: DataFrame) -> DataFrame:
    """What the verdict ladder asks of each claim's results."""
    counted = F.col("matched") & ~F.col("skipped") & ~F.coalesce("is_out_of_scope", F.lit(False))
    halting = counted & F.col("decision_type").isin(*HALTING)
    kept = F.array_sort(F.collect_list(F.when(counted, F.struct("order_index", "codes"))))
    return results.groupBy("claim_id").agg(
        F.max("terminated_at").alias("terminated_at"),
        F.max_by(F.struct("decision_type", "codes"), F.when(halting, F.col("order_index"))).alias("halted"),
        F.count_if(counted).alias("n"),
        F.count_if(counted & F.upper("decision_type").isin(*ADVERSE)).alias("adverse"),
        F.min_by("decision_type", F.when(counted, F.struct(precedence(F.col("decision_type")).alias("rank"), F.col("order_index")))).alias("winner"),
        F.array_distinct(F.flatten(F.transform(kept, lambda x: F.coalesce(x["codes"], F.array().cast("array<string>"))))).alias("codes"),
    )


def verdict_of(sums: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(claim_id, status, terminated_at, final_decision_type, applied_codes) by the
    verdict ladder over ``verdict_sums``.

    A claim that halted takes type and codes of its last matched DENY or STOP.
    Else, of the matched rules in scope: none is ALLOW; without an adverse one
    a failed coverage tool is REFER, another failed tool INCONCLUSIVE, none
    ALLOW; with one, the most severe type wins and all codes apply, in order.
    """
    none = F.array().cast("array<string>")
    if failures is None:
        sums = sums.withColumn("failed_coverage", none).withColumn("failed_other", none)
    else:
        sums = sums.join(failures, "claim_id", "left")
    early = F.col("terminated_at").isNotNull()
    clear = (F.col("n") > 0) & (F.col("adverse") == 0)
    no_cover, no_other = F.coalesce(F.size("failed_coverage"), F.lit(0)) > 0, F.coalesce(F.size("failed_other"), F.lit(0)) > 0
    decision = F.when(early, F.coalesce("halted.decision_type", F.lit("DENY"))).when(clear & no_cover, "REFER").when(clear & no_other, "INCONCLUSIVE").when(F.col("adverse") == 0, "ALLOW").otherwise(F.coalesce("winner", F.lit("ALLOW")))
    codes = F.when(early, F.coalesce("halted.codes", none)).when(clear & no_cover, F.array(F.lit("COVERAGE_VALIDATION_FAILED"))).when(F.col("adverse") == 0, none).otherwise(F.col("codes"))
    return sums.select("claim_id", F.when(early, "TERMINATED_EARLY").otherwise("COMPLETED").alias("status"), "terminated_at", decision.alias("final_decision_type"), codes.alias("applied_codes"))


def aggregate_verdicts(results: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """The verdict of each claim of ``results``, see ``verdict_of``."""
    return verdict_of(verdict_sums(results), failures)
