"""What is out of scope, excluded or referred to: rule keys and what they name.

Rule keys are ``pre:<sop>:<section>:<row>`` or ``step:<sop>:<step>:<row>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_KEY = r"^step:(\d+):(\d+):(\d+)$"
#: The form of an exclusion's target key, by its kind.
TARGET_FORMS = {
    "sop": r"^sop:(\d+)$",
    "rule": r"^(?:pre|step):(\d+):\d+(?::\d+)?$",
    "step": r"^step:(\d+):(\d+)$",
    "section": r"^pre:(\d+):(\d+)$",
    "html_block": r"^html:(\d+):html-[A-Za-z0-9]+$",
}
CUSTOM_STEP = 9000


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group).try_cast("int")


def out_of_scope_keys(keys: DataFrame, decisions: DataFrame, steps: DataFrame) -> DataFrame:
    """Those of ``keys`` (rule_key) whose decision (sop_id, step_number,
    row_index, is_out_of_scope) or step (sop_id, step_number, is_out_of_scope)
    is out of scope; preconditions and malformed keys never are."""
    asked = keys.filter(F.col("rule_key").rlike(STEP_KEY)).select("rule_key", *(_number(F.col("rule_key"), STEP_KEY, i).alias(n) for i, n in enumerate(("sop_id", "step_number", "row_index"), 1))).distinct()
    found = asked.join(decisions.select("sop_id", "step_number", "row_index", F.col("is_out_of_scope").alias("own")), ["sop_id", "step_number", "row_index"])
    both = found.join(steps.select("sop_id", "step_number", F.col("is_out_of_scope").alias("above")), ["sop_id", "step_number"], "left")
    return both.filter(F.coalesce("own", F.lit(False)) | F.coalesce("above", F.lit(False))).select("rule_key").distinct()


def shape_scope(shapes: DataFrame, rules: DataFrame, oos_keys: DataFrame) -> DataFrame:
    """Per shape (shape_id, manual_out_of_scope) of ``rules`` (shape_id,
    rule_key, manual, own): how many rules, how many out of scope (by key, by
    hand, or a custom rule's own flag), and whether the shape is: all of at
    least one rule, or by hand."""
    marked = rules.join(oos_keys.select("rule_key", F.lit(True).alias("keyed")), "rule_key", "left")
    oos = F.coalesce("keyed", F.lit(False)) | F.coalesce("manual", F.lit(False)) | F.coalesce("own", F.lit(False))
    counts = marked.groupBy("shape_id").agg(F.count("*").alias("rule_count"), F.count_if(oos).alias("oos_rule_count"))
    joined = shapes.join(counts, "shape_id", "left").fillna(0, ["rule_count", "oos_rule_count"])
    all_of = (F.col("rule_count") > 0) & (F.col("oos_rule_count") == F.col("rule_count"))
    return joined.select("shape_id", "rule_count", "oos_rule_count", (all_of | F.coalesce("manual_out_of_scope", F.lit(False))).alias("is_out_of_scope"))


def goto_references(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """(rule_key, position, reference): the keys of all rows of the steps that a
    rule (sop_id, rule_key, gotos) leads to, in order of first mention; steps
    that the procedure (sop_id, step_number, row_index, rule_key) lacks do not
    count."""
    asked = rules.select("sop_id", "rule_key", F.posexplode(F.array_distinct("gotos")).alias("at", "step_number"))
    rows = decisions.select("sop_id", "step_number", "row_index", F.col("rule_key").alias("reference"))
    found = asked.join(rows, ["sop_id", "step_number"])
    place = F.row_number().over(Window.partitionBy("rule_key").orderBy("at", "row_index")) - 1
    return found.select("rule_key", place.alias("position"), "reference")


def overrides(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(excluded_by, rule_key) for OVERRIDES ``edges`` (sop_id, source, target)
    between nodes of ``rules`` (sop_id, rule_key, source, section_id,
    graph_node_key): a target is a rule's own node or the step of its rows."""
    keyed = rules.filter(F.coalesce("graph_node_key", F.lit("")) != "")
    by = keyed.select("sop_id", F.col("graph_node_key").alias("source"), F.col("rule_key").alias("excluded_by"))
    own = keyed.select("sop_id", F.col("graph_node_key").alias("target"), "rule_key")
    step = keyed.filter("source = 'decision'").select("sop_id", F.concat(F.lit("step_"), F.col("section_id").cast("string")).alias("target"), "rule_key")
    return edges.join(by, ["sop_id", "source"]).join(own.union(step), ["sop_id", "target"]).select("excluded_by", "rule_key").distinct()


def user_exclusions(rules: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(excluded_by, rule_key) for the auditors' ``exclusions`` (id, sop_id,
    target_kind, target_key) of a rule, step, section, procedure or graph
    node; each kind is an equi join, and other kinds affect no rule."""
    key, kind = F.col("target_key"), F.col("target_kind")
    asked = exclusions.select(F.concat(F.lit("user-excl:"), F.col("id").cast("string")).alias("excluded_by"), "sop_id", kind.alias("kind"), key.alias("key"), *(_number(key, f, 1).alias(f"{k}_sop") for k, f in TARGET_FORMS.items()), _number(key, TARGET_FORMS["step"], 2).alias("step_no"), _number(key, TARGET_FORMS["section"], 2).alias("section_no"), _number(key, r"^step_(\d+)$", 1).alias("node_step"))
    rows = rules.select("rule_key", F.col("sop_id").alias("r_sop"), "source", "section_id", "graph_node_key")
    decisions, preconditions = rows.filter("source = 'decision'"), rows.filter("source = 'precondition'")
    of = lambda k: asked.filter(F.col("kind") == k)
    hits = [
        of("rule").join(rows, F.col("key") == F.col("rule_key")),
        of("step").join(decisions, (F.col("step_sop") == F.col("r_sop")) & (F.col("step_no") == F.col("section_id"))),
        of("section").join(preconditions, (F.col("section_sop") == F.col("r_sop")) & (F.col("section_no") == F.col("section_id"))),
        of("sop").join(rows, F.col("sop_sop") == F.col("r_sop")),
        of("graph_node").join(rows, (F.col("sop_id") == F.col("r_sop")) & (F.col("key") == F.col("graph_node_key"))),
        of("graph_node").join(decisions, (F.col("sop_id") == F.col("r_sop")) & (F.col("node_step") == F.col("section_id"))),
    ]
    out = hits[0].select("excluded_by", "rule_key")
    for h in hits[1:]:
        out = out.union(h.select("excluded_by", "rule_key"))
    return out.distinct()


def valid_targets(exclusions: DataFrame, steps: DataFrame, sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """``exclusions`` (id, sop_id, target_kind, target_key) with ``ok``: the key
    has its kind's form, names the exclusion's own procedure, and the step
    (sop_id, step_number), section (sop_id, section_id) or graph node (sop_id,
    node_key) that it names exists."""
    key, kind = F.col("target_key"), F.col("target_kind")
    own = F.lit(False)
    for name, form in TARGET_FORMS.items():
        own = F.when(kind == name, F.coalesce(_number(key, form, 1) == F.col("sop_id"), F.lit(False))).otherwise(own)
    rows = exclusions.withColumns({"_own": own, "_step": _number(key, TARGET_FORMS["step"], 2), "_section": _number(key, TARGET_FORMS["section"], 2)})
    for name, table, to, at in (("step", steps, "step_number", "_step"), ("section", sections, "section_id", "_section"), ("graph_node", nodes, "node_key", "target_key")):
        known = table.select("sop_id", F.col(to).alias(at), F.lit(True).alias(f"_{name}_known")).distinct()
        rows = rows.join(known, ["sop_id", at], "left")
    there = F.when(kind == "step", F.col("_own") & F.col("_step_known")).when(kind == "section", F.col("_own") & F.col("_section_known")).when(kind == "graph_node", F.col("_graph_node_known")).otherwise(F.col("_own"))
    return rows.select("id", "sop_id", "target_kind", "target_key", (F.coalesce(there, F.lit(False)) & (F.coalesce(key, F.lit("")) != "")).alias("ok"))


def custom_hosts(shapes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Where the custom rules of ``shapes`` (workflow_id, shape_id, position,
    sop_id, step_number) run: at the procedure and step of the shape's first
    decision (shape_id, canvas_pos, sop_id, step_number), else at the shape's
    own, else at a step parked behind all real ones, numbered by position."""
    first = decisions.filter("sop_id <> 0").groupBy("shape_id").agg(F.min_by(F.struct("sop_id", "step_number"), "canvas_pos").alias("host"))
    rows = shapes.join(first, "shape_id", "left")
    parked = F.col("host").isNull() & F.col("step_number").isNull()
    order = Window.partitionBy("workflow_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_parked", CUSTOM_STEP + F.sum(parked.cast("int")).over(order))
    sop = F.when(F.col("host").isNotNull(), F.col("host.sop_id")).otherwise(F.coalesce("sop_id", F.lit(0)))
    step = F.when(F.col("host").isNotNull(), F.col("host.step_number")).otherwise(F.coalesce("step_number", F.col("_parked")))
    return rows.select("workflow_id", "shape_id", sop.cast("int").alias("host_sop_id"), step.cast("int").alias("host_step"))


def first_per_key(rules: DataFrame, by: list[str], key: str, position: str) -> DataFrame:
    """The first rule of each key in its group; blank keys are dropped."""
    named = rules.filter(F.coalesce(key, F.lit("")) != "")
    at = Window.partitionBy(*by, key).orderBy(position)
    return named.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")
