"""Rule trees as adjacency rows: planning, validation, repair, versions.

A tree is (rule_id, node_id, parent_id or null, ord, ...).  Depth, paths and
inherited flags come from one join a level; everything else is columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions import decisions as d
from rulespan.functions import extract as x
from rulespan.sources.staging import stage


def tree_paths(nodes: DataFrame, flag: str | None = None) -> DataFrame:
    """Add depth, path (sortable in depth-first order) and, for a boolean
    column ``flag``, ``inherited``: whether the node or one above has it.

    A driver loop over depths: each turn joins the newest level's children only
    and is written out, so neither depth nor the number of nodes has a limit.
    Nodes whose parent is missing, or that are above themselves, are not reached.
    """
    own = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    step = F.struct("ord", "node_id")
    tree = nodes.select("node_id", "parent_id", step.alias("step"), own.alias("own"))
    level = stage(tree.filter("parent_id is null").select("node_id", F.lit(0).alias("depth"), F.array("step").alias("path"), F.col("own").alias("inherited")))
    walked = level
    while not level.isEmpty():
        above = level.select(F.col("node_id").alias("parent_id"), "depth", "path", "inherited")
        level = stage(tree.join(above, "parent_id").select("node_id", F.col("depth") + 1, F.concat("path", F.array("step")), F.col("inherited") | F.col("own")).toDF("node_id", "depth", "path", "inherited"))
        walked = walked.union(level)
    return nodes.join(walked, "node_id")


def preorder(nodes: DataFrame) -> DataFrame:
    """Number the nodes of each rule in depth-first order from 0."""
    return nodes.withColumn("row_index", F.row_number().over(Window.partitionBy("rule_id").orderBy("path")) - 1)


def plan_subrules(nodes: DataFrame) -> DataFrame:
    """Decisions of subrules (description, conditions, actions, output,
    applicable_when, is_out_of_scope, nav_op, nav_step, step_number)."""
    has_children = nodes.select(F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    acts, conds = F.array_join("actions", " "), F.array_join("conditions", " ")
    whole = F.concat_ws(" ", "description", conds, acts, "output")
    oos = F.coalesce("is_out_of_scope", F.lit(False)) | d.is_out_of_scope(whole)
    rows = nodes.withColumn("own_oos", oos).join(has_children, "node_id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    placed = preorder(tree_paths(rows, "own_oos"))
    stops = x.first_goto(F.array_join("actions", " ")).isNull() & F.lower(F.array_join("actions", "\n")).contains("stop")
    direct = Window.partitionBy("rule_id")
    only = F.bool_or((F.col("depth") == 0) & (F.coalesce("applicable_when", F.lit("")) != "")).over(direct)
    kind = F.when((F.col("depth") == 0) & only, "APPLICABLE_ONLY").otherwise(d.infer_aggregation(F.col("output"), F.col("has_children")))
    return placed.select(
        "rule_id", "node_id", "parent_id", "depth", "row_index",
        d.classify_decision(F.concat_ws(" ", F.array_join("actions", " "), "description", "output")).alias("decision_type"),
        F.col("inherited").alias("is_out_of_scope"),
        x.resolve_goto(whole, F.col("nav_op"), F.col("nav_step"), F.col("step_number")).alias("goto_step"),
        (F.col("inherited") | stops).alias("is_final"),
        kind.alias("aggregation"),
        F.array_distinct(F.concat(x.eob_codes(whole), x.ex_codes(whole), x.denial_codes(whole), x.system_codes(whole))).alias("codes"),
    )


def plan_leaf_rules(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """One synthesised decision for each rule without subrules."""
    blank = (F.size("conditions") == 0) & (F.size("actions") == 0)
    acts = F.array_join("actions", " ")
    whole = F.concat_ws(" ", "description", F.array_join("conditions", " "), acts, "output")
    action = F.concat_ws(" ", "description", acts, "output")
    oos = F.coalesce("is_out_of_scope", F.lit(False)) | d.is_out_of_scope(whole)
    found = F.regexp_extract(F.upper(F.concat_ws(" ", "description", acts)), r"\(?(F[3-5])\)?\b", 1)
    terminal = (found != "") & d.mentions(F.lower(action), "process the claim", "save the claim")
    leaves = rules.join(nodes.select("rule_id").distinct(), "rule_id", "left_anti")
    return leaves.select(
        "rule_id", "step_number", d.classify_decision(action).alias("decision_type"), oos.alias("is_out_of_scope"),
        (terminal | (oos & ~blank)).alias("is_final"), x.resolve_goto(whole, F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("step_number")).alias("goto_step"), F.lit("LEAF").alias("aggregation"),
    )


def validate_rules(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sop_id, severity, rule_id, problem) of rules (sop_id, rule_id,
    step_number, source_order, goto_step, aggregation_rule) and nodes (sop_id,
    rule_id, node_id, depth, goto_step, applicable_when).  Steps are declared
    and may collide within a procedure only."""
    declared = rules.select("sop_id", F.coalesce("step_number", "source_order").alias("goto_step")).distinct()
    step = Window.partitionBy("sop_id", "step_number").orderBy("source_order")
    twice = rules.filter("step_number is not null").withColumn("n", F.row_number().over(step)).filter("n > 1")
    targets = rules.select("sop_id", "rule_id", "goto_step").union(nodes.select("sop_id", "rule_id", "goto_step")).filter("goto_step is not null")
    dangling = targets.join(declared, ["sop_id", "goto_step"], "left_anti")
    nameless = nodes.filter("depth > 0 and coalesce(node_id, '') = ''")
    any_when = nodes.filter("depth = 0").groupBy("sop_id", "rule_id").agg(F.bool_or(F.coalesce("applicable_when", F.lit("")) != "").alias("any"))
    unmet = rules.filter(d.map_aggregation(F.col("aggregation_rule")) == "APPLICABLE_ONLY").join(any_when, ["sop_id", "rule_id"]).filter(~F.col("any"))
    report = lambda df, severity, text: df.select("sop_id", F.lit(severity).alias("severity"), "rule_id", text.alias("problem"))
    return (
        report(twice, "ERROR", F.concat(F.lit("step_number used twice: "), F.col("step_number").cast("string")))
        .union(report(dangling, "ERROR", F.concat(F.lit("routes to undeclared step "), F.col("goto_step").cast("string"))))
        .union(report(nameless, "WARN", F.lit("subrule without id")))
        .union(report(unmet, "WARN", F.lit("applicable_only without applicable_when")))
    )


def repair_rules(rules: DataFrame) -> DataFrame:
    """Strip targets that no rule declares; colliding step numbers move on."""
    from rulespan.operators.ordered import renumber_duplicates

    numbered = renumber_duplicates(rules, "sop_id", "source_order", "step_number")
    declared = numbered.select("sop_id", F.col("step_number").alias("goto_step"), F.lit(True).alias("known")).distinct()
    kept = numbered.join(declared, ["sop_id", "goto_step"], "left")
    return kept.withColumn("goto_step", F.when(F.col("known"), F.col("goto_step"))).drop("known")


def apply_structure(nodes: DataFrame, structure: DataFrame) -> DataFrame:
    """Give nodes the parents of ``structure`` (node_id, parent_id); a node that
    it leaves out, or whose new parent does not exist, hangs at the root."""
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    first = structure.groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))
    placed = nodes.drop("parent_id").join(first, "node_id", "left").join(known, "parent_id", "left")
    return placed.withColumn("parent_id", F.when(F.col("known") & (F.col("parent_id") != F.col("node_id")), F.col("parent_id"))).drop("known")


def merge_routing(draft: DataFrame, patch: DataFrame, declared: DataFrame) -> DataFrame:
    """Fill blank targets of ``draft`` (sop_id, rule_id, goto_step) from ``patch``
    where the patch names a step that is declared in the rule's procedure."""
    known = declared.select("sop_id", F.col("step_number").alias("patched")).distinct()
    ok = patch.select("sop_id", "rule_id", F.col("goto_step").alias("patched")).join(known, ["sop_id", "patched"], "left_semi")
    return draft.join(ok, ["sop_id", "rule_id"], "left").withColumn("goto_step", F.coalesce("goto_step", "patched")).drop("patched")


def reclassified(decisions: DataFrame) -> DataFrame:
    """``decisions`` (decision_type, action_text, condition_if, output_text, ...)
    with ``new_type``, read from action, condition and output in that order;
    the planner reads other texts.  Rows whose type stays are kept too, so the
    table can be written back as a whole."""
    filled = [F.nullif(F.coalesce(F.col(n), F.lit("")), F.lit("")) for n in ("action_text", "condition_if", "output_text")]
    return decisions.withColumn("new_type", d.classify_decision(F.concat_ws(" ", *filled)))


def transitions(decisions: DataFrame) -> DataFrame:
    """(decision_type, new_type, n) of reclassified rows whose type changes; a
    dry run is this count without the write."""
    changed = decisions.filter(~F.col("decision_type").eqNullSafe(F.col("new_type")))
    return changed.groupBy("decision_type", "new_type").agg(F.count("*").alias("n"))


def split_sections(decisions: DataFrame, size: int = 6) -> DataFrame:
    """Canvas parts of the decisions (sop_id, step, section, depth, row_index) of
    each step: ``label`` and ``part``, counted from 0.

    Several sections are a part each, whole and in order of appearance.  One
    section stays whole if any row of it is nested or it has at most ``size``
    rows; a longer flat one is cut into numbered parts.
    """
    step, section = Window.partitionBy("sop_id", "step"), F.trim(F.coalesce("section", F.lit("")))
    rows = decisions.withColumn("_first", F.min("row_index").over(Window.partitionBy("sop_id", "step", section)))
    rows = rows.withColumns({"_place": F.row_number().over(step.orderBy("row_index")) - 1, "_group": F.dense_rank().over(step.orderBy("_first")) - 1})
    several, nested, long = F.max("_group").over(step) > 0, F.max(F.coalesce("depth", F.lit(0))).over(step) > 0, F.count("*").over(step) > size
    chunk = F.floor(F.col("_place") / size).cast("int")
    part = F.when(several, F.col("_group")).when(~nested & long, chunk).otherwise(0).cast("int")
    label = F.when(several, section).when(~nested & long, F.concat(F.lit("part "), (chunk + 1).cast("string"))).otherwise("")
    return rows.withColumns({"label": label, "part": part}).drop("_first", "_place", "_group")


def next_version(current: DataFrame, documents: DataFrame) -> DataFrame:
    """Version and digest of new documents (sop_id, body map) after the current
    heads (sop_id, version, ...).  Every save is a new version, even of an equal
    body: the digest tells a reader that nothing changed."""
    digest = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("body")))), 256)
    heads = current.groupBy("sop_id").agg(F.max("version").alias("v"))
    rows = documents.select("sop_id", digest.alias("digest")).join(heads, "sop_id", "left")
    return rows.select("sop_id", "digest", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"))


def children_first(nodes: DataFrame, child: Column) -> DataFrame:
    """(parent_id, children) lists in order, from which trees are rebuilt a
    level at a time."""
    return nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", child.alias("c")))), lambda s: s["c"]).alias("children"))
