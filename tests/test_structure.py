"""Trees in and out of nested documents, chains and rings, sections of scans."""

import json
import random

from pyspark.sql import functions as F

from rulespan.operators import pointers as pt
from rulespan.operators import scans as sn
from rulespan.plans import draft as dr


def tree(r, depth, name):
    row = {"subrule_id": name, "condition_if": f"é \"{name}\"", "skip_to_step": r.choice([None, 3])}
    if depth:
        row[r.choice(["subrules", "children"])] = [tree(r, depth - 1 if r.random() < 0.7 else 0, f"{name}.{i}") for i in range(r.randint(0, 3))]
    return row


def shape(row):
    return {"node_id": row["subrule_id"], "description": row["condition_if"], "nav_step": row["skip_to_step"], "children": [shape(x) for x in row.get("subrules", row.get("children", []))]}


def test_trees_come_back_as_they_went_in(spark):
    r = random.Random(7)
    rows = [tree(r, 6, f"t{i}") for i in range(12)]
    chain = leaf = {"subrule_id": "c0", "condition_if": "x", "skip_to_step": None}
    for i in range(1, 20):
        chain = {"subrule_id": f"c{i}", "condition_if": "x", "skip_to_step": None, "subrules": [chain]}
    steps = [(1, json.dumps({"step_number": 1, "decision_rows": [*rows, chain, 5, "text"]})), (2, json.dumps({"number": "two"})), (3, None), (4, "no json"), (5, json.dumps({"number": 1234, "rows": [leaf | {"subrule_id": "", "then": "t"}]}))]
    rules = dr.draft_rules(spark.createDataFrame(steps, "sop_id long, step string"))
    assert sorted((x["sop_id"], x["rule_id"]) for x in rules.collect()) == [(1, "RULE-001"), (5, "RULE-1234")]
    nodes = dr.draft_rows(rules)
    out = {x["node_id"]: x for x in dr.nested(nodes, ["node_id", "description", "nav_step"]).collect()}
    assert {k: json.loads(x["document"]) for k, x in out.items() if k != "RULE-1234-001"} == {x["subrule_id"]: shape(x) for x in [*rows, chain]}
    assert out["c19"]["n_nodes"] == 20 and "RULE-1234-001" in out


def test_orphans_are_roots_and_rings_have_none(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "a", 0), ("d", "gone", 0), ("x", "y", 0), ("y", "x", 0), ("z", "y", 0)], "node_id string, parent_id string, ord int")
    out = {x["node_id"]: json.loads(x["document"]) for x in dr.nested(nodes, ["node_id"]).collect()}
    assert out == {"a": {"node_id": "a", "children": [{"node_id": "c", "children": []}, {"node_id": "b", "children": []}]}, "d": {"node_id": "d", "children": []}}
    assert dr.nested(nodes.limit(0), ["node_id"]).count() == 0


def test_trees_keep_every_drafted_row(spark):
    steps = [(7, json.dumps({"number": 2, "decision_rows": [{"subrule_id": "a", "action": "x"}, {"subrule_id": "b"}, {"subrule_id": "c"}, {"subrule_id": "d", "skip_to_step": 9}]}))]
    patches = spark.createDataFrame([(7, 2, "a", "when", 2, True), (7, 2, "d", None, 2, False), (7, 2, "b", "", 8, None), (7, 3, "c", "lost", 2, True)], "sop_id long, step_number int, node_id string, applicable_when string, nav_step int, is_out_of_scope boolean")
    structure = spark.createDataFrame([("b", "a", 7), ("c", "nowhere", 7), ("d", "b", 7)], "node_id string, parent_id string, sop_id long")
    rules, rows, lost = dr.make_trees(spark.createDataFrame(steps, "sop_id long, step string"), patches, structure)
    got = {x["node_id"]: (x["parent_id"], x["applicable_when"], x["nav_step"], x["is_out_of_scope"]) for x in rows.collect()}
    assert got == {"a": (None, "when", 2, True), "b": ("a", "", None, False), "c": (None, "", None, False), "d": ("b", "", 9, False)}
    assert rules.count() == 1 and lost.count() == 0


def test_chains_end_and_rings_do_not(spark):
    n = 1000
    links = [(f"k{i}", f"k{i + 1}") for i in range(n)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("in", "r1"), ("self", "self"), ("void", None), ("to void", "void")]
    out = {x["key"]: x["end"] for x in pt.follow(spark.createDataFrame(links, "key string, to string")).collect()}
    assert out == {f"k{i}": f"k{n}" for i in range(n)} | dict.fromkeys(["r0", "r1", "r2", "in", "self", "void", "to void"])
    assert pt.follow(spark.createDataFrame([], "key string, to string")).count() == 0


def test_odd_reports(spark):
    lines = [("r", 0, "| RULE-1 | a |"), ("r", 1, "- x/My sop.yaml"), ("r", 2, "| RULE-1 | `a`, b, , |"), ("r", 3, "| RULE_2 of 3 | Same as RULE-1 and RULE-3 | more |"), ("r", 4, "| RULE-2-1 | same as rule-2-1 |"), ("r", 5, None), ("r", 6, "|"), ("r", 7, "| RULE-4 |  |"), ("r", 8, "- other.yaml"), ("r", 9, "| RULE-2 | same as RULE-1 |"), ("q", 1, "| RULE-1 | z |"), ("r", 10, "| RULE-2 | c |")]
    found = pt.report_tools(pt.report_cells(spark.createDataFrame(lines, "report string, ord int, line string")))
    assert {(x["document"], x["rule_id"]): x["tools"] for x in found.collect()} == {("My sop.yaml", "RULE-1"): ["a", "b"], ("My sop.yaml", "RULE-2"): ["a", "b"], ("My sop.yaml", "RULE-2-1"): [], ("My sop.yaml", "RULE-4"): [], ("other.yaml", "RULE-2"): ["c"]}


def test_sections_of_a_ring_end(spark):
    e = [(1, "a", 0, "SECTION", "A", "t", None, "b"), (1, "b", 1, "SECTION", None, "u", None, "a"), (1, "s", 2, "STEP", "", "step", 3, "b"), (1, "n", 3, "NOTE", "", "under the step", None, "s"), (1, "e", 4, "SECTION", "", "", None, None), (2, "x", 0, "SECTION", None, None, None, "gone")]
    entities = spark.createDataFrame(e, "doc_id long, entity_id string, ord int, type string, label string, text string, step_number int, parent_ref string")
    out = {x["name"]: (x["ord"], x["items"]) for x in sn.section_texts(entities).collect()}
    assert out == {"A": (0, ["u", "t", "under the step"]), "u": (1, ["t", "under the step", "u"])}


def test_hot_documents_meet_pages_in_spans(spark):
    pages = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit("x").alias("text"))
    plan = spark.range(2_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("step_number"), (F.col("id") * 10).cast("int").alias("start_page"), (F.col("id") * 10 + F.col("id") % 7).cast("int").alias("end_page"))
    out = sn.page_spans(plan, pages)
    assert out.agg(F.sum(F.length("raw"))).first()[0] == sum(2 * (min(20_000, i * 10 + i % 7 + 2) - i * 10) - 1 for i in range(2_000))
