"""Composed reads where parts are missing, tie or are null."""

from rulespan.operators import scans as sn
from rulespan.operators import views as vw
from rulespan.plans import ir


def test_parts_are_lists_in_order(spark):
    parents = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "run_id long, status string")
    rows = spark.createDataFrame([(1, 2, "y"), (1, 1, "z"), (1, 1, "b"), (None, 0, "lost"), (9, 0, "else")], "run_id long, order_index int, v string")
    out = {r["run_id"]: [(x["order_index"], x["v"]) for x in r["part"]] for r in vw.composed(parents, "run_id", {"part": (rows, ["order_index"])}).collect()}
    assert out == {1: [(1, "b"), (1, "z"), (2, "y")], 2: [], None: []}
    assert vw.composed(parents.limit(0), "run_id", {"part": (rows, ["order_index"])}).count() == 0
    assert [r["part"] for r in vw.composed(parents, "run_id", {"part": (rows.limit(0), ["order_index"])}).collect()] == [[], [], []]


def test_changes_of_type_are_counted(spark):
    rows = spark.createDataFrame([("DENY", "deny it", None, ""), (None, None, None, None), ("PEND", "", "waive", "x"), ("PEND", "waive", None, None)], "decision_type string, action_text string, condition_if string, output_text string")
    assert sorted(tuple(r) for r in ir.transitions(ir.reclassified(rows)).na.fill("none").collect()) == [("PEND", "WAIVE", 2), ("none", "CONDITIONAL", 1)]


def test_a_plan_without_steps_is_complete(spark):
    plan = spark.createDataFrame([(1, None), (2, 3), (2, 4)], "doc_id long, step_number int")
    built = spark.createDataFrame([(2, 4), (2, 9), (7, 1)], "doc_id long, step_number int")
    none = spark.createDataFrame([], "doc_id long")
    out = {r["doc_id"]: (r["missing"], r["built"], r["complete"]) for r in sn.quality_gate(plan, built, none, none.union(plan.filter("doc_id = 1").select("doc_id"))).collect()}
    assert out == {1: ([], [], False), 2: ([3], [4, 9], False)}
    assert sn.quality_gate(plan.limit(0), built, none, none).count() == 0
