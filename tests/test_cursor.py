"""The fold against a plain walk, and the routing scenarios."""

import random

import pytest

from rulespan.operators import cursor
from rulespan.operators.cursor import execute_rules
from rulespan.operators.verdict import aggregate_verdicts, failed_tools

RULE = "rule_key string, sop_id int, source string, step_number int, canvas_pos int, shape_id string, decision_type string, is_out_of_scope boolean, is_final boolean, aggregation string, applicable_when string, goto_step int, codes array<string>, manual_oos boolean"
VERDICT = "claim_id long, rule_key string, matched boolean, applicable boolean, nav_op string, nav_step int"


def rule(key, sop, step, pos, kind="CONDITIONAL", source="decision", oos=False, final=False, aggregation="LEAF", when="", goto=None, codes=(), manual=False):
    return (key, sop, source, step, pos, f"s{pos}", kind, oos, final, aggregation, when, goto, list(codes), manual)


def plain(rules, verdicts):
    """The walk as a loop over one claim's rules: [(rule_key, matched, reason)]."""
    out = []
    judge = {v[1]: (bool(v[2]) and bool(v[3]), bool(v[3]), v[4], v[5]) for v in verdicts}
    for r in sorted((r for r in rules if r[2] == "precondition"), key=lambda r: r[4]):
        hit, applicable, *_ = judge[r[0]]
        reason = cursor.MANUAL if r[13] else cursor.NOT_APPLICABLE if not applicable and r[10] else ""
        out.append((r[0], hit and not reason, reason))
        if hit and not reason and r[6] in ("DENY", "STOP"):
            return out
    decisions = sorted((r for r in rules if r[2] != "precondition"), key=lambda r: r[4])
    halted = False
    for sop in dict.fromkeys(r[1] for r in decisions):
        steps = {}
        for r in (r for r in decisions if r[1] == sop):
            steps.setdefault(r[3] if r[3] is not None else cursor.PARKED + len(steps), []).append(r)
        until, origin, closed = 0, 0, None
        for step in sorted(steps):
            passed = cursor.HALTED if halted else closed or (f"skipped: routed from step {origin} to step {until}" if step < until else None)
            hits, only, met = [], any(r[9] == "APPLICABLE_ONLY" for r in steps[step]), False
            for r in steps[step]:
                hit, applicable, op, nav = judge[r[0]]
                own = cursor.MANUAL if r[13] else cursor.NO_RULE if r[7] and not r[8] else cursor.SIBLING if only and met else cursor.NOT_APPLICABLE if not applicable and r[10] else None
                reason = passed or own
                out.append((r[0], hit and not reason, reason or ""))
                if hit and not own:
                    hits.append((r, op, nav))
                    met = True
            if passed:
                continue
            gotos = [nav for _, op, nav in hits if op == "goto" and nav is not None] or [r[11] for r, _, _ in hits if r[11] is not None]
            if any(r[7] for r, _, _ in hits):
                closed = cursor.OUT_OF_SCOPE
            elif gotos and gotos[0] > step:
                until, origin = gotos[0], step
            elif any(r[6] in ("DENY", "STOP") and not r[7] for r, _, _ in hits):
                halted = True
            elif any(op == "stop" or (r[8] and not r[7]) for r, op, _ in hits):
                closed = cursor.ENDED
    return out


def run(spark, rules, verdicts):
    rows = execute_rules(spark.createDataFrame(rules, RULE), spark.createDataFrame(verdicts, VERDICT)).orderBy("claim_id", "order_index").collect()
    return {c: [(r["rule_key"], r["matched"], r["skip_reason"]) for r in rows if r["claim_id"] == c] for c in {r["claim_id"] for r in rows}}


def test_fold_equals_plain_walk(spark):
    r = random.Random(7)
    for _ in range(4):
        rules = []
        for pos in range(14):
            source = "precondition" if pos < 2 else "decision"
            rules.append(rule(f"r{pos}", r.choice([1, 2, 3]), r.choice([None, 1, 2, 3, 4, 5]), pos, r.choice(["DENY", "STOP", "PEND", "ALLOW", "CONDITIONAL", "CONDITIONAL"]), source, r.random() < 0.15, r.random() < 0.3, r.choice(["LEAF", "LEAF", "APPLICABLE_ONLY"]), r.choice(["", "when x"]), r.choice([None, None, 1, 3, 4, 9]), (), r.random() < 0.1))
        verdicts = [(c, x[0], r.random() < 0.4, r.random() < 0.8, r.choice([None, None, None, "goto", "stop"]), r.choice([None, 2, 4, 6])) for c in range(40) for x in rules]
        found = run(spark, rules, verdicts)
        for c in range(40):
            assert found[c] == plain(rules, [v for v in verdicts if v[0] == c]), rules


@pytest.mark.parametrize(
    ("rules", "hits", "ran"),
    [
        ([rule("a1", 100, 1, 0, goto=3), rule("a2", 100, 2, 1), rule("a3", 100, 3, 2), rule("b1", 200, 1, 3), rule("b2", 200, 2, 4)], {"a1"}, {"a1", "a3", "b1", "b2"}),
        ([rule("a1", 100, 1, 0, "DENY"), rule("a2", 100, 2, 1), rule("b1", 200, 1, 2)], {"a1"}, {"a1"}),
        ([rule("a1", 100, 1, 0, oos=True, final=True), rule("a2", 100, 2, 1), rule("b1", 200, 1, 2)], {"a1"}, {"a1", "b1"}),
        ([rule("a1", 100, 1, 0), rule("a2", 100, 2, 1, manual=True), rule("a3", 100, 3, 2)], {"a2"}, {"a1", "a3"}),
        ([rule("p", 100, None, 0, "DENY", "precondition", manual=True), rule("a1", 100, 1, 1)], {"p"}, {"a1"}),
        ([rule("a1", 100, 1, 0, "DENY", goto=3), rule("a2", 100, 2, 1), rule("a3", 100, 3, 2)], {"a1"}, {"a1", "a3"}),
        ([rule("a1", 100, 1, 0, goto=9), rule("a2", 100, 2, 1)], {"a1"}, {"a1"}),
        ([rule("a1", 100, 2, 0, goto=1), rule("a2", 100, 3, 1)], {"a1"}, {"a1", "a2"}),
        ([rule("a1", 100, 1, 0, aggregation="APPLICABLE_ONLY", when="x"), rule("a2", 100, 1, 1, aggregation="APPLICABLE_ONLY", when="y")], {"a1", "a2"}, {"a1"}),
    ],
)
def test_routing(spark, rules, hits, ran):
    found = run(spark, rules, [(1, r[0], r[0] in hits, True, None, None) for r in rules])[1]
    assert {k for k, _, reason in found if not reason} == ran


def test_precondition_halt_leaves_no_more_rows(spark):
    rules = [rule("p", 1, None, 0, "STOP", "precondition"), rule("a", 1, 1, 1)]
    assert run(spark, rules, [(1, "p", True, True, None, None), (1, "a", True, True, None, None)])[1] == [("p", True, "")]


def test_verdict_ladder(spark):
    schema = "claim_id long, order_index int, decision_type string, codes array<string>, matched boolean, skipped boolean, is_out_of_scope boolean, terminated_at string, tool_results_used array<string>"
    rows = [
        (1, 0, "BYPASS", ["a"], True, False, False, None, []),
        (1, 1, "PEND", ["b", "a"], True, False, False, None, []),
        (2, 0, "CONDITIONAL", [], True, False, False, None, ["t1"]),
        (3, 0, "CONDITIONAL", [], True, False, False, None, ["t2"]),
        (4, 0, "DENY", ["x"], True, False, False, "s", []),
        (5, 0, "DENY", ["x"], False, False, False, None, ["t1"]),
        (6, 0, "DENY", ["x"], True, True, False, None, []),
        (7, 0, "STRANGE", ["y"], True, False, False, None, []),
    ]
    tools = spark.createDataFrame([(2, "t1", "cbd_coverage", False), (3, "t2", "npi", False), (5, "t1", "cbd_coverage", False)], "claim_id long, binding_id string, tool_name string, ok boolean")
    results = spark.createDataFrame(rows, schema)
    got = {r["claim_id"]: (r["status"], r["final_decision_type"], r["applied_codes"]) for r in aggregate_verdicts(results, failed_tools(results, tools)).collect()}
    assert got == {
        1: ("COMPLETED", "PEND", ["a", "b"]),
        2: ("COMPLETED", "REFER", ["COVERAGE_VALIDATION_FAILED"]),
        3: ("COMPLETED", "INCONCLUSIVE", []),
        4: ("TERMINATED_EARLY", "DENY", ["x"]),
        5: ("COMPLETED", "ALLOW", []),
        6: ("COMPLETED", "ALLOW", []),
        7: ("COMPLETED", "ALLOW", []),
    }
