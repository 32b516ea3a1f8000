"""Routing of claims through ordered rules.

Rules of a workflow have an order on the canvas and, within a procedure
("sop"), a step number.  A claim's verdicts decide which steps are reached:

* preconditions come first; a matched DENY or STOP there ends the claim,
* each procedure is then walked once from its first step on.  A step's matched
  rules decide, in this order: out of scope (ends the procedure), a forward
  goto, DENY or STOP (ends the claim), a stop or a final rule (ends the
  procedure), or the next step,
* rules passed over are kept as skipped, with the reason.

What a step would do does not depend on whether it is reached.  So windows over
the steps say it first, and one fold over the few rules of a claim finds the
reached ones.  Rows are dealt by claim once; nothing is joined to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions.decisions import HALTING

PARKED = 10_000
# Reasons of skipped rules.
MANUAL = "manually marked out of scope (excluded from execution)"
NO_RULE = "out of scope: no rule defined for this step"
SIBLING = "not-applicable: sibling already applicable"
NOT_APPLICABLE = "not-applicable: applicable_when not satisfied"
OUT_OF_SCOPE = "skipped: prior step out of scope — auditing stopped"
HALTED = "skipped: claim halted earlier (DENY/STOP)"
ENDED = "skipped: audit path ended (terminal/stop)"

RULE_COLUMNS = ("rule_key", "sop_id", "source", "step_number", "canvas_pos", "shape_id", "decision_type", "is_out_of_scope", "is_final", "aggregation", "applicable_when", "goto_step", "codes", "manual_oos")


def order_rules(rules: DataFrame) -> DataFrame:
    """Add ``sop_rank`` (procedures by first appearance) and ``step``.

    Rules without a step number get a step each, parked behind the numbered
    ones by the number of steps begun before them; preconditions, which follow
    the canvas alone, are at step 0.
    """
    pre = F.col("source") == "precondition"
    sop = Window.partitionBy("sop_id", pre)
    ranked = rules.withColumn("first_pos", F.min("canvas_pos").over(sop))
    ranked = ranked.withColumn("sop_rank", F.when(pre, -1).otherwise(F.dense_rank().over(Window.partitionBy(pre).orderBy("first_pos"))))
    same = Window.partitionBy("sop_id", pre, "step_number").orderBy("canvas_pos")
    begins = F.col("step_number").isNull() | (F.row_number().over(same) == 1)
    ranked = ranked.withColumn("begins", begins.cast("int"))
    before = F.coalesce(F.sum("begins").over(sop.orderBy("canvas_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.when(pre, 0).otherwise(F.coalesce("step_number", (PARKED + before).cast("int")))
    return ranked.withColumn("step", step).drop("first_pos", "begins")


def _first(value: Column, when: Column) -> Column:
    """The value of the first row, in canvas order, where ``when`` holds."""
    return F.min_by(value, F.when(when, F.col("canvas_pos")))


def judge_rules(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join ordered rules with verdicts (claim_id, rule_key, matched, applicable,
    nav_op, nav_step) and mark what happens to each rule if its step is reached."""
    rows = order_rules(rules.select(*RULE_COLUMNS)).join(verdicts, "rule_key")
    applicable = F.coalesce("applicable", F.lit(True))
    hit = F.coalesce("matched", F.lit(False)) & applicable
    pre = F.col("source") == "precondition"
    manual = F.coalesce("manual_oos", F.lit(False))
    blank = ~pre & F.coalesce("is_out_of_scope", F.lit(False)) & ~F.coalesce("is_final", F.lit(False))
    rows = rows.repartition("claim_id").withColumn("hit", hit & ~manual & ~blank)
    step = Window.partitionBy("claim_id", "sop_rank", "step")
    only = ~pre & F.bool_or(F.col("aggregation") == "APPLICABLE_ONLY").over(step)
    earlier = F.coalesce(F.max(F.col("hit").cast("int")).over(step.orderBy("canvas_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unmet = ~applicable & (F.coalesce("applicable_when", F.lit("")) != "")
    reason = F.when(manual, MANUAL).when(blank, NO_RULE).when(F.coalesce(only, F.lit(False)) & (earlier == 1), SIBLING).when(unmet, NOT_APPLICABLE)
    rows = rows.withColumn("own_reason", reason)
    return rows.withColumn("hit", F.col("hit") & F.col("own_reason").isNull())


def step_outcomes(rows: DataFrame) -> DataFrame:
    """Add what the step of each rule does once reached: outcome, target, halt_shape."""
    hit, oos = F.col("hit"), F.coalesce("is_out_of_scope", F.lit(False))
    step = Window.partitionBy("claim_id", "sop_rank", "step")
    halting = hit & F.col("decision_type").isin(*HALTING) & ~oos
    goto = hit & (F.col("nav_op") == "goto") & F.col("nav_step").isNotNull()
    target = F.coalesce(_first(F.col("nav_step"), goto).over(step), _first(F.col("goto_step"), hit & F.col("goto_step").isNotNull()).over(step))
    ends = hit & ((F.col("nav_op") == "stop") | (F.coalesce("is_final", F.lit(False)) & ~oos))
    rows = rows.withColumns({
        "leaves": F.bool_or(hit & oos).over(step),
        "target": target,
        "halts": F.bool_or(halting).over(step),
        "halt_shape": _first(F.col("shape_id"), halting).over(step),
        "ends": F.coalesce(F.bool_or(ends).over(step), F.lit(False)),
    })
    outcome = F.when(F.col("source") == "precondition", "next").when(F.col("leaves"), "oos").when(F.col("target") > F.col("step"), "goto").when(F.col("halts"), "halt").when(F.col("ends"), "end").otherwise("next")
    return rows.withColumn("outcome", outcome).drop("leaves", "halts", "ends")


_STATE = "struct<sop:int,step:int,reason:string,until:int,origin:int,closed:string,halted:boolean,shape:string,reasons:array<string>>"


def walk(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Fold each claim's rules, in order, through the state of its walk.

    Returns claim_id, terminated_at (shape of the halting rule), order_index,
    reason (why the rule's step was passed over) and the ``carried`` columns.
    The first rule of a step settles its reason and what follows from it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sop_rank", "step", "canvas_pos", "outcome", "target", "halt_shape", F.struct(*carried).alias("rule"))))
    start = F.struct(F.lit(-2).alias("sop"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("until"), F.lit(0).alias("origin"), F.lit(None).cast("string").alias("closed"), F.lit(False).alias("halted"), F.lit(None).cast("string").alias("shape"), F.array().cast("array<string>").alias("reasons")).cast(_STATE)

    def merge(s: Column, x: Column) -> Column:
        again = (s["sop"] == x["sop_rank"]) & (s["step"] == x["step"])
        kept = s.withField("reasons", F.concat(s["reasons"], F.array(s["reason"])))
        return F.when(again, kept).otherwise(entered(s, x))

    def entered(s: Column, x: Column) -> Column:
        same = s["sop"] == x["sop_rank"]
        # a one-element transform names what several fields below need
        old = F.struct(F.when(same, s["until"]).otherwise(0).alias("until"), F.when(same, s["origin"]).otherwise(0).alias("origin"), F.when(same, s["closed"]).alias("closed"))
        return F.transform(F.array(old), lambda o: judged(s, x, o))[0]

    def judged(s: Column, x: Column, o: Column) -> Column:
        jumped = F.concat(F.lit("skipped: routed from step "), o["origin"].cast("string"), F.lit(" to step "), o["until"].cast("string"))
        reason = F.when(s["halted"], HALTED).when(o["closed"].isNotNull(), o["closed"]).when(x["step"] < o["until"], jumped)
        return F.transform(F.array(F.struct(reason.alias("reason"))), lambda r: after(s, x, o, r["reason"]))[0]

    def after(s: Column, x: Column, o: Column, reason: Column) -> Column:
        here = reason.isNull()
        goto = here & (x["outcome"] == "goto")
        halt = here & (x["outcome"] == "halt")
        closing = F.when(here & (x["outcome"] == "oos"), OUT_OF_SCOPE).when(here & (x["outcome"] == "end"), ENDED)
        return F.struct(
            x["sop_rank"].alias("sop"),
            x["step"].alias("step"),
            reason.alias("reason"),
            F.when(goto, x["target"]).otherwise(o["until"]).alias("until"),
            F.when(goto, x["step"]).otherwise(o["origin"]).alias("origin"),
            F.coalesce(o["closed"], closing).alias("closed"),
            (s["halted"] | halt).alias("halted"),
            F.coalesce(s["shape"], F.when(halt, x["halt_shape"])).alias("shape"),
            F.concat(s["reasons"], F.array(reason)).alias("reasons"),
        ).cast(_STATE)

    listed = rows.groupBy("claim_id").agg(ordered.alias("rules"))
    folded = listed.select("claim_id", "rules", F.aggregate("rules", start, merge).alias("s"))
    flat = folded.select("claim_id", F.col("s.shape").alias("terminated_at"), F.posexplode(F.arrays_zip(F.col("rules.rule").alias("rule"), F.col("s.reasons").alias("reason"))).alias("order_index", "at"))
    return flat.select("claim_id", "terminated_at", "order_index", "at.reason", "at.rule.*")


def execute_rules(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rule results of every claim: rule columns, matched, skipped, skip_reason,
    terminated_at (shape of the halting rule) and order_index.

    A matched DENY or STOP precondition ends the claim at once; what comes
    after it leaves no rows.
    """
    rows = judge_rules(rules, verdicts)
    pre = F.col("source") == "precondition"
    stops = pre & F.col("hit") & F.col("decision_type").isin(*HALTING)
    claim = Window.partitionBy("claim_id")
    rows = rows.withColumn("stop_pos", F.min(F.when(stops, F.col("canvas_pos"))).over(claim)).withColumn("stop_shape", _first(F.col("shape_id"), stops).over(claim))
    rows = rows.filter(F.col("stop_pos").isNull() | (pre & (F.col("canvas_pos") <= F.col("stop_pos"))))
    done = walk(step_outcomes(rows), [*RULE_COLUMNS, "hit", "own_reason", "stop_shape", "sop_rank", "step"])
    reason = F.coalesce("reason", "own_reason")
    return done.select("claim_id", "order_index", *RULE_COLUMNS, (F.col("hit") & reason.isNull()).alias("matched"), reason.isNotNull().alias("skipped"), F.coalesce(reason, F.lit("")).alias("skip_reason"), F.coalesce("terminated_at", "stop_shape").alias("terminated_at"), "sop_rank", "step")
