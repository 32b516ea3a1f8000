"""Planning and validating rule trees built from customers and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.plans import ir
from rulespan.queries import fixtures as fx
from rulespan.queries import text as tq

c = F.col
N = len(fx.PHRASES.rows)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of customers: number k hangs under k // 3; those below 20 and each
    40th are roots, and roots by fours are a rule, so rules grow with the table."""
    p = fx.PHRASES.spark(spark)
    k = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("id")).withColumn("k", (c("id") % N).cast("int"))
    rows = k.join(p, "k")
    top = (c("id") < 20) | (c("id") % 40 == 0)
    climb = lambda r, _: F.when((r < 20) | (r % 40 == 0), r).otherwise(F.floor(r / 3).cast("long"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(40)), c("id"), climb)
    return rows.select(
        F.format_string("n%07d", c("id")).alias("node_id"),
        F.when(~top, F.format_string("n%07d", F.floor(c("id") / 3).cast("long"))).alias("parent_id"),
        (c("id") % 3).cast("int").alias("ord"),
        F.concat(F.lit("rule"), F.floor(root / 4).cast("string")).alias("rule_id"),
        F.when(c("id") % 2 == 0, c("phrase")).alias("description"),
        F.array(F.when(c("id") % 3 == 0, F.coalesce("phrase", F.lit(""))).otherwise("")).alias("conditions"),
        F.array(F.when(c("id") % 5 == 0, F.coalesce("phrase", F.lit(""))).otherwise("check")).alias("actions"),
        F.when(c("id") % 7 == 0, c("phrase")).otherwise("").alias("output"),
        F.when((c("id") == 4) | (c("id") % 80 == 0), "when large").alias("applicable_when"),
        (c("id") % 41 == 0).alias("is_out_of_scope"),
        F.when(c("id") % 11 == 0, "goto").when(c("id") % 11 == 1, "proceed").alias("nav_op"),
        F.when(c("id") % 11 == 0, (c("id") % 9).cast("int")).alias("nav_step"),
        (c("id") % 6).cast("int").alias("step_number"),
    )


_NODES = f"""n0 AS (SELECT c_custkey AS id, phrase FROM customer JOIN {fx.PHRASES.sql()} p ON p.k = c_custkey % {N}),
n1 AS (SELECT *, CASE WHEN id % 2 = 0 THEN phrase END AS d, CASE WHEN id % 3 = 0 THEN coalesce(phrase, '') ELSE '' END AS co, CASE WHEN id % 5 = 0 THEN coalesce(phrase, '') ELSE 'check' END AS ac,
  CASE WHEN id % 7 = 0 THEN phrase ELSE '' END AS ou FROM n0),
n2 AS (SELECT *, concat_ws(' ', d, co, ac, ou) AS whole, concat_ws(' ', ac, d, ou) AS act FROM n1),
walk AS (SELECT id, id // 4 AS rule, 0 AS depth, lpad((id % 3)::VARCHAR, 2, '0') || lpad(id::VARCHAR, 8, '0') AS path, id % 41 = 0 OR {tq._has("lower(whole)", "out of scope", "out-of-scope", "stop further auditing", "stop auditing further")} AS oos FROM n2 WHERE id < 20 OR id % 40 = 0
  UNION ALL SELECT n.id, w.rule, w.depth + 1, w.path || '/' || lpad((n.id % 3)::VARCHAR, 2, '0') || lpad(n.id::VARCHAR, 8, '0'), w.oos OR n.id % 41 = 0 OR {tq._has("lower(n.whole)", "out of scope", "out-of-scope", "stop further auditing", "stop auditing further")}
  FROM walk w JOIN n2 n ON n.id >= 20 AND n.id % 40 > 0 AND n.id // 3 = w.id)"""


def ir_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.plan_subrules(nodes(spark, sf_dir)).select("node_id", "depth", "row_index", "decision_type", "is_out_of_scope", "goto_step", "is_final", "aggregation", F.array_join("codes", ",").alias("codes"))


_G1, _G2, _NX = tq.x.GOTO_VERB, tq.x.GOTO_DIRECTLY, tq.x.NEXT_STEP
_ACT = tq._CLASSIFY.replace(tq.T, "act")
_CODES = "list_concat(list_concat(regexp_extract_all(upper(whole), '%s', 1), regexp_extract_all(array_to_string(regexp_extract_all(upper(whole), '%s', 1), '/'), '([0-9]{3})', 1)), list_concat(CASE WHEN contains(upper(whole), 'CDD') THEN ['CDD'] ELSE [] END, list_transform(regexp_extract_all(upper(whole), '%s', 1), lambda n: 'F' || n)))" % (tq.x.EOB, tq.x.EX_GROUP, tq.x.SYSTEM)
_PLAN = f"""WITH RECURSIVE {_NODES}
SELECT 'n' || lpad(id::VARCHAR, 7, '0') AS node_id, depth, (row_number() OVER (PARTITION BY rule ORDER BY path) - 1)::INTEGER AS row_index, {_ACT} AS decision_type, oos AS is_out_of_scope,
  coalesce(CASE WHEN id % 11 = 0 THEN id % 9 END, coalesce(nullif(regexp_extract(whole, '{_G1}', 1), ''), nullif(regexp_extract(whole, '{_G2}', 1), ''))::INTEGER, CASE WHEN id % 6 >= 1 AND (id % 11 = 1 OR regexp_matches(whole, '{_NX}')) THEN id % 6 + 1 END)::INTEGER AS goto_step,
  oos OR (regexp_extract(ac, '{_G1}', 1) = '' AND regexp_extract(ac, '{_G2}', 1) = '' AND contains(lower(ac), 'stop')) AS is_final,
  CASE WHEN depth = 0 AND rule IN (SELECT id // 4 FROM n2 WHERE id = 4 OR id % 80 = 0) THEN 'APPLICABLE_ONLY' WHEN NOT kids THEN 'LEAF' WHEN {tq._has("lower(coalesce(ou, ''))", "any pair", "any of the above")} THEN 'ANY' WHEN {tq._has("lower(coalesce(ou, ''))", "only one subrule", "exactly one")} THEN 'XOR_ONE'
    WHEN {tq._has("lower(coalesce(ou, ''))", "always")} AND {tq._has("lower(coalesce(ou, ''))", "met")} THEN 'ALWAYS_MET' ELSE 'FIRST_MATCH' END AS aggregation,
  array_to_string(list_filter(cs, lambda e, i: list_position(cs, e) = i), ',') AS codes
FROM (SELECT n2.*, walk.rule, walk.depth, walk.path, walk.oos, {_CODES} AS cs, n2.id IN (SELECT id // 3 FROM n2 WHERE id >= 20 AND id % 40 > 0) AS kids FROM n2 JOIN walk ON walk.id = n2.id)"""


def ir_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.tree_paths(nodes(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("n"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select(
        c("o_orderkey").cast("string").alias("rule_id"),
        (c("o_custkey") % 50).alias("sop_id"),
        F.when(c("o_orderkey") % 9 > 0, (c("o_orderkey") % 97).cast("int")).alias("step_number"),
        c("o_orderkey").cast("int").alias("source_order"),
        F.when(c("o_orderkey") % 4 == 0, (c("o_orderkey") % 150).cast("int")).alias("goto_step"),
        F.when(c("o_orderkey") % 5 == 0, "applicable_only").alias("aggregation_rule"),
    )


def child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    l = l.join(fx.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_custkey") % 50).alias("sop_id")), "l_orderkey")
    return l.select("sop_id", c("l_orderkey").cast("string").alias("rule_id"), F.when(c("l_linenumber") != 5, F.concat_ws(".", "l_orderkey", "l_linenumber")).alias("node_id"), (c("l_linenumber") > 3).cast("int").alias("depth"), F.when(c("l_linenumber") == 6, (c("l_orderkey") % 200).cast("int")).alias("goto_step"), F.when(c("l_orderkey") % 10 == 0, "w").alias("applicable_when"))


def ir_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.validate_rules(rule_rows(spark, sf_dir), child_rows(spark, sf_dir))


_R = "(SELECT o_orderkey, o_custkey % 50 AS sop_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 97 END AS step_number, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 150 END AS goto_step FROM orders)"
_VALID = f"""WITH r AS {_R}, l AS (SELECT DISTINCT l_orderkey, l_linenumber, sop_id FROM lineitem JOIN r ON o_orderkey = l_orderkey), dec AS (SELECT DISTINCT sop_id, coalesce(step_number, o_orderkey) AS s FROM r),
t AS (SELECT sop_id, o_orderkey AS k, goto_step AS g FROM r UNION ALL SELECT sop_id, l_orderkey, l_orderkey % 200 FROM l WHERE l_linenumber = 6)
SELECT sop_id, 'ERROR' AS severity, o_orderkey::VARCHAR AS rule_id, 'step_number used twice: ' || step_number AS problem FROM (SELECT *, row_number() OVER (PARTITION BY sop_id, step_number ORDER BY o_orderkey) AS n FROM r WHERE step_number IS NOT NULL) WHERE n > 1
UNION ALL SELECT t.sop_id, 'ERROR', k::VARCHAR, 'routes to undeclared step ' || g FROM t LEFT JOIN dec ON dec.sop_id = t.sop_id AND s = g WHERE g IS NOT NULL AND s IS NULL
UNION ALL SELECT sop_id, 'WARN', l_orderkey::VARCHAR, 'subrule without id' FROM l WHERE l_linenumber = 5
UNION ALL SELECT sop_id, 'WARN', l_orderkey::VARCHAR, 'applicable_only without applicable_when' FROM l WHERE l_linenumber <= 3 AND l_orderkey % 5 = 0 AND l_orderkey % 10 <> 0 GROUP BY sop_id, l_orderkey"""


def ir_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.repair_rules(rule_rows(spark, sf_dir)).select("rule_id", "step_number", "goto_step")


_REPAIR = f"""WITH r AS {_R}, a AS (SELECT *, row_number() OVER (PARTITION BY sop_id, step_number ORDER BY o_orderkey) > 1 AS again FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY sop_id ORDER BY o_orderkey) AS k FROM a WHERE again),
g AS (SELECT sop_id, unnest(range(1, (count(*) + 100)::BIGINT)) AS free FROM r GROUP BY 1), f AS (SELECT g.sop_id, free, row_number() OVER (PARTITION BY g.sop_id ORDER BY free) AS k FROM g ANTI JOIN r ON r.sop_id = g.sop_id AND r.step_number = g.free),
n AS (SELECT o_orderkey, sop_id, goto_step, step_number FROM a WHERE NOT again UNION ALL SELECT o_orderkey, k.sop_id, goto_step, free FROM k JOIN f ON f.sop_id = k.sop_id AND f.k = k.k)
SELECT o_orderkey::VARCHAR AS rule_id, step_number::INTEGER AS step_number, CASE WHEN b.s IS NOT NULL THEN goto_step END::INTEGER AS goto_step FROM n LEFT JOIN (SELECT DISTINCT sop_id, step_number AS s FROM n) b ON b.sop_id = n.sop_id AND b.s = n.goto_step"""


def orphan_reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = nodes(spark, sf_dir).select("node_id", "parent_id")
    plan = base.filter(F.substring("node_id", 8, 1) != "7").select("node_id", F.when(F.substring("node_id", 8, 1) == "3", "missing").otherwise(c("parent_id")).alias("parent_id"))
    return ir.apply_structure(base, plan)


_ORPHAN = "SELECT 'n' || lpad(c_custkey::VARCHAR, 7, '0') AS node_id, CASE WHEN c_custkey >= 20 AND c_custkey % 40 > 0 AND c_custkey % 10 NOT IN (3, 7) THEN 'n' || lpad((c_custkey // 3)::VARCHAR, 7, '0') END AS parent_id FROM customer"


def routing_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_rows(spark, sf_dir)
    patch = rows.filter("source_order % 3 = 0").select("sop_id", "rule_id", (c("source_order") % 120).alias("goto_step"))
    return ir.merge_routing(rows.select("sop_id", "rule_id", "goto_step"), patch, rows.filter("step_number is not null").select("sop_id", "step_number"))


_PATCH = f"""WITH r AS {_R}, d AS (SELECT DISTINCT sop_id, step_number FROM r WHERE step_number IS NOT NULL)
SELECT r.sop_id, o_orderkey::VARCHAR AS rule_id, coalesce(goto_step, CASE WHEN o_orderkey % 3 = 0 THEN d.step_number END)::INTEGER AS goto_step FROM r LEFT JOIN d ON d.sop_id = r.sop_id AND d.step_number = o_orderkey % 120"""


def decision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with tagged sections, nested tables and long flat ones."""
    k, step = c("o_orderkey"), c("o_custkey") % 7
    section = F.when(step < 3, c("o_orderstatus")).when(step == 3, F.lit(None)).otherwise(" ")
    depth = F.when((step == 4) & (k % 11 == 0), 1).otherwise(0)
    rows = fx.table(spark, sf_dir, "orders").select((c("o_custkey") % 300).alias("sop_id"), step.alias("step"), section.alias("section"), depth.alias("depth"), k.alias("row_index"))
    return ir.split_sections(rows).select("sop_id", "step", "row_index", "label", "part")


_PARTS = """WITH d AS (SELECT o_custkey % 300 AS sop_id, o_custkey % 7 AS step, CASE WHEN o_custkey % 7 < 3 THEN o_orderstatus ELSE '' END AS s, o_custkey % 7 = 4 AND o_orderkey % 11 = 0 AS deep, o_orderkey AS row_index FROM orders),
g AS (SELECT sop_id, step, s, row_number() OVER (PARTITION BY sop_id, step ORDER BY min(row_index)) - 1 AS i, count(*) OVER (PARTITION BY sop_id, step) AS sections FROM d GROUP BY sop_id, step, s),
w AS (SELECT sop_id, step, bool_or(deep) AS deep, count(*) AS n, list_sort(list(row_index)) AS keys FROM d GROUP BY ALL)
SELECT d.sop_id, d.step, row_index, CASE WHEN sections > 1 THEN d.s WHEN NOT w.deep AND n > 6 THEN 'part ' || ((list_position(keys, row_index) - 1) // 6 + 1) ELSE '' END AS label,
  (CASE WHEN sections > 1 THEN i WHEN NOT w.deep AND n > 6 THEN (list_position(keys, row_index) - 1) // 6 ELSE 0 END)::INTEGER AS part
FROM d JOIN g ON g.sop_id = d.sop_id AND g.step = d.step AND g.s = d.s JOIN w ON w.sop_id = d.sop_id AND w.step = d.step"""


def ir_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("sop_id"), F.create_map(F.lit("b"), c("c_mktsegment"), F.lit("a"), F.lit("1")).alias("body"))
    first = ir.next_version(spark.createDataFrame([], "sop_id long, version int, digest string"), m)
    later = m.withColumn("body", F.when(c("sop_id") % 2 == 0, c("body")).otherwise(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("x"))))
    return ir.next_version(first, later)


_VERSION = """SELECT c_custkey AS sop_id, sha256(CASE WHEN c_custkey % 2 = 0 THEN '{"a":"1","b":"' || c_mktsegment || '"}' ELSE '{"a":"2","b":"x"}' END) AS digest, 2 AS version FROM customer"""


def reclassify_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of changes, of orders whose phrase is action, condition or output."""
    rows = fx.phrased(spark, sf_dir)
    at = lambda i: F.when(c("o_orderkey") % 3 == i, c("phrase"))
    old = F.when(c("o_orderkey") % 4 == 0, "DENY").when(c("o_orderkey") % 4 == 1, "CONDITIONAL").when(c("o_orderkey") % 4 == 2, "PEND")
    return ir.transitions(ir.reclassified(rows.select(old.alias("decision_type"), at(0).alias("action_text"), at(1).alias("condition_if"), at(2).alias("output_text"))))


_RECLASSIFY = f"""SELECT old AS decision_type, new_type, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'DENY' WHEN 1 THEN 'CONDITIONAL' WHEN 2 THEN 'PEND' END AS old, {tq._CLASSIFY} AS new_type FROM {fx.PHRASED_SQL}) WHERE old IS DISTINCT FROM new_type GROUP BY ALL"""


QUERIES = {
    "reclassify_decisions": (reclassify_decisions, _RECLASSIFY),
    "ir_plan": (ir_plan, _PLAN),
    "ir_tree_depth": (ir_tree_depth, f"WITH RECURSIVE {_NODES} SELECT depth, count(*) AS n FROM walk GROUP BY depth"),
    "ir_validate": (ir_validate, _VALID),
    "ir_repair": (ir_repair, _REPAIR),
    "ir_validate_all": (ir_validate, _VALID),
    "ir_repair_all": (ir_repair, _REPAIR),
    "routing_patches_all": (routing_patches, _PATCH),
    "orphan_reattach": (orphan_reattach, _ORPHAN),
    "routing_patches": (routing_patches, _PATCH),
    "decision_parts": (decision_parts, _PARTS),
    "ir_versions": (ir_versions, _VERSION),
}
