"""Out-of-scope flags, references and exclusions over orders as decision rows and
customers as precondition sections; procedures grow with the customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import scope as s
from rulespan.queries import fixtures as fx

c = F.col
_D = "(SELECT o_custkey // 40 AS sop_id, o_orderkey % 9 + 1 AS step_number, o_orderkey AS row_index, o_orderkey % 7 = 0 AS oos, o_custkey, 'step:' || (o_custkey // 40) || ':' || (o_orderkey % 9 + 1) || ':' || o_orderkey AS rule_key FROM orders)"


def sop_of() -> Column:
    return F.floor(c("o_custkey") / 40).cast("int")


def step_of() -> Column:
    return (c("o_orderkey") % 9 + 1).cast("int")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    rows = o.select(sop_of().alias("sop_id"), step_of().alias("step_number"), c("o_orderkey").cast("int").alias("row_index"), (c("o_orderkey") % 7 == 0).alias("is_out_of_scope"), "o_custkey")
    return rows.withColumn("rule_key", F.concat_ws(":", F.lit("step"), "sop_id", "step_number", "row_index"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("sop_id", "step_number", ((c("sop_id") + c("step_number")) % 11 == 0).alias("is_out_of_scope")).distinct()


def asked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of rows, of preconditions, of rows that do not exist, and malformed ones."""
    d, k = decisions(spark, sf_dir), c("row_index")
    beside = F.concat_ws(":", F.lit("step"), "sop_id", "step_number", k + 1)
    key = F.when(k % 5 == 0, F.regexp_replace("rule_key", "^step", "pre")).when(k % 5 == 2, beside).when(k % 5 == 3, F.concat_ws(":", F.lit("step"), "sop_id", "step_number")).otherwise(c("rule_key"))
    return d.select(key.alias("rule_key"), (c("o_custkey") % 200).alias("shape_id"), (k % 13 == 0).alias("manual"), (k % 5 == 0).alias("custom"), (k % 10 == 0).alias("own"))


def rules_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.out_of_scope_keys(asked_keys(spark, sf_dir), decisions(spark, sf_dir), steps(spark, sf_dir))


_OOS = f"SELECT rule_key FROM {_D} WHERE row_index % 5 IN (1, 4) AND (oos OR (sop_id + step_number) % 11 = 0)"


def shape_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = asked_keys(spark, sf_dir)
    shapes = fx.table(spark, sf_dir, "customer").select((c("c_custkey") % 260).alias("shape_id")).distinct().withColumn("manual_out_of_scope", c("shape_id") % 50 == 7)
    rules = keys.select("shape_id", "rule_key", (c("manual") | (c("shape_id") % 30 == 1)).alias("manual"), (c("custom") & c("own")).alias("own"))
    return s.shape_scope(shapes, rules, rules_out_of_scope(spark, sf_dir))


_SHAPES = f"""WITH o AS ({_OOS}), r AS (SELECT o_custkey % 200 AS shape_id, row_index % 13 = 0 OR o_custkey % 200 % 30 = 1 OR row_index % 10 = 0 OR rule_key IN (SELECT rule_key FROM o) AS oos FROM {_D}),
n AS (SELECT shape_id, count(*) AS rule_count, count(*) FILTER (oos) AS oos_rule_count FROM r GROUP BY 1)
SELECT s.shape_id, coalesce(rule_count, 0) AS rule_count, coalesce(oos_rule_count, 0) AS oos_rule_count, s.shape_id % 50 = 7 OR coalesce(rule_count > 0 AND rule_count = oos_rule_count, FALSE) AS is_out_of_scope
FROM (SELECT DISTINCT c_custkey % 260 AS shape_id FROM customer) s LEFT JOIN n USING (shape_id)"""


def goto_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    gotos = F.array((c("row_index") % 12).cast("int"), (c("step_number") + 1).cast("int"), (c("row_index") % 12).cast("int"))
    return s.goto_references(d.filter("row_index % 4 = 0").select("sop_id", "rule_key", gotos.alias("gotos")), d)


_REFS = f"""WITH d AS {_D}, a AS (SELECT sop_id, rule_key, 0 AS pos, row_index % 12 AS g FROM d WHERE row_index % 4 = 0 UNION ALL SELECT sop_id, rule_key, 1, step_number + 1 FROM d WHERE row_index % 4 = 0 AND step_number + 1 <> row_index % 12)
SELECT a.rule_key, (row_number() OVER (PARTITION BY a.rule_key ORDER BY pos, d.row_index) - 1)::INTEGER AS position, d.rule_key AS reference FROM a JOIN d ON d.sop_id = a.sop_id AND d.step_number = a.g"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows and their graph nodes: decisions, and a precondition a customer."""
    dec = decisions(spark, sf_dir).select("sop_id", "rule_key", F.lit("decision").alias("source"), c("step_number").alias("section_id"), F.concat(F.lit("step_"), c("step_number").cast("string"), F.lit("_d"), c("row_index").cast("string")).alias("graph_node_key"))
    m, sop = fx.table(spark, sf_dir, "customer"), F.floor(c("c_custkey") / 40).cast("int")
    pre = m.select(sop.alias("sop_id"), F.concat_ws(":", F.lit("pre"), sop, "c_custkey", F.lit("0")).alias("rule_key"), F.lit("precondition").alias("source"), c("c_custkey").cast("int").alias("section_id"), F.when(c("c_custkey") % 8 > 0, F.concat(F.lit("pre_"), c("c_custkey").cast("string"), F.lit("_r1"))).alias("graph_node_key"))
    return dec.union(pre)


_RULES = f"""(SELECT sop_id, rule_key, 'decision' AS source, step_number AS section_id, 'step_' || step_number || '_d' || row_index AS node FROM {_D}
  UNION ALL SELECT c_custkey // 40, 'pre:' || (c_custkey // 40) || ':' || c_custkey || ':0', 'precondition', c_custkey, CASE WHEN c_custkey % 8 > 0 THEN 'pre_' || c_custkey || '_r1' END FROM customer)"""


def rule_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preconditions that override whole steps, and some that override one row."""
    m, o = fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "orders")
    node = lambda k: F.concat(F.lit("pre_"), c(k).cast("string"), F.lit("_r1"))
    whole = m.filter("c_custkey % 3 = 0").select(F.floor(c("c_custkey") / 40).cast("int").alias("sop_id"), node("c_custkey").alias("source"), F.concat(F.lit("step_"), (c("c_custkey") % 11).cast("string")).alias("target"))
    one = o.filter("o_orderkey % 6 = 0").select(sop_of().alias("sop_id"), node("o_custkey").alias("source"), F.concat(F.lit("step_"), step_of().cast("string"), F.lit("_d"), c("o_orderkey").cast("string")).alias("target"))
    return s.overrides(rules(spark, sf_dir), whole.union(one))


_OVER = f"""WITH r AS {_RULES}, e AS (SELECT c_custkey // 40 AS sop_id, 'pre_' || c_custkey || '_r1' AS s, 'step_' || (c_custkey % 11) AS t FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT o_custkey // 40, 'pre_' || o_custkey || '_r1', 'step_' || (o_orderkey % 9 + 1) || '_d' || o_orderkey FROM orders WHERE o_orderkey % 6 = 0)
SELECT DISTINCT b.rule_key AS excluded_by, r.rule_key FROM e JOIN r b ON b.sop_id = e.sop_id AND b.node = e.s JOIN r ON r.sop_id = e.sop_id AND (r.node = e.t OR (r.source = 'decision' AND 'step_' || r.section_id = e.t))"""


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a customer, of each kind, some stale or of another procedure."""
    m, k = fx.table(spark, sf_dir, "customer"), c("c_custkey")
    sop = F.floor(k / 40).cast("int")
    other = F.when(k % 10 == 9, sop + 1).otherwise(sop)
    kinds = {0: ("rule", F.concat_ws(":", F.lit("pre"), other, k, F.lit("0"))), 1: ("step", F.concat_ws(":", F.lit("step"), other, k % 12)), 2: ("section", F.concat_ws(":", F.lit("pre"), other, k)), 4: ("graph_node", F.when(k % 4 == 0, F.concat(F.lit("pre_"), k.cast("string"), F.lit("_r1"))).otherwise(F.concat(F.lit("step_"), (k % 12).cast("string")))), 5: ("html_block", F.concat_ws(":", F.lit("html"), other, F.concat(F.lit("html-"), F.hex(k)))), 3: ("sop", F.concat_ws(":", F.lit("sop"), other))}
    kind, key = F.lit("nonsense"), F.lit("x")
    for i, (name, made) in kinds.items():
        kind, key = F.when(k % 7 == i, name).otherwise(kind), F.when(k % 7 == i, made).otherwise(key)
    return m.select(k.alias("id"), sop.alias("sop_id"), kind.alias("target_kind"), key.alias("target_key"))


_OTHER = "(c_custkey // 40 + (c_custkey % 10 = 9)::INTEGER)"
_EXCL = f"""(SELECT c_custkey AS id, c_custkey // 40 AS sop_id, {_OTHER} AS other, c_custkey % 12 AS st, CASE c_custkey % 7 WHEN 0 THEN 'rule' WHEN 1 THEN 'step' WHEN 2 THEN 'section' WHEN 3 THEN 'sop' WHEN 4 THEN 'graph_node' WHEN 5 THEN 'html_block' ELSE 'nonsense' END AS target_kind,
  CASE c_custkey % 7 WHEN 0 THEN 'pre:' || {_OTHER} || ':' || c_custkey || ':0' WHEN 1 THEN 'step:' || {_OTHER} || ':' || (c_custkey % 12) WHEN 2 THEN 'pre:' || {_OTHER} || ':' || c_custkey WHEN 3 THEN 'sop:' || {_OTHER}
    WHEN 4 THEN CASE WHEN c_custkey % 4 = 0 THEN 'pre_' || c_custkey || '_r1' ELSE 'step_' || (c_custkey % 12) END WHEN 5 THEN 'html:' || {_OTHER} || ':html-' || printf('%X', c_custkey) ELSE 'x' END AS target_key FROM customer)"""


def user_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.user_exclusions(rules(spark, sf_dir), exclusions(spark, sf_dir))


_USER = f"""WITH r AS {_RULES}, x AS {_EXCL}
SELECT DISTINCT 'user-excl:' || id AS excluded_by, rule_key FROM (
  SELECT id, rule_key FROM x JOIN r ON rule_key = target_key WHERE target_kind = 'rule'
  UNION ALL SELECT id, rule_key FROM x JOIN r ON r.sop_id = other AND section_id = st WHERE target_kind = 'step' AND source = 'decision'
  UNION ALL SELECT id, rule_key FROM x JOIN r ON r.sop_id = other AND section_id = id WHERE target_kind = 'section' AND source = 'precondition'
  UNION ALL SELECT id, rule_key FROM x JOIN r ON r.sop_id = other WHERE target_kind = 'sop'
  UNION ALL SELECT id, rule_key FROM x JOIN r ON r.sop_id = x.sop_id AND node = target_key WHERE target_kind = 'graph_node'
  UNION ALL SELECT id, rule_key FROM x JOIN r ON r.sop_id = x.sop_id AND 'step_' || section_id = target_key WHERE target_kind = 'graph_node' AND source = 'decision')"""


def exclusion_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = rules(spark, sf_dir).filter("graph_node_key is not null").select("sop_id", c("graph_node_key").alias("node_key"))
    sections = rules(spark, sf_dir).filter("source = 'precondition'").select("sop_id", "section_id")
    return s.valid_targets(exclusions(spark, sf_dir), steps(spark, sf_dir), sections, nodes).select("id", "target_kind", "ok")


_VALID = f"""WITH r AS {_RULES}, x AS {_EXCL}
SELECT id, target_kind, CASE target_kind WHEN 'nonsense' THEN FALSE WHEN 'step' THEN other = sop_id AND EXISTS (SELECT 1 FROM {_D} d WHERE d.sop_id = x.sop_id AND d.step_number = st)
  WHEN 'section' THEN other = sop_id AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = id AND c_custkey // 40 = sop_id) WHEN 'graph_node' THEN EXISTS (SELECT 1 FROM r WHERE r.sop_id = x.sop_id AND node = target_key) ELSE other = sop_id END AS ok FROM x"""


def custom_rule_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.table(spark, sf_dir, "customer")
    shapes = m.select((c("c_custkey") % 25).alias("workflow_id"), c("c_custkey").alias("shape_id"), c("c_custkey").alias("position"), F.when(c("c_custkey") % 2 == 0, (c("c_custkey") % 90).cast("int")).alias("sop_id"), F.when(c("c_custkey") % 5 == 0, (c("c_custkey") % 8).cast("int")).alias("step_number"))
    first = decisions(spark, sf_dir).select(c("o_custkey").alias("shape_id"), c("row_index").alias("canvas_pos"), "sop_id", "step_number")
    return s.custom_hosts(shapes, first)


_HOSTS = f"""WITH f AS (SELECT o_custkey AS k, arg_min(sop_id, row_index) AS s, arg_min(step_number, row_index) AS st FROM {_D} WHERE sop_id <> 0 GROUP BY 1),
p AS (SELECT c_custkey AS k, s, st, s IS NULL AND c_custkey % 5 > 0 AS parked FROM customer LEFT JOIN f ON f.k = c_custkey)
SELECT k % 25 AS workflow_id, k AS shape_id, (CASE WHEN s IS NOT NULL THEN s WHEN k % 2 = 0 THEN k % 90 ELSE 0 END)::INTEGER AS host_sop_id,
  (CASE WHEN s IS NOT NULL THEN st WHEN k % 5 = 0 THEN k % 8 ELSE 9000 + (SELECT count(*) FROM p q WHERE q.k % 25 = p.k % 25 AND q.parked AND q.k <= p.k) END)::INTEGER AS host_step FROM p"""


def rules_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    key = F.when(c("o_orderkey") % 6 == 0, "").when(c("o_orderkey") % 6 > 1, F.concat(F.lit("k"), (c("o_orderkey") % 4).cast("string")))
    return s.first_per_key(o.select("o_custkey", "o_orderkey", key.alias("key")), ["o_custkey"], "key", "o_orderkey")


QUERIES = {
    "rules_out_of_scope": (rules_out_of_scope, _OOS),
    "shape_scope": (shape_scope, _SHAPES),
    "goto_references": (goto_references, _REFS),
    "rule_overrides": (rule_overrides, _OVER),
    "user_exclusions": (user_exclusions, _USER),
    "exclusion_targets": (exclusion_targets, _VALID),
    "custom_rule_hosts": (custom_rule_hosts, _HOSTS),
    "rules_by_key": (rules_by_key, "SELECT o_custkey, min(o_orderkey) AS o_orderkey, 'k' || (o_orderkey % 4) AS key FROM orders WHERE o_orderkey % 6 > 1 GROUP BY o_custkey, o_orderkey % 4"),
}
