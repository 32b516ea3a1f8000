"""Merges and upserts over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import merge as m
from rulespan.queries import fixtures as fx

c = F.col


def sop_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderstatus").alias("status"), c("o_orderpriority").alias("narrative"))
    old = o.filter("o_orderkey % 3 <> 0").withColumn("status", F.lit("old"))
    new = o.filter("o_orderkey % 2 = 0").withColumn("narrative", F.when(c("o_orderkey") % 4 == 0, "").otherwise("new"))
    return m.upsert(old, new, ["o_orderkey"], ("narrative",))


_UPSERT = """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'old' END AS status,
  CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority WHEN o_orderkey % 4 <> 0 THEN 'new' WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS narrative FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"""


def code_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select((c("user_id") % 100).alias("sop_id"), c("event_type").alias("code"))
    return m.insert_missing(e.filter("sop_id < 50").distinct(), e, ["sop_id", "code"])


def step_execution_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return m.latest_wins(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "updated")


def exclusion_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(c("event_id") % 5 == 0, True).when(c("event_id") % 5 == 1, False)
    e = fx.table(spark, sf_dir, "events").select("user_id", "event_id", flag.alias("flag"))
    return m.toggles(e, ["user_id"], "flag", "event_id")


_TOGGLE = """WITH e AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS f FROM events), s AS (SELECT user_id, max(event_id) FILTER (f IS NOT NULL) AS last, coalesce(arg_max(f, event_id) FILTER (f IS NOT NULL), 0) AS b FROM e GROUP BY user_id)
SELECT s.user_id, (b + count(*) FILTER (f IS NULL AND event_id > coalesce(last, -1))) % 2 = 1 AS excluded FROM s JOIN e USING (user_id) GROUP BY s.user_id, b"""


def graph_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select((c("o_custkey") % 40).alias("sop_id"), "o_orderkey")
    return m.replace_groups(o, o.filter("sop_id < 7 and o_orderkey % 2 = 0"), "sop_id").groupBy("sop_id").agg(F.count("*").alias("n"))


def step_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("deny", "note", "OVERRIDE", "eligibility", "refer", "allow")))
    rule = lambda k: F.struct(F.element_at(kinds, ((c("o_orderkey") + k) % 6 + 1).cast("int")).alias("kind"), F.concat(F.lit("c"), F.lit(k)).alias("condition"), F.lit("a").alias("action"), (c("o_orderkey") % 7 == k).alias("is_exception"))
    s = o.select("o_custkey", c("o_orderkey"), F.array(rule(0), rule(1)).alias("rules"))
    return m.promote_preconditions(s.select(c("o_custkey").alias("sop_id"), c("o_orderkey").alias("section_pos"), "rules"))


_ZERO = """WITH r AS (SELECT o_custkey AS sop_id, o_orderkey AS sp, k, ['DENY', 'NOTE', 'OVERRIDE', 'ELIGIBILITY', 'REFER', 'ALLOW'][(o_orderkey + k) % 6 + 1] AS kind, o_orderkey % 7 = k AS ex FROM orders, (SELECT unnest([0, 1]) AS k) n)
SELECT sop_id, 0 AS step_number, (row_number() OVER (PARTITION BY sop_id ORDER BY sp, k) - 1)::INTEGER AS row_index, 'c' || k AS condition_if, 'a' AS action, CASE kind WHEN 'OVERRIDE' THEN 'BYPASS' WHEN 'ELIGIBILITY' THEN 'CONDITIONAL' WHEN 'NOTE' THEN 'CONDITIONAL' ELSE kind END AS decision_type
FROM r WHERE ex OR kind IN ('DENY', 'ALLOW', 'BYPASS', 'OVERRIDE', 'ELIGIBILITY')"""


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("formats"))


QUERIES = {
    "sop_upsert": (sop_upsert, _UPSERT),
    "code_insert": (code_insert, "SELECT DISTINCT user_id % 100 AS sop_id, event_type AS code FROM events"),
    "step_execution_latest": (step_execution_latest, "SELECT user_id, event_type, event_id, n > 1 AS updated FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE r = 1"),
    "exclusion_toggles": (exclusion_toggles, _TOGGLE),
    "graph_replace": (graph_replace, "SELECT o_custkey % 40 AS sop_id, count(*) AS n FROM orders WHERE o_custkey % 40 >= 7 OR o_orderkey % 2 = 0 GROUP BY 1"),
    "step_zero": (step_zero, _ZERO),
    "ingest_summary": (ingest_summary, "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, array_to_string(list_sort(list(DISTINCT lang)), ',') AS formats FROM documents GROUP BY source"),
}
