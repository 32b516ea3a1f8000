"""Order-dependent operators and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import ordered as w
from rulespan.operators import sets as s
from rulespan.queries import fixtures as fx

c = F.col


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


def first_missing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.first_missing(fx.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_FIRST = """SELECT l_orderkey, min(k)::BIGINT AS missing FROM (SELECT o.l_orderkey, k FROM (SELECT DISTINCT l_orderkey FROM lineitem) o, (SELECT unnest(range(1, 9)) AS k) n
  EXCEPT SELECT l_orderkey, l_linenumber::BIGINT FROM lineitem) GROUP BY 1"""


def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.gaps(fx.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.neighbours(fx.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(c("event_id") % 3 == 0, c("event_type")).when(c("event_id") % 3 == 1, " ").alias("label"))
    return e


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.carry_down(carried(spark, sf_dir), "user_id", ["event_id"], "label").select("event_id", "label")


def page_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carried(spark, sf_dir).withColumn("page", F.when(c("event_id") % 4 == 0, c("event_id") % 50))
    return w.fill_both_ways(rows, "user_id", ["event_id"], "page").select("event_id", "page")


def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.runs_of(carried(spark, sf_dir), "user_id", ["event_id"], c("event_id") % 5 == 0).select("event_id", "run")


def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.chunks(carried(spark, sf_dir), "user_id", ["event_id"], 6).select("event_id", "chunk")


def budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (c("o_orderkey") % 13).alias("score"), (c("o_orderkey") % 400 + 1).alias("cost"))
    return w.top_within_budget(o, "o_custkey", "score", "o_orderkey", "cost", 900).select("o_custkey", "o_orderkey", "spent")


def char_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return w.budget_batches(d, "source", ["doc_id"], "doc_id", "n_chars", 5000)


_BATCH = """WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
b AS (SELECT source, doc_id, n, 0 AS batch, n_chars AS s FROM d WHERE n = 1 UNION ALL
  SELECT d.source, d.doc_id, d.n, CASE WHEN b.s > 0 AND b.s + d.n_chars > 5000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.s > 0 AND b.s + d.n_chars > 5000 THEN d.n_chars ELSE b.s + d.n_chars END
  FROM b JOIN d ON d.source = b.source AND d.n = b.n + 1)
SELECT source, doc_id, batch FROM b"""


def code_best_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select((c("user_id") % 40).alias("code"), c("event_type").alias("system"), F.round(c("value"), 1).alias("confidence"), "event_id")
    return w.best_of(e, ["code", "system"], c("confidence"), [c("event_id")])


def sop_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.first_seen(fx.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


def renumbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps 1, 5, 9 and none, so repeats fall into the gaps between them."""
    step = F.when(c("o_orderkey") % 5 > 0, (c("o_orderkey") % 3 * 4 + 1).cast("int"))
    o = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", step.alias("step"))
    return w.renumber_duplicates(o, "o_custkey", "o_orderkey", "step")


_RENUM = """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 * 4 + 1 END AS step FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, step ORDER BY o_orderkey) > 1 AS again FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM a WHERE again),
g AS (SELECT o_custkey, unnest(range(1, (count(*) + 10)::BIGINT)) AS free FROM o GROUP BY 1), f AS (SELECT o_custkey, free, row_number() OVER (PARTITION BY o_custkey ORDER BY free) AS k FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = g.o_custkey AND o.step = g.free))
SELECT o_custkey, o_orderkey, step::INTEGER AS step FROM a WHERE NOT again UNION ALL SELECT k.o_custkey, o_orderkey, free::INTEGER FROM k JOIN f ON f.o_custkey = k.o_custkey AND f.k = k.k"""


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.first_by_content(fx.table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "content_hash")


def ordered_code_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("E"), (c("l_partkey") % 9).cast("string")).alias("code"), (c("l_partkey") * 1000 + c("l_linenumber")).alias("pos"))
    return s.merge_in_order(l, "l_orderkey", "pos", "code").select("l_orderkey", F.array_join("codes", ",").alias("codes"))


def checklist_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = lines(spark, sf_dir).withColumn("origin", F.lit("extracted"))
    want = fx.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l_linenumber"))
    return s.backfill(have, want, ["l_orderkey", "l_linenumber"], "origin", "checklist")


_CHECK = """SELECT DISTINCT l_orderkey, l_linenumber, 'extracted' AS origin FROM lineitem UNION ALL
SELECT o.o_orderkey, k, 'checklist' FROM orders o, (SELECT unnest([1, 2, 3, 4])::INTEGER AS k) n WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_linenumber = k)"""


def rebuild_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 < 2").select("o_orderkey", c("o_orderstatus").alias("v"))
    new = o.filter("o_orderkey % 3 > 0").select("o_orderkey", F.when(c("o_orderkey") % 7 == 0, "Z").otherwise(c("o_orderstatus")).alias("v"))
    return s.diff(old, new, ["o_orderkey"], ["v"]).groupBy("change").agg(F.count("*").alias("n"))


_DIFF = """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'delete' WHEN 2 THEN 'insert' ELSE CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'Z' THEN 'update' ELSE 'same' END END AS change, count(*) AS n FROM orders GROUP BY 1"""


def customer_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.table(spark, sf_dir, "customer").select(c("c_nationkey").cast("string").alias("customer"), F.when(c("c_custkey") % 2 == 0, "Commercial").otherwise("Medicare").alias("product"), c("c_mktsegment").alias("plan"))
    return s.plans_of(m, "Commercial").select("customer", F.array_join("plans", ",").alias("plans"))


QUERIES = {
    "first_missing_line": (first_missing_line, _FIRST),
    "step_gaps": (step_gaps, "SELECT * FROM (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE next - l_linenumber > 1"),
    "sibling_pairs": (sibling_pairs, "SELECT * FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL"),
    "carry_forward": (carry_forward, "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS label FROM events"),
    "page_fill": (page_fill, "SELECT event_id, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS page FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_id % 50 END AS p FROM events)"),
    "table_runs": (table_runs, "SELECT event_id, sum((event_id % 5 = 0)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM events"),
    "row_chunks": (row_chunks, "SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 6)::INTEGER AS chunk FROM events"),
    "budget_topk": (budget_topk, "SELECT o_custkey, o_orderkey, spent::BIGINT AS spent FROM (SELECT *, sum(o_orderkey % 400 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 13 DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 13 DESC, o_orderkey) AS n FROM orders) WHERE spent <= 900 OR n = 1"),
    "char_budget_batches": (char_budget_batches, _BATCH),
    "code_best_confidence": (code_best_confidence, "SELECT code, system, confidence, event_id FROM (SELECT *, row_number() OVER (PARTITION BY code, system ORDER BY confidence DESC, event_id) AS n FROM (SELECT user_id % 40 AS code, event_type AS system, round(value, 1) AS confidence, event_id FROM events)) WHERE n = 1"),
    "sop_first_seen": (sop_first_seen, "SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY at1)::INTEGER AS rank FROM (SELECT user_id, event_type, min(event_id) AS at1 FROM events GROUP BY ALL)"),
    "renumbered_steps": (renumbered_steps, _RENUM),
    "content_dedupe": (content_dedupe, "SELECT min(doc_id) AS doc_id, left(sha256(text), 16) AS content_hash FROM documents GROUP BY text"),
    "ordered_code_merge": (ordered_code_merge, "SELECT l_orderkey, string_agg(code, ',' ORDER BY pos) AS codes FROM (SELECT l_orderkey, 'E' || (l_partkey % 9) AS code, min(l_partkey * 1000 + l_linenumber) AS pos FROM lineitem GROUP BY ALL) GROUP BY 1"),
    "checklist_missing": (checklist_missing, _CHECK),
    "rebuild_diff": (rebuild_diff, _DIFF),
    "customer_plans": (customer_plans, "SELECT c_nationkey::VARCHAR AS customer, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS plans FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1"),
}
