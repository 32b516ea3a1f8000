"""The document graph over customers as documents, orders as steps and lines as rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import docgraph
from rulespan.queries import fixtures as fx

c = F.col


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m, o, l, e = (fx.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "events"))
    sop = lambda k: F.when(k % 50 > 0, F.concat(F.lit("s"), k.cast("string"))).otherwise("")
    k, n = c("c_custkey"), (c("o_orderkey") % 8)
    documents = m.filter("c_custkey % 7 > 0").select(sop(k).alias("sop_id"), c("c_name").alias("title"), k.alias("seq"))
    sections = m.select(sop(k).alias("sop_id"), F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("place"), c("c_mktsegment").alias("name"), k.alias("seq"))
    steps = o.select(sop(c("o_custkey")).alias("sop_id"), n.alias("number"), c("o_orderpriority").alias("question"), c("o_orderkey").alias("seq"))
    rows = l.select("l_orderkey", "l_linenumber", "l_returnflag").join(o.select(c("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rules = rows.groupBy("l_orderkey", "l_linenumber", "o_custkey").agg(F.min("l_returnflag").alias("f")).select(sop(c("o_custkey")).alias("sop_id"), (c("l_orderkey") % 8).alias("number"), c("l_linenumber").alias("row_index"), F.when(c("f") != "N", c("f")).alias("decision"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"))
    notes = e.select(sop(c("user_id")).alias("sop_id"), (c("event_id") % 9).alias("number"), F.concat(F.lit("note "), c("event_id") % 300).alias("text"), c("event_type").alias("annotation_type"), c("event_id").alias("seq"))
    codes = e.select(sop(c("user_id")).alias("sop_id"), F.lit("EOB").alias("code_system"), F.concat(F.lit("E"), c("event_id") % 60).alias("raw_value"), c("event_id").alias("seq"))
    limits = m.select(sop(k).alias("sop_id"), F.concat(F.lit("g"), k % 4).alias("group_name"), F.when(k % 2 == 0, "IN").alias("network_type"), k.alias("seq"))
    return docgraph.document_graph(documents, sections, steps, rules, notes, codes, limits)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[0]


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1]


_PARTS = """d AS (SELECT 's' || c_custkey AS key, c_name AS label FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 50 > 0),
p AS (SELECT 's' || c_custkey AS sop, 's' || c_custkey || ':pre:' || i AS key, i, c_mktsegment AS label FROM (SELECT *, unnest(range(0, c_custkey % 3 + 1)) AS i FROM customer) WHERE c_custkey % 50 > 0),
s AS (SELECT 's' || o_custkey AS sop, 's' || o_custkey || ':step:' || (o_orderkey % 8) AS key, o_orderkey % 8 AS i, arg_max(o_orderpriority, o_orderkey) AS label FROM orders WHERE o_custkey % 50 > 0 GROUP BY 1, 2, 3),
r0 AS (SELECT o_custkey AS ck, l_orderkey AS k, l_linenumber AS i, min(l_returnflag) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 50 > 0 GROUP BY ALL),
r AS (SELECT 's' || ck || ':step:' || (k % 8) AS step, 's' || ck || ':step:' || (k % 8) || ':rule:' || i AS key, i, arg_max(CASE WHEN f <> 'N' THEN f ELSE 'CONDITIONAL' END, k) AS label FROM r0 GROUP BY 1, 2, 3),
e AS (SELECT *, 's' || user_id AS sop FROM events WHERE user_id % 50 > 0)"""
_NODES = f"""WITH {_PARTS} SELECT key, 'DOCUMENT' AS type, label FROM d UNION ALL SELECT key, 'PRE_SECTION', label FROM p UNION ALL SELECT key, 'STEP', label FROM s UNION ALL SELECT key, 'RULE', label FROM r
UNION ALL SELECT 'ann:note ' || (event_id % 300), 'ANNOTATION', arg_max(event_type, event_id) FROM e GROUP BY 1 UNION ALL SELECT DISTINCT 'code:EOB:E' || (event_id % 60), 'CODE_REF', 'E' || (event_id % 60) FROM e
UNION ALL SELECT 's' || c_custkey || ':gr:g' || (c_custkey % 4) || ':' || CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE '' END, 'GROUP_LIMIT', CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE 'BOTH' END FROM customer WHERE c_custkey % 50 > 0"""
_LINKS = f"""WITH {_PARTS}, x AS (SELECT sop AS source, key AS target, 'HAS_PRE_SECTION' AS rel, i AS place FROM p UNION ALL SELECT sop, key, 'HAS_STEP', i FROM s UNION ALL SELECT step, key, 'HAS_RULE', i FROM r
  UNION ALL SELECT DISTINCT sop || ':step:' || (event_id % 9), 'ann:note ' || (event_id % 300), 'ANNOTATED_BY', NULL FROM e UNION ALL SELECT DISTINCT sop, 'code:EOB:E' || (event_id % 60), 'USES_CODE', NULL FROM e
  UNION ALL SELECT 's' || c_custkey, 's' || c_custkey || ':gr:g' || (c_custkey % 4) || ':' || CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE '' END, 'HAS_GROUP_RULE', NULL FROM customer WHERE c_custkey % 50 > 0)
SELECT source, target, rel, place::INTEGER AS place FROM x WHERE source IN (SELECT key FROM d) OR source IN (SELECT key FROM s)"""

QUERIES = {"document_nodes": (graph_nodes, _NODES), "document_links": (graph_links, _LINKS)}
