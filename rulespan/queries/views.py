"""Composed reads over orders as runs and steps, and lines as what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import views as vw
from rulespan.queries import fixtures as fx

c = F.col


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))


_L = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"


def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir)
    runs = fx.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), c("o_orderstatus").alias("status"))
    evaluations = l.select(c("k").alias("run_id"), (8 - c("n")).alias("order_index"), F.concat(F.lit("r"), c("p").cast("string")).alias("rule_key"))
    tools = l.filter("n > 3").select(c("k").alias("run_id"), c("n").alias("call_id"), (c("p") % 2 == 0).alias("ok"))
    out = vw.run_details(runs, evaluations, tools)
    return out.select("run_id", "status", F.to_json("evaluations").alias("evaluations"), F.to_json("tool_invocations").alias("tool_invocations"))


_DETAILS = f"""WITH {_L}, e AS (SELECT k, to_json(list({{'order_index': 8 - n, 'rule_key': 'r' || p}} ORDER BY n DESC))::VARCHAR AS e FROM l GROUP BY k), t AS (SELECT k, to_json(list({{'call_id': n, 'ok': p % 2 = 0}} ORDER BY n))::VARCHAR AS t FROM l WHERE n > 3 GROUP BY k)
SELECT o_orderkey AS run_id, o_orderstatus AS status, coalesce(e, '[]') AS evaluations, coalesce(t, '[]') AS tool_invocations FROM orders LEFT JOIN e ON e.k = o_orderkey LEFT JOIN t ON t.k = o_orderkey"""


def claim_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir)
    headers = fx.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), c("o_custkey").alias("claim_id"))
    agents = l.select(c("k").alias("run_id"), c("n").alias("first_index"), (c("p") % 5).alias("shape_id"))
    phase = F.when(c("n") == 1, "FETCH").when(c("n") == 2, "PARSE").otherwise("EVALUATE")
    tools = l.select(c("k").alias("run_id"), c("n").alias("call_id"), phase.alias("phase"), F.concat(F.lit("t"), c("n").cast("string")).alias("tool_name"), (c("p") % 3 > 0).alias("ok"), c("p").alias("duration_ms"))
    calls = l.filter("n = 7").select(c("k").alias("run_id"), c("n").alias("call_id"), c("p").alias("totalTokens"))
    out = vw.claim_snapshots(headers, agents, tools, calls)
    return out.select("run_id", "claim_id", *(F.to_json(n).alias(n) for n in ("agents", "outerToolInvocations", "llmCalls")))


_SNAPSHOTS = f"""WITH {_L}, a AS (SELECT k, to_json(list({{'first_index': n, 'shape_id': p % 5}} ORDER BY n))::VARCHAR AS a,
  to_json(list({{'call_id': n, 'phase': CASE n WHEN 1 THEN 'FETCH' ELSE 'PARSE' END, 'tool': 't' || n, 'status': CASE WHEN p % 3 > 0 THEN 'completed' ELSE 'failed' END, 'durationMs': p}} ORDER BY n) FILTER (n < 3))::VARCHAR AS t,
  to_json(list({{'call_id': n, 'totalTokens': p}} ORDER BY n) FILTER (n = 7))::VARCHAR AS c FROM l GROUP BY k)
SELECT o_orderkey AS run_id, o_custkey AS claim_id, coalesce(nullif(a, 'null'), '[]') AS agents, coalesce(nullif(t, 'null'), '[]') AS "outerToolInvocations", coalesce(nullif(c, 'null'), '[]') AS "llmCalls" FROM orders LEFT JOIN a ON a.k = o_orderkey"""


def job_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as procedures, their orders as steps, and lines as decisions: each
    hangs below the line three before it, if there is one."""
    l = lines(spark, sf_dir)
    sops = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("sop_id"), c("c_mktsegment").alias("title"))
    o = fx.table(spark, sf_dir, "orders")
    steps = o.select(c("o_custkey").alias("sop_id"), c("o_orderkey").alias("step_id"), c("o_orderkey").alias("step_number"), c("o_orderstatus").alias("question"))
    name = lambda n: F.concat_ws(".", "k", n.cast("string"))
    decisions = l.select(c("k").alias("step_id"), name(c("n")).alias("node_id"), F.when(c("n") > 3, name(c("n") - 3)).alias("parent_id"), c("n").alias("ord"), c("p").alias("rule"))
    codes = o.filter("o_orderkey % 4 = 0").select(c("o_custkey").alias("sop_id"), (c("o_orderkey") % 100).alias("value"))
    out = vw.job_sections(sops, steps, decisions, ["rule"], {"codes": (codes, ["value"])})
    return out.select("sop_id", "title", F.sha2(F.to_json("steps"), 256).alias("steps"), F.to_json("codes").alias("codes"))


_SECTIONS = f"""WITH {_L}, a AS (SELECT k, n, '{{"rule":' || p || ',"children":[]}}' AS d FROM l WHERE n = 7),
b AS (SELECT l.k, l.n, '{{"rule":' || p || ',"children":[' || coalesce(a.d, '') || ']}}' AS d FROM l LEFT JOIN a ON a.k = l.k AND l.n = 4 WHERE l.n BETWEEN 4 AND 6),
t AS (SELECT l.k, l.n, '{{"rule":' || p || ',"children":[' || coalesce(b.d, '') || ']}}' AS d FROM l LEFT JOIN b ON b.k = l.k AND b.n = l.n + 3 WHERE l.n < 4
  UNION ALL SELECT k, n, d FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = x.k AND l.n = x.n - 3)),
d AS (SELECT k, '[' || string_agg(d, ',' ORDER BY n) || ']' AS d FROM t GROUP BY k),
s AS (SELECT o_custkey, '[' || string_agg('{{"step_number":' || o_orderkey || ',"question":"' || o_orderstatus || '","decisions":"' || replace(coalesce(d, '[]'), '"', '\\"') || '"}}', ',' ORDER BY o_orderkey) || ']' AS s,
  '[' || coalesce(string_agg('{{"value":' || (o_orderkey % 100) || '}}', ',' ORDER BY o_orderkey % 100) FILTER (o_orderkey % 4 = 0), '') || ']' AS c FROM orders LEFT JOIN d ON d.k = o_orderkey GROUP BY 1)
SELECT c_custkey AS sop_id, c_mktsegment AS title, sha256(coalesce(s, '[]')) AS steps, coalesce(c, '[]') AS codes FROM customer LEFT JOIN s ON o_custkey = c_custkey"""


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("doc_id"), c("c_name").alias("title"))
    o = fx.table(spark, sf_dir, "orders").select(c("o_custkey").alias("doc_id"), c("o_orderkey").alias("k"))
    rows = lines(spark, sf_dir).join(o, "k")
    return vw.document_summaries(documents, o, rows, rows.filter("n > 5"))


_SUMMARIES = f"""WITH {_L}, r AS (SELECT o_custkey AS d, n FROM l JOIN orders ON o_orderkey = k)
SELECT c_custkey AS doc_id, c_name AS title, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS step_count, (SELECT count(*) FROM r WHERE d = c_custkey) AS rule_count, (SELECT count(*) FROM r WHERE d = c_custkey AND n > 5) AS code_count FROM customer"""

QUERIES = {
    "run_details": (run_details, _DETAILS),
    "claim_snapshots": (claim_snapshots, _SNAPSHOTS),
    "job_sections": (job_sections, _SECTIONS),
    "document_summaries": (document_summaries, _SUMMARIES),
}
