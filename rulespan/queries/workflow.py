"""Canvas bindings, copies, semantic edges, providers and leaf rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import workflow as w
from rulespan.plans import ir
from rulespan.queries import fixtures as fx

c = F.col
#: A customer's shape as JSON text: three rules and two tools; both engines read it.
_PROPS = """concat('{"sop_rules": [{"key": "step:', c_custkey % 90, ':1:0", "condition": "c', c_custkey, '", "manual_out_of_scope": ', CASE WHEN c_custkey % 4 = 0 THEN 'true' ELSE 'false' END, '}, {"key": "", "sop_id": 1}, {"key": "custom:', c_custkey, '", "sop_id": ', c_custkey % 7, ', "action": "a"}], "tool_calls": [{"name": "t', c_custkey % 5, '", "rule_key": "step:', c_custkey % 90, ':1:0", "args_template": {"k": "v"}}, {"name": "t1", "for_rule_key": "gone"}]}')"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS shape_id", f"{_PROPS} AS properties")


def bound_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sops = fx.table(spark, sf_dir, "customer").select((c("c_custkey") % 80 + 1).cast("int").alias("sop_id"))
    return w.rule_bindings(shapes(spark, sf_dir), sops)


_BOUND = """SELECT c_custkey AS shape_id, 0 AS ordering, 'step:' || (c_custkey % 90) || ':1:0' AS rule_key, (c_custkey % 90)::INTEGER AS sop_id, 'c' || c_custkey AS condition, '' AS action, c_custkey % 4 = 0 AS manual FROM customer WHERE c_custkey % 90 BETWEEN 1 AND 80
UNION ALL SELECT c_custkey, 2, 'custom:' || c_custkey, (c_custkey % 7)::INTEGER, '', 'a', FALSE FROM customer WHERE c_custkey % 7 > 0"""


def bound_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "name string")
    return w.tool_bindings(shapes(spark, sf_dir), tools, bound_rules(spark, sf_dir))


_TOOLS = """SELECT c_custkey AS shape_id, 0 AS ordering, 't' || (c_custkey % 5) AS name, CASE WHEN c_custkey % 90 BETWEEN 1 AND 80 THEN 'step:' || (c_custkey % 90) || ':1:0' END AS rule_key, '{"k":"v"}' AS args FROM customer WHERE c_custkey % 5 BETWEEN 1 AND 3
UNION ALL SELECT c_custkey, 1, 't1', NULL, '{}' FROM customer"""


def workflow_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, o = fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "orders")
    all_shapes = m.select((c("c_custkey") % 20).cast("string").alias("workflow_id"), c("c_custkey").cast("string").alias("shape_id"), c("c_mktsegment").alias("label"))
    ways = o.select(c("o_custkey").cast("string").alias("source_shape"), (c("o_custkey") + (c("o_orderkey") % 3) * 10).cast("string").alias("target_shape"), c("o_orderkey").alias("label"))
    copied, edges = w.duplicate_workflow(all_shapes, ways, "3", "copy")
    return copied.select(F.lit("shape").alias("kind"), c("shape_id").alias("a"), F.lit(None).cast("string").alias("b"), "label").union(edges.select(F.lit("edge"), "source_shape", "target_shape", c("label").cast("string")))


_ID = "left(sha256('copy/' || {}), 32)".format
_COPY = f"""SELECT 'shape' AS kind, {_ID("c_custkey")} AS a, NULL::VARCHAR AS b, c_mktsegment AS label FROM customer WHERE c_custkey % 20 = 3
UNION ALL SELECT 'edge', {_ID("o_custkey")}, {_ID("(o_custkey + o_orderkey % 3 * 10)")}, o_orderkey::VARCHAR FROM orders WHERE o_custkey % 20 = 3 AND o_orderkey % 3 IN (0, 2) AND o_custkey + o_orderkey % 3 * 10 IN (SELECT c_custkey FROM customer)"""


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    nodes = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("key"), (c("c_custkey") % 3).alias("sop_id"))
    rel = F.element_at(F.array(*map(F.lit, (*w.SEMANTIC, "HAS_STEP", "GOTO"))), (k % 8 + 1).cast("int"))
    return w.semantic_edges(nodes, fx.table(spark, sf_dir, "orders").select(c("o_custkey").alias("source"), (k % 1000).alias("target"), rel.alias("rel")))


_SEMANTIC = f"SELECT a.c_custkey % 3 AS sop_id, o_custkey AS source, {list(w.SEMANTIC)}[o_orderkey % 8 + 1] AS rel, o_orderkey % 1000 AS target FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_orderkey % 1000 WHERE o_orderkey % 8 < 6 AND a.c_custkey % 3 = b.c_custkey % 3"


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("string")
    kind = F.when(c("s_suppkey") % 2 == 0, "NPI-1").otherwise("NPI-2")
    body = F.concat(F.lit('{"number": "'), k, F.lit('", "enumeration_type": "'), kind, F.lit('", "basic": {"first_name": "F'), k, F.lit('", "organization_name": "O'), k, F.lit('"}, "addresses": [{"address_purpose": "LOCATION", "city": "old"}, {"address_purpose": "MAILING", "city": "m"}, {"address_purpose": "LOCATION", "city": "c'), k, F.lit('"}], "taxonomies": [{"code": "x"}, {"code": "p'), k, F.lit('", "primary": true}, {"code": "y", "primary": false}]}'))
    p = w.provider(body)
    return fx.table(spark, sf_dir, "supplier").select(p["npi"].alias("npi"), p["first_name"].alias("first_name"), p["last_name"].alias("last_name"), p["organization_name"].alias("organization_name"), p["practice_address"]["city"].alias("practice"), p["mailing_address"]["city"].alias("mailing"), p["primary_taxonomy"].alias("taxonomy"), F.array_join(p["other_taxonomies"], ",").alias("others"))


_PROVIDERS = """SELECT s_suppkey::VARCHAR AS npi, CASE WHEN s_suppkey % 2 = 0 THEN 'F' || s_suppkey END AS first_name, CASE WHEN s_suppkey % 2 = 0 THEN '' END AS last_name, CASE WHEN s_suppkey % 2 = 1 THEN 'O' || s_suppkey END AS organization_name,
  'c' || s_suppkey AS practice, 'm' AS mailing, 'p' || s_suppkey AS taxonomy, 'x,y' AS others FROM supplier"""


def ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fx.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("node_id"), F.when(c("o_custkey") % 9 > 0, c("o_custkey")).alias("parent_id"), (c("o_orderkey") % 13).alias("ord"))
    return ir.children_first(nodes, c("node_id")).select("parent_id", F.array_join("children", ",").alias("children"))


def leaf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.phrased(spark, sf_dir)
    k = c("o_orderkey")
    rules = p.select(k.cast("string").alias("rule_id"), (k % 9).cast("int").alias("step_number"), F.lit("d").alias("description"), F.array(F.lit("c")).alias("conditions"), F.array(F.coalesce("phrase", F.lit(""))).alias("actions"), F.lit("").alias("output"), (k % 21 == 0).alias("is_out_of_scope"))
    nodes = fx.table(spark, sf_dir, "lineitem").select(c("l_orderkey").cast("string").alias("rule_id")).filter("rule_id like '%3'")
    return ir.plan_leaf_rules(rules, nodes).select("rule_id", "is_out_of_scope", "is_final", "aggregation")


_LEAF = f"""WITH r AS (SELECT o_orderkey AS k, coalesce(phrase, '') AS p FROM {fx.PHRASED_SQL} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 3)),
o AS (SELECT *, k % 21 = 0 OR regexp_matches(lower(p), 'out of scope|out-of-scope|stop further auditing|stop auditing further') AS oos FROM r)
SELECT k::VARCHAR AS rule_id, oos AS is_out_of_scope, oos OR (regexp_matches(upper(p), '\\(?(F[3-5])\\)?\\b') AND regexp_matches(lower(p), 'process the claim|save the claim')) AS is_final, 'LEAF' AS aggregation FROM o"""

QUERIES = {
    "bound_rules": (bound_rules, _BOUND),
    "bound_tools": (bound_tools, _TOOLS),
    "workflow_copy": (workflow_copy, _COPY),
    "semantic_edges": (semantic_edges, _SEMANTIC),
    "providers": (providers, _PROVIDERS),
    "ordered_children": (ordered_children, "SELECT o_custkey AS parent_id, string_agg(o_orderkey, ',' ORDER BY o_orderkey % 13, o_orderkey) AS children FROM orders WHERE o_custkey % 9 > 0 GROUP BY 1"),
    "leaf_rules": (leaf_rules, _LEAF),
}
