"""Choices, counts and cut-off JSON over orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions import jsontext
from rulespan.operators import summaries as s
from rulespan.queries import fixtures as fx

c = F.col


def primary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    return s.primary_tables(fx.table(spark, sf_dir, "orders").select(c("o_custkey").alias("doc_id"), k.alias("tbl"), (k % 3).alias("first_step"), (k % 11).alias("n_steps")))


_PRIMARY = "SELECT o_custkey AS doc_id, arg_max(o_orderkey, (o_orderkey % 3 = 1)::BIGINT * 1000000000000000 + o_orderkey % 11 * 10000000000000 - o_orderkey) AS tbl, count(*) AS candidates FROM orders GROUP BY 1"
_NAMES = ("Version", "Last updated by", "Date", "Change notes", "Release date", "Owner", "remarks", "x", " by ", "Effective version")


def revision_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    return s.revision_columns(fx.table(spark, sf_dir, "orders").select((c("o_custkey") % 3000).alias("sheet_id"), k.alias("position"), F.element_at(F.array(*map(F.lit, _NAMES)), (k % 10 + 1).cast("int")).alias("name")))


def _best(field: str) -> str:
    words = s.REVISION_COLUMNS[field]
    score = f"CASE WHEN lower(trim(name)) IN ({', '.join(map(repr, words))}) THEN 2 WHEN regexp_matches(lower(trim(name)), '{'|'.join(words)}') THEN 1 END"
    return f"arg_max(name, {score} * 100000000000 - k) FILTER ({score} IS NOT NULL) AS {field}"


_REVISION = f"""SELECT sheet_id, {', '.join(map(_best, s.REVISION_COLUMNS))} FROM (SELECT o_custkey % 3000 AS sheet_id, o_orderkey AS k, {list(_NAMES)}[o_orderkey % 10 + 1] AS name FROM orders) GROUP BY 1"""


def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(k.alias("sop_id"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit(" u"), c("o_custkey") % 500)).alias("url"), F.when(k % 5 > 0, F.concat(F.lit("t"), k % 70)).otherwise("").alias("title"), k.alias("position"))
    return s.latest_documents(rows).select("sop_id")


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").withColumn("sop_id", c("o_custkey"))
    return s.store_counts(fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("sop_id")), o.select("sop_id", (c("o_orderkey") % 4).alias("step_number")), o.select("sop_id", (c("o_orderkey") % 6).alias("rule_key")), o.select("sop_id", c("o_orderstatus").alias("code")))


def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").withColumn("sop_id", c("o_custkey") % 900)
    bound = o.filter("o_orderkey % 40 <> 7").select("sop_id")
    pre = fx.table(spark, sf_dir, "customer").select((c("c_custkey") % 1000).alias("sop_id"), (c("c_custkey") % 3).alias("n_rules"))
    return s.fidelity(bound, o.select("sop_id", ((c("o_orderkey") + c("sop_id")) % 30).alias("step_number")), pre)


_FIDELITY = """WITH o AS (SELECT o_orderkey AS k, o_custkey % 900 AS s FROM orders), b AS (SELECT s, count(*) FILTER (k % 40 <> 7) AS bound, count(*) AS n, bool_or((k + s) % 30 = 0) AS zero FROM o GROUP BY 1), p AS (SELECT c_custkey % 1000 AS s, sum(c_custkey % 3) AS pre FROM customer GROUP BY 1)
SELECT s AS sop_id, coalesce(bound, 0) AS bound, e AS expected, coalesce(bound, 0) = e AS ok FROM (SELECT s, bound, (coalesce(n, 0) + CASE WHEN coalesce(zero, FALSE) THEN 0 ELSE coalesce(pre, 0) END)::BIGINT AS e FROM b FULL JOIN p USING (s))"""


def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey").cast("string")
    cut = F.concat(F.lit('so: {"a": '), k, F.lit(', "nodes": [{"b": '), k, F.lit('}, {"b": 1'))
    lists = F.when(c("o_orderkey") % 2 == 0, '{"x": [1, 2], "y": [10, 20, 30], "z": 5}').otherwise('{"x": [1], "y": [2], "z": "long text, no list"}')
    deep = F.concat(F.lit('{"l": [1, null, "a"], "d": {"k": '), k, F.lit('}, "n": null, "s": "t", "r": [{"CDML_SEQ_NO": '), k, F.lit(', "CDML_FROM_DT": "f", "CDML_TO_DT": "t"}, {"CDML_SEQ_NO": 2, "CDML_FROM_DT": null, "CDML_TO_DT": "t"}]}'))
    aliases = F.create_map(F.lit("b"), F.when(c("o_orderkey") % 3 > 0, k), F.lit("c"), F.lit("last"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", jsontext.salvage_object(cut).alias("kept"), jsontext.dominant_list(lists).alias("dominant"), F.get_json_object(jsontext.flat_details(deep), "$.d").alias("flat_d"), F.get_json_object(jsontext.flat_details(deep), "$.l").alias("flat_l"), F.array_join(jsontext.line_ranges(deep), ",").alias("ranges"), jsontext.first_present(aliases, ("a", "b", "c")).alias("present"))


_MEMBERS = """SELECT o_orderkey, '{"a": ' || o_orderkey || ', "nodes": [{"b": ' || o_orderkey || '}]}' AS kept, CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'x' END AS dominant, '{"k": ' || o_orderkey || '}' AS flat_d, '["1","a"]' AS flat_l,
  o_orderkey || '|f|t' AS ranges, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey::VARCHAR ELSE 'last' END AS present FROM orders"""

QUERIES = {
    "primary_tables": (primary_tables, _PRIMARY),
    "revision_columns": (revision_columns, _REVISION),
    "latest_documents": (latest_documents, "SELECT max(o_orderkey) AS sop_id FROM orders GROUP BY CASE WHEN o_orderkey % 3 = 1 THEN 'u' || (o_custkey % 500) WHEN o_orderkey % 5 > 0 THEN 't' || (o_orderkey % 70) ELSE 'sop:' || o_orderkey END"),
    "store_counts": (store_counts, "SELECT c_custkey AS sop_id, count(DISTINCT o_orderkey % 4) AS steps, count(DISTINCT o_orderkey % 6) AS rules, count(DISTINCT o_orderstatus) AS codes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "fidelity": (fidelity, _FIDELITY),
    "json_members": (json_members, _MEMBERS),
}
