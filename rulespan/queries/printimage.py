"""Print-image blocks rendered from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import documents as dc
from rulespan.operators import printimage as p
from rulespan.queries import fixtures as fx
from rulespan.queries.documents import images

c = F.col
#: The head of an image as an expression that both engines read.
_HEAD = """concat('|1 INSUREDS ID NUMBER | HIC# ', CASE WHEN o_orderkey % 3 = 0 THEN concat('h.', o_orderkey, 'AB-1 x') ELSE '' END, ' RTE: R', o_orderkey % 7, ' ATTCH: KEYER: k DT: 1 ID#:  77 | 02/NO
|5 ADDRESS |6 PAT RELATION ', CASE WHEN o_orderkey % 4 > 0 THEN '01/SELF' ELSE 'none' END, ' |7 INSURED ADDRESS
|7C INSURANCE PLAN OR PROGRAM NAME, PAYOR ID AND SPC |
|| nothing here |
|| ', 10000 + o_orderkey % 9000, '   F/COMM  INS   |
|-+', '
|7E INSURANCE ADDRESS |
| left |  PO   BOX ', o_orderkey % 50, ' | x
| left two |    |
| l | CITY | y
|-+
|34 PAY-TO PROVIDER NPI: ', CASE WHEN o_orderkey % 5 > 0 THEN '1234567890 ' ELSE '' END, 'CLRNG HOUSE CLAIM ID: C', o_orderkey, ' |
')"""


def print_image_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = c("content")
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_HEAD} AS content")
    h, y, t = p.header_fields(text), p.payer(text), p.pay_to(text)
    return rows.select("o_orderkey", h["hic"].alias("hic"), h["rte"].alias("rte"), h["attch"].alias("attch"), p.patient_relation(text).alias("relation"), y["payor_id"].alias("payor_id"), y["spc"].alias("spc"), p.insurance_address(text).alias("address"), t["npi"].alias("npi"), t["clearing_house_id"].alias("clearing"))


_HEADS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || 'AB-1' ELSE '' END AS hic, 'R' || (o_orderkey % 7) AS rte, '' AS attch, CASE WHEN o_orderkey % 4 > 0 THEN '01/SELF' END AS relation,
  (10000 + o_orderkey % 9000)::VARCHAR AS payor_id, 'F/COMM INS' AS spc, 'PO BOX ' || (o_orderkey % 50) || ' CITY' AS address, CASE WHEN o_orderkey % 5 > 0 THEN '1234567890' END AS npi, 'C' || o_orderkey AS clearing FROM orders"""


def print_image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("claim_id").cast("string")
    tail = F.concat(F.lit("\n|24M CONTROL|\n| 001 | "), k, F.lit("1 |\n| 002 | "), k, F.lit("2 |\n|24H EPSDT IND | FAMILY |\n| 001 | Y |   |\n| 003 |  | N |\n| 001 | Z |   |"))
    claims = images(spark, sf_dir).withColumn("content", F.concat("content", tail))
    return p.line_extras(dc.service_lines(claims).select("claim_id", "line_no"), claims)


_LINES = """SELECT l_orderkey AS claim_id, n::INTEGER AS line_no, CASE WHEN n <= 2 THEN l_orderkey || '' || n END AS line_item_control_no, CASE WHEN n = 1 THEN 'Z' END AS epsdt_ind, CASE WHEN n = 3 THEN 'N' END AS family_planning_ind
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""

QUERIES = {"print_image_head": (print_image_head, _HEADS), "print_image_lines": (print_image_lines, _LINES)}
