"""Nested JSON and fuzzy names: results of Python readings.  Where the input is
rendered with a known answer, the statement gives that answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions import fuzzy, jsontext
from rulespan.queries import fixtures as fx

c = F.col


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    text = F.concat(F.lit('{"a":{"k":"first","cpt":"99213GT"},"note":null,"list":[{"k":"'), c("o_orderstatus"), F.lit('"},{"k":""}],"npi":"1'), F.lpad(c("o_orderkey").cast("string"), 9, "0"), F.lit('","row_id":5,"fileName":"x.pdf","updatedBy":"me","per":1,"comments":"c","lineComment":"d","GridId":7,"version":2,"audit":"kept","unit":"N/A","PROC_DT":"20240101","processedDate":20240102,"svcSrvCd":"h0031HN"}'))
    return o.select("o_orderkey", text.alias("j"))


def deep_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = c("j")
    return nested(spark, sf_dir).select("o_orderkey", jsontext.find_last_first(j, "k").alias("last_first"), jsontext.find_first(j, "k").alias("first"), F.array_join(jsontext.procedure_codes(j), ",").alias("codes"), F.array_join(jsontext.npi_numbers(j), ",").alias("npi"))


def json_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("o_orderkey", jsontext.prune(c("j")).alias("pruned"))


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    cut = F.concat(F.lit("["), c("props"), F.lit(", "), c("props"), F.lit(', {"k": '))
    prose = F.concat(F.lit("Here it is: ```json\n"), c("props"), F.lit("\n``` done"))
    return e.select("event_id", jsontext.salvage_array(cut).alias("kept"), jsontext.from_prose(prose).alias("found"))


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    names = ["Harbor Behavioral Gold", "Standard Medicare", "Community Medicaid", "Choice Plus Commercial"]
    asked = F.element_at(F.array(*map(F.lit, ("Harbour Behavoral Gold plan $5", "community medicaid HMO west", "zzz", "plus choice", ""))), (c("p_partkey") % 5 + 1).cast("int"))
    m = fuzzy.match_name(asked, names)
    return p.select("p_partkey", m["name"].alias("name"), (m["similarity"] >= 80).alias("close"))


QUERIES = {
    "deep_find": (deep_find, "SELECT o_orderkey, o_orderstatus AS last_first, 'first' AS first, '99213,99213GT,H0031,H0031HN' AS codes, '1' || lpad(o_orderkey::VARCHAR, 9, '0') AS npi FROM orders"),
    "json_prune": (json_prune, """SELECT o_orderkey, '{"PROC_DT": "20240101", "a": {"cpt": "99213GT", "k": "first"}, "audit": "kept", "list": [{"k": "' || o_orderstatus || '"}, {}], "npi": "1' || lpad(o_orderkey::VARCHAR, 9, '0') || '", "processedDate": 20240102, "svcSrvCd": "h0031HN", "version": 2}' AS pruned FROM orders"""),
    "json_salvage": (json_salvage, """SELECT event_id, '[{"k": ' || regexp_extract(props, '([0-9]+)', 1) || '}, {"k": ' || regexp_extract(props, '([0-9]+)', 1) || '}]' AS kept, '{"k": ' || regexp_extract(props, '([0-9]+)', 1) || '}' AS found FROM events"""),
    "fuzzy_match": (fuzzy_match, "SELECT p_partkey, ['Harbor Behavioral Gold', 'Community Medicaid', 'Standard Medicare', 'Choice Plus Commercial', 'Standard Medicare'][p_partkey % 5 + 1] AS name, p_partkey % 5 NOT IN (2, 4) AS close FROM part"),
}
