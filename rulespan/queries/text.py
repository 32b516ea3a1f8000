"""Scalar functions over phrases, codes, links and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions import decisions as d
from rulespan.functions import extract as x
from rulespan.functions import values as v
from rulespan.queries import fixtures as fx

P = fx.PHRASED_SQL
T = "coalesce(phrase, '')"
c = F.col


def _has(text: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def classify_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.phrased(spark, sf_dir).select("o_orderkey", d.classify_decision(c("phrase")).alias("decision_type"))


_U = f"regexp_replace(upper({T}), '[-_]+', ' ', 'g')"
_CLASSIFY = f"""CASE WHEN {_has(_U, 'CDD', 'DENY', 'DENIAL', 'DENIED')} THEN 'DENY' WHEN {_has(_U, 'BYPASS', 'OVERRIDE')} THEN 'BYPASS'
  WHEN {_has(_U, 'PEND')} THEN 'PEND' WHEN {_has(_U, 'WAIVE')} THEN 'WAIVE'
  WHEN regexp_matches({_U}, '\\bALLOW\\b') OR ({_has(_U, 'PROCESS')} AND {_has(_U, 'F3')}) THEN 'ALLOW'
  WHEN {_has(_U, 'REFERRAL')} OR ({_has(_U, 'REFER')} AND {_has(_U, *d.REVIEWERS)}) THEN 'REFER'
  WHEN {_has(_U, 'STOP')} AND NOT {_has(_U, 'OUT OF SCOPE')} THEN 'STOP' ELSE 'CONDITIONAL' END"""


def classify_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("phrase")
    return fx.phrased(spark, sf_dir).select(
        "o_orderkey",
        d.classify_decision_document(p).alias("by_document"),
        d.classify_decision_flat(p, x.denial_codes(p)).alias("by_writer"),
        d.classify_precondition(F.when(c("o_orderkey") % 7 == 0, "waive"), c("o_orderkey") % 11 == 0, p, F.lit("when eligible")).alias("by_section"),
    )


_L, _UP, _UPC = f"lower({T})", f"upper({T})", f"upper({T} || ' when eligible')"
_VARIANTS = f"""SELECT o_orderkey,
  CASE WHEN {_has(_L, 'deny', 'denial', 'zero out', 'reduce to 0')} THEN 'DENY' WHEN {_has(_L, 'bypass')} THEN 'BYPASS' WHEN {_has(_L, 'allow')} THEN 'ALLOW'
    WHEN {_has(_L, 'pend', 'f5')} THEN 'PEND' WHEN {_has(_L, 'waive')} THEN 'WAIVE' WHEN {_has(_L, 'refer to', 'follow the', 'proceed to', 'skip to')} THEN 'REFER'
    WHEN {_has(_L, 'does not apply', 'this p&p')} THEN 'STOP' WHEN {_has(_L, '(f3)', '(f4)', 'process the claim', 'save the claim')} THEN 'SYSTEM' ELSE 'CONDITIONAL' END AS by_document,
  CASE WHEN {_has(_UP, 'CDD', 'DENY', 'DENIAL')} THEN 'DENY' WHEN {_has(_UP, 'BYPASS', 'OVERRIDE')} THEN 'BYPASS' WHEN {_has(_UP, 'PEND')} THEN 'PEND'
    WHEN {_has(_UP, 'ALLOW')} OR ({_has(_UP, 'PROCESS')} AND {_has(_UP, 'F3')}) THEN 'ALLOW' WHEN {_has(_UP, 'WAIVE')} THEN 'WAIVE' WHEN {_has(_UP, 'STOP', 'DO NOT')} THEN 'STOP' ELSE 'CONDITIONAL' END AS by_writer,
  CASE WHEN o_orderkey % 7 = 0 THEN 'WAIVE' WHEN o_orderkey % 11 = 0 THEN 'OVERRIDE' WHEN {_has(_UPC, 'DENY')} THEN 'DENY' WHEN {_has(_UPC, 'ALLOW')} THEN 'ALLOW'
    WHEN {_has(_UPC, 'BYPASS', 'OVERRIDE')} THEN 'BYPASS' WHEN {_has(_UPC, 'PEND')} THEN 'PEND' WHEN {_has(_UPC, 'WAIVE')} THEN 'WAIVE' ELSE 'NOTE' END AS by_section FROM {P}"""


def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("phrase")
    parts = {"eob": x.eob_codes(p), "ex": x.ex_codes(p), "denial": x.denial_codes(p), "sysact": x.system_codes(p), "document": x.document_codes(p)}
    return fx.phrased(spark, sf_dir).select("o_orderkey", *(F.array_join(e, ",").alias(n) for n, e in parts.items()))


def _once(items: str) -> str:
    """First occurrences of a list, in order, joined."""
    return f"array_to_string(list_filter({items}, lambda e, i: list_position({items}, e) = i), ',')"


_EX = f"regexp_extract_all(array_to_string(regexp_extract_all({_UP}, '{x.EX_GROUP}', 1), '/'), '([0-9]{{3}})', 1)"
_CODES = f"""SELECT o_orderkey, {_once(f"regexp_extract_all({_UP}, '{x.EOB}', 1)")} AS eob, {_once(_EX)} AS ex,
  CASE WHEN contains({_UP}, 'CDD') THEN 'CDD' ELSE '' END AS denial, {_once(f"list_transform(regexp_extract_all({_UP}, '{x.SYSTEM}', 1), lambda n: 'F' || n)")} AS sysact,
  {_once(f"list_transform(regexp_extract_all({T}, '{x.DOCUMENT_CODE}', 0), lambda m: regexp_replace(m, '^EX\\s*[Cc]ode\\s+', ''))")} AS document FROM {P}"""


def extract_gotos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("phrase")
    op = F.when(c("o_orderkey") % 5 == 0, "goto").when(c("o_orderkey") % 5 == 1, "next")
    step = F.when(c("o_orderkey") % 10 == 0, F.lit(3))
    return fx.phrased(spark, sf_dir).select(
        "o_orderkey",
        x.first_goto(p).alias("first_goto"),
        F.array_join(F.transform(x.all_gotos(p), lambda n: n.cast("string")), ",").alias("all_gotos"),
        x.resolve_goto(p, op, step, (c("o_orderkey") % 4).cast("int")).alias("resolved"),
    )


_FIRST = f"coalesce(nullif(regexp_extract({T}, '{x.GOTO_VERB}', 1), ''), nullif(regexp_extract({T}, '{x.GOTO_DIRECTLY}', 1), ''))::INTEGER"
_BOTH = f"list_concat(regexp_extract_all({T}, '{x.GOTO_VERB}', 1), regexp_extract_all({T}, '{x.GOTO_DIRECTLY}', 1))"
_GOTOS = f"""SELECT o_orderkey, {_FIRST} AS first_goto, {_once(_BOTH)} AS all_gotos,
  coalesce(CASE WHEN o_orderkey % 10 = 0 THEN 3 END, {_FIRST}, CASE WHEN o_orderkey % 4 >= 1 AND (o_orderkey % 5 = 1 OR regexp_matches({T}, '{x.NEXT_STEP}')) THEN o_orderkey % 4 + 1 END)::INTEGER AS resolved FROM {P}"""


def scope_and_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("phrase")
    rule = F.element_at(F.array(*map(F.lit, ("applicable_only", "any_clean", "xor_one", "first_match", "always_met", "", "other"))), (c("o_orderkey") % 7 + 1).cast("int"))
    return fx.phrased(spark, sf_dir).select("o_orderkey", d.is_out_of_scope(p, F.lit("x")).alias("out_of_scope"), d.infer_aggregation(p, c("o_orderkey") % 3 > 0).alias("inferred"), d.map_aggregation(rule).alias("mapped"))


_SCOPE = f"""SELECT o_orderkey, {_has(_L, *d.OUT_OF_SCOPE_PHRASES)} AS out_of_scope,
  CASE WHEN o_orderkey % 3 = 0 THEN 'LEAF' WHEN {_has(_L, 'any pair', 'any of the above')} THEN 'ANY' WHEN {_has(_L, 'only one subrule', 'exactly one')} THEN 'XOR_ONE'
    WHEN {_has(_L, 'always')} AND {_has(_L, 'met')} THEN 'ALWAYS_MET' ELSE 'FIRST_MATCH' END AS inferred,
  ['APPLICABLE_ONLY', 'ANY', 'XOR_ONE', 'FIRST_MATCH', 'ALWAYS_MET', NULL, NULL][o_orderkey % 7 + 1] AS mapped FROM {P}"""

_CODE = "CASE p_partkey % 9 WHEN 0 THEN 'e' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') WHEN 1 THEN lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') WHEN 2 THEN 'CDS' WHEN 3 THEN 'F7' WHEN 4 THEN ' 11 ' WHEN 5 THEN '0450' WHEN 6 THEN 'H2019' WHEN 7 THEN '99213' ELSE 'zz' END"
_RAW = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey % 9000 AS STRING) WHEN 1 THEN '99213' WHEN 2 THEN '9921325' WHEN 3 THEN 'H2019' ELSE ' 992145 ' END"


def code_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_CODE} AS code", f"{_RAW} AS raw")
    return parts.select("p_partkey", x.code_type(c("code")).alias("code_type"), x.cpt_base(c("raw")).alias("base"), F.array_join(x.cpt_modifiers(c("raw")), ",").alias("modifiers"))


_TYPES = f"""SELECT p_partkey, CASE WHEN regexp_matches(code, '^[EFW][0-9]{{2}}$') THEN 'EOB' WHEN regexp_matches(code, '^[0-9]{{3}}$') THEN 'EX' WHEN code IN ('CDD', 'CDS', 'CDA') THEN 'DENIAL'
    WHEN regexp_matches(code, '^F[3-9]$') THEN 'SYSTEM_ACT' WHEN regexp_matches(code, '^[0-9]{{2}}$') THEN 'POS' WHEN regexp_matches(code, '^[0-9]{{4}}$') THEN 'REVENUE'
    WHEN regexp_matches(code, '^([A-Z][0-9]{{4}}|[0-9]{{5}})$') THEN 'CPT' ELSE 'UNKNOWN' END AS code_type,
  CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN CASE WHEN length(raw) >= 5 THEN substr(raw, 1, 5) ELSE lpad(raw, 5, '0') END ELSE raw END AS base,
  CASE WHEN regexp_matches(raw, '^[0-9]{{6,}}$') THEN right(raw, 2) ELSE '' END AS modifiers
FROM (SELECT p_partkey, upper(trim({_CODE})) AS code, trim({_RAW}) AS raw FROM part)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("phrase")
    period = x.limit_period(p)
    return fx.phrased(spark, sf_dir).select(
        "o_orderkey",
        F.array_join(x.modifier_tokens(p), ",").alias("modifiers"),
        F.array_join(x.token_set(p), " ").alias("tokens"),
        x.approximate_tokens(p).alias("approx_tokens"),
        x.looks_like_reference(p).alias("is_reference"),
        period["n"].alias("period"),
        period["unit"].alias("unit"),
        v.clean_name(p).alias("name"),
        v.shorten(p, 20).alias("short"),
        v.line_of_business(p, F.lit("plan"), F.lit("Commercial")).alias("lob"),
    )


_TOKENS = f"""SELECT o_orderkey,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({T}, '([A-Za-z0-9]+)', 1), lambda t: upper(t)), lambda t: regexp_matches(t, '^([0-9]{{2}}|[A-Z]{{2}})$')))), ',') AS modifiers,
  array_to_string(list_sort(list_distinct(regexp_extract_all({_L}, '([a-z0-9]{{3,}})', 1))), ' ') AS tokens, (length({T}) // 3 + 1)::INTEGER AS approx_tokens,
  len(regexp_extract_all({T}, '\\S+')) >= 3 AND regexp_matches({T}, '{x.DOCUMENT_WORDS}') AS is_reference,
  nullif(regexp_extract({T}, '{x.PERIOD}', 1), '')::INTEGER AS period,
  CASE WHEN regexp_extract({T}, '{x.PERIOD}', 1) <> '' THEN regexp_replace(lower(regexp_extract({T}, '{x.PERIOD}', 2)), 's$', '') || 's' END AS unit,
  trim(upper(regexp_replace(regexp_replace({T}, '(?is)(\\$|[0-9]|\\bHMO\\b).*$', ''), '[^A-Za-z ]', '', 'g'))) AS name,
  CASE WHEN length(trim({T})) <= 20 THEN trim({T}) ELSE rtrim(substr(trim({T}), 1, 20)) || '…' END AS short,
  CASE WHEN {_has(_L, 'medicare')} THEN 'Medicare' WHEN {_has(_L, 'medicaid')} THEN 'Medicaid' ELSE 'Commercial' END AS lob FROM {P}"""

_WORDS = fx.Rows("k int, word string", list(enumerate(["Met", " matched ", "not met", "NOT_MET", "fail", "Skip", "skipped", "unknown", "N/A", "odd", "", None, "DENY", "pended", "allow", "Pass", "INCONCLUSIVE", "approved"])))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"cast(o_orderkey % {len(_WORDS.rows)} as int) as k")
    w = c("word")
    codes = F.when(c("o_orderkey") % 4 == 0, F.array(F.lit("E1"))).otherwise(F.array().cast("array<string>"))
    k = c("o_orderkey")
    return orders.join(_WORDS.spark(spark), "k").select(
        "o_orderkey",
        d.rule_status(w).alias("rule_status"),
        d.audit_status(w).alias("audit_status"),
        d.decision_status(w).alias("decision_status"),
        d.evaluation_status(k % 9 == 0, k % 5 == 0, codes, w, k % 2 == 0, F.when(k % 3 == 0, "deny").otherwise("ALLOW")).alias("evaluation"),
    )


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in values)


_RS = f"""CASE WHEN s IN ('skipped', 'skip') THEN 'Skipped' WHEN s IN ({_in(d.MET_TOKENS)}) THEN 'Met' WHEN s IN ({_in(d.NOT_MET_TOKENS)}) THEN 'Not-Met' WHEN s IN ({_in(d.INCONCLUSIVE_TOKENS)}) THEN 'Inconclusive' ELSE '' END"""
_STATUSES = f"""SELECT o_orderkey, r AS rule_status, CASE r WHEN 'Met' THEN 'CLEAN' WHEN 'Not-Met' THEN 'DEFECT' WHEN 'Skipped' THEN '' ELSE 'INCONCLUSIVE' END AS audit_status,
  CASE WHEN u IN ({_in(d.ADVERSE)}) THEN 'DEFECT' WHEN u IN ({_in(d.CLEAN_TYPES)}) THEN 'CLEAN' WHEN u = 'INCONCLUSIVE' THEN 'INCONCLUSIVE' ELSE '' END AS decision_status,
  CASE WHEN o_orderkey % 9 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0) THEN 'Skipped' WHEN r <> '' THEN r WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'Not-Met'
    WHEN o_orderkey % 2 = 0 THEN 'Met' ELSE 'Inconclusive' END AS evaluation
FROM (SELECT *, {_RS} AS r FROM (SELECT o_orderkey, regexp_replace(lower(trim(coalesce(word, ''))), '[_ ]', '-', 'g') AS s, upper(trim(coalesce(word, ''))) AS u
  FROM orders JOIN {_WORDS.sql()} w ON w.k = o_orderkey % {len(_WORDS.rows)}))"""

_URLX = "CASE page_id % 7 WHEN 0 THEN url || '.pdf' WHEN 1 THEN '#part' WHEN 2 THEN '#' WHEN 3 THEN 'files/a.DOCX?x=1' WHEN 4 THEN url WHEN 5 THEN '/b.xls#s' ELSE '' END"
_TYPEX = "CASE page_id % 4 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/pdf' ELSE 'x/y' END"


def link_and_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages").selectExpr("page_id", "url", "html", f"{_URLX} AS href", f"{_TYPEX} AS content_type")
    return pages.select(
        "page_id",
        v.link_type(c("href")).alias("link_type"),
        v.detect_format(c("content_type"), c("href"), F.encode("html", "UTF-8")).alias("format"),
        v.normalise_url(c("url")).alias("plain_url"),
        v.with_scheme(c("href")).alias("full_href"),
        v.block_id(c("html")).alias("block_id"),
        v.content_hash(F.encode("html", "UTF-8")).alias("content_hash"),
        v.endpoint_key(F.lit("get"), c("url")).alias("endpoint_key"),
    )


_EXT = "lower(regexp_extract(regexp_replace(regexp_replace(href, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[^/.](\\.[A-Za-z0-9]+)$', 1))"
_EXTF = f"CASE {_EXT} WHEN '.html' THEN 'HTML' WHEN '.htm' THEN 'HTML' WHEN '.docx' THEN 'DOCX' WHEN '.doc' THEN 'DOCX' WHEN '.xlsx' THEN 'XLSX' WHEN '.xls' THEN 'XLSX' WHEN '.pdf' THEN 'PDF' END"
_LINKS = f"""SELECT page_id, CASE WHEN href IN ('', '#') THEN 'UNRESOLVED' WHEN starts_with(href, '#') THEN 'INTERNAL_ANCHOR' WHEN coalesce({_EXTF}, 'HTML') = 'HTML' THEN 'HTML_SOP' ELSE {_EXTF} END AS link_type,
  coalesce(CASE content_type WHEN 'Text/HTML; charset=utf-8' THEN 'HTML' WHEN 'application/pdf' THEN 'PDF' END, {_EXTF}, CASE WHEN starts_with(lower(html), '<!doctype') OR starts_with(lower(html), '<html') THEN 'HTML' ELSE 'UNKNOWN' END) AS format,
  regexp_replace(split_part(url, '#', 1), '/+$', '') AS plain_url, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^(https?://|file://|/)') THEN href ELSE 'https://' || href END AS full_href,
  'html-' || left(sha1(html), 12) AS block_id, left(sha256(html), 16) AS content_hash, left(sha256('GET ' || url), 32) AS endpoint_key
FROM (SELECT *, {_URLX} AS href, {_TYPEX} AS content_type FROM pages)"""

_MONEYX = "CASE l_linenumber % 5 WHEN 0 THEN '.5' WHEN 1 THEN CAST(l_linenumber AS STRING) || '.25' WHEN 2 THEN 'abc' WHEN 3 THEN '$1,234.50' ELSE '-7' END"


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_MONEYX} AS raw")
    return lines.select("l_orderkey", "l_linenumber", v.money(c("raw")).alias("amount"), v.whole_number(c("raw")).alias("whole"), v.is_npi(F.lpad(c("l_orderkey").cast("string"), 10, "1")).alias("npi"), v.digits(c("raw")).alias("digits")).groupBy("l_linenumber", "amount", "whole", "npi", "digits").agg(F.count("*").alias("n"))


_AMOUNTS = f"""SELECT l_linenumber, amount, whole, npi, digits, count(*) AS n FROM (
  SELECT l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 0.5 WHEN 1 THEN l_linenumber + 0.25 WHEN 2 THEN NULL WHEN 3 THEN 1234.5 ELSE -7.0 END::DOUBLE AS amount,
    CASE l_linenumber % 5 WHEN 4 THEN -7 END::INTEGER AS whole, TRUE AS npi, regexp_replace({_MONEYX}, '[^0-9]', '', 'g') AS digits FROM lineitem) GROUP BY ALL"""

_DATEX = "CASE o_orderkey % 4 WHEN 0 THEN '1995-03-17' WHEN 1 THEN '03/17/2030' WHEN 2 THEN 'soon' ELSE '1995-3-17' END"


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate", f"{_DATEX} AS raw")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    ms = (c("o_orderkey") * 977).cast("long")
    return o.select(
        "o_orderkey",
        v.parse_date(c("raw")).cast("string").alias("day"),
        v.iso_text(c("o_orderdate")).alias("iso"),
        v.clock_text(c("o_orderdate")).alias("clock"),
        v.duration_text(ms).alias("duration"),
        v.minutes_between(c("o_orderdate"), c("o_orderdate") + F.expr("make_interval(0,0,0,0,0,o_orderkey % 90,0)"), 2).alias("minutes"),
        v.opt_out_status(c("raw"), now).alias("opt_out"),
    )


_DATES = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '1995-03-17' END AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%I:%M:%S %p') AS clock,
  CASE WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration, (o_orderkey % 90)::DOUBLE AS minutes,
  CASE o_orderkey % 4 WHEN 0 THEN 'No (Expired)' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Unknown' ELSE 'No (Expired)' END AS opt_out
FROM (SELECT *, (o_orderkey * 977) // 1000 AS s FROM orders)"""

QUERIES = {
    "classify_decision": (classify_decision, f"SELECT o_orderkey, {_CLASSIFY} AS decision_type FROM {P}"),
    "classify_variants": (classify_variants, _VARIANTS),
    "extract_codes": (extract_codes, _CODES),
    "extract_gotos": (extract_gotos, _GOTOS),
    "scope_and_aggregation": (scope_and_aggregation, _SCOPE),
    "code_types": (code_types, _TYPES),
    "text_tokens": (tokens, _TOKENS),
    "status_words": (statuses, _STATUSES),
    "link_and_format": (link_and_format, _LINKS),
    "amounts": (amounts, _AMOUNTS),
    "dates": (dates, _DATES),
}
