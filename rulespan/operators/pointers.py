"""Chains of references followed to their end, and the tools that a report of
rules names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.sources.staging import stage

c = F.col

# How a report writes rules, references and the lack of a tool,
# and what its tools are called where calls were captured (null: not captured).
RULE_ID = r"(?i)(RULE[-_][0-9][0-9\-]*)"
NO_TOOL = r"(?i)no (additional )?tool used|not specified"
SAME_AS = "same as"
DOCUMENT = r"([\w. ]+\.yaml)"
CAPTURED_NAMES = {
    "facets_get_summary": "facets_get_summary",
    "facets_claim_summary": "facets_get_claim_summary",
    "facets_get_claim_summary": "facets_get_claim_summary",
    "facets_get_member_eligibility": "facets_get_member_eligibility",
    "facets_get_member_info": "facets_get_member_info",
    "facets_get_line_details": "facets_get_line_details",
    "get_claim_line_details": "facets_get_line_details",
    "facets_get_duplicate_claim": "facets_get_duplicate_claim",
    "facet_ext_portal_group_model": "facet_ext_portal_group_model",
    "doc360": "doc360_read_claim_by_fln_dcc",
    "doc360_read_claim_by_fln_dcc": "doc360_read_claim_by_fln_dcc",
    "claim_micro_image_id_to_fln_dcc_doc360_parse": "doc360_read_claim_by_fln_dcc",
    "npi_registry": "npi_registry_lookup",
    "npi_registry_lookup": "npi_registry_lookup",
    "diagnosis_coverage_tool": "cbd_coverage",
    "check_member_address_and_state": "check_member_address_and_state",
    "check_timely_filing_state_date": "check_timely_filing_state_date",
    "check_timely_filing_deadline": "check_timely_filing_deadline",
    "facets_get_provider_details": None,
    "medicare_optout": None,
    "medicare_optout_tool": None,
    "calculate_days_between_dates": None,
    "facet_ext_portal_group_model ": "facet_ext_portal_group_model",
}


def follow(links: DataFrame, key: str = "key", to: str = "to") -> DataFrame:
    """(key, end) of ``links`` (key, to): where the chain from each key ends, that
    is at the first ``to`` which is no key itself; null if it runs into a ring.

    Pointer doubling: every turn each key takes over where its target leads, so
    chains of n links take log n joins.  Keys travel as numbers.  A key n links
    from its end has one n - 1 links from it ahead, so a turn that ends no chain
    is the last: what is left is in a ring or leads into one.  A null ``to``
    ends a chain at once.  Keys must be unique.
    """
    rows = stage(links.select(F.monotonically_increasing_id().alias("id"), c(key).alias("key"), c(to).alias("to")))
    ids = rows.select(c("key").alias("to"), c("id").alias("next"))
    # a key whose target is no key ends its chain; it points to itself
    at = stage(rows.select("id", "to").join(ids, "to", "left").select("id", F.coalesce("next", "id").alias("end"), c("next").isNull().alias("done")))
    n, over = rows.count(), at.filter("done").count()
    while over < n:
        ahead = at.select(c("id").alias("end"), c("end").alias("next"), c("done").alias("ends"))
        moved = stage(at.filter("not done").join(ahead, "end").select("id", c("next").alias("end"), c("ends").alias("done")))
        ended = moved.filter("done").count()
        at = at.filter("done").unionByName(moved)
        if not ended:
            break
        over += ended
    last = at.filter("done").select("id", "end").join(rows.select(c("id").alias("end"), c("to").alias("to")), "end").select("id", "to")
    return rows.select("id", "key").join(last, "id", "left").select("key", c("to").alias("end"))


def report_cells(lines: DataFrame) -> DataFrame:
    """(report, document, rule_id, cell) of the lines (report, ord, line) of mapping
    reports: a line that begins with a dash names a document, lines of a table
    below it a rule and its tools; the last line of a rule counts."""
    named = F.ltrim("line").startswith("-") & (F.regexp_extract("line", DOCUMENT, 1) != "")
    w = Window.partitionBy("report").orderBy("ord")
    rows = lines.withColumn("document", F.last(F.when(named, F.trim(F.regexp_extract("line", DOCUMENT, 1))), True).over(w))
    parts = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), F.trim)
    rows = rows.filter(~named & c("line").startswith("|") & c("document").isNotNull()).withColumn("parts", parts).filter(F.size("parts") >= 2)
    rule = F.replace(F.upper(F.regexp_extract(c("parts")[0], RULE_ID, 1)), F.lit("_"), F.lit("-"))
    rows = rows.withColumn("rule_id", rule).filter("rule_id <> ''")
    return rows.groupBy("report", "document", "rule_id").agg(F.max_by(c("parts")[1], "ord").alias("cell"))


def report_tools(cells: DataFrame) -> DataFrame:
    """(report, document, rule_id, tools) of :func:`report_cells`: the tools that a
    rule's cell lists, or those of the rule that it calls the same.  Rings,
    references to nothing and cells without a tool give an empty list."""
    key = F.struct("report", "document", "rule_id")
    others = F.filter(F.transform(F.regexp_extract_all("cell", F.lit(RULE_ID), F.lit(1)), lambda r: F.replace(F.upper(r), F.lit("_"), F.lit("-"))), lambda r: r != c("rule_id"))
    same = F.lower("cell").contains(SAME_AS)
    clean = lambda t: F.trim(F.regexp_replace(F.trim(t), "^`+|`+$", ""))
    named = F.filter(F.transform(F.split("cell", ","), clean), lambda t: (t != "") & ~t.rlike(NO_TOOL))
    tools = F.when(same | c("cell").rlike(NO_TOOL), F.array().cast("array<string>")).otherwise(named)
    rows = stage(cells.select(key.alias("key"), same.alias("same"), F.get(others, F.lit(0)).alias("other"), tools.alias("tools")))
    links = rows.filter("same").select("key", F.when(c("other").isNotNull(), F.struct(c("key.report"), c("key.document"), c("other").alias("rule_id"))).alias("to"))
    ends = follow(links)
    ended = rows.join(ends, "key", "left").withColumn("at", F.when(c("same"), c("end")).otherwise(c("key")))
    found = rows.filter("not same").select(c("key").alias("at"), c("tools").alias("named"))
    out = ended.join(found, "at", "left")
    return out.select("key.*", F.coalesce("named", F.array().cast("array<string>")).alias("tools"))


def captured_tools(tools: DataFrame, captured: DataFrame) -> DataFrame:
    """(report, document, rule_id, captured, gaps): the report's tools under their
    captured names, once each in order, where calls (name) were captured, and
    the others with the reason."""
    names = F.map_from_arrays(F.array(*map(F.lit, CAPTURED_NAMES)), F.array(*(F.lit(v).cast("string") for v in CAPTURED_NAMES.values())))
    # of what was captured only names that tools map to matter, so they are one short row
    there = captured.filter(c("name").isin(*filter(None, CAPTURED_NAMES.values()))).agg(F.collect_set("name").alias("_there"))
    each = tools.select("report", "document", "rule_id", "tools").crossJoin(F.broadcast(there))
    seen = lambda m: F.array_contains("_there", m)
    mapped = lambda t: F.element_at(names, t)
    gap = lambda t: F.when(~F.map_contains_key(names, t), F.concat(t, F.lit("(unknown)"))).when(mapped(t).isNull(), F.concat(t, F.lit("(no-capture)"))).when(~seen(mapped(t)), F.concat(t, F.lit("->"), mapped(t), F.lit("(not-in-snapshot)")))
    some = lambda listed, keep: F.coalesce(F.filter(listed, keep), F.array().cast("array<string>"))
    known = F.array_distinct(some(F.transform("tools", mapped), seen))
    return each.select("report", "document", "rule_id", known.alias("captured"), some(F.transform("tools", gap), lambda g: g.isNotNull()).alias("gaps"))
