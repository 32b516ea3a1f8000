"""Rows that documents leave behind: annotations, references, dates, logs, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions.values import without_nul

# Kinds of annotations, and words by which one touches a claim.
ANNOTATIONS = ("NOTE", "ALERT", "EXCEPTION", "TIP", "WARNING", "HIGHLIGHT")
IMPACT_WORDS = ("DENY", "BYPASS", "CODE", "PEND", "OVERRIDE", "E51", "F51", "346")


def stored(text: Column, most: int | None = None) -> Column:
    """Text as a column keeps it: no NUL, at most ``most`` characters."""
    clean = without_nul(text)
    return F.substring(clean, 1, most) if most else clean


def _first_of(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(""))


def annotation_rows(rows: DataFrame) -> DataFrame:
    """Annotations (sop_id, type, text, is_claim_impact) to be stored: unknown
    kinds are notes, blank ones go, and a word of weight is an impact."""
    kind = F.upper(stored(_first_of("type"), 16))
    content = stored(_first_of("text"))
    heavy = F.coalesce("is_claim_impact", F.lit(False))
    for word in IMPACT_WORDS:
        heavy = heavy | F.upper(content).contains(word)
    return rows.select("sop_id", F.when(kind.isin(*ANNOTATIONS), kind).otherwise("NOTE").alias("annotation_type"), content.alias("content_text"), heavy.alias("is_claim_impact")).filter("content_text <> ''")


def reference_rows(links: DataFrame) -> DataFrame:
    """Links (sop_id, href, url, link_text, text, link_type, resolved_url, status)
    as references; one is resolved by a resolved address or status OK."""
    kind = F.coalesce(F.nullif("link_type", F.lit("")), F.lit("UNRESOLVED"))
    resolved = (F.coalesce("resolved_url", F.lit("")) != "") | F.coalesce(F.col("status") == "OK", F.lit(False))
    return links.select("sop_id", stored(_first_of("link_text", "text")).alias("ref_text"), stored(_first_of("href", "url")).alias("ref_url"), stored(kind, 32).alias("ref_type"), resolved.alias("is_resolved"))


def date_condition_rows(found: DataFrame) -> DataFrame:
    """Date conditions (sop_id, date_from, date_to, effective_date, context,
    context_text, source_field, applies_to) as they are stored, once each."""
    text = lambda c: stored(F.coalesce(c, F.lit("")), 32).alias(c)
    return found.select("sop_id", text("date_from"), text("date_to"), text("effective_date"), stored(_first_of("context", "context_text")).alias("context_text"), stored(_first_of("source_field", "applies_to"), 256).alias("applies_to")).distinct()


def unresolved_links(links: DataFrame) -> DataFrame:
    """Unresolved links (job_id, url, text, link_type) to look up later, once
    each, with their first six words as a hint."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    return links.filter("link_type = 'UNRESOLVED'").select("job_id", F.coalesce("text", F.lit("")).alias("text"), F.col("url").alias("parent"), F.coalesce(F.array_join(F.slice(words, 1, 6), " "), F.lit("")).alias("hint")).distinct()


def stage_log(events: DataFrame) -> DataFrame:
    """Start and end events (row_id, kind, ts, status, error) of pipeline stages
    as rows with a duration; one without an end is RUNNING."""
    start, end = F.min(F.when(F.col("kind") == "start", F.col("ts"))), F.max(F.when(F.col("kind") == "end", F.col("ts")))
    ended = F.max_by("status", F.when(F.col("kind") == "end", F.col("ts")))
    error = F.max_by("error", F.when(F.col("kind") == "end", F.col("ts")))
    duration = F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 3)
    rows = events.groupBy("row_id").agg(start.alias("started"), ended.alias("status"), duration.alias("duration_s"), error.alias("error_detail"))
    return rows.filter("started is not null").select("row_id", F.coalesce("status", F.lit("RUNNING")).alias("status"), "duration_s", F.coalesce("error_detail", F.lit("")).alias("error_detail"))


def endpoint_log(calls: DataFrame) -> DataFrame:
    """Endpoints (method, url) of a call log (call_id, method, url, success,
    called_at): once each, successes counted, the last success's time."""
    ok = F.coalesce("success", F.lit(False))
    return calls.groupBy(F.upper("method").alias("method"), "url").agg(F.count("*").alias("calls"), F.count_if(ok).alias("success_count"), F.max(F.when(ok, F.col("called_at"))).alias("last_success"))


def branch_edges(steps: DataFrame, rows: DataFrame) -> DataFrame:
    """(sop_id, source, target, rel): branches of steps (sop_id, number, yes, no)
    and skips of their rows (sop_id, number, skip_to), where the target is a
    step; zero is no target; an edge is drawn once."""
    known = steps.select("sop_id", F.col("number").alias("target")).distinct()
    ways = steps.select("sop_id", F.col("number").alias("source"), F.explode(F.array(F.struct(F.col("yes").alias("target"), F.lit("BRANCH_YES").alias("rel")), F.struct(F.col("no").alias("target"), F.lit("BRANCH_NO").alias("rel")))).alias("w")).select("sop_id", "source", "w.target", "w.rel")
    skips = rows.select("sop_id", F.col("number").alias("source"), F.col("skip_to").alias("target"), F.lit("SKIPS_TO").alias("rel")).join(steps.select("sop_id", F.col("number").alias("source")), ["sop_id", "source"], "left_semi")
    return ways.unionByName(skips).filter("target <> 0").join(known, ["sop_id", "target"], "left_semi").distinct().select("sop_id", "source", "target", "rel")


def goto_targets(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, step_number) of GOTO relations (position, source, target, rel) to
    entities (id, step_number) with a step; the last of a source counts."""
    steps = entities.filter("step_number is not null").select(F.col("id").alias("target"), "step_number")
    found = relations.filter("rel = 'GOTO'").join(steps, "target")
    return found.groupBy("source").agg(F.max_by("step_number", "position").alias("step_number"))


def parent_edges(documents: DataFrame) -> DataFrame:
    """(parent_id, child_id, depth): documents (sop_id, url, parent_url, depth,
    position) under the first document that has their parent's address."""
    named = documents.filter(F.coalesce("url", F.lit("")) != "")
    first = named.groupBy(F.col("url").alias("parent_url")).agg(F.min_by("sop_id", "position").alias("parent_id"))
    return documents.filter(F.coalesce("parent_url", F.lit("")) != "").join(first, "parent_url").filter("parent_id is not null").select("parent_id", F.col("sop_id").alias("child_id"), "depth")


def page_coverage(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Per document: its pages (doc_id, page), those that entities (doc_id, page)
    name, the numbers missing, and whether none is."""
    covered = entities.filter("page is not null").select("doc_id", "page").distinct().withColumn("hit", F.lit(True))
    marked = pages.filter("page is not null").select("doc_id", "page").distinct().join(covered, ["doc_id", "page"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("page"))))
    out = marked.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count_if("hit").alias("hit_pages"), missing.alias("missing_pages"))
    total = covered.groupBy("doc_id").agg(F.count("*").alias("covered_pages"))
    out = out.join(total, "doc_id", "left")
    return out.select("doc_id", "page_count", F.coalesce("covered_pages", F.lit(0)).alias("covered_pages"), "missing_pages", (F.size("missing_pages") == 0).alias("coverage_ok"))


def decision_cells(number: Column, cells: Column) -> Column:
    """Condition, second condition and action of a step's row of cells: blank
    cells and a leading step number go; the last parts of long rows join."""
    filled = F.filter(cells, lambda t: F.trim(t) != "")
    numbered = F.coalesce(F.trim(F.get(filled, F.lit(0))) == number.cast("string"), F.lit(False))
    kept = F.when(numbered, F.slice(filled, 2, F.size(filled))).otherwise(filled)
    n = F.size(kept)
    at = lambda i: F.get(kept, F.lit(i))
    first, also = F.when(n >= 2, at(0)).otherwise(""), F.when(n >= 3, at(1)).otherwise("")
    action = F.when(n == 1, at(0)).when(n == 2, at(1)).otherwise(F.array_join(F.slice(kept, 3, F.greatest(n, F.lit(1))), " "))
    made = F.struct(F.substring(first, 1, 500).alias("condition_if"), F.substring(also, 1, 500).alias("condition_and"), F.substring(action, 1, 1000).alias("action"))
    return F.when(n > 0, made)


def rowless_questions(steps: DataFrame) -> DataFrame:
    """Steps (number, question, branch_yes, n_rows) that ask without an answer."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return steps.filter(~blank("question") & blank("branch_yes") & (F.col("n_rows") == 0))


def remaining_budgets(records: DataFrame, by: str, order: str, tokens: str, total: int = 130_000, most: int = 110_000, least: int = 5_000) -> DataFrame:
    """What each tool record of a group may take: what the records before it have
    left of ``total``, held between ``least`` and ``most``.  ``tokens`` is what
    a record took in the end; where that is yet to be found, see
    :func:`rulespan.operators.compaction.compacted`."""
    spent = F.coalesce(F.sum(tokens).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.withColumn("budget", F.greatest(F.lit(least), F.least(F.lit(most), F.lit(total) - spent)))


def recent_ascending(rows: DataFrame, order: list[str], most: int = 120) -> DataFrame:
    """The newest ``most`` rows, oldest of them first."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most).orderBy(*order)


def agent_nodes(evaluations: DataFrame, defects: tuple[str, ...]) -> DataFrame:
    """Per run and node its evaluations (run_id, shape_id or null, rule_key,
    order_index, matched, skipped, decision_type, early), matched decisions in
    order, and whether the run ended here: at the first node, in order of
    appearance, with a defect decision of a run that ended early."""
    shape = F.coalesce("shape_id", F.concat(F.lit("orphaned:"), "rule_key"))
    kind = F.upper(F.coalesce("decision_type", F.lit("")))
    fired = F.col("matched") & ~F.coalesce("skipped", F.lit(False)) & (kind != "")
    seen = F.array_sort(F.collect_list(F.when(fired, F.struct("order_index", kind.alias("k")))))
    nodes = evaluations.groupBy("run_id", shape.alias("shape_id")).agg(F.min("order_index").alias("first_index"), F.count("*").alias("n_evaluations"), F.array_distinct(F.transform(seen, lambda x: x["k"])).alias("matched_decisions"), F.bool_or("early").alias("early"))
    bad = F.col("early") & F.arrays_overlap("matched_decisions", F.array(*map(F.lit, defects)))
    first = F.min(F.when(bad, F.col("first_index"))).over(Window.partitionBy("run_id"))
    return nodes.select("run_id", "shape_id", "n_evaluations", "matched_decisions", F.coalesce(bad & (F.col("first_index") == first), F.lit(False)).alias("terminated_here"))


def agent_tools(tools: DataFrame) -> DataFrame:
    """Per run and node how many bound tool calls (run_id, shape_id, phase) it has
    but those that fetch and parse."""
    return tools.filter(F.col("shape_id").isNotNull() & ~F.col("phase").isin("FETCH", "PARSE")).groupBy("run_id", "shape_id").agg(F.count("*").alias("n_tools"))


def agents_filled(both: DataFrame) -> DataFrame:
    """Nodes and tool counts side by side; a node may have only one of them."""
    return both.select("run_id", "shape_id", F.coalesce("n_evaluations", F.lit(0)).alias("n_evaluations"), F.coalesce("n_tools", F.lit(0)).alias("n_tools"), F.coalesce("matched_decisions", F.array().cast("array<string>")).alias("matched_decisions"), F.coalesce("terminated_here", F.lit(False)).alias("terminated_here"))


def agents_rollup(evaluations: DataFrame, tools: DataFrame, defects: tuple[str, ...]) -> DataFrame:
    """Per run and node: ``agent_nodes`` and ``agent_tools`` together."""
    return agents_filled(agent_nodes(evaluations, defects).join(agent_tools(tools), ["run_id", "shape_id"], "full"))
