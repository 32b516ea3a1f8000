"""Scanned documents: pages put together, entities and their relations, and the
steps and sections that they make.

What a model has read from page images (pages, entities, relations, rows) comes
as tables; everything here is what has to be right about them afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions.decisions import mentions
from rulespan.operators.ranges import within
from rulespan.sources.staging import stage

c = F.col

# Kinds of relations, those that follow from the kinds of parent
# and child, phrases that end a workflow or leave its scope, and sizes.
RELATIONS = ("HAS_STEP", "HAS_SUBSTEP", "HAS_CONDITION", "HAS_ROW", "IN_SECTION", "CONTINUES", "GOTO", "REFERENCES", "APPLIES_TO")
BY_KINDS = {("SECTION", "STEP"): "HAS_STEP", ("STEP", "SUBSTEP"): "HAS_SUBSTEP", ("SUBSTEP", "SUBSTEP"): "HAS_SUBSTEP", ("TABLE", "ROW"): "HAS_ROW"}
CONDITIONS = ("CONDITION", "WARNING", "NOTE")
ACTIONS = ("SUBSTEP", "ROW")
TERMINAL = ("(f3)", "(f4)", "process the claim", "save the claim")
OUT_OF_SCOPE = ("out of scope", "out-of-scope", "stop further auditing", "stop auditing further")
UNNUMBERED = 10_000
MOST_QUESTION, MOST_RAW, MOST_CELL, MOST_ITEM, MOST_NAME = 500, 4000, 1000, 2000, 120


def whole_pages(pages: DataFrame, reread: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """One row a page of ``pages`` (doc_id, slice, ord, page, ...): the first one
    seen where slices overlap; pages without a number follow, in order.  Pages
    up to a document's ``totals`` (doc_id, pages) that no slice has come from
    ``reread`` (the columns of pages)."""
    loose = Window.partitionBy("doc_id", c("page").isNull()).orderBy("slice", "ord")
    numbered = pages.withColumn("page", F.coalesce("page", F.row_number().over(loose) + UNNUMBERED))
    first = Window.partitionBy("doc_id", "page").orderBy("slice", "ord")
    kept = numbered.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    if reread is None or totals is None:
        return kept
    wanted = reread.join(totals.select("doc_id", c("pages").alias("_pages")), "doc_id").filter("page between 1 and _pages").drop("_pages")
    again = wanted.join(kept.select("doc_id", "page"), ["doc_id", "page"], "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.unionByName(again)


def missing_pages(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, page) of pages from 1 to a document's total that are not there."""
    wanted = totals.filter("pages >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    return wanted.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def stitched_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Where each of ``tables`` (doc_id, page, tbl, continues) belongs: to_page and
    to_tbl, its own place or that of the last table of the page before.

    A page's first table goes there if it continues and that page still has a
    table: one whose only table has itself gone to the page before has none.
    So a page is settled by its own marks, or else by being unlike the page
    before; the distance to the last settled page tells which.  Numbers of a
    page's tables start at 0; a page that is first or stands alone keeps its own.
    """
    held = tables.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.max(F.when(c("tbl") == 0, c("continues"))).alias("goes"))
    w = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.select("doc_id", "page").join(held, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("goes", F.lit(False)).alias("goes"))
    rows = rows.withColumns({"at": F.row_number().over(w), "before": F.coalesce(F.lag("n").over(w), F.lit(0)), "page_before": F.lag("page").over(w)})
    settled = F.when(~c("goes") | (c("before") == 0), False).when(c("before") > 1, True)
    rows = rows.withColumn("settled", settled)
    last = F.last(F.when(c("settled").isNotNull(), F.struct("at", "settled")), True).over(w)
    rows = rows.withColumn("last", last).withColumn("moves", F.when((c("at") - c("last.at")) % 2 == 0, c("last.settled")).otherwise(~c("last.settled")))
    moved = rows.select("doc_id", "page", "moves", "page_before", (c("before") - 1).alias("last_tbl"))
    both = tables.join(moved, ["doc_id", "page"])
    goes = (c("tbl") == 0) & c("moves")
    return both.select(*tables.columns, F.when(goes, c("page_before")).otherwise(c("page")).alias("to_page"), F.when(goes, c("last_tbl")).otherwise(c("tbl")).cast("int").alias("to_tbl"))


def relations(entities: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, source, target, rel, label): what parents say of entities (doc_id,
    entity_id, type, parent_ref), and of the relations ``told`` (doc_id, source,
    target, rel, label) those between known entities of a known kind; each once."""
    kinds = entities.groupBy("doc_id", "entity_id").agg(F.max("type").alias("kind"))
    above = kinds.select("doc_id", c("entity_id").alias("parent_ref"), c("kind").alias("above"))
    child = entities.join(above, ["doc_id", "parent_ref"])
    rel = F.coalesce(*(F.when((c("above") == a) & (c("type") == b), r) for (a, b), r in BY_KINDS.items()), F.when(c("type").isin(*CONDITIONS), "HAS_CONDITION").otherwise("IN_SECTION"))
    seeds = child.select("doc_id", c("parent_ref").alias("source"), c("entity_id").alias("target"), rel.alias("rel"), F.lit("").alias("label"), F.lit(0).alias("_way"))
    ends = lambda name: kinds.select("doc_id", c("entity_id").alias(name))
    known = told.withColumn("rel", F.upper("rel")).filter(c("rel").isin(*RELATIONS)).join(ends("source"), ["doc_id", "source"], "left_semi").join(ends("target"), ["doc_id", "target"], "left_semi")
    added = known.select("doc_id", "source", "target", "rel", F.substring(F.coalesce("label", F.lit("")), 1, 200).alias("label"), F.lit(1))
    both = seeds.union(added)
    return both.groupBy("doc_id", "source", "target", "rel").agg(F.min(F.struct("_way", "label"))["label"].alias("label"))


def below(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, entity_id, depth, path) of all that hangs below each of
    ``roots`` (doc_id, root), once: by parent_ref, nearest first, ``path`` being
    the order in which a level is met.

    A driver loop over depths that joins the newest level and writes it; rings
    end where they began.
    """
    child = entities.select("doc_id", "parent_ref", "entity_id", "ord").filter("parent_ref is not null")
    seen = newest = stage(roots.select("doc_id", "root", c("root").alias("entity_id"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("path")))
    out = None
    depth = 0
    while not newest.isEmpty():
        depth += 1
        ahead = newest.select("doc_id", "root", c("entity_id").alias("parent_ref"), "path").join(child, ["doc_id", "parent_ref"])
        ahead = ahead.groupBy("doc_id", "root", "entity_id").agg(F.min(F.concat("path", F.array(c("ord").cast("long")))).alias("path"))
        known = seen if out is None else out
        newest = stage(ahead.join(known.select("doc_id", "root", "entity_id"), ["doc_id", "root", "entity_id"], "left_anti").select("doc_id", "root", "entity_id", F.lit(depth).alias("depth"), "path"))
        out = newest if out is None else out.union(newest)
    return out


def section_texts(entities: DataFrame) -> DataFrame:
    """(doc_id, ord, name, items) of the sections among ``entities`` (doc_id,
    entity_id, ord, type, label, text, step_number, parent_ref): the texts of
    all below them but numbered steps; sections without any are left out, so
    what is below is known before a section is numbered."""
    sections = entities.filter("type = 'SECTION'")
    held = below(entities, sections.select("doc_id", c("entity_id").alias("root")))
    said = entities.filter("not (type = 'STEP' and step_number is not null)").select("doc_id", "entity_id", F.trim(F.coalesce("text", F.lit(""))).alias("t")).filter("t <> ''")
    items = held.join(said, ["doc_id", "entity_id"]).groupBy("doc_id", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "path", "t"))), lambda s: F.substring(s["t"], 1, MOST_ITEM)).alias("items"))
    name = F.coalesce(F.nullif("label", F.lit("")), F.nullif("text", F.lit("")), F.lit("Section"))
    full = sections.withColumnRenamed("entity_id", "root").join(items, ["doc_id", "root"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return full.select("doc_id", place.alias("ord"), F.substring(name, 1, MOST_NAME).alias("name"), "items")


def page_spans(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, step_number, raw): the text of the pages (doc_id, page, text) that a
    planned step (doc_id, step_number, start_page, end_page) covers and of the
    one after, in order; spans meet pages in an equi join."""
    spans = plan.filter("start_page is not null and end_page is not null").select("doc_id", "step_number", F.greatest("start_page", F.lit(0)).alias("start"), (c("end_page") + 2).alias("stop")).filter("start < stop")
    met = within(pages.filter("page >= 0").select("doc_id", "page", "text"), spans, "doc_id", "page")
    return met.groupBy("doc_id", "step_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "\n").alias("raw"))


def member_texts(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, step_number, raw): the texts of a step's entities ``members``
    (doc_id, step_number, nth, entity_id) and of what hangs below them, marked
    by dashes; each entity once."""
    roots = members.select("doc_id", c("entity_id").alias("root")).distinct()
    held = below(entities, roots)
    own = members.select("doc_id", "step_number", "nth", "entity_id", F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("path"))
    deep = members.withColumnRenamed("entity_id", "root").join(held, ["doc_id", "root"]).select("doc_id", "step_number", "nth", "entity_id", "depth", "path")
    once = own.union(deep).groupBy("doc_id", "step_number", "entity_id").agg(F.min(F.struct("nth", "depth", "path")).alias("at"))
    said = once.join(entities.select("doc_id", "entity_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "entity_id"])
    line = F.when(c("at.depth") == 0, c("text")).otherwise(F.concat(F.lit("- "), F.trim("text")))
    lines = said.filter("trim(text) <> ''").groupBy("doc_id", "step_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("t")))), lambda s: s["t"]).alias("lines"))
    return lines.select("doc_id", "step_number", F.array_join("lines", "\n").alias("raw"))


def scanned_steps(plan: DataFrame, pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, step_number, question, is_terminal, raw_text) of a plan (doc_id,
    step_number, question, start_page, end_page, entities): from its pages where
    it has any, else from its entities; steps without a text are left out."""
    plan = plan.dropDuplicates(["doc_id", "step_number"])
    paged = page_spans(plan, pages).select("doc_id", "step_number", c("raw").alias("paged"))
    has_pages = pages.select("doc_id").distinct().withColumn("has_pages", F.lit(True))
    by_range = c("start_page").isNotNull() & c("end_page").isNotNull() & F.coalesce("has_pages", F.lit(False))
    ready = stage(plan.join(has_pages, "doc_id", "left").withColumn("by_range", by_range))
    members = ready.filter("not by_range").select("doc_id", "step_number", F.posexplode("entities").alias("nth", "entity_id"))
    members = members.join(entities.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")
    other = member_texts(members, entities).select("doc_id", "step_number", c("raw").alias("told"))
    keys = ["doc_id", "step_number"]
    rows = ready.join(paged, keys, "left").join(other, keys, "left").withColumn("raw", F.when(c("by_range"), c("paged")).otherwise(c("told")))
    rows = rows.filter("trim(coalesce(raw, '')) <> ''")
    return rows.select("doc_id", "step_number", F.substring(F.coalesce("question", F.lit("")), 1, MOST_QUESTION).alias("question"), mentions(F.lower("raw"), *TERMINAL).alias("is_terminal"), F.substring("raw", 1, MOST_RAW).alias("raw_text"))


def fallback_rows(members: DataFrame, entities: DataFrame, gotos: DataFrame, read: DataFrame) -> DataFrame:
    """Decision rows of steps for which nothing was ``read`` (doc_id, step_number):
    each entity below a step's ``members`` is a row under its parent's, with
    the target that ``gotos`` (doc_id, source, step_number) gives it.  An entity
    without a text is no row, nor is what hangs below it.

    (doc_id, step_number, node_id, parent_id, ord, condition_if, action,
    skip_to_step, is_out_of_scope); parent_id is null at the top.
    """
    target = gotos.groupBy("doc_id", c("source").alias("node_id")).agg(F.max("step_number").alias("skip_to_step"))
    child = stage(entities.filter("parent_ref is not null").select("doc_id", c("parent_ref").alias("above"), c("entity_id").alias("node_id"), "ord", "type", F.trim(F.coalesce("text", F.lit(""))).alias("text")).filter("text <> ''"))
    open_ = members.join(read.select("doc_id", "step_number"), ["doc_id", "step_number"], "left_anti").select("doc_id", "step_number", c("entity_id").alias("above"), F.lit(None).cast("string").alias("parent_id"))
    level = stage(open_.join(child, ["doc_id", "above"]).drop("above"))
    out = level
    while not level.isEmpty():
        up = level.select("doc_id", "step_number", c("node_id").alias("above"), c("node_id").alias("parent_id"))
        level = stage(up.join(child, ["doc_id", "above"]).drop("above").join(out.select("doc_id", "step_number", "node_id"), ["doc_id", "step_number", "node_id"], "left_anti").select(*out.columns))
        out = out.union(level)
    said = F.substring("text", 1, MOST_CELL)
    rows = out.join(target, ["doc_id", "node_id"], "left")
    return rows.select(
        "doc_id", "step_number", "node_id", "parent_id", "ord", F.when(c("type").isin(*CONDITIONS), said).otherwise("").alias("condition_if"), F.when(c("type").isin(*ACTIONS), said).otherwise("").alias("action"),
        "skip_to_step", mentions(F.lower("text"), *OUT_OF_SCOPE).alias("is_out_of_scope"),
    )


def quality_gate(plan: DataFrame, built: DataFrame, sections: DataFrame, problems: DataFrame) -> DataFrame:
    """(doc_id, planned, built, missing, sections, n_problems, complete) of each
    planned document: step numbers planned (doc_id, step_number) and built, those
    that are missing, how many sections it has, and how many ``problems``
    (doc_id) its draft has; complete where nothing is missing and none is left."""
    steps = plan.filter("step_number is not null").select("doc_id", "step_number").distinct()
    made = built.filter("step_number is not null").select("doc_id", "step_number").distinct()
    listed = lambda rows, name: rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("step_number")).alias(name))
    out = plan.select("doc_id").distinct()
    for name, rows in (("planned", steps), ("built", made), ("missing", steps.join(made, ["doc_id", "step_number"], "left_anti"))):
        out = out.join(listed(rows, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    for name, rows in (("sections", sections), ("n_problems", problems)):
        out = out.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("complete", (F.size("missing") == 0) & (c("n_problems") == 0))
