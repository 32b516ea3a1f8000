"""Procedure documents: business fields, labelled sections, steps and what their
cells say, group tables, notes, reference tables and sub-procedures.

All read the rows of :func:`rulespan.operators.markup.nodes`, which a caller
stages once.  Descendants are found by joins of node numbers with node ranges;
context that carries on from heading to table to list is a window over events
in document order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions import decisions as d
from rulespan.functions import extract as x
from rulespan.operators.markup import joined, spaced, with_text
from rulespan.operators.ranges import within

c = F.col

# Header words, label words that name no section, terminal
# phrases, branch words, note words and the colours of highlighted text.
BUSINESS_HEADERS = ("platform", "audience", "lob", "line of business", "product", "state", "div", "contact")
IF_HEADERS = ("if", "if…", "if...", "condition", "situation", "when")
AND_HEADERS = ("and", "and…", "and...", "also", "plus")
THEN_HEADERS = ("then", "then…", "then...", "action", "result", "outcome")
COLUMN_NAMES = ("step", "action", "if", "then", "and", "category", "details", "group", "guidelines", "if…", "and…", "then…")
HEADER_TOKENS = (*IF_HEADERS, *AND_HEADERS, *THEN_HEADERS, "step", "action", "step/action", "and… / then…")
TERMINAL = ("(F3)", "(F4)", "process the claim", "save the claim")
BRANCH = r"(?i)^(yes|no|all items match|any item[s/]* (?:do )?not match|11[,\s]|02[,\s]|correct|incorrect|true|false)[:\s–\-]"
NOT_A_QUESTION = ("Note", "Alert", "Warning", "Exception")
NOTE_WORD = r"(?i)^\s*(note|alert|warning|exception|tip|important)[:\s*]"
NOTE_TYPES = {"NOTE": "NOTE", "ALERT": "ALERT", "WARNING": "ALERT", "EXCEPTION": "EXCEPTION", "TIP": "TIP", "IMPORTANT": "NOTE"}
COLOURS = {"fff176": "HIGHLIGHT", "ffff00": "HIGHLIGHT", "ffe0b2": "HIGHLIGHT", "fce4d6": "HIGHLIGHT", "fff9e6": "NOTE", "eaf4fb": "NOTE", "e8f4e8": "TIP", "fdecea": "ALERT", "fff3cd": "ALERT"}
BACKGROUND = r"background(?:-color)?\s*:\s*#?([0-9a-fA-F]{3,6})"
STEP_HEADING = r"(?i)\bStep\s+([0-9]+)\b"
SKIP = r"[Ss]kip\s+to\s+[Ss]tep\s+([0-9]+)"
NEAREST = ("h1", "h2", "h3", "h4", "h5", "div", "span")


def number(text: Column) -> Column:
    """A text of digits only as a number, else null."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("long"))


def skip_to(text: Column) -> Column:
    return F.regexp_extract(text, SKIP, 1).try_cast("int")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def colour(style: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(style, BACKGROUND, 1)), F.lit(""))


def colour_type(style: Column) -> Column:
    found = colour(style)
    return F.coalesce(*(F.when(found == k, kind) for k, kind in COLOURS.items()))


def note_type(text: Column) -> Column:
    word = F.upper(F.regexp_extract(text, NOTE_WORD, 1))
    return F.coalesce(*(F.when(word == k, kind) for k, kind in NOTE_TYPES.items()))


def table_rows(found: DataFrame) -> DataFrame:
    """(doc_id, tbl, row, last, has_td, style, anchor, nth): rows of tables, from 0."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("node")) - 1
    return found.filter("tag = 'tr' and tbl is not null").select("doc_id", "tbl", c("node").alias("row"), "last", "has_td", "style", "anchor", nth.alias("nth"))


def table_cells(found: DataFrame) -> DataFrame:
    """Cells that are their row's children: (doc_id, tbl, row, node, last, start,
    stop, col, tag, anchor, colspan, raw, text), text with pieces spaced."""
    rows = found.filter("tag in ('td', 'th') and parent = row and tbl is not null")
    col = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("node")) - 1
    rows = rows.select("doc_id", "tbl", "row", "node", "last", "start", "stop", col.alias("col"), "tag", "anchor", "colspan")
    return with_text(rows, found).withColumn("text", spaced(c("raw")))


def step_tables(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, tbl, col, first_step, n_steps, last_step): tables of three rows
    or more whose column 0 or 1 begins with two or more consecutive numbers."""
    known = rows.groupBy("doc_id", "tbl").agg(F.count("*").alias("n_rows"), F.count_if("has_td").alias("n_data")).filter("n_rows >= 3 and n_data >= 2")
    data = rows.filter("has_td").join(known.select("doc_id", "tbl"), ["doc_id", "tbl"], "left_semi")
    each = data.select("doc_id", "tbl", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("col"))
    each = each.join(cells.select("doc_id", "row", "col", number(joined(c("raw"))).alias("num")), ["doc_id", "row", "col"], "left")
    w = Window.partitionBy("doc_id", "tbl", "col").orderBy("row")
    placed = each.withColumn("n", F.row_number().over(w)).withColumn("broken", F.max(c("num").isNull().cast("int")).over(w)).filter("broken = 0")
    runs = placed.groupBy("doc_id", "tbl", "col").agg(F.min_by("num", "n").alias("first_step"), F.count("*").alias("n_steps"), F.max_by("num", "n").alias("last_step"), F.countDistinct(c("num") - c("n")).alias("shifts"))
    good = runs.filter("n_steps >= 2 and shifts = 1").groupBy("doc_id", "tbl").agg(F.min_by(F.struct("col", "first_step", "n_steps", "last_step"), "col").alias("best"))
    return good.select("doc_id", "tbl", "best.*")


def ranked_step_tables(found: DataFrame) -> DataFrame:
    """Step tables with their place: 1 is the primary one, which starts at 1 and
    has most steps; of equals the first."""
    order = Window.partitionBy("doc_id").orderBy((c("first_step") == 1).desc(), c("n_steps").desc(), "tbl")
    return found.withColumn("place", F.row_number().over(order))


def step_cells(rows: DataFrame, cells: DataFrame, tables: DataFrame, nested: bool = False) -> DataFrame:
    """(doc_id, tbl, number, row, node, last, start, stop, raw, text): the cell
    beside the number of each step, the first of a number; with ``nested`` rows
    of tables within a table are read as its own."""
    data = rows.filter("has_td").select("doc_id", c("tbl").alias("own"), "row")
    spans = tables.select("doc_id", "tbl", "col")
    if nested:
        ends = rows.groupBy("doc_id", "tbl").agg((F.max("last") + 1).alias("stop"))
        mine = within(data, spans.join(ends, ["doc_id", "tbl"]).withColumn("start", c("tbl")), "doc_id", "row").drop("start", "stop")
    else:
        mine = data.withColumnRenamed("own", "tbl").join(spans, ["doc_id", "tbl"])
    numbers = cells.select("doc_id", "row", "col", number(joined(c("raw"))).alias("number")).filter("number is not null")
    first = Window.partitionBy("doc_id", "tbl", "number").orderBy("row")
    mine = mine.join(numbers, ["doc_id", "row", "col"]).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    beside = cells.select("doc_id", "row", c("col").alias("beside"), "node", "last", "start", "stop", "raw", "text")
    return mine.withColumn("beside", F.when(c("col") == 0, 1).otherwise(0)).join(beside, ["doc_id", "row", "beside"]).select("doc_id", "tbl", "number", "row", "node", "last", "start", "stop", "raw", "text")


def inside(found: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """Nodes of ``found`` below those of ``spans`` (doc_id, node, last), with the
    span's node as ``of``; ``more`` columns of spans come along."""
    held = spans.select("doc_id", c("node").alias("of"), (c("node") + 1).alias("_from"), (c("last") + 1).alias("_to"), *more)
    return within(found, held, "doc_id", "node", "_from", "_to").drop("_from", "_to")


def notes(found: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Notes of documents (doc_id, ord, annotation_type, text), or below each of
    ``spans`` (doc_id, of, ...): quoted, coloured, or begun with a note word;
    each text once.  Of a whole document colours come first and texts of up
    to eight characters are left out; below spans quotes come first and list
    items count too."""
    tags = ("p", "div", "span", "strong", "em", *(("li",) if spans is not None else ()))
    elements = found.filter(~c("tag").startswith("#") & (c("tag").isin("blockquote", "aside", *tags) | (c("style") != "")))
    if spans is not None:
        elements = inside(elements, spans)
    keys = ["doc_id"] if spans is None else ["doc_id", "of"]
    elements = with_text(elements, found).withColumn("t", spaced(c("raw")))
    quoted, coloured = (1, 0) if spans is None else (0, 2)
    ways = F.array(
        F.struct((F.lit(quoted) + F.when(c("tag") == "aside", 0.5).otherwise(0.0)).alias("way"), F.when(c("tag").isin("blockquote", "aside"), "NOTE").alias("kind")),
        F.struct(F.lit(float(coloured)).alias("way"), colour_type(c("style")).alias("kind")),
        F.struct(F.lit(3.0).alias("way"), F.when(c("tag").isin(*tags), note_type(c("t"))).alias("kind")),
    )
    each = elements.select(*keys, "node", "t", F.explode(F.filter(ways, lambda s: s["kind"].isNotNull())).alias("w")).filter((c("t") != "") if spans is not None else F.length("t") > 8)
    once = each.groupBy(*keys, "t").agg(F.min(F.struct("w.way", "node", "w.kind")).alias("best"))
    order = Window.partitionBy(*keys).orderBy("best.way", "best.node")
    return once.select(*keys, (F.row_number().over(order) - 1).alias("ord"), c("best.kind").alias("annotation_type"), c("t").alias("text"))


def list_items(found: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """List items below ``spans`` with their text."""
    items = inside(found.filter("tag = 'li'").select("doc_id", "node", "last", "start", "stop", "items"), spans, *more)
    return with_text(items, found).withColumn("text", spaced(c("raw")))


def step_details(found: DataFrame, cells: DataFrame) -> DataFrame:
    """What each step cell (doc_id, number, node, last, text, ...) says: question,
    yes and no branches with their targets, referenced documents, whether it
    ends the work, and its text."""
    child = with_text(found.filter("parent is not null and tag <> '#document'").select("doc_id", c("parent").alias("of"), "node", "tag", "start", "stop"), found)
    prominent = c("tag").isin("p", "strong", "b", "em")
    t = F.trim(F.when(prominent, spaced(c("raw"))).otherwise(joined(c("raw"))))
    asks = F.when(prominent, (t != "") & ~reduce(lambda a, b: a | b, (t.startswith(w) for w in NOT_A_QUESTION))).otherwise(~c("tag").isin("table", "ul", "ol", "div") & (F.length(t) > 10))
    question = child.join(cells.select("doc_id", c("node").alias("of")), ["doc_id", "of"], "left_semi").filter(asks).groupBy("doc_id", "of").agg(F.min_by(t, "node").alias("question"))

    items = list_items(found, cells).filter("items < 2")
    low = F.lower("text")
    branch = lambda word: F.max_by("text", F.when(low.rlike(rf"^{word}\b"), c("node")))
    branches = items.groupBy("doc_id", "of").agg(branch("yes").alias("yes"), branch("no").alias("no"))

    links = with_text(inside(found.filter("tag = 'a' and href is not null").select("doc_id", "node", "start", "stop"), cells), found).withColumn("t", joined(c("raw"))).filter(x.looks_like_reference(c("t")))
    refs = links.groupBy("doc_id", "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "t"))), lambda s: s["t"]).alias("refs"))
    out = cells.withColumnRenamed("node", "of")
    for part in (question, branches, refs):
        out = out.join(part, ["doc_id", "of"], "left")
    text = lambda name: F.coalesce(name, F.lit(""))
    return out.select(
        "doc_id", "tbl", "number", text("question").alias("question"), text("yes").alias("branch_yes"), text("no").alias("branch_no"), skip_to(c("yes")).alias("skip_to_step_yes"), skip_to(c("no")).alias("skip_to_step_no"),
        F.coalesce("refs", F.array().cast("array<string>")).alias("referenced"), holds(c("text"), TERMINAL).alias("is_terminal"), c("text").alias("raw_text"),
    )


def step_branches(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Decision rows from the list items of step cells: yes, no, and other items
    that begin with a condition."""
    items = list_items(found, cells, "tbl", "number").filter("items < 2")
    low, t, colon = F.lower("text"), c("text"), F.instr("text", ":")
    kind = F.when(low.rlike(r"^yes\b"), "Yes").when(low.rlike(r"^no\b"), "No").when(t.rlike(BRANCH), "")
    rest = F.when(colon > 0, F.substr(t, colon + 1)).otherwise(t)
    after = lambda word: F.regexp_replace(t, rf"(?i)^{word}\s*[–\-:]\s*", "")
    rows = items.withColumn("kind", kind).filter("kind is not null")
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "of").orderBy("node")) - 1
    condition = F.when(c("kind") != "", c("kind")).when(colon > 0, F.trim(F.substr(t, F.lit(1), colon - 1))).otherwise(F.substring(t, 1, 60))
    action = F.trim(F.when(c("kind") == "Yes", after("yes")).when(c("kind") == "No", after("no")).otherwise(rest))
    return rows.select("doc_id", "tbl", "number", ord_.alias("ord"), condition.alias("condition_if"), action.alias("action"), d.classify_decision_document(t).alias("decision"), x.document_codes(t).alias("codes"), skip_to(t).alias("skip_to_step"))


def business_tables(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, tbl): tables with two business words or more among their headers."""
    head = cells.join(rows.filter("nth = 0").select("doc_id", "row"), ["doc_id", "row"], "left_semi")
    return head.filter(holds(F.lower("text"), BUSINESS_HEADERS)).groupBy("doc_id", "tbl").agg(F.count("*").alias("n")).filter("n >= 2").select("doc_id", "tbl")


def business_fields(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Platform, audience, line of business, product and state of each document
    by its first business table; of several rows the last with a value counts."""
    first = business_tables(rows, cells).groupBy("doc_id").agg(F.min("tbl").alias("tbl"))
    mine = cells.join(first, ["doc_id", "tbl"], "left_semi").join(rows.select("doc_id", "row", "nth"), ["doc_id", "row"])
    h = F.lower("text")
    field = F.when(h.contains("platform"), "platform").when(h.contains("audience"), "audience").when(holds(h, ("lob", "line of business")), "lob").when(h.contains("product"), "product").when(holds(h, ("state", "div")), "state_div")
    head = mine.filter("nth = 0").select("doc_id", "col", field.alias("field")).filter("field is not null")
    values = mine.filter("nth > 0 and text <> ''").join(head, ["doc_id", "col"]).groupBy("doc_id", "field").agg(F.max_by("text", F.struct("nth", "col")).alias("value"))
    # the field map is by column: a later header of the same field wins within a row
    of = lambda name: F.max(F.when(c("field") == name, c("value")))
    items = lambda v: F.filter(F.transform(F.split(v, r"[\n,]"), F.trim), lambda s: s != "")
    listed = lambda v: F.when(F.size(items(v)) > 0, items(v)).otherwise(F.array(v))
    plain = values.groupBy("doc_id").agg(*(of(n).alias(n) for n in ("platform", "product", "state_div", "lob", "audience")))
    out = first.select("doc_id").join(plain, "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", *(F.coalesce(n, F.lit("")).alias(n) for n in ("platform", "product", "state_div")), *(F.when(c(n).isNotNull(), listed(c(n))).otherwise(none).alias(n) for n in ("lob", "audience")))


def labelled_sections(found: DataFrame, rows: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Sections before the steps (doc_id, ord, name, section_id, node, last, of,
    of_last): a short label beside a longer text, in rows of tables that are
    neither step nor business tables, then in elements whose first child looks
    like a heading; the first of a name.  node and last are the element whose
    markup is the section, of and of_last the one that holds its content."""
    spans = found.filter("tag = 'table'").select("doc_id", c("node").alias("tbl"), "last")
    other = spans.join(tables.select("doc_id", "tbl").union(business_tables(rows, cells)), ["doc_id", "tbl"], "left_anti")
    # rows below any such table count, in the order of the outermost one
    before = F.max("last").over(Window.partitionBy("doc_id").orderBy("tbl").rowsBetween(Window.unboundedPreceding, -1))
    outer = other.withColumn("_before", F.coalesce(before, F.lit(-1))).filter("tbl > _before").select("doc_id", c("tbl").alias("outer"), c("tbl").alias("start"), (c("last") + 1).alias("stop"))
    mine = within(rows.select("doc_id", "row"), outer, "doc_id", "row").drop("start", "stop")
    head = cells.filter("col = 0").select("doc_id", "row", (F.coalesce("colspan", F.lit(1)) >= 2).alias("wide"), F.length("text").alias("head_len"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("col"))
    tds = cells.filter("tag = 'td'").withColumn("n", nth).filter("n <= 2")
    label = tds.filter("n = 1").select("doc_id", "row", F.trim("text").alias("name"), F.length("text").alias("name_len"), c("anchor").alias("section_id"))
    content = tds.filter("n = 2").select("doc_id", "row", "node", "last", F.length("text").alias("len"))
    pairs = mine.join(head, ["doc_id", "row"]).join(label, ["doc_id", "row"]).join(content, ["doc_id", "row"])
    pairs = pairs.filter(~(c("wide") & c("head_len").between(3, 119)) & c("name_len").between(1, 80) & (c("len") > c("name_len")) & (c("name") != "") & ~F.lower("name").isin(*COLUMN_NAMES))
    from_tables = pairs.select("doc_id", F.lit(0).alias("way"), c("outer").alias("first"), c("row").alias("second"), "name", "section_id", "node", "last", c("node").alias("of"), c("last").alias("of_last"))

    children = found.filter("parent is not null and not tag like '#%'")
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("node"))
    two = children.withColumn("n", place).filter("n <= 2").select("doc_id", c("parent").alias("block"), "n", "node", "last", "tag", "start", "stop")
    texts = with_text(two, found).withColumn("t", F.trim(spaced(c("raw")))).filter("t <> ''")
    heading = texts.filter(c("n") == 1).filter(c("tag").isin("div", "span", "p", "h2", "h3", "h4", "dt")).select("doc_id", "block", c("t").alias("name"))
    body = texts.filter("n = 2").select("doc_id", "block", c("node").alias("of"), c("last").alias("of_last"), F.length("t").alias("len"))
    blocks = found.select("doc_id", c("node").alias("block"), "last", c("anchor").alias("section_id"))
    from_blocks = heading.join(body, ["doc_id", "block"]).filter((F.length("name") <= 80) & (c("len") >= F.length("name"))).join(blocks, ["doc_id", "block"])
    both = from_tables.union(from_blocks.select("doc_id", F.lit(1), "block", F.lit(0), "name", "section_id", "block", "last", "of", "of_last"))
    w = Window.partitionBy("doc_id", "name").orderBy("way", "first", "second")
    once = both.withColumn("n", F.row_number().over(w)).filter("n = 1")
    order = Window.partitionBy("doc_id").orderBy("way", "first", "second")
    return once.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "name", "section_id", "node", "last", "of", "of_last")


def section_items(found: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section, ord, item_type, text, codes, sub_items): outermost list
    items of a section's content as rules, then its other paragraphs; each
    text once, the first."""
    spans = sections.select("doc_id", c("ord").alias("section"), c("of").alias("node"), c("of_last").alias("last"))
    items = list_items(found, spans, "section").filter("items = 0 and text <> ''").select("doc_id", "section", F.lit(0).alias("way"), "node", "last", "text")
    plain = inside(found.filter("tag in ('p', 'div')").select("doc_id", "node", "last", "start", "stop"), spans, "section")
    plain = with_text(plain, found).withColumn("text", spaced(c("raw"))).filter(F.length("text") > 10).select("doc_id", "section", F.lit(1), "node", "last", "text")
    w = Window.partitionBy("doc_id", "section", "text").orderBy("way", "node")
    once = items.union(plain).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    below = list_items(found, once.filter("way = 0").select("doc_id", "node", "last").distinct()).groupBy("doc_id", "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda s: s["text"]).alias("sub"))
    once = once.join(below.withColumnRenamed("of", "node"), ["doc_id", "node"], "left")
    order = Window.partitionBy("doc_id", "section").orderBy("way", "node")
    sub = F.when((c("way") == 0) & c("sub").isNotNull(), c("sub")).otherwise(F.array().cast("array<string>"))
    return once.select("doc_id", "section", (F.row_number().over(order) - 1).alias("ord"), F.when(c("way") == 0, "RULE").otherwise("INFO").alias("item_type"), "text", x.document_codes(c("text")).alias("codes"), sub.alias("sub_items"))


def own_texts(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, row, texts): the texts of each row's cells in order, without
    those of tables in them."""
    pieces = found.filter("tag = '#text' and cell is not null").groupBy("doc_id", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda s: s["text"]), " ").alias("own"))
    both = cells.select("doc_id", "row", "col", c("node").alias("cell")).join(pieces, ["doc_id", "cell"], "left")
    return both.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("own", F.lit("")).alias("own")))), lambda s: s["own"]).alias("texts"))


def is_header(cells: Column) -> Column:
    """Whether all filled cells of a row are header words; true of none."""
    filled = F.filter(cells, lambda v: F.trim(v) != "")
    bare = lambda v: F.lower(F.trim(F.regexp_replace(v, r"[…./\s]+$", "")))
    return F.forall(filled, lambda v: bare(v).isin(*HEADER_TOKENS) | F.regexp_replace(bare(v), r"[…./\s]+", "").isin("if", "and", "then", "andthen"))


def step_claims(found: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, number, pos, cells, holder): what each step claims, in document
    order, by any shape of table or list: rows with a number in the first two
    cells open that step, rows after belong to it, and so do tables and lists
    after a heading that names a step or after a numbered table.  Rows of
    tables in a cell are their row's; a row is claimed once however many tables
    are around it.  ``holder`` is the outermost table or list."""
    tables = found.filter("tag = 'table' and tbl is null").select("doc_id", c("node").alias("tbl"))
    texts = own_texts(found, cells)
    own = rows.join(tables, ["doc_id", "tbl"], "left_semi").select("doc_id", "tbl", "row").join(texts, ["doc_id", "row"])
    first, second = number(F.get("texts", F.lit(0))), number(F.get("texts", F.lit(1)))
    own = own.withColumn("num", F.coalesce(first, second)).withColumn("at", F.when(first.isNotNull(), 0).when(second.isNotNull(), 1))
    last_num = F.last("num", True).over(Window.partitionBy("doc_id", "tbl").orderBy("row"))
    own = own.withColumn("in_table", last_num)

    heads = with_text(found.filter("tag in ('h1', 'h2', 'h3', 'h4')").select("doc_id", "node", "start", "stop"), found)
    heads = heads.select("doc_id", c("node").alias("pos"), F.regexp_extract(spaced(c("raw")), STEP_HEADING, 1).try_cast("long").alias("set"), F.lit(True).alias("sets"))
    ends = own.groupBy("doc_id", "tbl").agg(F.max_by("num", F.when(c("num").isNotNull(), c("row"))).alias("set"))
    opened = ends.select("doc_id", c("tbl").alias("pos"), "set", c("set").isNotNull())
    lists = found.filter("tag in ('ul', 'ol') and tbl is null and lists = 0 and items = 0").select("doc_id", c("node").alias("pos"), F.lit(None).cast("long"), F.lit(False))
    events = heads.union(opened).union(lists)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    context = events.withColumn("current", F.last(F.when(c("sets"), F.struct("set")), True).over(before)["set"]).select("doc_id", c("pos").alias("holder"), "current")

    own = own.withColumnRenamed("tbl", "holder").join(context, ["doc_id", "holder"]).withColumn("number", F.coalesce("in_table", "current")).filter("number is not null")
    kept = F.when(c("at").isNotNull(), F.filter("texts", lambda v, i: i != c("at"))).otherwise(c("texts"))
    direct = own.select("doc_id", "number", c("row").alias("pos"), kept.alias("cells"), "holder")

    full = cells.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]).alias("cells"))
    deep = rows.join(tables, ["doc_id", "tbl"], "left_anti").select("doc_id", "row")
    spans = own.join(rows.select("doc_id", "row", "last"), ["doc_id", "row"]).select("doc_id", "number", "holder", (c("row") + 1).alias("start"), (c("last") + 1).alias("stop"))
    nested = within(deep, spans, "doc_id", "row").join(full, ["doc_id", "row"], "left").select("doc_id", "number", c("row").alias("pos"), F.coalesce("cells", F.array().cast("array<string>")).alias("cells"), "holder")

    claimed = context.join(found.filter("tag in ('ul', 'ol')").select("doc_id", c("node").alias("holder")), ["doc_id", "holder"]).filter("current is not null")
    items = with_text(found.filter("tag = 'li'").select("doc_id", c("parent").alias("holder"), "node", "start", "stop"), found).withColumn("t", spaced(c("raw"))).filter("t <> ''")
    listed = items.join(claimed, ["doc_id", "holder"]).select("doc_id", c("current").alias("number"), c("node").alias("pos"), F.array("t"), "holder")
    return direct.union(nested).union(listed)


def step_inventory(claims: DataFrame) -> DataFrame:
    """(doc_id, number, title, n_rows, rows, raw_text) of each claimed step: the
    first long cell as title, rows without header rows, and their text; both
    texts are whole, however long."""
    rows = claims.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("all"))
    long = F.filter(F.flatten(F.transform("all", lambda s: s["cells"])), lambda v: number(v).isNull() & ~F.trim(v).rlike("^[0-9]+$") & (F.length(v) > 10))
    kept = F.filter(F.transform("all", lambda s: s["cells"]), lambda v: (F.size(v) > 0) & ~is_header(v))
    rows = rows.select("doc_id", "number", F.coalesce(F.get(long, F.lit(0)), F.lit("")).alias("title"), kept.alias("rows"))
    raw = F.array_join(F.transform("rows", lambda v: F.array_join(v, " | ")), "\n")
    return rows.select("doc_id", "number", "title", F.size("rows").alias("n_rows"), "rows", raw.alias("raw_text"))


def unclaimed_sections(found: DataFrame, sections: DataFrame, claims: DataFrame) -> DataFrame:
    """Sections that neither lie in a table or list claimed by a step nor hold
    one.  Claimed elements never overlap, so the last one that begins before a
    section's end tells."""
    lists = found.filter("tag in ('table', 'ul', 'ol')").select("doc_id", c("node").alias("holder"), "last")
    taken = claims.select("doc_id", "holder").distinct().join(lists, ["doc_id", "holder"])
    marks = taken.select("doc_id", c("holder").alias("pos"), F.struct("holder", "last").alias("claim"), F.lit(None).cast("int").alias("ord"))
    ends = sections.select("doc_id", c("last").alias("pos"), F.lit(None).cast("struct<holder:int,last:int>"), "ord")
    latest = F.last("claim", True).over(Window.partitionBy("doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))
    seen = marks.union(ends).withColumn("latest", latest).filter("ord is not null").select("doc_id", "ord", "latest")
    free = sections.join(seen, ["doc_id", "ord"]).filter(c("latest").isNull() | (c("latest.last") < c("node")))
    return free.drop("latest")


def columns_of(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, tbl, columns, if_then): columns of a table's first row with cells,
    and whether its first row has both if and then words."""
    words = F.lower(F.regexp_replace(c("text"), r"^[…. ]+|[…. ]+$", ""))
    per = cells.groupBy("doc_id", "tbl", "row").agg(F.sum(F.coalesce("colspan", F.lit(1))).alias("columns"), F.max(holds(words, IF_HEADERS)).alias("has_if"), F.max(holds(words, THEN_HEADERS)).alias("has_then"))
    sized = per.groupBy("doc_id", "tbl").agg(F.min_by("columns", "row").alias("columns"))
    head = per.join(rows.filter("nth = 0").select("doc_id", "row"), ["doc_id", "row"], "left_semi").select("doc_id", "tbl", (c("has_if") & c("has_then")).alias("if_then"))
    return sized.join(head, ["doc_id", "tbl"], "left").withColumn("if_then", F.coalesce("if_then", F.lit(False)))


def group_tables(found: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, tbl): tables of limits by group: three rows or more, two columns or
    more, no step and no if/then table, with a period somewhere in them."""
    spans = found.filter("tag = 'table'").select("doc_id", c("node").alias("tbl"), "start", "stop")
    body = with_text(spans, found).select("doc_id", "tbl", spaced(c("raw")).rlike(x.PERIOD).alias("periods"))
    n = rows.groupBy("doc_id", "tbl").agg(F.count("*").alias("n")).filter("n >= 3")
    first_td = cells.filter("tag = 'td'").groupBy("doc_id", "row").agg(F.min_by(F.trim(joined(c("raw"))), "col").alias("v"))
    vals = rows.filter("nth > 0").select("doc_id", "tbl", "row").join(first_td, ["doc_id", "row"], "left").groupBy("doc_id", "tbl").agg(F.max(F.coalesce((c("v") != "") & ~c("v").rlike("^[0-9]+$"), F.lit(False))).alias("worded"))
    good = n.join(body.filter("periods"), ["doc_id", "tbl"]).join(vals.filter("worded"), ["doc_id", "tbl"]).join(columns_of(rows, cells).filter("columns >= 2 and not if_then"), ["doc_id", "tbl"])
    return good.select("doc_id", "tbl")


def group_rows(found: DataFrame, rows: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Limits of group tables (doc_id, tbl, ord, group_name, limit_days,
    limit_months, limit_years, member_submitted_only, special_notes, raw_text,
    is_highlighted)."""
    mine = rows.filter("nth > 0").join(tables.select("doc_id", "tbl").distinct(), ["doc_id", "tbl"], "left_semi").select("doc_id", "tbl", "row", "style")
    n = F.count("*").over(Window.partitionBy("doc_id", "row"))
    cells = cells.withColumn("n", n)
    name = cells.filter("col = 0 and not (n = 1 and colspan is not null)").select("doc_id", "row", F.trim("text").alias("group_name")).filter("group_name <> ''")
    details = cells.filter("col = 1").select("doc_id", "row", F.trim("text").alias("details"), "node", "last")
    noted = F.col("text").rlike(NOTE_WORD) | F.lower("text").contains("exception")
    special = list_items(found, details.select("doc_id", "row", "node", "last"), "row").filter(noted).groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda s: s["text"]).alias("special"))
    out = mine.join(name, ["doc_id", "row"]).join(details.select("doc_id", "row", "details"), ["doc_id", "row"], "left").join(special, ["doc_id", "row"], "left")
    text = F.coalesce("details", F.lit(""))
    unit = F.lower(F.regexp_extract(text, x.PERIOD, 2))
    value = F.regexp_extract(text, x.PERIOD, 1).try_cast("int")
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("row")) - 1
    limits = (F.when(unit.contains(u), value).alias(f"limit_{u}s") for u in ("day", "month", "year"))
    return out.select(
        "doc_id", "tbl", ord_.alias("ord"), "group_name", *limits, F.lower(text).contains("member submitted").alias("member_submitted_only"),
        F.coalesce("special", F.array().cast("array<string>")).alias("special_notes"), text.alias("raw_text"), colour(c("style")).isNotNull().alias("is_highlighted"),
    )


def first_inside(tables: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, of, tbl): the first of ``tables`` below each span."""
    return inside(tables.select("doc_id", c("tbl").alias("node")), spans).groupBy("doc_id", "of").agg(F.min("node").alias("tbl"))


def document_groups(found: DataFrame, rows: DataFrame, cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Group limits of a whole document: the first group table within each table
    that is no step table; the first row of a name counts."""
    spans = found.filter("tag = 'table'").select("doc_id", c("node").alias("tbl"), "node", "last").join(steps.select("doc_id", "tbl"), ["doc_id", "tbl"], "left_anti")
    first = first_inside(group_tables(found, rows, cells), spans)
    each = first.join(group_rows(found, rows, cells, first), ["doc_id", "tbl"])
    w = Window.partitionBy("doc_id", "group_name").orderBy("of", "ord")
    order = Window.partitionBy("doc_id").orderBy("of", "_row")
    once = each.withColumn("n", F.row_number().over(w)).filter("n = 1").withColumnRenamed("ord", "_row")
    return once.withColumn("ord", F.row_number().over(order) - 1).drop("n", "of", "tbl", "_row")


def reference_tables(found: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, ord, name, table_type, contents): rows whose label speaks of valid
    or invalid attachments, then those whose label speaks of codes, with the
    list items beside it."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("col"))
    tds = cells.filter("tag = 'td'").withColumn("n", nth)
    label = tds.filter("n = 1").select("doc_id", "row", c("text").alias("label"))
    beside = tds.filter("n = 2").select("doc_id", "row", "node", "last", c("text").alias("beside"))
    pairs = rows.select("doc_id", "row", "anchor").join(label, ["doc_id", "row"]).join(beside, ["doc_id", "row"])
    valid, invalid, attach = (lambda t, p=p: t.rlike(p) for p in (r"(?i)\bvalid\b", r"(?i)\binvalid\b", r"(?i)\battachment|POTF\b"))
    kind = F.when(valid(c("label")) & ~invalid(c("label")), F.when(attach(c("label")) | attach(c("beside")), "POTF_VALID")).when(invalid(c("label")), "POTF_INVALID")
    by_id = F.when(c("anchor").contains("valid-potf") & ~c("anchor").contains("invalid"), "POTF_VALID").when(c("anchor").contains("invalid-potf"), "POTF_INVALID")
    potf = pairs.withColumn("table_type", F.coalesce(by_id, kind)).filter("table_type is not null").withColumn("way", F.lit(0))
    codes = pairs.filter(c("label").rlike(r"(?i)\bcode\b")).withColumn("table_type", F.lit("CODE_LOOKUP")).withColumn("way", F.lit(1))
    both = potf.union(codes)
    items = list_items(found, beside).filter("true").select("doc_id", "of", c("node").alias("item"), "items", "text")
    full = both.join(items.withColumnRenamed("of", "node"), ["doc_id", "node"]).filter((c("way") == 1) | (c("items") == 0))
    tables = full.groupBy("doc_id", "row", "way", "label", "table_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda s: s["text"]).alias("contents"))
    order = Window.partitionBy("doc_id").orderBy("way", "row")
    return tables.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), F.trim("label").alias("name"), "table_type", "contents")


def sub_procedures(found: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, tbl, ord, name, heading): step tables but the primary one, named
    by the nearest text before them that looks like a heading."""
    subs = tables.filter("place > 1")
    titles = with_text(found.filter(c("tag").isin(*NEAREST)).select("doc_id", "node", "start", "stop"), found).withColumn("t", joined(c("raw")))
    good = titles.filter(F.length("t").between(6, 119) & ~F.trim("t").rlike("^[0-9]+$"))
    good = good.withColumn("t", F.trim(F.regexp_replace("t", r"(?i)[↑↓]\s*(Back|Top|Menu).*", ""))).filter("t <> ''")
    marks = good.select("doc_id", c("node").alias("pos"), "t", F.lit(None).cast("int").alias("tbl"))
    before = F.last("t", True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    named = marks.union(subs.select("doc_id", c("tbl").alias("pos"), F.lit(None).cast("string"), "tbl")).withColumn("heading", before).filter("tbl is not null").select("doc_id", "tbl", F.coalesce("heading", F.lit("")).alias("heading"))
    fallback = F.concat(F.lit("Sub-Procedure ("), c("first_step").cast("string"), F.lit("–"), c("last_step").cast("string"), F.lit(")"))
    order = Window.partitionBy("doc_id").orderBy("place")
    return subs.join(named, ["doc_id", "tbl"]).select("doc_id", "tbl", (F.row_number().over(order) - 1).alias("ord"), F.when(c("heading") != "", c("heading")).otherwise(fallback).alias("name"), "heading")


def sub_steps(found: DataFrame, rows: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Steps of sub-procedures, their question led by where they are."""
    subs = sub_procedures(found, tables)
    mine = step_cells(rows, cells, tables.filter("place > 1"), nested=True)
    details = step_details(found, mine).join(subs.select("doc_id", "tbl", c("ord").alias("sub"), "name", "heading"), ["doc_id", "tbl"])
    lead = F.concat(F.lit("["), F.when(c("heading") != "", c("heading")).otherwise("SUB"), F.lit(" Step "), c("number").cast("string"), F.lit("] "))
    return details.withColumn("question", F.concat(lead, F.ltrim("question"))).drop("heading")


def wide_title(cells: DataFrame) -> DataFrame:
    """(doc_id, wide): the first cell over two columns or more with a text of 9
    to 119 characters, where neither title nor first heading gives one."""
    return cells.filter((F.coalesce("colspan", F.lit(1)) >= 2) & F.length("text").between(9, 119)).groupBy("doc_id").agg(F.min_by("text", "node").alias("wide"))


def metadata(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Title (title tag, else first heading, else a wide cell) and the effective
    and revision dates that a document's text names; empty where there is none."""
    heads = with_text(found.filter("tag in ('title', 'h1')").select("doc_id", "node", "tag", "start", "stop"), found)
    clean = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    first = heads.groupBy("doc_id").agg(*(F.min_by(clean(spaced(c("raw"))), F.when(c("tag") == t, c("node"))).alias(t) for t in ("title", "h1")))
    whole = found.filter("tag = '#document'").select("doc_id", spaced(c("text")).alias("whole"))
    out = whole.join(first, "doc_id", "left").join(wide_title(cells), "doc_id", "left")
    date = lambda p: F.regexp_extract("whole", p, 1)
    filled = lambda name: F.nullif(c(name), F.lit(""))
    return out.select("doc_id", F.coalesce(filled("title"), filled("h1"), clean(c("wide")), F.lit("")).alias("title"), date(r"(?i)(?:original\s+)?effective\s+date[:\s]*([0-9/\-]+)").alias("effective_date"), date(r"(?i)revision\s+date[:\s]*([0-9/\-]+)").alias("revision_date"))
