"""Documents as rows: HTML elements, tables, links, and claim print images.

Python reads markup into element rows, one document at a time; what the rows
mean (links, trees, step tables, decisions) is said with DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions import decisions as d
from rulespan.functions import extract as x
from rulespan.functions import values as v

# Tags that matter, and header words of decision tables.
BLOCKS = ("section", "article", "header", "footer", "nav", "main", "aside", "div", "h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "table", "tr", "td", "th", "a", "title", "blockquote", "pre", "b", "strong", "em")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDDEN = ("script", "style", "noscript", "template")
IF_WORDS = ("if", "if…", "if...", "condition", "situation", "when")
THEN_WORDS = ("then", "then…", "then...", "action", "result", "outcome")
CLOSED_BY = {"p": ("p", "h1", "h2", "h3", "h4", "ul", "ol", "table", "div"), "li": ("li",), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}

ELEMENTS = "doc_id long, ord int, parent int, depth int, tag string, anchor string, href string, text string"


class _Elements(HTMLParser):
    """Collects [ord, parent, depth, tag, id, href, first piece, last piece] of
    block tags, and every piece of text once; an element's text is a range of
    the pieces.  ``own`` has for each element the pieces that are in no other
    element of its tag below it, so a piece is noted once a tag at most and
    markup that is never closed stays linear."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.pieces: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.inner: dict[str, list[int]] = {}
        self.own: list[list[str]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._leave()
        if tag in BLOCKS and tag not in VOID:
            known = dict(attrs)
            parent = self.open[-1][1] if self.open else None
            self.rows.append([len(self.rows), parent, len(self.open), tag, known.get("id") or "", (known.get("href") or "").strip(), len(self.pieces), None])
            self.own.append([])
            self.open.append((tag, len(self.rows) - 1))
            self.inner.setdefault(tag, []).append(len(self.rows) - 1)

    def _leave(self) -> str:
        tag, i = self.open.pop()
        self.inner[tag].pop()
        self.rows[i][7] = len(self.pieces)
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.inner.get(tag):
            while self._leave() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and not self.hidden and data.strip():
            self.pieces.append(data)
            for open_ in self.inner.values():
                if open_:
                    self.own[open_[-1]].append(data)

    def text(self, row: list) -> str:
        """All text of an element."""
        return " ".join(" ".join(self.pieces[row[6] : row[7]]).split())


def _parsed(html: str | None) -> _Elements:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    return parser


def html_elements(pages: DataFrame) -> DataFrame:
    """Block elements of ``pages`` (doc_id, html) in document order, each with its
    text but that of elements of its own tag inside it: links, titles and
    headings, which do not nest, have all of theirs.  Texts of whole subtrees
    are read with :mod:`rulespan.operators.markup`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, html in zip(batch.column("doc_id").to_pylist(), batch.column("html").to_pylist()):
                parser = _parsed(html)
                out += [(doc_id, *r[:6], " ".join(" ".join(own).split())) for r, own in zip(parser.rows, parser.own)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "ord", "parent", "depth", "tag", "anchor", "href", "text"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(read, ELEMENTS)


def table_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, tbl, row, cells, headers, head) of the tables of ``pages`` (doc_id,
    html): the cells of a row, which of them are headers, and the cells of the
    table's first row.  Cells follow their row, rows their table; one pass."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, html in zip(batch.column("doc_id").to_pylist(), batch.column("html").to_pylist()):
                parser, at, tables = _parsed(html), {"table": None, "tr": None}, {}
                for r in parser.rows:
                    if r[3] in at:
                        at[r[3]] = r[0]
                    elif r[3] in ("td", "th"):
                        tables.setdefault(at["table"], {}).setdefault(at["tr"], []).append((parser.text(r), r[3] == "th"))
                for tbl, rows in tables.items():
                    ordered = [rows[k] for k in sorted(rows, key=lambda k: (k is not None, k))]
                    head = [t for t, _ in ordered[0]]
                    out += [(doc_id, tbl, i, [t for t, _ in cells], [h for _, h in cells], head) for i, cells in enumerate(ordered)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "tbl", "row", "cells", "headers", "head"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(read, "doc_id long, tbl int, row int, cells array<string>, headers array<boolean>, head array<string>")


def links(elements: DataFrame) -> DataFrame:
    """Links of each document, the first of an address kept, with their type.
    Empty addresses stay only where the text names a document."""
    found = elements.filter("tag = 'a'").groupBy("doc_id", "href").agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"))
    blank = F.col("href").isin("", "#")
    kept = found.filter(~blank | x.looks_like_reference(F.col("text")))
    return kept.withColumn("link_type", v.link_type(F.col("href")))


def anchors(elements: DataFrame) -> DataFrame:
    """In-page links with the element they lead to, if there is one.  Both sides
    are merged: anchors may be long and alike, so their size on disk is no
    measure for a broadcast."""
    targets = elements.filter("anchor <> ''").groupBy("doc_id", "anchor").agg(F.min("ord").alias("target")).hint("merge")
    inside = elements.filter("tag = 'a' and href like '#_%'").withColumn("anchor", F.expr("substring(href, 2)"))
    return inside.select("doc_id", "ord", "anchor").join(targets, ["doc_id", "anchor"], "left").withColumn("unresolved", F.col("target").isNull())


def dom_edges(elements: DataFrame) -> DataFrame:
    """HAS_CHILD and NEXT_SIBLING edges between elements."""
    child = elements.filter("parent is not null").select("doc_id", F.col("parent").alias("source"), F.col("ord").alias("target"), F.lit("HAS_CHILD").alias("rel"))
    after = F.lead("ord").over(Window.partitionBy("doc_id", "parent").orderBy("ord"))
    sibling = elements.select("doc_id", F.col("ord").alias("source"), after.alias("target"), F.lit("NEXT_SIBLING").alias("rel")).filter("target is not null")
    return child.union(sibling)


def table_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, tbl, row, col, text, header) of table rows, a row a cell."""
    each = rows.select("doc_id", "tbl", "row", F.posexplode(F.arrays_zip(F.col("cells").alias("text"), F.col("headers").alias("header"))).alias("col", "cell"))
    return each.select("doc_id", "tbl", "row", "col", "cell.text", "cell.header")


def step_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, tbl, col, first_step, n_steps): tables whose column 0 or 1 holds
    consecutive whole numbers from its first data row on, two at least."""
    data = cells.filter("not header and col <= 1").withColumn("num", F.when(F.col("text").rlike("^[0-9]+$"), F.col("text").try_cast("int")))
    w = Window.partitionBy("doc_id", "tbl", "col").orderBy("row")
    placed = data.withColumn("n", F.row_number().over(w)).withColumn("broken", F.max(F.col("num").isNull().cast("int")).over(w))
    runs = placed.filter("broken = 0").groupBy("doc_id", "tbl", "col").agg(F.min("num").alias("first_step"), F.count("*").alias("n_steps"), F.countDistinct(F.col("num") - F.col("n")).alias("shifts"))
    good = runs.filter("n_steps >= 2 and shifts = 1")
    return good.groupBy("doc_id", "tbl").agg(F.min("col").alias("col"), F.min_by("first_step", "col").alias("first_step"), F.min_by("n_steps", "col").alias("n_steps"))


def decision_rows(rows: DataFrame) -> DataFrame:
    """Rows of if/then and if/and/then tables with disposition, codes and target;
    in three columns a blank first cell takes the one above."""
    cell = lambda column, i: F.get(column, F.lit(i))
    three = F.size("head") >= 3
    then_head = F.lower(F.when(three, cell("head", 2)).otherwise(cell("head", 1)))
    rows = rows.filter(F.lower(cell("head", 0)).isin(*IF_WORDS) & then_head.isin(*THEN_WORDS) & (F.col("row") > 0))
    rows = rows.select("doc_id", "tbl", "row", three.alias("three"), *(cell("cells", i).alias(f"c{i}") for i in range(3)))
    above = F.last(F.nullif("c0", F.lit("")), True).over(Window.partitionBy("doc_id", "tbl").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    then = F.coalesce(F.when(F.col("three"), F.col("c2")).otherwise(F.col("c1")), F.lit(""))
    first = F.coalesce(F.when(F.col("three"), above).otherwise(F.col("c0")), F.lit(""))
    also = F.coalesce(F.when(F.col("three"), F.col("c1")), F.lit(""))
    return rows.select("doc_id", "tbl", "row", first.alias("condition_if"), also.alias("condition_and"), then.alias("action"), d.classify_decision_document(then).alias("decision"), x.document_codes(F.concat_ws(" ", first, also, then)).alias("codes"), F.regexp_extract(then, r"[Ss]kip\s+to\s+[Ss]tep\s+([0-9]+)", 1).try_cast("int").alias("skip_to"))


# Fixed value: the layout of a service line in a claim's print image.
SERVICE_LINE = r"^\s*\|\s*([0-9]{6})\s+([0-9]{6})\s*\|\s*([0-9]{2})\s*\|\s*([A-Z0-9]{0,2})\s*\|\s*([0-9]{5})\s*((?:\s+[A-Z0-9]{2,4}){0,4})\s*\|\s*([A-L]{1,4}|[0-9]{1,4})\s*\|\s*([0-9]+\.[0-9]{2})\s*\|\s*([0-9]+(?:\.[0-9]+)?)\s*\|\s*([0-9]{4})\s*\|\s*([NY])\s*\|"
TOTALS = r"\|\s*([0-9]{9})\s+(?:EIN|SSN)\s*\|\s*([A-Z0-9]+)\s*\|\s*([A-Z/ ]+?)\s*\|\s*([0-9]+\.[0-9]{2})\s*\|\s*(\.?[0-9]+\.?[0-9]*)\s*\|"
DIAGNOSIS = r"\b([0-9]+)\s*\|?\s*[A-L]?\s*([A-Z][0-9][0-9A-Z](?:\.?[0-9A-Z]{1,4})?)\b"


def short_date(text: Column) -> Column:
    """A MMDDYY date; two-digit years above 68 are of the last century."""
    day = F.to_date(text, "MMddyy")
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)


def service_lines(claims: DataFrame) -> DataFrame:
    """Service lines of print images (claim_id, content), numbered from 1."""
    split = claims.select("claim_id", F.posexplode(F.split("content", "\n")).alias("at", "line")).filter(F.col("line").rlike(SERVICE_LINE))
    part = lambda i: F.regexp_extract("line", SERVICE_LINE, i)
    pointer = part(7)
    letters = F.transform(F.filter(F.split(pointer, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch) - F.lit(64))
    numbers = F.transform(F.filter(F.split(pointer, ""), lambda ch: (ch != "") & (ch != "0")), lambda ch: ch.try_cast("int"))
    return split.select(
        "claim_id",
        F.row_number().over(Window.partitionBy("claim_id").orderBy("at")).alias("line_no"),
        short_date(part(1)).alias("from_date"),
        short_date(part(2)).alias("to_date"),
        part(3).alias("place"),
        part(5).alias("cpt"),
        F.filter(F.split(F.trim(part(6)), r"\s+"), lambda m: m != "").alias("modifiers"),
        F.when(pointer.rlike("^[A-L]+$"), letters).otherwise(numbers).alias("pointers"),
        part(8).cast("double").alias("charge"),
        part(9).cast("double").alias("units"),
        part(11).alias("emergency"),
    )


def claim_totals(claims: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("content", TOTALS, i)
    return claims.select("claim_id", F.nullif(part(2), F.lit("")).alias("account"), v.money(part(4)).alias("total_charge"), v.money(part(5)).alias("patient_paid"))


def claim_diagnoses(claims: DataFrame) -> DataFrame:
    """Diagnosis pointers and codes of the row between boxes 21 and 23."""
    row = F.regexp_extract("content", r"(?s)\|21\s+DIAGNOSIS.*?\|\s*(.*?)\|\|\s*23 PRIOR", 1)
    both = F.arrays_zip(F.regexp_extract_all(row, F.lit(DIAGNOSIS), F.lit(1)).alias("p"), F.regexp_extract_all(row, F.lit(DIAGNOSIS), F.lit(2)).alias("code"))
    return claims.select("claim_id", F.explode(F.array_distinct(both)).alias("z")).select("claim_id", F.col("z.p").cast("int").alias("pointer"), F.col("z.code").alias("code"))


def page_ranges(steps: DataFrame) -> DataFrame:
    """Pages of document steps (doc_id, step, page or null): gaps take their
    neighbour's page, a step ends where the next begins."""
    from rulespan.operators.ordered import fill_both_ways

    filled = fill_both_ways(steps, "doc_id", ["step"], "page")
    return filled.withColumn("last_page", F.coalesce(F.lead("page").over(Window.partitionBy("doc_id").orderBy("step")), "page"))


def step_plan(entities: DataFrame) -> DataFrame:
    """Steps of a scanned document (doc_id, step, entity_id, text): fragments of
    one number together, the shortest text as title."""
    return entities.groupBy("doc_id", "step").agg(F.min_by("text", F.struct(F.length("text").alias("n"), F.col("entity_id").alias("i"))).alias("title"), F.array_sort(F.collect_list("entity_id")).alias("entities"))


def confidence(fields: Column, lists: Column) -> Column:
    """Mean of field confidences and of 0.95 for each listed item, to 3 places."""
    total = F.aggregate(fields, F.lit(0.0), lambda a, b: a + b) + lists * 0.95
    return F.round(total / F.greatest(F.size(fields) + lists, F.lit(1)), 3)
