"""Markup as rows: every element and every piece of text of a document.

One pass over a document writes its nodes in document order.  A node holds its
subtree as a range of node numbers and its text as a range of characters of the
document's text, which is stored once, so the rows stay linear in the markup
however deep it nests.  What the nodes mean is said with DataFrames.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
UNREAD = ("script", "style", "template")
CELLS = ("td", "th")
PARTS = ("tr", "tbody", "thead", "tfoot")
CLOSED_BY = {
    "p": ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "blockquote", "section", "td", "th", "tr", "li"),
    "a": ("a",),
    "li": ("li",),
    "td": (*CELLS, *PARTS),
    "th": (*CELLS, *PARTS),
    "tr": PARTS,
    "thead": PARTS[1:],
    "tbody": PARTS[1:],
}
GAP = "\x1f"
FLUSH = 50_000
NODE = pa.schema(
    [
        ("doc_id", pa.int64()), ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()),
        ("tbl", pa.int32()), ("row", pa.int32()), ("cell", pa.int32()), ("items", pa.int32()), ("lists", pa.int32()),
        ("anchor", pa.string()), ("href", pa.string()), ("style", pa.string()), ("colspan", pa.int32()), ("has_td", pa.bool_()),
        ("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string()),
    ]
)
NODES = "doc_id long, node int, last int, parent int, tag string, tbl int, row int, cell int, items int, lists int, anchor string, href string, style string, colspan int, has_td boolean, start int, stop int, text string"


class _Nodes(HTMLParser):
    """The nodes of one document, as lists in the order of ``NODE`` without the id."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple] = []
        self.held: Counter = Counter()
        self.unread = 0
        self.bare: list[int] = []  # open rows without a td so far
        self.pieces: list[str] = []
        self.chars = 0

    def _around(self) -> tuple:
        """Of the innermost open element: node, and nearest table, row, cell
        with itself among them, and how many list items and lists are open."""
        return self.open[-1][1:] if self.open else (None, None, None, None, 0, 0)

    def _next(self) -> int:
        return self.chars + (1 if self.pieces else 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNREAD:
            self.unread += 1
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._leave()
        parent, tbl, row, cell, items, lists = self._around()
        node, known = len(self.rows), dict(attrs)
        span = known.get("colspan") or ""
        at = self._next()
        self.rows.append([node, node, parent, tag, tbl, row, cell, items, lists, known.get("id") or "", known.get("href"), known.get("style") or "", int(span) if span.isascii() and span.isdigit() and len(span) < 9 else None, False, at, at, None])
        if tag == "td":
            for up in self.bare:
                self.rows[up][13] = True
            self.bare.clear()
        elif tag == "tr":
            self.bare.append(node)
        if tag not in VOID:
            self.held[tag] += 1
            self.open.append((tag, node, node if tag == "table" else tbl, node if tag == "tr" else None if tag == "table" else row, node if tag in CELLS else None if tag in ("table", "tr") else cell, items + (tag == "li"), lists + (tag in ("ul", "ol"))))

    def _leave(self) -> str:
        tag, node, *_ = self.open.pop()
        self.held[tag] -= 1
        if self.bare and self.bare[-1] == node:
            self.bare.pop()
        row = self.rows[node]
        row[1], row[15] = len(self.rows) - 1, max(row[14], self.chars)
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag in UNREAD:
            self.unread = max(0, self.unread - 1)
        if self.held[tag]:
            while self._leave() != tag:
                pass

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not self.unread:
            piece = piece.replace(GAP, " ")
            parent, tbl, row, cell, items, lists = self._around()
            node, at = len(self.rows), self._next()
            self.pieces.append(piece)
            self.chars = at + len(piece)
            self.rows.append([node, node, parent, "#text", tbl, row, cell, items, lists, "", None, "", None, False, at, self.chars, piece])

    def close(self) -> None:
        super().close()
        while self.open:
            self._leave()


def nodes_of(html: str | None) -> list[list]:
    """The nodes of a text, and last the document itself as node -1."""
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    document = [-1, len(parser.rows) - 1, None, "#document", None, None, None, 0, 0, "", None, "", None, False, 0, parser.chars, GAP.join(parser.pieces)]
    return [*parser.rows, document]


def nodes(pages: DataFrame) -> DataFrame:
    """The nodes of ``pages`` (doc_id, html), in document order:

    node and ``last``, the last one in its subtree; parent; tag, "#text" for a
    piece of text and "#document" for the whole; tbl, row and cell, the nearest
    table around the node and, within that table, its row and cell; items and
    lists, how many list items and lists are around it; anchor (its id), href
    and colspan (null if it has none), style; has_td, whether a row holds a td;
    start and stop, its text in the document's text; text, of pieces and
    documents only.  A null html is an empty document: one row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for doc_id, html in zip(batch.column("doc_id").to_pylist(), batch.column("html").to_pylist()):
                out += [(doc_id, *r) for r in nodes_of(html)]
                if len(out) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODE)], schema=NODE)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODE)], schema=NODE)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(read, NODES)


def ended_references(html: Column) -> Column:
    """Markup in which only references that end in a semicolon are read, as a
    parser for browsers also reads ``&amp`` and ``&copy=``: other ampersands are
    written out."""
    return F.regexp_replace(html, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def documents(found: DataFrame) -> DataFrame:
    """(doc_id, whole): the text of each document, pieces parted by ``GAP``."""
    return found.filter("tag = '#document'").select("doc_id", F.col("text").alias("whole"))


def spaced(text: Column) -> Column:
    """Pieces of a text parted by spaces."""
    return F.translate(text, GAP, " ")


def joined(text: Column) -> Column:
    """Pieces of a text one after another."""
    return F.replace(text, F.lit(GAP), F.lit(""))


def with_text(rows: DataFrame, found: DataFrame, name: str = "raw") -> DataFrame:
    """``rows`` (doc_id, start, stop, ...) with their text, cut from the document's."""
    cut = F.substr(F.col("whole"), F.col("start") + 1, F.col("stop") - F.col("start"))
    return rows.join(documents(found), "doc_id").withColumn(name, cut).drop("whole")
