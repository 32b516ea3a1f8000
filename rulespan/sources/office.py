"""Workbooks and text documents from their zip containers, as rows.

Read them with ``spark.read.format("binaryFile")``; a task holds one file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Header names of a claim-number column.
CLAIM_HEADERS = ("claim_id", "claim id", "claimid", "claim number", "claim_number", "claim")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _cells(content: bytes) -> list[tuple]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"] if "xl/workbook.xml" in names else []
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for i, name in enumerate(files):
            for c in (c for c in ET.fromstring(z.read(name)).iter() if _tag(c) == "c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for ch in letters:
                    col = 26 * col + ord(ch) - 64
                text = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
                text = shared[int(text)] if c.get("t") == "s" and text else text
                out.append((i, titles[i] if i < len(titles) else name, int(row) - 1, col - 1, text))
    return out


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, row, col, value) of workbooks (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path, *r) for r in _cells(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "sheet_no", "sheet", "row", "col", "value"])

    return files.select("path", "content").mapInArrow(read, "path string, sheet_no int, sheet string, row int, col int, value string")


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, header_row): the first of five rows with three texts in five."""
    rows = cells.filter("row < 5 and trim(value) <> ''").groupBy("path", "sheet_no", "row").agg(F.count("*").alias("n"), F.count_if(~F.col("value").rlike(r"^-?[0-9.]+$")).alias("texts"))
    return rows.filter("texts >= 0.6 * n").groupBy("path", "sheet_no").agg(F.min("row").alias("header_row"))


def claim_ids(cells: DataFrame) -> DataFrame:
    """Claim numbers of each workbook's first sheet, in order, repeats kept."""
    first = cells.filter("sheet_no = 0")
    heads = first.join(header_rows(first), ["path", "sheet_no"]).filter("row = header_row").filter(F.lower(F.trim("value")).isin(*CLAIM_HEADERS))
    column = heads.groupBy("path", "header_row").agg(F.min("col").alias("col"))
    return first.join(column, ["path", "col"]).filter("row > header_row and trim(value) <> ''").select("path", "row", F.trim("value").alias("claim_id"))


def billing_grid(cells: DataFrame) -> DataFrame:
    """(cpt_pay, cpt_deny, modifier) of all sheets: the header may be anywhere in
    the first 250 rows; rows marked "not found" go."""
    wanted = ("cpt pay", "cpt deny", "modifier")
    heads = cells.filter("row < 250").withColumn("h", F.lower(F.trim("value"))).filter(F.col("h").isin(*wanted))
    full = heads.groupBy("path", "sheet_no", "row").agg(F.countDistinct("h").alias("k")).filter("k = 3").groupBy("path", "sheet_no").agg(F.min("row").alias("header_row"))
    names = heads.join(full, ["path", "sheet_no"]).filter("row = header_row").select("path", "sheet_no", "header_row", "col", "h")
    body = cells.join(names, ["path", "sheet_no", "col"]).filter("row > header_row")
    rows = body.groupBy("path", "sheet_no", "row").agg(*(F.max(F.when(F.col("h") == h, F.trim("value"))).alias(h.replace(" ", "_")) for h in wanted))
    return rows.filter("cpt_pay is not null and cpt_deny is not null and lower(coalesce(modifier, '')) not like '%not found%'")


def workbook_kind(cells: DataFrame) -> DataFrame:
    """(path, kind) by the words of the top rows."""
    text = F.lower(F.array_join(F.collect_list(F.when(F.col("row") < 20, F.col("value"))), " "))
    kind = F.when(F.col("t").rlike("calculator|calculate"), "CALCULATOR").when(F.col("t").rlike(r"\bcodes?\b"), "CODE_TABLE").when(F.col("t").rlike(r"\brules?\b"), "RULE_TABLE").otherwise("GENERIC")
    return cells.groupBy("path").agg(text.alias("t")).select("path", kind.alias("kind"))


def _paragraphs(content: bytes) -> list[tuple]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        inside = {id(p): (t, r, c) for t, table in enumerate(x for x in body.iter() if _tag(x) == "tbl") for r, row in enumerate(x for x in table if _tag(x) == "tr") for c, cell in enumerate(x for x in row if _tag(x) == "tc") for p in cell.iter() if _tag(p) == "p"}
        for n, p in enumerate(x for x in body.iter() if _tag(x) == "p"):
            style = next((v for s in p.iter() if _tag(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
            text = "".join(t.text or "" for t in p.iter() if _tag(t) == "t").strip()
            out.append((n, style, text, *inside.get(id(p), (None, None, None))))
    return out


def text_paragraphs(files: DataFrame) -> DataFrame:
    """(path, pos, style, text, tbl, row, col) of text documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path, *r) for r in _paragraphs(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "pos", "style", "text", "tbl", "row", "col"])

    return files.select("path", "content").mapInArrow(read, "path string, pos int, style string, text string, tbl int, row int, col int")


def text_sections(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs outside tables under the heading above them."""
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.lower("style").startswith("heading")
    outside = paragraphs.filter("tbl is null and text <> ''")
    return outside.withColumn("heading", F.last(F.when(heading, F.col("text")), True).over(w)).filter(~heading).select("path", "pos", "heading", "text")
