"""Containers, nested text and merges on inline data."""

import io
import zipfile

from pyspark.sql import functions as F

from rulespan.functions import fuzzy, jsontext
from rulespan.operators import documents, merge
from rulespan.operators.sets import union_first_wins
from rulespan.sources import office


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets>" + "".join(f'<sheet name="{n}"/>' for n in sheets) + "</sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Claim ID</t></si></sst>")
        for i, rows in enumerate(sheets.values()):
            cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="{"s" if v == 0 else "inlineStr"}">' + (f"<v>{v}</v>" if v == 0 else f"<is><t>{v}</t></is>") + "</c>" for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark):
    one = workbook({"A": [["Title"], [0, "x"], ["C1", "1"], [" ", "2"], ["C2", "3"], ["C1", "4"]]})
    two = workbook({"G": [["intro"], ["CPT Pay", "CPT Deny", "Modifier"], ["99213", "99214", "Allowed with 25"], ["1", "2", "Not found"]], "H": [["cpt pay", "modifier", "cpt deny"], ["3", "ok", "4"]]})
    cells = office.workbook_cells(spark.createDataFrame([("one", one), ("two", two)], "path string, content binary"))
    assert cells.filter("path = 'one' and row = 1 and col = 0").first()["value"] == "Claim ID"
    heads = {(r["path"], r["sheet_no"]): r["header_row"] for r in office.header_rows(cells).collect()}
    assert heads[("two", 1)] == 0
    ids = office.claim_ids(cells.filter("row > 0")).orderBy("row").collect()
    assert [r["claim_id"] for r in ids] == ["C1", "C2", "C1"]
    assert sorted(tuple(r)[3:] for r in office.billing_grid(cells).collect()) == [("3", "4", "ok"), ("99213", "99214", "Allowed with 25")]


def test_text_documents(spark):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("One", "Heading1") + p("a") + "<w:tbl><w:tr><w:tc>" + p("cell") + "</w:tc></w:tr></w:tbl>" + p("Two", "Heading2") + p("b")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    rows = office.text_paragraphs(spark.createDataFrame([("d", out.getvalue())], "path string, content binary"))
    assert rows.filter("tbl is not null").count() == 1
    assert [(r["heading"], r["text"]) for r in office.text_sections(rows).orderBy("pos").collect()] == [("One", "a"), ("Two", "b")]


def test_elements(spark):
    html = '<div id="top"><p>one<p>two <b>x</b></div><ul><li>a<li>b</ul><a href="#top">up</a><a href="#no">lost</a><script>var a="<p>";</script>'
    rows = documents.html_elements(spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string"))
    got = [(r["tag"], r["parent"], r["text"]) for r in rows.orderBy("ord").collect()]
    assert got == [("div", None, "one two x"), ("p", 0, "one"), ("p", 0, "two x"), ("b", 2, "x"), ("ul", None, "a b"), ("li", 4, "a"), ("li", 4, "b"), ("a", None, "up"), ("a", None, "lost")]
    assert {(r["anchor"], r["unresolved"]) for r in documents.anchors(rows).collect()} == {("top", False), ("no", True)}


def test_nested_text(spark):
    rows = spark.createDataFrame([('{"a": {"k": null}, "b": [{"k": 1}, {"k": ""}]}',), ("not json",), (None,)], "j string")
    j = F.col("j")
    out = rows.select(jsontext.find_last_first(j, "k"), jsontext.find_first(j, "k"), jsontext.prune(j)).collect()
    assert [tuple(r) for r in out] == [("1", None, '{"b": [{"k": 1}, {}]}'), (None, None, None), (None, None, None)]
    calls = rows.select(jsontext.guarded(F.col("j"), lambda t: '{"ok": 1}' if t else "?", ("ok",), '{"ok": 0}')).collect()
    assert [r[0] for r in calls] == ['{"ok": 1}', '{"ok": 1}', '{"ok": 0}']


def test_similarity(spark):
    df = spark.createDataFrame([("MEDICARE", "MEDICARE"), ("ABCD", "BCDE"), ("", "X")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.similarity_percent(F.col("a"), F.col("b"))).collect()] == [100.0, 75.0, 0.0]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, note string")
    new = spark.createDataFrame([(2, "c", ""), (3, "d", None)], "k int, v string, note string")
    assert sorted(tuple(r) for r in merge.upsert(old, new, ["k"], ("note",)).collect()) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]
    assert sorted(r["v"] for r in union_first_wins([new, old], "k").collect()) == ["a", "c", "d"]
    path = f"{tmp_path}/t"
    merge.write_partitions(old, path, "k")
    merge.write_partitions(new, path, "k")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == ["a", "c", "d"]
