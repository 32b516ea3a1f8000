"""Markup as nodes, ranges, and odd documents."""

import random
import time

from rulespan.operators import markup as mk
from rulespan.operators import sections as sc
from rulespan.operators.ranges import within


def test_points_meet_the_spans_that_hold_them(spark):
    r = random.Random(4)
    points = [(r.choice("ab"), r.randrange(200), i) for i in range(150)]
    spans = [(r.choice("abc"), a, a + r.choice([0, 1, 2, 3, 7, 64, 150]), i) for i, a in enumerate(r.randrange(190) for _ in range(60))]
    p = spark.createDataFrame(points, "k string, at int, p int")
    s = spark.createDataFrame(spans, "k string, start int, stop int, s int")
    got = sorted((x["p"], x["s"]) for x in within(p, s, "k", "at").collect())
    assert got == sorted((i, j) for k, at, i in points for q, a, b, j in spans if k == q and a <= at < b)
    assert within(p, s.limit(0), "k", "at").count() == 0


def test_nodes_keep_their_ranges_and_text():
    rows = mk.nodes_of("<div id=x>a<p> b <p>c<ul><li>d<li>e<ul><li>f</ul></ul><script>no</script><br>g</div>h")
    tags = [(r[3], rows[r[2]][3] if r[2] is not None else None) for r in rows[:-1] if r[3] != "#text"]
    assert tags == [("div", None), ("p", "div"), ("p", "div"), ("ul", "div"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("script", "div"), ("br", "div")]
    whole = rows[-1][16]
    texts = {r[0]: whole[r[14] : r[15]].split(mk.GAP) for r in rows[:-1] if r[3] in ("div", "li", "ul")}
    assert texts[0] == list("abcdefg") and list(texts.values())[-1] == ["f"]
    assert [r[8] for r in rows[:-1] if r[3] == "#text"] == [0, 0, 0, 1, 1, 2, 0, 0] and whole.split(mk.GAP) == list("abcdefgh")


def test_deep_markup_stays_linear():
    took = time.process_time()
    for piece in ("<div>x", "<table><tr><td>x", "<ul><li>x", "<a href=y>x", "<div><b>x</b>"):
        rows = mk.nodes_of(piece * 30_000)
        assert sum(len(r[16] or "") for r in rows) < 4 * 30_000 and rows[-1][1] == len(rows) - 2
    assert time.process_time() - took < 30


def test_odd_documents(spark):
    html = [(1, None), (2, ""), (3, "no markup"), (4, "<table>"), (5, "<tr><td>1</td><td>x</td></tr>"), (6, "<table><tr><td colspan='x'>1</td></tr><tr><td>2</td><td></td></tr><tr></tr></table>"), (None, "<h1>t</h1>"), (3, "twice")]
    found = mk.nodes(spark.createDataFrame(html, "doc_id long, html string"))
    rows, cells = sc.table_rows(found), sc.table_cells(found)
    tables = sc.ranked_step_tables(sc.step_tables(rows, cells))
    assert [(r["doc_id"], r["col"], r["n_steps"]) for r in tables.collect()] == [(6, 0, 2)]
    steps = sc.step_cells(rows, cells, tables)
    assert [(r["number"], r["text"]) for r in steps.collect()] == [(2, "")]  # step 1 has no cell beside its number
    for out in (sc.step_details(found, steps), sc.step_branches(found, steps), sc.notes(found, steps), sc.notes(found), sc.business_fields(rows, cells), sc.labelled_sections(found, rows, cells, tables), sc.reference_tables(found, rows, cells), sc.document_groups(found, rows, cells, tables), sc.sub_steps(found, rows, cells, tables), sc.metadata(found, cells)):
        out.collect()
    assert {r["number"]: r["rows"] for r in sc.step_inventory(sc.step_claims(found, rows, cells)).collect()} == {1: [], 2: []}


def test_step_texts_are_whole(spark):
    long, lines = "a long cell " * 900 + "end", [f"line {i} of the step" for i in range(400)]
    html = f"<table><tr><td>1</td><td>{long}</td></tr>{''.join(f'<tr><td>{t}</td></tr>' for t in lines)}</table>"
    found = mk.nodes(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    (out,) = sc.step_inventory(sc.step_claims(found, sc.table_rows(found), sc.table_cells(found))).collect()
    assert out["title"] == long and out["n_rows"] == 401
    assert out["raw_text"] == "\n".join([long, *lines])


def test_group_tables_of_a_document_are_those_within_others(spark):
    html = "<table><tr><td>{}</td></tr></table>".format("<table><tr><td>Group</td><td>Limit</td></tr><tr><td>A</td><td>3 months</td></tr><tr><td>A</td><td>9 days</td></tr></table>")
    found = mk.nodes(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    rows, cells = sc.table_rows(found), sc.table_cells(found)
    out = sc.document_groups(found, rows, cells, sc.step_tables(rows, cells)).collect()
    assert [(r["ord"], r["group_name"], r["limit_months"], r["limit_days"]) for r in out] == [(0, "A", 3, None)]


def test_unclosed_elements_keep_linear_texts(spark):
    from rulespan.operators import documents as dc

    for piece in ("<div>x", "<ul><li>x", "<blockquote><div>x</b>"):
        out = dc.html_elements(spark.createDataFrame([(1, piece * 20_000)], "doc_id long, html string"))
        assert out.selectExpr("sum(length(text))").first()[0] <= 4 * 20_000
