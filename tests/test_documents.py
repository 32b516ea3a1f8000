"""Pages: references cut off, and how documents are dealt and joined."""

from pyspark.sql import functions as F

from rulespan.operators import documents as dc
from rulespan.operators import markup as mk
from rulespan.operators import sections as sc
from rulespan.queries import sections as qs
from rulespan.sources.staging import dealt


def test_references_without_a_semicolon_stay(spark):
    rows = [(1, "<title>a&amp;&amp</title>"), (2, "<title>b &copy=1 &#38; &#38 &lt;i&gt; & c</title>"), (3, None)]
    pages = spark.createDataFrame(rows, "doc_id long, html string").withColumn("html", mk.ended_references(F.col("html")))
    found = mk.nodes(pages)
    titles = {r["doc_id"]: r["title"] for r in sc.metadata(found, sc.table_cells(found)).collect()}
    assert titles == {1: "a&&amp", 2: "b &copy=1 & &#38 <i> & c", 3: ""}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_are_not_broadcast(spark):
    pages = spark.createDataFrame([(1, '<h1 id="a">T</h1><a href="#a">x</a><a href="#b">y</a>')], "doc_id long, html string")
    out = dc.anchors(dc.html_elements(pages))
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r["anchor"], r["target"], r["unresolved"]) for r in out.collect()) == [("a", 0, False), ("b", None, True)]


def test_texts_of_documents_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found, _, cells = qs.parsed(spark, str(tmp_path))
    for out in (mk.with_text(found.select("doc_id", "node", "start", "stop"), found), sc.metadata(found, cells), sc.notes(found)):
        assert "BroadcastHashJoin" not in plan(out)


def test_rows_are_dealt_over_tasks(spark):
    rows = dealt(spark.range(12_001).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() == 3
    assert rows.count() == 12_001
    assert dealt(spark.range(0), "id").count() == 0
