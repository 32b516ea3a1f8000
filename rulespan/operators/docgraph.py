"""The graph of a document store: a node for each part of a document, keyed so
that writing it again changes nothing, and the edges that hang it up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(*parts: str | Column) -> Column:
    """Parts joined by colons; text that is no column name stands for itself."""
    return F.concat_ws(":", *(F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts))


def _part(rows: DataFrame, key: Column, kind: str, parent: Column, rel: str, order: str | None, label: Column) -> tuple[DataFrame, DataFrame]:
    place = F.col(order).cast("int") if order else F.lit(None).cast("int")
    both = rows.filter("coalesce(sop_id, '') <> ''").select(key.alias("key"), F.lit(kind).alias("type"), label.cast("string").alias("label"), parent.alias("parent"), place.alias("place"), "seq")
    nodes = both.groupBy("key", "type").agg(F.max_by("label", "seq").alias("label"))
    edges = both.select(F.col("parent").alias("source"), F.col("key").alias("target"), F.lit(rel).alias("rel"), "place").distinct()
    return nodes, edges


def document_graph(documents: DataFrame, sections: DataFrame, steps: DataFrame, rules: DataFrame, annotations: DataFrame, codes: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, type, label) and edges (source, target, rel, place).

    All inputs have sop_id and seq (the order of writing: the last label of a
    node stays).  Sections are keyed by place, steps by number, rules by step
    and row; annotations by their text and codes by system and value, so
    documents share them; limits by group and network.  Parts of documents
    without an id, and edges from parents that are not there, are left out.
    """
    step = _key("sop_id", "=step", "number")
    parts = [
        _part(sections, _key("sop_id", "=pre", "place"), "PRE_SECTION", F.col("sop_id"), "HAS_PRE_SECTION", "place", F.col("name")),
        _part(steps, step, "STEP", F.col("sop_id"), "HAS_STEP", "number", F.col("question")),
        _part(rules, _key("sop_id", "=step", "number", "=rule", "row_index"), "RULE", step, "HAS_RULE", "row_index", F.coalesce("decision", F.lit("CONDITIONAL"))),
        _part(annotations, _key("=ann", "text"), "ANNOTATION", step, "ANNOTATED_BY", None, F.coalesce("annotation_type", F.lit("NOTE"))),
        _part(codes, _key("=code", "code_system", "raw_value"), "CODE_REF", F.col("sop_id"), "USES_CODE", None, F.col("raw_value")),
        _part(limits, _key("sop_id", "=gr", "group_name", "network_type"), "GROUP_LIMIT", F.col("sop_id"), "HAS_GROUP_RULE", None, F.coalesce("network_type", F.lit("BOTH"))),
    ]
    nodes = documents.filter("coalesce(sop_id, '') <> ''").groupBy(F.col("sop_id").alias("key")).agg(F.lit("DOCUMENT").alias("type"), F.max_by("title", "seq").alias("label"))
    edges = None
    for more, ways in parts:
        nodes, edges = nodes.unionByName(more), ways if edges is None else edges.unionByName(ways)
    known = nodes.filter(F.col("type").isin("DOCUMENT", "STEP")).select(F.col("key").alias("source")).distinct()
    return nodes, edges.join(known, "source", "left_semi").select("source", "target", "rel", "place")
