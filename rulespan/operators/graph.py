"""The typed property graph: building, cleaning, checking, walking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.sources.staging import stage

# Aliases of node types and relations, and prefixes of keys.
TYPE_ALIASES = {"DOC": "DOCUMENT", "SOP": "DOCUMENT", "PRECONDITION": "PRE_SECTION", "PRESECTION": "PRE_SECTION", "PROCEDURE_STEP": "STEP", "DECISION_ROW": "DECISION", "NOTE": "ANNOTATION", "CODE": "CODE_REF", "REF": "REFERENCE"}
TYPES = ("DOCUMENT", "META", "PRE_SECTION", "RULE", "STEP", "DECISION", "ANNOTATION", "GROUP_LIMIT", "CODE_REF", "DATE_COND", "REFERENCE")
KEY_PREFIXES = {"doc": "DOCUMENT", "meta": "META", "pre": "PRE_SECTION", "rule": "RULE", "step": "STEP", "dec": "DECISION", "ann": "ANNOTATION", "grp": "GROUP_LIMIT", "code": "CODE_REF", "date": "DATE_COND", "ref": "REFERENCE"}


def snake(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), "[^A-Z0-9]+", "_")


def node_type(raw: Column, key: Column) -> Column:
    """Canonical type: by name, by alias, else by the key's prefix, else null."""
    name = snake(raw)
    alias = F.element_at(F.create_map(*[F.lit(v) for kv in TYPE_ALIASES.items() for v in kv]), name)
    prefix = F.element_at(F.create_map(*[F.lit(v) for kv in KEY_PREFIXES.items() for v in kv]), F.lower(F.element_at(F.split(key, ":"), 1)))
    return F.coalesce(F.when(name.isin(*TYPES), name), alias, prefix)


def sanitise(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, type, position) with canonical types, the first of a key kept,
    and edges (source, target, rel) without blanks and repeats."""
    typed = nodes.filter("coalesce(key, '') <> ''").withColumn("type", node_type(F.col("type"), F.col("key"))).filter("type is not null")
    first = typed.groupBy("key").agg(F.min_by(F.struct("type", "position"), "position").alias("n")).select("key", "n.*")
    clean = edges.filter("coalesce(source, '') <> '' and coalesce(target, '') <> ''").select("source", "target", snake(F.col("rel")).alias("rel")).filter("rel <> ''").distinct()
    return first, clean


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    keys = nodes.select("key").distinct()
    no_source = edges.join(keys, edges["source"] == keys["key"], "left_anti")
    no_target = edges.join(keys, edges["target"] == keys["key"], "left_anti")
    return no_source.union(no_target).distinct()


def attached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    keys = nodes.select("key").distinct()
    return edges.join(keys, edges["source"] == keys["key"], "left_semi").join(keys, edges["target"] == keys["key"], "left_semi")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(severity, problem, n): no nodes, repeated keys, no document, dangling edges."""
    totals = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "DOCUMENT").alias("documents"))
    twice = nodes.groupBy("key").count().filter("count > 1").agg(F.count("*").alias("twice"))
    loose = dangling(nodes, edges).agg(F.count("*").alias("loose"))
    # three one-row tables side by side
    row = totals.select(F.lit(1).alias("k"), "*").join(twice.select(F.lit(1).alias("k"), "*"), "k").join(loose.select(F.lit(1).alias("k"), "*"), "k")
    checks = F.array(
        F.struct(F.lit("HARD").alias("severity"), F.lit("no nodes").alias("problem"), (F.col("nodes") == 0).cast("long").alias("n")),
        F.struct(F.lit("HARD").alias("severity"), F.lit("duplicate keys").alias("problem"), F.col("twice").alias("n")),
        F.struct(F.lit("HARD").alias("severity"), F.lit("no document").alias("problem"), (F.col("documents") == 0).cast("long").alias("n")),
        F.struct(F.lit("SOFT").alias("severity"), F.lit("dangling edges").alias("problem"), F.col("loose").alias("n")),
    )
    return row.select(F.explode(checks).alias("c")).select("c.*").filter("n > 0")


def edge_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the types of both ends."""
    a = nodes.select(F.col("key").alias("source"), F.col("type").alias("source_type"))
    b = nodes.select(F.col("key").alias("target"), F.col("type").alias("target_type"))
    return edges.join(a, "source").join(b, "target")


def reach(edges: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """(start, key, depth, path) of all walks along ``edges`` (source, target)
    from ``starts`` (key), without visiting a node twice, ``most`` steps long.

    A driver loop over depths; each turn joins the ends of the newest walks
    only and is written out, so the number of walks has no limit.
    """
    walks = newest = stage(starts.select(F.col("key").alias("start"), "key", F.lit(0).alias("depth"), F.array("key").alias("path")))
    for depth in range(1, most + 1):
        ahead = newest.join(edges.select(F.col("source").alias("key"), "target"), "key").filter(~F.array_contains("path", F.col("target")))
        newest = stage(ahead.select("start", F.col("target").alias("key"), F.lit(depth).alias("depth"), F.concat("path", F.array("target")).alias("path")))
        if newest.isEmpty():
            break
        walks = walks.union(newest)
    return walks


def descendants(edges: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """(start, key, depth) of every node within ``most`` steps of each of
    ``starts`` (key), once, at its least depth; the start itself at 0."""
    seen = newest = stage(starts.select(F.col("key").alias("start"), "key", F.lit(0).alias("depth")).distinct())
    for depth in range(1, most + 1):
        ahead = newest.join(edges.select(F.col("source").alias("key"), "target"), "key").select("start", F.col("target").alias("key")).distinct()
        newest = stage(ahead.join(seen, ["start", "key"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 4, max_documents: int = 200) -> DataFrame:
    """(url, depth, found) in reach of ``seeds`` (url, position) over ``links``
    (source, position, target), breadth first, the first ``max_documents``.

    ``found`` numbers pages from 0 as a reader of one page after the other
    finds them: the links of earlier pages first, those of a page by position.
    A driver loop over depths; each turn joins the newest pages only and drops
    those seen before, and is written out before the next; it ends when enough
    pages are found, so no turn has more than ``max_documents`` pages to open.
    """
    first = seeds.groupBy("url").agg(F.min("position").alias("at")).select("url", F.lit(0).alias("depth"), F.struct(F.lit(0).cast("long").alias("by"), F.col("at").cast("long").alias("at")).alias("via"))
    seen = newest = stage(_numbered(first, 0, max_documents))
    for depth in range(1, max_depth + 1):
        so_far = seen.count()
        if so_far >= max_documents:
            break
        ahead = links.join(newest.select(F.col("url").alias("source"), F.col("found").alias("by")), "source")
        via = F.min(F.struct(F.col("by").cast("long").alias("by"), F.col("position").cast("long").alias("at"))).alias("via")
        ahead = ahead.groupBy(F.col("target").alias("url")).agg(via).join(seen.select("url"), "url", "left_anti")
        newest = stage(_numbered(ahead.select("url", F.lit(depth).alias("depth"), "via"), so_far, max_documents))
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen


def _numbered(pages: DataFrame, base: int, most: int) -> DataFrame:
    """The first pages by ``via`` up to ``most`` in all, numbered from ``base``."""
    first = pages.orderBy("via", "url").limit(most - base)
    return first.select("url", "depth", (F.row_number().over(Window.orderBy("via", "url")) - 1 + base).alias("found"))
