"""The property graph over regions, nations and customers, and the crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import graph as g
from rulespan.queries import fixtures as fx

c = F.col


def raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with aliases, untyped keys, repeats and loose ends."""
    r, n, m = (fx.table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = (
        r.select(F.concat(F.lit("doc:"), "r_regionkey").alias("key"), F.lit("sop").alias("type"), c("r_regionkey").cast("long").alias("position"))
        .union(n.select(F.concat(F.lit("step:"), "n_nationkey"), F.lit("procedure step"), c("n_nationkey").cast("long")))
        .union(m.select(F.concat(F.lit("dec:"), "c_custkey"), F.when(c("c_custkey") % 3 == 0, "Decision-Row").when(c("c_custkey") % 3 == 1, "whatever").otherwise("rule"), c("c_custkey")))
        .union(m.filter("c_custkey % 10 = 0").select(F.concat(F.lit("dec:"), "c_custkey"), F.lit("note"), c("c_custkey") + 10**7))
        .union(m.filter("c_custkey % 50 = 0").select(F.concat(F.lit("zz:"), "c_custkey"), F.lit("??"), c("c_custkey")))
    )
    edges = (
        n.select(F.concat(F.lit("doc:"), "n_regionkey").alias("source"), F.concat(F.lit("step:"), "n_nationkey").alias("target"), F.lit("has step").alias("rel"))
        .union(m.select(F.concat(F.lit("step:"), "c_nationkey"), F.concat(F.lit("dec:"), "c_custkey"), F.lit("HAS_DECISION")))
        .union(m.filter("c_custkey % 20 = 0").select(F.concat(F.lit("dec:"), "c_custkey"), F.concat(F.lit("gone:"), "c_custkey"), F.lit("goto")))
        .union(m.filter("c_custkey % 30 = 0").select(F.concat(F.lit("dec:"), "c_custkey"), F.lit(""), F.lit("goto")))
    )
    return nodes, edges


_NODES = """nodes AS (SELECT 'doc:' || r_regionkey AS key, 'DOCUMENT' AS type, r_regionkey::BIGINT AS position FROM region UNION ALL SELECT 'step:' || n_nationkey, 'STEP', n_nationkey FROM nation
  UNION ALL SELECT 'dec:' || c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'RULE' ELSE 'DECISION' END, c_custkey FROM customer)"""
_EDGES = """edges AS (SELECT 'doc:' || n_regionkey AS source, 'step:' || n_nationkey AS target, 'HAS_STEP' AS rel FROM nation UNION ALL SELECT 'step:' || c_nationkey, 'dec:' || c_custkey, 'HAS_DECISION' FROM customer
  UNION ALL SELECT 'dec:' || c_custkey, 'gone:' || c_custkey, 'GOTO' FROM customer WHERE c_custkey % 20 = 0)"""


def graph_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.sanitise(*raw(spark, sf_dir))[0]


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.dangling(*g.sanitise(*raw(spark, sf_dir)))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = g.sanitise(*raw(spark, sf_dir))
    return g.edge_rows(nodes, g.attached(nodes, edges))


def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = g.sanitise(*raw(spark, sf_dir))
    doubled = nodes.union(nodes.filter("position % 100 = 7"))
    return g.validate(doubled.filter("type <> 'DOCUMENT'"), edges)


_VALID = f"""WITH {_NODES}, {_EDGES}, k AS (SELECT key FROM nodes WHERE type <> 'DOCUMENT')
SELECT 'HARD' AS severity, 'duplicate keys' AS problem, count(*) AS n FROM nodes WHERE type <> 'DOCUMENT' AND position % 100 = 7
UNION ALL SELECT 'HARD', 'no document', 1 UNION ALL SELECT 'SOFT', 'dangling edges', count(*) FROM edges WHERE source NOT IN (SELECT key FROM k) OR target NOT IN (SELECT key FROM k)"""


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks up from every customer's decision node."""
    _, edges = g.sanitise(*raw(spark, sf_dir))
    up = edges.select(c("target").alias("source"), c("source").alias("target"))
    starts = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("dec:"), "c_custkey").alias("key"))
    return g.reach(up, starts).select("start", "key", "depth", F.array_join("path", ">").alias("path"))


_UP = f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'dec:' || c_custkey AS start, 'dec:' || c_custkey AS key, 0 AS depth, 'dec:' || c_custkey AS path FROM customer
  UNION ALL SELECT w.start, e.source, w.depth + 1, w.path || '>' || e.source FROM w JOIN edges e ON e.target = w.key WHERE w.depth < 10)
SELECT * FROM w"""


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs below each document; some decisions lead on to others, so
    nodes are met by several ways, and some ways are rings."""
    _, edges = g.sanitise(*raw(spark, sf_dir))
    m = fx.table(spark, sf_dir, "customer")
    onward = m.filter("c_custkey % 6 = 0").select(F.concat(F.lit("dec:"), "c_custkey").alias("source"), F.concat(F.lit("dec:"), c("c_custkey") + 1).alias("target"))
    back = m.filter("c_custkey % 36 = 0").select(F.concat(F.lit("dec:"), c("c_custkey") + 1).alias("source"), F.concat(F.lit("dec:"), "c_custkey").alias("target"))
    deeper = m.filter("c_custkey % 10 = 0").select(F.concat(F.lit("gone:"), c("c_custkey") * 2).alias("source"), F.concat(F.lit("far:"), "c_custkey").alias("target"))
    starts = fx.table(spark, sf_dir, "region").select(F.concat(F.lit("doc:"), "r_regionkey").alias("key"))
    every = edges.select("source", "target").union(onward).union(back).union(deeper)
    return g.descendants(every, starts).filter("depth > 0").groupBy("start", "depth").agg(F.count("*").alias("n"))


_DOWN = f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT source, target FROM edges UNION SELECT 'dec:' || c_custkey, 'dec:' || (c_custkey + 1) FROM customer WHERE c_custkey % 6 = 0
  UNION SELECT 'dec:' || (c_custkey + 1), 'dec:' || c_custkey FROM customer WHERE c_custkey % 36 = 0 UNION SELECT 'gone:' || (c_custkey * 2), 'far:' || c_custkey FROM customer WHERE c_custkey % 10 = 0),
w AS (SELECT 'doc:' || r_regionkey AS start, 'doc:' || r_regionkey AS key, 0 AS depth FROM region
  UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN ways e ON e.source = w.key WHERE w.depth < 10)
SELECT start, depth, count(*) AS n FROM (SELECT start, key, min(depth) AS depth FROM w GROUP BY ALL) WHERE depth > 0 GROUP BY start, depth"""


def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = g.sanitise(*raw(spark, sf_dir))
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl over all pages; a link leads to the page of its number, round the
    table.  Its limit is the feature."""
    p = fx.table(spark, sf_dir, "pages").select(c("page_id").alias("url"))
    n = max(1, p.count())
    ways = F.array(c("url") * 3 + 2, c("url") * 2 + 1, c("url"))
    links = p.select(c("url").alias("source"), F.posexplode(ways).alias("position", "to")).select("source", "position", (c("to") % n).alias("target"))
    return g.crawl(links, p.filter("url = 0").withColumn("position", F.lit(0)), 6, 40)


_CRAWL = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS s, 0 AS at, (page_id * 3 + 2) % n AS t FROM pages, n UNION ALL SELECT page_id, 1, (page_id * 2 + 1) % n FROM pages, n),
w AS (SELECT 0::BIGINT AS url, 0 AS depth, '' AS path UNION ALL SELECT e.t, w.depth + 1, w.path || e.at FROM w JOIN e ON e.s = w.url WHERE w.depth < 6)
SELECT url, depth, (row_number() OVER (ORDER BY depth, path) - 1)::INTEGER AS found FROM (SELECT url, min(depth) AS depth, min_by(path, (depth, path)) AS path FROM w GROUP BY url) ORDER BY 3 LIMIT 40"""

QUERIES = {
    "graph_sanitize": (graph_sanitize, f"WITH {_NODES} SELECT * FROM nodes"),
    "dangling_edges": (dangling_edges, f"WITH {_EDGES} SELECT * FROM edges WHERE rel = 'GOTO'"),
    "graph_edges": (graph_edges, f"WITH {_NODES}, {_EDGES} SELECT e.*, a.type AS source_type, b.type AS target_type FROM edges e JOIN nodes a ON a.key = source JOIN nodes b ON b.key = target"),
    "graph_validate": (graph_validate, _VALID),
    "ancestors": (ancestors, _UP),
    "ancestors_all": (ancestors, _UP),
    "descendants": (descendants, _DOWN),
    "node_histogram": (node_histogram, f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type"),
    "crawl_frontier": (crawl_frontier, _CRAWL),
    "crawl_frontier_all": (crawl_frontier, _CRAWL),
}
