"""Chains of references, rule trees drafted from nested steps and written out
again, and scanned documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import compaction as cp
from rulespan.operators import pointers as pt
from rulespan.operators import scans as sn
from rulespan.plans import draft as dr
from rulespan.queries import fixtures as fx
from rulespan.sources import runs as rn
from rulespan.sources.staging import dealt, shared_folder, stage

c = F.col
CAPTURED = fx.Rows("name string", [("facets_get_summary",), ("npi_registry_lookup",), ("doc360_read_claim_by_fln_dcc",), ("facets_get_summary",)])


# A report's documents are blocks of 1,000 or 100 orders; every rule is the same
# as the one before, the first lists tools, has none, or closes a ring.
_K = "SELECT o_orderkey AS k, CASE WHEN o_orderkey DIV 1000 % 2 = 1 THEN 100 ELSE 1000 END AS size FROM orders"
_B = f"SELECT k, size, k DIV size AS block, k % size = 0 AS first, (k DIV size) * size DIV 100 % 5 AS kind FROM ({_K})"
_CELL = """CASE WHEN NOT first THEN concat('Same as RULE-', k - 1, ', see there') WHEN kind = 0 THEN '`facets_get_summary`, npi_registry, doc360 , doc360' WHEN kind = 1 THEN concat('same as rule_', k + 2)
  WHEN kind = 2 THEN 'No additional tool used' WHEN kind = 3 THEN 'same as RULE-99999999' ELSE 'medicare_optout, odd_tool, facets_get_line_details' END"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.table(spark, sf_dir, "orders").createOrReplaceTempView("_report_orders")
    rows = spark.sql(_B.replace("FROM orders", "FROM _report_orders"))
    report = F.concat_ws("_", "size", "block")
    head = rows.filter("first").select(report.alias("report"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("- docs/sop "), report, F.lit(".yaml")).alias("line"))
    line = F.concat(F.lit("| "), F.when(c("k") % 2 == 0, "rule_").otherwise("RULE-"), c("k").cast("string"), F.lit(" of it | "), F.expr(_CELL), F.lit(" | x |"))
    body = rows.select(report.alias("report"), c("k").alias("ord"), line.alias("line"))
    stale = rows.filter("first").select(report.alias("report"), (c("k") - 0.5).cast("long"), F.lit("|no rule|none|"))
    return head.union(body).union(stale)


def report_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pt.report_tools(pt.report_cells(report_lines(spark, sf_dir)))
    return found.select("document", "rule_id", F.array_join("tools", "|").alias("tools"))


def captured_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = pt.report_tools(pt.report_cells(report_lines(spark, sf_dir)))
    found = pt.captured_tools(tools, CAPTURED.spark(spark))
    return found.select("document", "rule_id", F.array_join("captured", "|").alias("captured"), F.array_join("gaps", "|").alias("gaps"))


_DUCK_B = _B.replace(" DIV ", " // ")
_RULE = "'sop ' || size || '_' || block || '.yaml' AS document, 'RULE-' || k AS rule_id"
_TOOLS = f"SELECT {_RULE}, CASE kind WHEN 0 THEN 'facets_get_summary|npi_registry|doc360|doc360' WHEN 4 THEN 'medicare_optout|odd_tool|facets_get_line_details' ELSE '' END AS tools FROM ({_DUCK_B})"
_CAPTURED = f"""SELECT {_RULE}, CASE kind WHEN 0 THEN 'facets_get_summary|npi_registry_lookup|doc360_read_claim_by_fln_dcc' ELSE '' END AS captured,
  CASE kind WHEN 4 THEN 'medicare_optout(no-capture)|odd_tool(unknown)|facets_get_line_details->facets_get_line_details(not-in-snapshot)' ELSE '' END AS gaps FROM ({_DUCK_B})"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for each customer: a chain of rows, 50 deep for every hundredth and
    one to three else, an entry that is no row, and a row of other field names."""
    k = c("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    depth = F.when(k % 100 == 0, 50).otherwise((k % 3 + 1).cast("int"))
    wrap = lambda inner, d: text('{"condition_if":"c', k, "-", d, '","condition_and":"', F.when(d % 2 == 0, "and").otherwise(""), '","action":"a","skip_to_step":', F.when(d % 3 == 0, (d % 50).cast("string")).otherwise("null"), ',"is_out_of_scope":', F.when(d % 4 == 0, "true").otherwise("false"), ',"', F.when(d % 2 == 0, "subrules").otherwise("children"), '":[', inner, "]}")
    chain = F.aggregate(F.sequence(depth, F.lit(1)), F.lit(""), wrap)
    other = text('{"if":"B","then":"go","goto_step":"7","subrule_id":"X', k, '","applicable_when":"w"}')
    number = F.when(k % 7 == 0, "null").otherwise((k % 5 + 1).cast("string"))
    step = text('{"number":', number, ',"question":"Q', k, '","conditions":["c",""],"terminal_action":"end","decision_rows":[', chain, ',"no row",', other, "]}")
    return dealt(fx.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("sop_id"), step.alias("step"))


def draft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = dr.draft_rules(steps(spark, sf_dir)).drop("_step")
    patches = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("sop_id"), (c("c_custkey") % 5 + 1).cast("int").alias("step_number"), F.when(c("c_custkey") % 2 == 0, " ANY_clean ").otherwise("no such").alias("aggregation_rule"))
    return dr.patched_rules(rules, patches).withColumns({n: F.array_join(n, "|") for n in ("conditions", "actions")})


_RULES = "SELECT c_custkey AS sop_id, 'RULE-00' || (c_custkey % 5 + 1) AS rule_id, (c_custkey % 5 + 1)::INTEGER AS step_number, 'Q' || c_custkey AS description, '' AS section, 'c' AS conditions, 'end' AS actions, '' AS output, false AS is_out_of_scope, CASE WHEN c_custkey % 2 = 0 THEN 'any_clean' END AS aggregation_rule FROM customer WHERE c_custkey % 7 > 0"


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after patches to the last row and a structure that hangs it below the
    first; customers by tens name a parent that is not there."""
    k = c("c_custkey")
    cust = fx.table(spark, sf_dir, "customer")
    patches = cust.select(k.alias("sop_id"), (k % 5 + 1).cast("int").alias("step_number"), F.concat(F.lit("X"), k.cast("string")).alias("node_id"), F.lit("other").alias("applicable_when"), (k % 5 + 1).cast("int").alias("nav_step"), (k % 2 == 0).alias("is_out_of_scope"))
    structure = cust.select(F.concat(F.lit("X"), k.cast("string")).alias("node_id"), F.when(k % 10 == 0, "gone").otherwise(F.concat(F.lit("RULE-00"), (k % 5 + 1).cast("string"), F.lit("-001"))).alias("parent_id"), k.alias("sop_id"))
    rules = stage(dr.draft_rules(steps(spark, sf_dir)))
    return rules, stage(dr.patched_rows(dr.draft_rows(rules), rules, patches)), structure


def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir)[1]
    return rows.drop("table_name", "output").withColumns({n: F.array_join(n, "|") for n in ("conditions", "actions")})


_CHAIN = """d AS (SELECT c_custkey AS k, 'RULE-00' || (c_custkey % 5 + 1) AS rule_id, unnest(range(1, CASE WHEN c_custkey % 100 = 0 THEN 51 ELSE c_custkey % 3 + 2 END)) AS d FROM customer WHERE c_custkey % 7 > 0)"""
_ROWS = f"""WITH {_CHAIN}
SELECT k AS sop_id, rule_id, rule_id || repeat('-001', d) AS node_id, CASE WHEN d > 1 THEN rule_id || repeat('-001', d - 1) END AS parent_id, 0 AS ord, 'c' || k || '-' || d AS description, CASE WHEN d % 2 = 0 THEN 'and' ELSE '' END AS conditions, 'a' AS actions,
  '' AS applicable_when, d % 4 = 0 AS is_out_of_scope, CASE WHEN d % 3 = 0 THEN 'goto' END AS nav_op, CASE WHEN d % 3 = 0 THEN d % 50 END::INTEGER AS nav_step FROM d
UNION ALL SELECT c_custkey, 'RULE-00' || (c_custkey % 5 + 1), 'X' || c_custkey, NULL, 2, 'B', '', 'go', 'w', c_custkey % 2 = 0, 'goto', 7 FROM customer WHERE c_custkey % 7 > 0"""


def nested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of drafted rows as one document each, told by size and digest."""
    rows = dr.draft_rows(stage(dr.draft_rules(steps(spark, sf_dir))))
    key = lambda n: F.concat_ws("/", c("sop_id").cast("string"), n)
    rows = rows.select(key("node_id").alias("node_id"), F.when(c("parent_id").isNotNull(), key("parent_id")).alias("parent_id"), "ord", "description", "nav_step")
    out = dr.nested(rows, ["node_id", "description", "nav_step"])
    return out.select("node_id", "n_nodes", F.length("document").alias("n"), F.sha2("document", 256).alias("digest"))


_NESTED = f"""WITH {_CHAIN},
t AS (SELECT k || '/' || rule_id || '-001' AS node_id, string_agg('{{"node_id":"' || k || '/' || rule_id || repeat('-001', d) || '","description":"c' || k || '-' || d || '","nav_step":' || CASE WHEN d % 3 = 0 THEN (d % 50)::VARCHAR ELSE 'null' END || ',"children":[', '' ORDER BY d) || repeat(']}}', count(*)) AS doc, count(*) AS n_nodes FROM d GROUP BY k, rule_id
  UNION ALL SELECT c_custkey || '/X' || c_custkey, '{{"node_id":"' || c_custkey || '/X' || c_custkey || '","description":"B","nav_step":7,"children":[]}}', 1 FROM customer WHERE c_custkey % 7 > 0)
SELECT node_id, n_nodes, length(doc)::INTEGER AS n, sha256(doc) AS digest FROM t"""


# Scanned documents: the lines of an order are the entities of one.
_KIND = "CASE ln WHEN 1 THEN 'SECTION' WHEN 2 THEN 'STEP' WHEN 3 THEN 'SUBSTEP' WHEN 4 THEN 'NOTE' WHEN 5 THEN 'SECTION' WHEN 6 THEN 'TABLE' ELSE 'ROW' END"
_TEXT = "CASE ln WHEN 6 THEN ' ' WHEN 4 THEN concat('Note ', k, ': out of scope') ELSE concat('T', ln, ' ', k) END"
_E = f"SELECT k, ln, {_KIND} AS type, {_TEXT} AS text, CASE WHEN ln = 5 THEN 1 WHEN ln > 1 THEN ln - 1 END AS up FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS ln FROM lineitem)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.table(spark, sf_dir, "lineitem").createOrReplaceTempView("_scan_lines")
    rows = spark.sql(_E.replace("FROM lineitem", "FROM _scan_lines"))
    name = lambda n: F.concat(F.lit("e"), c(n).cast("string"))
    return rows.select(c("k").alias("doc_id"), name("ln").alias("entity_id"), c("ln").alias("ord"), "type", F.when(c("ln") == 5, F.concat(F.lit("Part "), c("k").cast("string"))).alias("label"), "text", F.when(c("ln") == 2, (c("k") % 9).cast("int")).alias("step_number"), F.when(c("up").isNotNull(), name("up")).alias("parent_ref"))


def scanned_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by parents, and of those told a target, one of no known kind, one
    to nothing and one that is there already."""
    e = stage(entities(spark, sf_dir))
    told = fx.Rows("source string, target string, rel string, label string", [("e4", "e2", "goto", "back"), ("e3", "e1", "LEADS", ""), ("e1", "e99", "GOTO", ""), ("e1", "e2", "has_step", "again"), ("e4", "e2", "GOTO", "back")]).spark(spark)
    docs = e.select("doc_id").distinct()
    return sn.relations(e, docs.join(F.broadcast(told)))


_RELATIONS = f"""WITH e AS ({_E}) SELECT a.k AS doc_id, 'e' || b.ln AS source, 'e' || a.ln AS target, CASE a.ln WHEN 2 THEN 'HAS_STEP' WHEN 3 THEN 'HAS_SUBSTEP' WHEN 4 THEN 'HAS_CONDITION' WHEN 7 THEN 'HAS_ROW' ELSE 'IN_SECTION' END AS rel, '' AS label FROM e a JOIN e b ON b.k = a.k AND b.ln = a.up
UNION ALL SELECT a.k, 'e4', 'e2', 'GOTO', 'back' FROM e a JOIN e b ON b.k = a.k AND b.ln = 2 WHERE a.ln = 4"""
_BELOW = """w AS (SELECT k, ln AS root, ln, 0 AS depth, '' AS path FROM e WHERE {roots} UNION ALL SELECT w.k, root, e.ln, depth + 1, path || e.ln FROM w JOIN e ON e.k = w.k AND e.up = w.ln)"""


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.section_texts(stage(entities(spark, sf_dir))).withColumn("items", F.array_join("items", "|"))


_SECTIONS = f"""WITH RECURSIVE e AS ({_E}), {_BELOW.format(roots="type = 'SECTION'")},
i AS (SELECT w.k, root, string_agg(text, '|' ORDER BY depth, path) AS items FROM w JOIN e ON e.k = w.k AND e.ln = w.ln WHERE depth > 0 AND w.ln NOT IN (2, 6) GROUP BY ALL)
SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY root) - 1)::INTEGER AS ord, CASE root WHEN 5 THEN 'Part ' || k ELSE 'T1 ' || k END AS name, items FROM i"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents that share all orders as their pages."""
    return fx.table(spark, sf_dir, "orders").select((c("o_orderkey") % 3).alias("doc_id"), F.floor(c("o_orderkey") / 3).cast("int").alias("page"), F.concat(F.lit("p"), c("o_orderkey").cast("string"), F.when(c("o_orderkey") % 50 == 0, " Process the claim").otherwise("")).alias("text"))


def scanned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by page ranges in the shared documents, by entities in those of lines."""
    k = c("o_orderkey")
    first = F.floor(k / 3).cast("int")
    ranged = fx.table(spark, sf_dir, "orders").select((k % 3).alias("doc_id"), k.cast("int").alias("step_number"), F.lit("Q").alias("question"), first.alias("start_page"), F.when(k % 11 > 0, first + (k % 5).cast("int") - 1).alias("end_page"), F.array(F.lit("e2")).alias("entities"))
    e = entities(spark, sf_dir).withColumn("doc_id", c("doc_id") + 10)
    loose = e.select("doc_id").distinct().select("doc_id", F.lit(1).alias("step_number"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.array(F.lit("e2"), F.lit("e5"), F.lit("e3")).alias("entities"))
    return sn.scanned_steps(ranged.union(loose), pages(spark, sf_dir), stage(e))


_STEPS = f"""WITH RECURSIVE p AS (SELECT o_orderkey % 3 AS doc_id, o_orderkey // 3 AS page, 'p' || o_orderkey || CASE WHEN o_orderkey % 50 = 0 THEN ' Process the claim' ELSE '' END AS t FROM orders),
s AS (SELECT o_orderkey % 3 AS doc_id, o_orderkey AS n, o_orderkey // 3 AS a, o_orderkey // 3 + o_orderkey % 5 AS b FROM orders WHERE o_orderkey % 11 > 0),
r AS (SELECT s.doc_id, n, 'Q' AS q, string_agg(t, chr(10) ORDER BY page) AS raw FROM s JOIN p ON p.doc_id = s.doc_id AND page BETWEEN a AND b GROUP BY ALL),
e AS ({_E}), {_BELOW.format(roots="ln IN (2, 5)")},
m AS (SELECT w.k + 10 AS doc_id, 1 AS n, '' AS q, string_agg(CASE WHEN depth = 0 THEN text ELSE '- ' || text END, chr(10) ORDER BY root, depth, path) AS raw FROM (SELECT * FROM w UNION ALL SELECT k, 9, ln, 0, '' FROM e WHERE ln = 3 AND k NOT IN (SELECT k FROM e WHERE ln = 2)
  UNION ALL SELECT e.k, 9, 4, 1, '4' FROM e JOIN e f ON f.k = e.k AND f.ln = 3 WHERE e.ln = 4 AND e.k NOT IN (SELECT k FROM e WHERE ln = 2)) w JOIN e ON e.k = w.k AND e.ln = w.ln WHERE w.ln <> 6 GROUP BY ALL)
SELECT doc_id, n::INTEGER AS step_number, q AS question, contains(lower(raw), 'process the claim') AS is_terminal, raw AS raw_text FROM (SELECT * FROM r UNION ALL SELECT * FROM m)"""


def scanned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stage(entities(spark, sf_dir))
    members = e.filter("type = 'SECTION'").select("doc_id", F.when(c("entity_id") == "e1", 1).otherwise(5).alias("step_number"), "entity_id")
    gotos = e.filter("type = 'NOTE'").select("doc_id", c("entity_id").alias("source"), F.lit(2).alias("step_number"))
    read = e.filter(c("doc_id") % 4 == 0).select("doc_id", F.lit(5).alias("step_number")).distinct()
    return sn.fallback_rows(members, e, gotos, read)


_FALLBACK = f"""WITH RECURSIVE e AS ({_E}), w AS (SELECT k, ln AS root, ln, NULL::INTEGER AS par, 0 AS depth FROM e WHERE type = 'SECTION' UNION ALL SELECT w.k, root, e.ln, CASE WHEN depth > 0 THEN w.ln END, depth + 1 FROM w JOIN e ON e.k = w.k AND e.up = w.ln AND e.ln <> 6)
SELECT w.k AS doc_id, CASE root WHEN 1 THEN 1 ELSE 5 END AS step_number, 'e' || w.ln AS node_id, 'e' || par AS parent_id, w.ln AS ord, CASE WHEN type = 'NOTE' THEN text ELSE '' END AS condition_if, CASE WHEN type IN ('SUBSTEP', 'ROW') THEN text ELSE '' END AS action, CASE WHEN w.ln = 4 THEN 2 END AS skip_to_step, w.ln = 4 AS is_out_of_scope
FROM w JOIN e ON e.k = w.k AND e.ln = w.ln WHERE depth > 0 AND NOT (root = 5 AND w.k % 4 = 0)"""


def stitched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers with none to two tables, most of which go on."""
    k = c("o_orderkey")
    found = fx.table(spark, sf_dir, "orders").select(c("o_custkey").alias("doc_id"), k.alias("page"))
    n = F.when(c("page") % 7 == 0, 0).when(c("page") % 3 == 0, 2).otherwise(1)
    tables = found.select("doc_id", "page", F.explode(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), n)).alias("tbl")).withColumn("continues", (c("tbl") == 0) & (c("page") % 5 > 0))
    return sn.stitched_tables(found, tables).select("doc_id", "page", "tbl", "to_page", "to_tbl")


_STITCHED = """WITH RECURSIVE p AS (SELECT o_custkey AS d, o_orderkey AS page, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT d, page, n, i, 0 AS moved, NULL::BIGINT AS prev, 0 AS pn FROM p WHERE i = 1
  UNION ALL SELECT p.d, p.page, p.n, p.i, CASE WHEN p.n > 0 AND p.page % 5 > 0 AND w.n - w.moved > 0 THEN 1 ELSE 0 END, w.page, w.n FROM w JOIN p ON p.d = w.d AND p.i = w.i + 1)
SELECT d AS doc_id, page, t::INTEGER AS tbl, CASE WHEN t = 0 AND moved = 1 THEN prev ELSE page END AS to_page, (CASE WHEN t = 0 AND moved = 1 THEN pn - 1 ELSE t END)::INTEGER AS to_tbl FROM w, (VALUES (0), (1)) AS v(t) WHERE t < n"""


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(c("l_quantity") % 10 != 0, (c("l_orderkey") % 20).cast("int"))
    return fx.table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("doc_id"), c("l_linenumber").alias("slice"), c("l_orderkey").alias("ord"), page.alias("page")).distinct()


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of overlapping slices, the last ones read again where they lack."""
    totals = fx.table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("doc_id"), F.lit(24).alias("pages"))
    reread = totals.select("doc_id", F.lit(-1).alias("slice"), F.lit(0).cast("long").alias("ord"), F.explode(F.array(F.lit(0), F.lit(3), F.lit(22), F.lit(22), F.lit(25))).alias("page"))
    return sn.whole_pages(_slices(spark, sf_dir), reread, totals)


_S = "s AS (SELECT DISTINCT l_suppkey AS doc_id, l_linenumber AS slice, l_orderkey AS ord, CASE WHEN l_quantity % 10 <> 0 THEN l_orderkey % 20 END AS page FROM lineitem)"
_PAGES = f"""WITH {_S}, n AS (SELECT doc_id, slice, ord, coalesce(page, 10000 + row_number() OVER (PARTITION BY doc_id, page IS NULL ORDER BY slice, ord))::INTEGER AS page FROM s),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY slice, ord) = 1)
SELECT * FROM k UNION ALL SELECT s_suppkey, -1, 0, p FROM supplier, (VALUES (3), (22)) AS v(p) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = s_suppkey AND k.page = p)"""


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = fx.table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("doc_id"), F.lit(24).alias("pages"))
    return sn.missing_pages(sn.whole_pages(_slices(spark, sf_dir)), totals)


_MISSING = f"WITH {_S} SELECT s_suppkey AS doc_id, p::INTEGER AS page FROM supplier, range(1, 25) AS v(p) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = s_suppkey AND s.page = p)"

TOTAL, MOST, LEAST = 600, 500, 40


def tool_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as tool records of texts up to 600 characters, within
    small budgets."""
    k = c("o_orderkey")
    text = F.call_function("repeat", F.lit("x"), (k * 37 % 601).cast("int"))
    records = fx.table(spark, sf_dir, "orders").select(c("o_custkey").alias("claim_id"), k.alias("ord"), F.concat(F.lit('{"tool": "t", "result": "'), text, F.lit('"}')).alias("record"))
    claims = fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("claim_id"), F.lit('{"cpt": "99213"}').alias("claim"))
    return cp.compacted(records, claims, TOTAL, MOST, LEAST).select("claim_id", "ord", "budget", "tokens", F.length("record").alias("chars"))


# A cut text begins with a quote, which takes two characters, and may end with one.
_CUT = "CASE WHEN n + 2 > 3 * b THEN 3 * b + 1 ELSE n + 4 END + length((n + 2)::VARCHAR) + 66"
_COMPACTED = f"""WITH RECURSIVE r AS (SELECT o_custkey AS claim_id, o_orderkey AS ord, o_orderkey * 37 % 601 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT claim_id, 0 AS i, NULL::BIGINT AS ord, {TOTAL}::BIGINT AS left_, NULL::BIGINT AS b, NULL::BIGINT AS t, NULL::BIGINT AS chars FROM r WHERE i = 1
  UNION ALL SELECT claim_id, i, ord, left_ - (chars // 3 + 1), b, chars // 3 + 1, chars FROM (SELECT *, CASE WHEN (n + 2) // 3 + 1 > b THEN {_CUT} ELSE n + 27 END AS chars
    FROM (SELECT r.claim_id, r.i, r.ord, r.n, left_, greatest({LEAST}, least({MOST}, left_)) AS b FROM w JOIN r ON r.claim_id = w.claim_id AND r.i = w.i + 1)))
SELECT claim_id, ord, b AS budget, t AS tokens, chars::INTEGER AS chars FROM w WHERE i > 0"""


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved as runs with their lines: even ones go through, odd ones stop at
    a line that cannot be written."""
    folder = shared_folder(spark)
    orders = fx.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), F.when(c("o_orderkey") % 3 == 0, "RUNNING").otherwise("TERMINATED_EARLY").alias("status"))
    lines = fx.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("run_id"), "l_linenumber")
    for odd in (0, 1):
        mine = lines.filter(c("run_id") % 2 == odd)
        rows = mine.withColumn("l_linenumber", F.when((F.lit(odd) == 1) & (c("run_id") % 101 == 50), F.raise_error(F.lit("broken line")).cast("int")).otherwise(c("l_linenumber")))
        rn.save_runs(folder, orders.filter(c("run_id") % 2 == odd), {"evaluations": rows, "tools": mine})
    kept = rn.saved(spark, folder, "evaluations").groupBy("run_id").agg(F.count("*").alias("n"))
    return rn.saved(spark, folder, "runs").join(kept, "run_id", "left").select("run_id", "status", (c("error_message") != "").alias("failed"), F.coalesce("n", F.lit(0)).alias("n_rows"))


_SAVED = "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 1 THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'COMPLETED' ELSE 'TERMINATED_EARLY' END AS status, o_orderkey % 2 = 1 AS failed, CASE WHEN o_orderkey % 2 = 1 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_rows FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"

def scan_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose plan has all lines of an order and whose steps the first
    four; odd ones have a problem in their draft."""
    e = entities(spark, sf_dir)
    plan = e.select("doc_id", F.when(c("ord") != 3, c("ord")).alias("step_number"))
    out = sn.quality_gate(plan, plan.filter("step_number <= 4"), e.filter("type = 'SECTION'"), e.filter("ord = 1 and doc_id % 2 = 1"))
    text = lambda n: F.array_join(F.transform(n, lambda v: v.cast("string")), ",")
    return out.withColumns({n: text(n) for n in ("planned", "built", "missing")})


_QUALITY = f"""WITH e AS ({_E}), g AS (SELECT k, coalesce(string_agg(ln::VARCHAR, ',' ORDER BY ln) FILTER (ln <> 3), '') AS planned, coalesce(string_agg(ln::VARCHAR, ',' ORDER BY ln) FILTER (ln <= 4 AND ln <> 3), '') AS built, coalesce(string_agg(ln::VARCHAR, ',' ORDER BY ln) FILTER (ln > 4), '') AS missing,
  count(*) FILTER (ln IN (1, 5)) AS sections, count(*) FILTER (ln = 1 AND k % 2 = 1) AS n_problems FROM e GROUP BY k)
SELECT k AS doc_id, planned, built, missing, sections, n_problems, missing = '' AND n_problems = 0 AS complete FROM g"""

QUERIES = {
    "report_tools": (report_tools, _TOOLS),
    "captured_tools": (captured_tools, _CAPTURED),
    "draft_rules": (draft_rules, _RULES),
    "draft_rows": (draft_rows, _ROWS),
    "nested_rules": (nested_rules, _NESTED),
    "scanned_relations": (scanned_relations, _RELATIONS),
    "section_texts": (section_texts, _SECTIONS),
    "scanned_steps": (scanned_steps, _STEPS),
    "scanned_rows": (scanned_rows, _FALLBACK),
    "stitched_tables": (stitched_tables, _STITCHED),
    "whole_pages": (whole_pages, _PAGES),
    "missing_pages": (missing_pages, _MISSING),
    "scan_quality": (scan_quality, _QUALITY),
    "tool_compaction": (tool_compaction, _COMPACTED),
    "saved_runs": (saved_runs, _SAVED),
}
