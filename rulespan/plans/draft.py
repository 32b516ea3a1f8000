"""Draft rule trees from the steps of a document, patched and structured, and
trees written out again as nested documents.

Nested rows arrive as JSON text of any depth.  They are opened a level a turn:
each turn reads the newest level's children out of its rows and writes them, so
neither depth nor breadth is held by one task.  Writing puts the rows in
depth-first order and sets brackets by their depths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.plans.ir import apply_structure
from rulespan.sources.staging import dealt, stage

c = F.col

# What a patch may call the aggregation of a rule.
AGGREGATIONS = ("applicable_only", "any", "any_clean", "xor_one", "exactly_one", "only_one", "first_match", "first", "always_met", "always")


def field(row: Column, *names: str) -> Column:
    """The first of the fields that is there, as text without NULs; else ''."""
    value = F.coalesce(*(F.get_json_object(row, f"$.{n}") for n in names), F.lit(""))
    return F.translate(value, "\0", "")


def whole_number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))


def listed(row: Column, *names: str) -> Column:
    """The entries of the first of the fields that is a filled list, as JSON texts."""
    lists = [F.from_json(F.get_json_object(row, f"$.{n}"), "array<string>") for n in names]
    filled = [F.when(F.size(a) > 0, a) for a in lists]
    return F.coalesce(*filled, F.array().cast("array<string>"))


def truth(row: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(row, f"$.{name}"), F.lit("")).isin("", "false", "0", "null", "[]", "{}") == F.lit(False)


def draft_rules(steps: DataFrame) -> DataFrame:
    """(sop_id, rule_id, step_number, description, section, conditions, actions,
    output, is_out_of_scope) of ``steps`` (sop_id, step), each step a JSON text;
    steps without a number are left out."""
    s = c("step")
    rows = steps.withColumn("n", whole_number(field(s, "step_number", "number"))).filter("n is not null")
    texts = lambda *names: F.filter(F.transform(listed(s, *names), lambda t: F.translate(t, "\0", "")), lambda t: t != "")
    last = field(s, "terminal_action")
    actions = F.when(F.size(texts("actions")) > 0, texts("actions")).when(last != "", F.array(last)).otherwise(F.array().cast("array<string>"))
    named = F.coalesce(F.nullif(field(s, "yaml_rule_id"), F.lit("")), F.concat(F.lit("RULE-"), F.lpad(c("n").cast("string"), 3, "0")))
    long = F.when(c("n") > 999, F.concat(F.lit("RULE-"), c("n").cast("string"))).otherwise(named)
    rule_id = F.when(field(s, "yaml_rule_id") != "", named).otherwise(long)
    return rows.select("sop_id", rule_id.alias("rule_id"), c("n").alias("step_number"), field(s, "question", "title").alias("description"), field(s, "section").alias("section"), texts("conditions").alias("conditions"), actions.alias("actions"), field(s, "output_text").alias("output"), truth(s, "is_out_of_scope").alias("is_out_of_scope"), s.alias("_step"))


def draft_rows(rules: DataFrame) -> DataFrame:
    """Rows of the rules of :func:`draft_rules` as a tree: sop_id, rule_id, node_id,
    parent_id (null at the top), ord, table_name, description, conditions,
    actions, output, applicable_when, is_out_of_scope, nav_op, nav_step.

    A row without an id is numbered below its parent.  Entries that are no
    objects are skipped but keep their number.  Reading stops at 1,000 levels,
    which is where JSON readers stop.  Rows are dealt over tasks at each level, as
    nested texts are heavy to read and small in files.
    """
    r = c("row")

    def opened(parents: DataFrame, owner: str, children: Column) -> DataFrame:
        """The rows in ``children``, below ``owner``."""
        each = parents.select("sop_id", "rule_id", c(owner).alias("owner"), F.posexplode(children).alias("ord", "row")).filter(F.ltrim("row").startswith("{"))
        number = (c("ord") + 1).cast("string")
        made = F.concat("owner", F.lit("-"), F.when(c("ord") < 999, F.lpad(number, 3, "0")).otherwise(number))
        return each.withColumn("node_id", F.coalesce(F.nullif(field(r, "subrule_id"), F.lit("")), made))

    level = stage(opened(dealt(rules, "sop_id"), "rule_id", listed(c("_step"), "decision_rows", "rows")).withColumn("parent_id", F.lit(None).cast("string")))
    read = level
    while not level.isEmpty():
        level = stage(opened(dealt(level, "sop_id", 20_000), "node_id", listed(r, "subrules", "children")).withColumn("parent_id", c("owner")))
        read = read.unionByName(level)
    target = whole_number(F.coalesce(F.nullif(F.nullif(field(r, "skip_to_step"), F.lit("")), F.lit("0")), field(r, "goto_step")))
    one = lambda text: F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return read.select(
        "sop_id", "rule_id", "node_id", "parent_id", "ord", field(r, "table_name").alias("table_name"), field(r, "condition_if", "if").alias("description"),
        one(field(r, "condition_and", "and")).alias("conditions"), one(field(r, "action", "then")).alias("actions"), field(r, "output_text").alias("output"), field(r, "applicable_when").alias("applicable_when"),
        truth(r, "is_out_of_scope").alias("is_out_of_scope"), F.when(target.isNotNull(), "goto").alias("nav_op"), target.alias("nav_step"),
    )


def patched_rows(rows: DataFrame, rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Top rows with what ``patches`` (sop_id, step_number, node_id,
    applicable_when, nav_step, is_out_of_scope) say of them: conditions and
    targets fill blanks only, targets must be declared in the document."""
    steps = rules.select("sop_id", "rule_id", "step_number")
    declared = rules.select("sop_id", c("step_number").alias("p_nav")).distinct().withColumn("ok", F.lit(True))
    told = patches.select("sop_id", "step_number", "node_id", c("applicable_when").alias("p_when"), c("nav_step").alias("p_nav"), c("is_out_of_scope").alias("p_oos"))
    told = told.join(declared, ["sop_id", "p_nav"], "left").join(steps, ["sop_id", "step_number"]).drop("step_number")
    one = told.groupBy("sop_id", "rule_id", "node_id").agg(F.min(F.nullif("p_when", F.lit(""))).alias("p_when"), F.min(F.when(c("ok"), c("p_nav"))).alias("p_nav"), F.max(F.coalesce("p_oos", F.lit(False))).alias("p_oos"))
    both = rows.join(one, ["sop_id", "rule_id", "node_id"], "left")
    top = c("parent_id").isNull()
    goes = top & c("nav_op").isNull() & c("p_nav").isNotNull()
    return both.withColumns(
        {
            "applicable_when": F.when(top & (c("applicable_when") == "") & c("p_when").isNotNull(), c("p_when")).otherwise(c("applicable_when")),
            "nav_op": F.when(goes, "goto").otherwise(c("nav_op")),
            "nav_step": F.when(goes, c("p_nav")).otherwise(c("nav_step")),
            "is_out_of_scope": c("is_out_of_scope") | (top & F.coalesce("p_oos", F.lit(False))),
        }
    ).drop("p_when", "p_nav", "p_oos")


def patched_rules(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Rules with the aggregation that ``patches`` (sop_id, step_number,
    aggregation_rule) give their step, where it is a known one."""
    name = F.lower(F.trim("aggregation_rule"))
    told = patches.filter(name.isin(*AGGREGATIONS)).groupBy("sop_id", "step_number").agg(F.min(name).alias("aggregation_rule"))
    return rules.join(told, ["sop_id", "step_number"], "left")


def make_trees(steps: DataFrame, patches: DataFrame, structure: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, rows and lost rows of documents: the draft, patched while rows hang
    where the document has them, then hung below the parents that ``structure``
    (node_id, parent_id) names.  ``lost`` (sop_id, node_id) is what the draft has
    and the tree has not; it is empty, as rows left out keep a place at the top."""
    rules = stage(draft_rules(steps))
    draft = stage(patched_rows(draft_rows(rules), rules, patches))
    key = lambda side: F.concat_ws("/", c("sop_id").cast("string"), side)
    told = structure.select(key(c("node_id")).alias("node_id"), key(c("parent_id")).alias("parent_id"))
    keyed = draft.withColumns({"node_id": key(c("node_id")), "parent_id": F.when(c("parent_id").isNotNull(), key(c("parent_id")))})
    kept = keyed.filter("parent_id is not null").select("node_id", "parent_id").join(told.select("node_id"), "node_id", "left_anti")
    trees = apply_structure(keyed, told.unionByName(kept))
    plain = lambda name: F.substr(c(name), F.length(c("sop_id").cast("string")) + 2, F.length(c(name)))
    trees = stage(trees.withColumns({"node_id": plain("node_id"), "parent_id": plain("parent_id")}))
    lost = draft.select("sop_id", "node_id").join(trees.select("sop_id", "node_id"), ["sop_id", "node_id"], "left_anti")
    return rules.drop("_step"), trees, lost


def rooted(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is not among them hang at the root."""
    known = nodes.select(c("node_id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    return nodes.join(known, "parent_id", "left").withColumn("parent_id", F.when(c("_known"), c("parent_id"))).drop("_known")


def root_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path) of a forest (node_id, parent_id, ord): the way from a node's
    root to it, as (ord, node_id), which sorts depth first.

    Pointer doubling: every turn each node takes over the way that its highest
    known ancestor has gone so far, so a tree of depth d takes log d joins.
    Nodes that hang below themselves have no root and are left out.
    """
    at = stage(nodes.select("node_id", c("parent_id").alias("up"), F.array(F.struct("ord", "node_id")).alias("path")))
    n, turns = at.count(), 0
    while 1 << turns <= n and not at.filter("up is not null").isEmpty():
        above = at.select(c("node_id").alias("up"), c("up").alias("next"), c("path").alias("way"), F.lit(True).alias("known"))
        both = at.join(above, "up", "left")
        at = stage(both.select("node_id", F.when(c("known"), c("next")).otherwise(c("up")).alias("up"), F.when(c("known"), F.concat("way", "path")).otherwise(c("path")).alias("path")))
        turns += 1
    return at.filter("up is null").select("node_id", "path")


def nested(nodes: DataFrame, fields: list[str], children: str = "children") -> DataFrame:
    """(node_id, n_nodes, document) of the roots of a forest (node_id, parent_id,
    ord, ...): their tree as JSON text, each node's ``fields`` and its children
    in order.

    A document is its nodes' texts in depth-first order with brackets between
    them, which the depths of neighbours tell; so it is one sort, whatever the
    depth.  Only a document's own nodes are held at once.  Node ids must be
    unique; orphans count as roots.
    """
    forest = rooted(nodes)
    own = forest.select("node_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("own"))
    placed = root_paths(forest).join(own, "node_id").select(c("path")[0]["node_id"].alias("root"), "path", (F.size("path") - 1).alias("depth"), "own")
    after = F.lead("depth").over(Window.partitionBy("root").orderBy("path"))
    placed = placed.withColumn("after", after)
    opened = F.concat(F.substr(c("own"), F.lit(1), F.length("own") - 1), F.when(c("own") == "{}", "").otherwise(","), F.lit(f'"{children}":['))
    closed = F.call_function("repeat", F.lit("]}"), c("depth") - F.coalesce("after", F.lit(0)) + 1)
    text = F.concat(opened, closed, F.when(c("after") <= c("depth"), ",").otherwise(""))
    rows = placed.select("root", "path", text.alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda s: s["text"]), "")
    return rows.groupBy(c("root").alias("node_id")).agg(F.count("*").alias("n_nodes"), joined.alias("document"))
