"""Canvas workflows: bindings read from properties, copies, semantic edges, and
provider payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations that say something about rules' meaning.
SEMANTIC = ("OVERRIDES", "IMPLIES", "GUARDS", "CITED_BY", "APPLIES_TO", "USES_CODE")
PROPERTIES = "sop_rules array<struct<key:string,sop_id:int,condition:string,action:string,manual_out_of_scope:boolean>>, tool_calls array<struct<name:string,rule_key:string,for_rule_key:string,args_template:map<string,string>>>"
PROVIDER = "number string, enumeration_type string, basic struct<status:string,first_name:string,last_name:string,credential:string,organization_name:string>, addresses array<struct<address_purpose:string,city:string,state:string>>, taxonomies array<struct<code:string,primary:boolean>>"


def _key_sop(key: Column) -> Column:
    return F.regexp_extract(key, r"^(?:pre|step):(\d+):", 1).try_cast("int")


def rule_bindings(shapes: DataFrame, sops: DataFrame) -> DataFrame:
    """(shape_id, ordering, rule_key, sop_id, condition, action, manual) of the
    rules in the shapes' JSON ``properties``: those with a key whose procedure,
    named or read from the key, exists.  ``ordering`` is the place in the list."""
    each = shapes.select("shape_id", F.posexplode(F.from_json("properties", PROPERTIES)["sop_rules"]).alias("ordering", "r"))
    named = each.filter(F.coalesce("r.key", F.lit("")) != "").withColumn("sop_id", F.coalesce(F.nullif("r.sop_id", F.lit(0)), _key_sop(F.col("r.key"))))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c.rpartition(".")[2])
    known = named.join(sops.select("sop_id").distinct(), "sop_id", "left_semi")
    return known.select("shape_id", "ordering", F.col("r.key").alias("rule_key"), "sop_id", blank("r.condition"), blank("r.action"), F.coalesce("r.manual_out_of_scope", F.lit(False)).alias("manual"))


def tool_bindings(shapes: DataFrame, tools: DataFrame, rules: DataFrame) -> DataFrame:
    """(shape_id, ordering, name, rule_key, args) of the known tools (name) in the
    shapes' properties, with the bound rule of the same shape that they name,
    the last of equal keys, or none."""
    each = shapes.select("shape_id", F.posexplode(F.from_json("properties", PROPERTIES)["tool_calls"]).alias("ordering", "t"))
    asked = each.select("shape_id", "ordering", F.col("t.name").alias("name"), F.coalesce(F.nullif("t.rule_key", F.lit("")), F.nullif("t.for_rule_key", F.lit(""))).alias("rule_key"), F.coalesce(F.to_json("t.args_template"), F.lit("{}")).alias("args"))
    bound = rules.select("shape_id", "rule_key", F.lit(True).alias("bound")).distinct()
    joined = asked.join(tools.select("name").distinct(), "name", "left_semi").join(bound, ["shape_id", "rule_key"], "left")
    return joined.select("shape_id", "ordering", "name", F.when(F.col("bound"), F.col("rule_key")).alias("rule_key"), "args")


def duplicate_workflow(shapes: DataFrame, connections: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """A copy of the shapes (workflow_id, shape_id, ...) and the connections
    (source_shape, target_shape, ...) of a workflow under new ids, which follow
    from the old id and the target; a connection with an end elsewhere is not
    copied.  A workflow's shapes need not fit anywhere but in a join."""
    new_id = lambda c: F.left(F.sha2(F.concat_ws("/", F.lit(target), c), 256), F.lit(32))
    mine = shapes.filter(F.col("workflow_id") == source)
    ids = mine.select("shape_id")
    copied = mine.withColumns({"workflow_id": F.lit(target), "shape_id": new_id(F.col("shape_id"))})
    inner = connections
    for end in ("source_shape", "target_shape"):
        inner = inner.join(ids.withColumnRenamed("shape_id", end), end, "left_semi")
    return copied, inner.withColumns({end: new_id(F.col(end)) for end in ("source_shape", "target_shape")})


def semantic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sop_id, source, rel, target) of edges of meaning between nodes (sop_id, key)."""
    inside = edges.filter(F.col("rel").isin(*SEMANTIC))
    a, b = nodes.select(F.col("key").alias("source"), "sop_id"), nodes.select(F.col("key").alias("target"), F.col("sop_id").alias("_to"))
    return inside.join(a, "source").join(b, "target").filter(F.col("sop_id") == F.col("_to")).select("sop_id", "source", "rel", "target")


def provider(payload: Column) -> Column:
    """A registry's JSON provider: names of a person or an organisation, its last
    location and mailing address, its primary taxonomy and the other ones."""
    p = F.from_json(payload, PROVIDER)
    person = F.coalesce(p["enumeration_type"] == "NPI-1", F.lit(False))
    text = lambda c: F.coalesce(c, F.lit(""))
    last = lambda kind: F.try_element_at(F.filter(p["addresses"], lambda a: a["address_purpose"] == kind), F.lit(-1))
    main = lambda x: F.coalesce(x["primary"], F.lit(False))
    return F.struct(
        text(p["number"]).alias("npi"),
        F.when(person, text(p["basic"]["first_name"])).alias("first_name"),
        F.when(person, text(p["basic"]["last_name"])).alias("last_name"),
        F.when(~person, text(p["basic"]["organization_name"])).alias("organization_name"),
        last("LOCATION").alias("practice_address"),
        last("MAILING").alias("mailing_address"),
        F.try_element_at(F.filter(p["taxonomies"], main), F.lit(-1))["code"].alias("primary_taxonomy"),
        F.transform(F.filter(p["taxonomies"], lambda x: ~main(x)), lambda x: x["code"]).alias("other_taxonomies"),
    )
