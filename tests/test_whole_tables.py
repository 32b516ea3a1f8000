"""Queries that must read past any fixed key."""

import pytest

from rulespan.queries import all_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    keys = spark.range(3900, 4200).withColumnRenamed("id", "o_orderkey")
    keys.selectExpr("o_orderkey", "o_orderkey % 70 AS o_custkey").write.parquet(f"{base}/orders.parquet")
    keys.selectExpr("o_orderkey AS l_orderkey", "explode(sequence(1, 6)) AS l_linenumber").write.parquet(f"{base}/lineitem.parquet")
    return base


def test_rule_queries_read_all_keys(spark, tables):
    run = {n: all_queries()[n][0](spark, tables) for n in ("ir_validate_all", "ir_repair_all", "routing_patches_all", "rule_hydration_all")}
    assert run["ir_repair_all"].count() == run["routing_patches_all"].count() == 300
    assert run["ir_validate_all"].filter("problem = 'subrule without id'").count() == 300
    assert run["rule_hydration_all"].count() == 6 * sum(k % 7 <= 4 for k in range(3900, 4200))


def test_graph_queries_reach_all_nodes_and_pages(spark, tmp_path):
    spark.range(1, 11).selectExpr("id AS c_custkey", "id % 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).selectExpr("id AS n_nationkey", "0L AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1).selectExpr("id AS r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(1100).selectExpr("id AS page_id").write.parquet(f"{tmp_path}/pages.parquet")
    up = all_queries()["ancestors_all"][0](spark, str(tmp_path))
    assert {r["start"] for r in up.collect()} == {f"dec:{i}" for i in range(1, 11)} and up.count() == 30
    depth, order = {0: 0}, [0]
    for page in order:  # one page after the other, its links as they stand there
        for t in ((3 * page + 2) % 1100, (2 * page + 1) % 1100):
            if t not in depth and depth[page] < 6:
                depth[t] = depth[page] + 1
                order.append(t)
    want = [(u, depth[u], i) for i, u in enumerate(order[:40])]
    found = all_queries()["crawl_frontier_all"][0](spark, str(tmp_path)).collect()
    assert sorted((r["url"], r["depth"], r["found"]) for r in found) == sorted(want)


def test_walks_and_trees_have_no_depth_limit(spark):
    from rulespan.operators import graph
    from rulespan.plans import ir

    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, 0, "r", i == 3) for i in range(60)], "node_id string, parent_id string, ord int, rule_id string, flag boolean")
    found = {r["node_id"]: r for r in ir.tree_paths(chain.coalesce(1), "flag").collect()}
    assert len(found) == 60 and found["n59"]["depth"] == 59 and found["n59"]["inherited"] and not found["n2"]["inherited"]
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "source string, target string")
    starts = spark.createDataFrame([("a",)], "key string")
    below = sorted((r["key"], r["depth"]) for r in graph.descendants(edges, starts).collect())
    assert below == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    walks = sorted(">".join(r["path"]) for r in graph.reach(edges, starts).collect())
    assert walks == ["a", "a>b", "a>b>d", "a>b>d>e", "a>c", "a>c>d", "a>c>d>e"]


def test_step_numbers_take_the_least_unused(spark):
    from rulespan.operators.ordered import renumber_duplicates

    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, 5), ("a", 4, 5), ("a", 5, 2), ("a", 6, 1), ("b", 1, None), ("b", 2, None), ("b", 3, 1), ("c", 1, 1)]
    out = renumber_duplicates(spark.createDataFrame(rows, "sop string, pos int, step int"), "sop", "pos", "step").collect()
    assert {(r["sop"], r["pos"]): r["step"] for r in out} == {("a", 1): 1, ("a", 2): 3, ("a", 3): 5, ("a", 4): 4, ("a", 5): 2, ("a", 6): 6, ("b", 1): None, ("b", 2): 2, ("b", 3): 1, ("c", 1): 1}
