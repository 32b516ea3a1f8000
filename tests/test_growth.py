"""Steps whose work grows with their input, not faster."""

from pyspark.sql import functions as F

from rulespan.operators import coverage as cv
from rulespan.operators import lookups as lk
from rulespan.operators import ordered
from rulespan.operators import pointers as pt
from rulespan.plans import draft as dr


def test_gaps_of_one_large_group_are_filled_in_one_pass(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("g"), "id", F.when(F.col("id") == n - 1, 7).when(F.col("id") == n - 2, 8).alias("page"))
    df = ordered.fill_both_ways(rows, "g", ["id"], "page")
    assert {(x["page"], x["n"]) for x in df.groupBy("page").agg(F.count("*").alias("n")).collect()} == {(8, n - 1), (7, 1)}


def test_requests_of_one_file_are_searched_by_several_tasks(spark):
    k = F.col("id")
    asked = spark.range(0, 12_000, 1, 1).select(
        k.alias("request_id"), F.when(k % 4 == 0, (k % 3).cast("string")).alias("npi"), F.when(k % 5 > 0, F.concat(F.lit("L"), k % 3)).alias("last_name"),
        F.when(k % 2 == 0, "F").when(k % 3 == 0, "").alias("first_name"), F.when(k % 7 == 0, "S").otherwise("").alias("state"),
    )
    records = spark.createDataFrame([(i, str(i % 3), f"L{i % 4}", "FG"[i % 2], "ST"[i % 5 == 0]) for i in range(24)] + [(99, None, None, "F", "S")], "record_id long, npi string, last_name string, first_name string, state string")
    df = cv.optout_registry(asked, records)
    want, known = set(), records.collect()
    for a in asked.collect():
        for r in known:
            if a["npi"]:
                fits = a["npi"] == r["npi"]
            else:
                fits = a["last_name"] and a["last_name"] == r["last_name"] and all(not a[n] or a[n] == r[n] for n in ("first_name", "state"))
            if fits:
                want.add((a["request_id"], r["record_id"]))
    got = df.select("request_id", "record_id", F.spark_partition_id().alias("p")).collect()
    assert {(x["request_id"], x["record_id"]) for x in got} == want and len(got) == len(want)
    assert len({x["p"] for x in got if x["request_id"] % 4}) > 4


def test_fields_of_rows_need_no_grouping(spark):
    ways = spark.createDataFrame([("who", 1, "B", "b"), ("who", 0, "A", "a"), ("when", 0, "C", "gone"), ("when", 5, "D", "c"), ("what", 0, "E", "gone")], "field string, rank int, system string, column string")
    claims = spark.createDataFrame([(1, "x", "y", "z"), (2, "", "y", None), (3, None, "", ""), (1, "w", None, "")], "claim_id long, a string, b string, c string")
    df = lk.row_fields(ways, claims)
    assert sorted(map(tuple, df.collect())) == [(1, "when", "z", "D:c"), (1, "who", "w", "A:a"), (1, "who", "x", "A:a"), (2, "who", "y", "B:b")]
    tall = claims.filter("a is null or a <> 'w'").unpivot("claim_id", ["a", "b", "c"], "column", "value")
    assert sorted(map(tuple, lk.field_priority(ways, tall).collect())) == [(1, "when", "z", "D:c"), (1, "who", "x", "A:a"), (2, "who", "y", "B:b")]
    assert lk.row_fields(ways.limit(0), claims).count() == 0


def test_lines_are_counted_against_packed_candidates(spark, monkeypatch):
    monkeypatch.setattr(lk, "PACK", 7)
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    lines = [(f"l{i}", i % 9, None if i % 11 == 0 else i % 3, i, i + i % 4 if i % 13 else None) for i in range(60)]
    cands = [(i, i % 4, i, i + 20 if i % 10 else None) for i in range(100)] + [(200, None, 0, 99)]
    ls = spark.createDataFrame(lines, "line_id string, claim_id long, k int, f long, t long").select("line_id", "claim_id", "k", day("f").alias("from_date"), day("t").alias("to_date"))
    cs = spark.createDataFrame(cands, "cand_id long, k int, f long, t long").select("cand_id", "k", day("f").alias("low_date"), day("t").alias("high_date"))
    out = {x["line_id"]: x["filtered_claims_count"] for x in lk.duplicate_claims(ls, cs, ["k"]).collect()}
    assert out == {i: sum(k is not None and k == ck and f >= lo and hi is not None and t <= hi for _, ck, lo, hi in cands) for i, _, k, f, t in lines if t is not None}


def test_rings_cost_no_more_turns_than_chains(spark, monkeypatch):
    turns, stage = [], pt.stage
    monkeypatch.setattr(pt, "stage", lambda df: turns.append(1) or stage(df))
    links = [(i, i + 1) for i in range(10)] + [(100 + i, 100 + (i + 1) % 3000) for i in range(3000)]
    out = {x["key"]: x["end"] for x in pt.follow(spark.createDataFrame(links, "key long, to long")).collect()}
    assert out == {i: 10 for i in range(10)} | {100 + i: None for i in range(3000)}
    assert len(turns) <= 7  # the rows, their ends, chains of 2, 4, 8 and 16 links, and a turn that ends none


def test_captured_tools_stay_in_their_row(spark):
    tools = spark.createDataFrame([("r", "d", "1", ["doc360", "odd", "doc360", "medicare_optout", "npi_registry"]), ("r", "d", "2", []), ("r", "d", "3", None)], "report string, document string, rule_id string, tools array<string>")
    seen = spark.createDataFrame([("doc360_read_claim_by_fln_dcc",), ("other",), (None,)], "name string")
    df = pt.captured_tools(tools, seen)
    assert {x["rule_id"]: (x["captured"], x["gaps"]) for x in df.collect()} == {"1": (["doc360_read_claim_by_fln_dcc"], ["odd(unknown)", "medicare_optout(no-capture)", "npi_registry->npi_registry_lookup(not-in-snapshot)"]), "2": ([], []), "3": ([], [])}
    assert [x["gaps"] for x in pt.captured_tools(tools, seen.limit(0)).orderBy("rule_id").collect()][0][0] == "doc360->doc360_read_claim_by_fln_dcc(not-in-snapshot)"


def test_drafts_are_read_by_several_tasks(spark, monkeypatch):
    sizes, dealt = [], dr.dealt
    monkeypatch.setattr(dr, "dealt", lambda rows, *more: sizes.append(dealt(rows, *more).rdd.getNumPartitions()) or dealt(rows, *more))
    step = '{"number":1,"decision_rows":[{"if":"a","children":[{"if":"b"}]}]}'
    rules = dr.draft_rules(spark.range(0, 11_000, 1, 1).select(F.col("id").alias("sop_id"), F.lit(step).alias("step")))
    assert dr.draft_rows(rules).count() == 22_000 and sizes[0] == 3
