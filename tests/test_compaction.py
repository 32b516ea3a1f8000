"""Tool records against the recurrence read record by record."""

import json
import random

import pytest

from rulespan.functions import jsontext as jt
from rulespan.operators import compaction as cp


def in_turn(records, claim, total, most, least):
    left, out = total, []
    for raw in records:
        record = json.loads(raw)
        budget = None
        if record.get("result") is not None:
            budget = max(least, min(most, left))
            record["result"] = jt.pruned(record["result"])
            if cp.tokens_by_length(json.dumps(record["result"])) > budget:
                record["result"] = cp.cut_result(record["result"], claim, budget, cp.tokens_by_length)
        text = json.dumps(record)
        left -= cp.tokens_by_length(text)
        out.append((budget, cp.tokens_by_length(text), text))
    return out


def record(r):
    kind = r.randint(0, 4)
    rows = [{"descCode": r.choice(["99213", "90837", "H0031", "11111"]), "covered": r.choice(["Y", "", None]), "mappingId": 5, "note": "x" * r.randint(0, 30)} for _ in range(r.randint(0, 40))]
    result = {0: None, 1: "t" * r.randint(0, 600), 2: {"grid": rows, "state": "TX"}, 3: {"list": [f"word{r.randint(0, 9)} " * r.randint(1, 9) for _ in range(r.randint(1, 30))]}, 4: {"a": {"b": "y" * r.randint(0, 300)}}}[kind]
    return json.dumps({"tool": f"t{kind}", "result": result})


@pytest.mark.parametrize("total,most,least", [(600, 300, 40), (300, 250, 100), (10_000, 9_000, 500)])
def test_records_equal_the_recurrence(spark, total, most, least):
    r = random.Random(total)
    claims = {i: {"cpt": r.choice(["99213GT", "90837", "zz"]), "say": f"word{i} word1"} for i in range(6)}
    rows = [(i, n, record(r)) for i in claims for n in range(r.randint(1, 25))]
    table = spark.createDataFrame(rows, "claim_id long, ord int, record string").repartition(3)
    known = spark.createDataFrame([(i, json.dumps(v)) for i, v in claims.items()], "claim_id long, claim string")
    got = {(x["claim_id"], x["ord"]): (x["budget"], x["tokens"], x["record"]) for x in cp.compacted(table, known, total, most, least).collect()}
    for i, claim in claims.items():
        mine = [raw for k, _, raw in rows if k == i]
        assert [got[i, n] for n in range(len(mine))] == in_turn(mine, claim, total, most, least)
    assert len(got) == len(rows)


def test_odd_records(spark):
    rows = [(None, 0, '{"result": "' + "x" * 900 + '"}'), (None, 1, "no json"), (None, 2, None), (1, 0, '{"result": []}'), (1, 1, '[1, 2]'), (2, 0, "[" * 100_000)]
    out = {(x["claim_id"], x["ord"]): x for x in cp.compacted(spark.createDataFrame(rows, "claim_id long, ord int, record string"), spark.createDataFrame([], "claim_id long, claim string"), 100, 90, 10).collect()}
    assert len(out) == len(rows) and out[None, 0]["budget"] == 90 and json.loads(out[None, 0]["record"])["result"]["_total_chars"] == 902
    assert [out[k]["budget"] for k in ((None, 1), (None, 2), (1, 0), (1, 1), (2, 0))] == [None, None, 90, None, None]


def test_keys_of_procedure_codes():
    assert jt.codes_in({"processedDate": "20240101", "PROC_DT": "20240102", "SRV_CD": "g0444", "a": [{"serviceSrvCd": 90837, "procCode": " 99213GT"}], "cpt": {"hcpcs": "A123"}, "IPCD_ID": True}) == {"G0444", "90837", "99213GT", "99213", "A123"}


def test_deep_json_gives_null(spark):
    deep = '{"a":' * 200_000 + "1" + "}" * 200_000
    table = spark.createDataFrame([(1, deep), (2, '{"npi": "1234567890", "k": 1}')], "i int, j string")
    for read in (lambda j: jt.prune(j), lambda j: jt.find_first(j, "k"), lambda j: jt.find_last_first(j, "k")):
        out = {x["i"]: x["v"] for x in table.select("i", read(table["j"]).alias("v")).collect()}
        assert out[1] is None and out[2] is not None
