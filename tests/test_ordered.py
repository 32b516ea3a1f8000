"""Budget batches over several ranges of a group, against a plain fold."""

import random

import pytest

from rulespan.operators import ordered
from rulespan.sources.staging import stage


@pytest.mark.parametrize("seed", [1, 4])
def test_budget_batches_across_ranges(spark, monkeypatch, seed):
    r, dealt = random.Random(seed), []
    monkeypatch.setattr(ordered, "stage", lambda df: dealt.append(stage(df)) or dealt[-1])
    rows = [(s, i, r.choice([0, 0, 1, 7, 40, 120])) for s in ("a", "b", None) for i in range(400 if s == "a" else 30)]
    want = {}
    for s in ("a", "b", None):
        batch = total = 0
        for g, i, n in rows:
            if g == s:
                if total > 0 and total + n > 100:
                    batch, total = batch + 1, 0
                total += n
                want[s, i] = batch
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = ordered.budget_batches(spark.createDataFrame(rows, "g string, i long, n long"), "g", ["i"], "i", "n", 100)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt[0].filter("_by = 'a'").select("_part").distinct().count() > 1
    assert {(x["g"], x["i"]): x["batch"] for x in df.collect()} == want
