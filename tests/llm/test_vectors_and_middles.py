"""Centroid clustering, fill-in-middle and the hash forest against brute force."""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from helpers import no_docs, odd_docs, odd_rows, prose

from rulespan.llm import neighbours
from rulespan.llm.centroids import Centroids, cluster_vectors, square
from rulespan.llm.fill_middle import MARKS, check_marks, fill_in_middle, restore
from rulespan.llm.neighbours import nearest_neighbours

NAN, INF = float("nan"), float("inf")


def clustered(rows, clusters, rounds, dims, scale=1024, seed=3):
    """The contract, row by row in whole numbers."""
    kept = [(i, [floor(Fraction(v) * scale) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], object).tolist()))
    centres = [x for _, x in order[:clusters]]
    near = lambda x: min(range(len(centres)), key=lambda j: (square(x, centres[j]), j))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), c in zip(kept, of) if c == j]
            if mine:
                centres[j] = [sum(v) // len(mine) for v in zip(*mine)]
    out = []
    for i, x in kept:
        j = near(x)
        out.append((i, j, square(x, centres[j]), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()))
    per = {}
    for _, j, d, _ in out:
        per[j] = per.get(j, 0) + d
    long = lambda v: v if v < 1 << 63 else None
    return [(i, j, long(d), long(per[j]), long(sum(per.values())), h) for i, j, d, h in out]


def same_clusters(spark, rows, clusters, rounds, dims, kind="double"):
    table = spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, embedding array<{kind}>, distance int").repartition(3)
    out = [tuple(r) for r in cluster_vectors(table, clusters=clusters, rounds=rounds, dimensions=dims).collect()]
    assert sorted(out, key=str) == sorted(clustered(rows, clusters, rounds, dims), key=str)


@pytest.mark.parametrize("spread", [0.001, 1.0, 40.0])
def test_clusters_equal_whole_number_arithmetic(spark, spread):
    r = np.random.default_rng(int(spread * 1000))
    rows = [(i, (np.round(r.standard_normal(6) * spread * 8) / 8).tolist()) for i in range(150)]
    same_clusters(spark, rows, 5, 4, 6, "float")


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [NAN, 1.0]), (4, [None, 1.0]), (5, [INF, 0.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (None, [0.5, -0.5]), (8, []), (9, [-0.0, 0.0])]
    same_clusters(spark, rows, 3, 3, 2)
    same_clusters(spark, rows, 8, 10, 2)  # fewer vectors than clusters
    table = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")
    assert cluster_vectors(table.limit(0)).count() == 0 and cluster_vectors(table).count() == 0


def test_clusters_of_components_of_any_size(spark):
    rows = [(1, [1e300, -1.0]), (2, [1e300, -1.5]), (3, [3.0, 4.0]), (4, [2.0**40, 0.0]), (5, [2.0**40 + 1, 0.25]), (6, [1.7e308, 0.0]), (7, [2.5, 4.0])]
    for clusters in (1, 2, 4):
        same_clusters(spark, rows, clusters, 3, 2)


def test_screening_leaves_ties_to_whole_numbers():
    here = Centroids([[10, 0], [0, 10], [10, 10], [0, 0]])
    x = np.array([[5, 5], [5, 0], [9, 1], [1 << 26, 1 << 26]], np.int32)
    shown = [0]
    assert here.nearest(x, shown).tolist() == [0, 0, 0, 2] and shown[0] >= 6
    r = np.random.default_rng(2)
    big = r.integers(-(1 << 27), 1 << 27, (300, 64)).astype(np.int32)
    centres = (big[:8] + r.integers(-2, 3, (8, 64))).tolist() + big[:3].tolist()
    there = Centroids(centres)
    want = [min(range(len(centres)), key=lambda j: (square(row, centres[j]), j)) for row in big.tolist()]
    assert there.nearest(big).tolist() == want
    low, high = there.intervals(big)
    true = np.array([[sum(c * c for c in centre) - 2 * sum(a * c for a, c in zip(row, centre)) for centre in centres] for row in big[:40].tolist()], float)
    assert (low[:40] <= true).all() and (true <= high[:40]).all()


def middle(doc_id, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        form, output, sizes = "plain", text, (None, None)
    else:
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h[3] % 100 < spm else "psm"
        output, sizes = (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), (len(p), len(m))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(units), form, *sizes, output, digest(output), digest(text)


@pytest.mark.parametrize("rate,spm,unit", [(100, 50, r"[^\n]*\n|[^\n]+"), (60, 30, r"(?s:.)"), (100, 100, r"[^ ]+ *| +")])
def test_middles_equal_the_definition(spark, rate, spm, unit):
    lines = [(100 + i, "\n".join(prose(i * 9 + j, j % 4) for j in range(i)), None, None) for i in range(30)]
    marked = [(200, "a <P> b\n", None, None), (201, "a <M", None, None), (202, "<S", None, None), (203, "\n" * 5, None, None), (204, "x" * 3_000_000, None, None), (205, "é\n𝄞<\n<" * 9, None, None)]
    docs = spark.createDataFrame([*lines, *marked], "doc_id long, text string, lang string, source string").unionByName(odd_docs(spark), allowMissingColumns=True)
    rows = [*lines, *marked, *odd_rows()]
    out = [tuple(r) for r in fill_in_middle(docs.withColumn("form", docs.doc_id), rate=rate, spm=spm, unit=unit).collect()]
    assert sorted(out, key=str) == sorted((middle(r[0], r[1], rate, spm, unit) for r in rows), key=str)
    assert all(hashlib.sha256(restore(r[5], r[2]).encode()).hexdigest() == r[7] for r in out)
    assert {"psm", "spm", "plain"} >= {r[2] for r in out} >= {"spm", "plain"}


def test_middles_of_nothing(spark):
    out = fill_in_middle(no_docs(spark), texts=False)
    assert out.count() == 0 and "output" not in out.columns
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            check_marks(marks)


def exact_neighbours(rows, k, every):
    width = max(len(x) for _, x in rows)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows])
    out = {}
    for i, (name, _) in enumerate(rows):
        if name is not None and name % every == 0:
            s = x @ x[i]
            best = sorted((-s[j], 1 << 62 if rows[j][0] is None else rows[j][0]) for j in range(len(rows)) if j != i)[:k]
            out.setdefault(name, []).append([(-a, None if b == 1 << 62 else b) for a, b in best])
    return out


def found_neighbours(table, **given):
    rows = {}
    for r in nearest_neighbours(table, **given).collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(v) for q, v in rows.items()}


@pytest.mark.parametrize("kind", ["even", "lengths", "clusters", "offset"])
@pytest.mark.parametrize("cell,pack,most_depth", [(4096, 1024, 16), (150, 7, 2)])
def test_forest_finds_most_neighbours(spark, kind, cell, pack, most_depth):
    r = np.random.default_rng(5)
    x = r.standard_normal((2500, 16))
    x = {"even": x, "lengths": x * np.exp(r.standard_normal((2500, 1))), "clusters": x * 0.05 + r.standard_normal((40, 16))[r.integers(0, 40, 2500)], "offset": x + 4}[kind]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    seen = {}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = found_neighbours(table, k=10, every=20, cell=cell, pack=pack, most_depth=most_depth, seen=seen)
    want = exact_neighbours(rows, 10, 20)
    assert set(got) == set(want) and seen["vectors"] == 2500
    hits = 0
    for q, (best,) in want.items():
        ranks, scores, ids = zip(*got[q])
        assert ranks == tuple(range(1, 11)) and q not in ids and len(set(ids)) == 10
        assert np.allclose(scores, [x[q] @ x[i] for i in ids], rtol=1e-12) and list(scores) == sorted(scores, reverse=True)
        hits += len({i for _, i in best} & set(ids))
    assert hits >= 0.9 * 10 * len(want)
    if kind == "clusters":
        assert seen["rows"] < 32 * 2500 / 4  # a query sees its surroundings, not the table


def test_deep_prefixes_are_counted(spark):
    """Beyond the depth that is counted for all prefixes, cells count for themselves."""
    r = np.random.default_rng(8)
    x = np.repeat(r.standard_normal((6, 8)), 100, axis=0) + r.standard_normal((600, 8)) * 1e-3
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    index = neighbours.Index(table, 5, 8, 30, 40, 16, 3, 1)
    _, asked = index.queries(10)
    rows = index.with_deep(asked, 1).toArrow()
    stored = index.entries.toArrow()
    entries = neighbours.rows_of(stored["codes"], "<i8", 8)
    for codes, counts in zip(neighbours.rows_of(rows["codes"], "<i8", 8), rows["counts"].to_pylist()):
        shared = neighbours.shared_prefix(codes, entries, 30)
        assert counts == [int((shared >= n).sum()) for n in range(31)]


def test_forest_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [0.5, -1.0]), (None, [1.0, 2.0]), (5, [3.0]), (8, [2.0, 2.0, 1.0]), (40, [1.0, 2.0])]
    idle = [(1, None), (2, [NAN, 1.0]), (3, [1.0, None]), (4, [INF, 0.0]), (7, []), (60, [0.0, -0.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows + idle], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours(table, k=10, every=20).collect() if r["vec_id"] is not None)
    want = sorted((q, n + 1, i, s) for q, lists in exact_neighbours(rows, 10, 20).items() for best in lists for n, (s, i) in enumerate(best) if i is not None)
    assert got == want
    assert nearest_neighbours(table.limit(0)).count() == 0
    assert nearest_neighbours(table.filter("vec_id = 0")).count() == 0
    assert nearest_neighbours(table.filter("vec_id in (5, 8)")).count() == 0


def test_copies_of_one_vector(spark):
    """A third of all rows are one vector: its least ids win every tie."""
    r = np.random.default_rng(4)
    x = r.standard_normal((900, 8))
    x[::3] = x[0] * 3
    rows = list(enumerate(x.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = found_neighbours(table, k=6, every=15)
    for q, (best,) in exact_neighbours(rows, 6, 15).items():
        assert [i for _, _, i in got[q]] == [i for _, i in best]
