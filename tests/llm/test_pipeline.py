"""The pipeline on small tables, stage by stage against brute force."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import prose
from test_brute_force import distance, edited

import corpus_pipeline as cp


def test_stages_take_effect(spark, tmp_path):
    rows = [(i, prose(i, 50 + i % 9), "en", f"s{i % 4}", 0) for i in range(120)]
    rows += [(500 + i, rows[i][1], "en", "s0", 0) for i in range(10)]
    shared = prose(9000, 40)
    rows += [(600 + i, prose(700 + i, 30) + " " + shared, "en", "s1", 0) for i in range(6)]
    rows += [(800 + i, " ".join(w.upper() + "!!" for w in prose(i, 50).split()), "en", "s2", 0) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 800), 0) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        assert name == "best_fit_packing" or tuple(docs.columns) == cp.COLUMNS
    ids = {n: [r[0] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    assert not [i for i in ids["quality_classifier"] if i >= 800]
    assert len([i for i in ids["quality_classifier"] if i < 800]) >= 130
    assert not [i for i in ids["near_dedup"] if 500 <= i < 600]
    cut = {r["doc_id"]: r["text"] for r in seen["substring_dedup"].collect()}
    assert all(shared not in t for t in cut.values()) and cut[0] == rows[0][1]
    assert max(ids["source_mixing"].count(i) for i in ids["source_mixing"]) == 2
    assert set(ids["best_fit_packing"]) == set(ids["source_mixing"])


def tables(spark, folder):
    """Prose of four sources with junk, exact and near copies and a shared passage."""
    rows = [(i, prose(i, 36 + i % 9), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(4)] + [(200 + i, edited(rows[i][1], 0.1, i), "en", "s2", 0) for i in range(4, 10)]
    shared = prose(9000, 38)
    rows += [(300 + i, f"{prose(700 + i, 20)} {shared} {prose(800 + i, 20)}", "en", "s3", 0) for i in range(5)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(500 + i, 40).split()), "en", "s0", 0) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 400), 0) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def plain_words(text):
    return "".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in text.lower()).split()


def expected_quality(spark, before, folder):
    from rulespan.llm import quality_pu as pu
    from rulespan.llm.features import quality_features

    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = pu.train(docs, labels)
    score = pu.chance(quality_features(pa.array([r["text"] for r in before]), pu.DIMS) @ model.weights)
    return Counter(r["doc_id"] for r, s in zip(before, score) if s >= pu.THRESHOLD)


def expected_dedup(before):
    words = {r["doc_id"]: plain_words(r["text"]) for r in before}
    ids, label = sorted(words), {i: i for i in words}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            longer = max(len(words[a]), len(words[b]))
            if label[a] != label[b] and distance(words[a], words[b]) <= int(0.2 * longer + 1e-9):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return Counter(set(label.values()))


def expected_strip(before):
    words = {r["doc_id"]: r["text"].split() for r in before}
    starts = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - 34) if starts[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return {i: t for i, t in out.items() if t}


def test_run_equals_brute_force_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from rulespan.llm.packing import default_tokenizer

    folder = str(tmp_path)
    tables(spark, folder)
    docs, before, after = spark.read.parquet(f"{folder}/documents.parquet"), {}, {}
    for name, stage in cp.STAGES:
        before[name] = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after[name] = docs.collect()
    ids = lambda rows: Counter(r["doc_id"] for r in rows)
    assert ids(after["quality_classifier"]) == expected_quality(spark, before["quality_classifier"], folder)
    assert not any(i >= 400 for i in ids(after["quality_classifier"]))
    assert ids(after["near_dedup"]) == expected_dedup(before["near_dedup"])
    assert not any(100 <= i < 300 for i in ids(after["near_dedup"]))
    assert {r["doc_id"]: r["text"] for r in after["substring_dedup"]} == expected_strip(before["substring_dedup"])
    sizes, taken = Counter(), Counter()
    for r in before["source_mixing"]:
        sizes[r["source"]] += len(r["text"].split())
    for r in after["source_mixing"]:
        taken[r["source"]] += len(r["text"].split())
    assert max(ids(after["source_mixing"]).values()) == 2 and set(ids(after["source_mixing"])) <= set(ids(before["source_mixing"]))
    weights = dict(zip(sorted(sizes), (5, 2, 1, 5)))
    level = next(x for x in np.arange(0, sum(sizes.values()), 0.5) if sum(min(2 * sizes[s], w * x) for s, w in weights.items()) >= 1.5 * sum(sizes.values()) - 1)
    assert all(abs(taken[s] - min(2 * sizes[s], w * level)) <= 60 for s, w in weights.items())
    library, pieces = Tokenizer.from_file(default_tokenizer()), Counter()
    for r in before["best_fit_packing"]:
        tokens = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        pieces[r["doc_id"], 0, 0, len(tokens), zlib.crc32(tokens.tobytes())] += 1
    slim = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert slim(after["best_fit_packing"]) == pieces
    whole = cp.run(spark, folder).collect()
    assert slim(whole) == pieces
    ends = Counter()
    for r in sorted(whole, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024
