"""Operators against brute-force readings on small tables, and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose

from rulespan.llm import near_dedup, packing
from rulespan.llm.mixing import fit_budget, mix_sources
from rulespan.llm.near_dedup import band_distances, near_duplicates
from rulespan.llm.packing import default_tokenizer, pack, plan_packing, tokenizer
from rulespan.llm.quality_pu import quality_classifier
from rulespan.llm.quality_rules import quality_rules
from rulespan.llm.substring_dedup import remove_repeats
from rulespan.llm.topk import top_k
from rulespan.llm.toxicity import toxicity
from rulespan.llm.warc import inflate, parse, record, records

DOCS = "doc_id long, text string, lang string, source string"


def edited(text: str, share: float, seed: int) -> str:
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{r.randint(0, 9999)}"
    return " ".join(words)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_equals_full_table():
    r = random.Random(3)
    a, b, limits = [], [], []
    for _ in range(150):
        x = [r.randint(1, 9) for _ in range(r.randint(0, 50))]
        y = [v for v in x if r.random() > 0.1] + [r.randint(1, 9) for _ in range(r.randint(0, 4))]
        a.append(np.array(x, np.uint32)), b.append(np.array(y, np.uint32)), limits.append(r.randint(0, 25))
    want = [min(distance(x, y), n + 1) for x, y, n in zip(a, b, limits)]
    assert band_distances(a, b, np.array(limits)).tolist() == want
    gaps = [max(sum((Counter(x.tolist()) - Counter(y.tolist())).values()), sum((Counter(y.tolist()) - Counter(x.tolist())).values())) for x, y in zip(a, b)]
    assert near_dedup.word_gaps(a, b).tolist() == gaps and near_dedup.word_gaps([], []).tolist() == []


def test_near_duplicate_classes(spark):
    texts = {i: prose(i, 60 + i) for i in range(12)}
    rows = dict(texts)
    for i in range(6):  # a star of near copies, exact copies, and a passage that clean texts share
        rows[100 + i] = edited(texts[0], 0.04, i)
        rows[200 + i] = texts[1].upper() + "!"
    passage = prose(77, 25)
    for i in range(6):
        rows[300 + i] = prose(900 + i, 70) + " " + passage
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in rows.items()], DOCS).repartition(3)
    found = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    for k in rows:
        want = 0 if 100 <= k < 200 else 1 if 200 <= k < 300 else k
        assert found[k]["class_id"] == want and found[k]["keep"] == (k == want)
    assert found[0]["n_links"] >= 1 and found[1]["n_links"] == 0


def five_of_one_bucket():
    """Five texts with one sketch entry: 2, 3 and 4 are near copies, 1 and 5 are near nothing."""
    for seed in range(100):
        passage, copy = prose(seed, 90), prose(1000 + seed, 60)
        rows = {1: passage, 5: passage + " " + prose(2000 + seed, 40)} | {i: passage + " " + edited(copy, 0.05, i) for i in (2, 3, 4)}
        slab = next(near_dedup.normalised(pa.array(list(rows.values()))))[2]
        if len(set(near_dedup.order_sketch(slab, 5, 1, 1)[:, 0].tolist())) == 1:
            return rows
    raise AssertionError("no seed gives such a bucket")


def test_a_bucket_asks_all_its_classes(spark):
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in five_of_one_bucket().items()], DOCS)
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, k=5, entries=1, picks=1).collect()}
    assert found == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5}


@pytest.mark.parametrize("edits", [0.08, 0.12, 0.16, 0.2])
def test_recall_down_to_the_threshold(edits):
    meet, n = 0, 300
    for i in range(n):
        text = prose(i, 200)
        slab = next(near_dedup.normalised(pa.array([text, edited(text, edits, i)])))[2]
        x, y = near_dedup.order_sketch(slab, near_dedup.K, near_dedup.ENTRIES, near_dedup.PICKS)
        meet += bool((x == y).any())
    want = near_dedup.recall(edits)
    assert want > 0.95 and abs(meet / n - want) < 0.04


def test_pairs_apart_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    texts = {i: edited(prose(i // 4, 40 + i // 4), 0.08, i) for i in range(60)}
    words = {i: t.split() for i, t in texts.items()}
    slab = next(near_dedup.normalised(pa.array(list(texts.values()))))[2]
    bags, fine = (near_dedup.word_bags(slab, n).to_pylist() for n in (near_dedup.BAG, near_dedup.FINE_BAG))
    traits = spark.createDataFrame([(i, len(words[i]), bytearray(bags[i]), bytearray(fine[i])) for i in texts], "doc_id long, n int, bag binary, fine binary")
    labels = spark.createDataFrame([(i, i // 2 * 2) for i in texts], "id long, label long")
    members = spark.createDataFrame([(e, e, i) for e in (0, 1) for i in texts if e == 0 or i < 9], "e int, h long, doc_id long")
    got = {(r["a"], r["b"]) for r in near_dedup.pairs_apart(members, labels, traits, 0.8).collect()}
    true = {(a, b) for a in texts for b in texts if a < b and a // 2 != b // 2 and distance(words[a], words[b]) <= 0.2 * max(len(words[a]), len(words[b]))}
    assert true and true <= got and all(a < b and a // 2 != b // 2 for a, b in got)
    assert len(got) < 3 * len(true)


def test_repeats_equal_brute_force(spark):
    r = random.Random(5)
    words = [[f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 90))] for _ in range(25)]
    shared = [f"s{i}" for i in range(60)]
    for i in (1, 4, 9):
        at = r.randint(0, len(words[i]))
        words[i][at:at] = shared[i : i + 50]
    words.append(["x", "y"] * 40)  # overlaps itself
    words.append(list(words[3]))
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    docs = spark.createDataFrame([(i, "\n ".join(w), None, None) for i, w in enumerate(words)], DOCS).repartition(3)
    found = {x["doc_id"]: x for x in remove_repeats(docs).collect()}
    for i, w in enumerate(words):
        gone = {p for s in range(len(w) - 34) if starts[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


def mirror_words() -> tuple[str, str]:
    """Two different 1,024-letter words whose polynomial hashes are equal modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart_not_only_their_hashes(spark):
    x, y = mirror_words()
    around = prose(1, 40).split()
    docs = spark.createDataFrame([(i, " ".join([*around[:20], w, *around[20:]]), None, None) for i, w in ((1, x), (2, y))], DOCS)
    assert {r["n_removed"] for r in remove_repeats(docs).collect()} == {0}
    alone = spark.createDataFrame([(1, x, None, None), (2, y, None, None), (3, x.upper(), None, None)], DOCS)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(alone).collect()} == {1: 1, 2: 2, 3: 1}
    text = " ".join([*around[:8], x, *around[8:15], *around[:8], y, *around[8:15]])
    judged = quality_rules(spark.createDataFrame([(1, text, None, None)], DOCS)).first()
    assert judged["n_repeat_words"] == 16  # the eight words before, and none with the mirrored one


def test_colliding_words_are_compared(monkeypatch):
    from rulespan.llm import common, quality_rules as rules

    monkeypatch.setattr(common, "hash_words", lambda data, start, end, places=None: np.ones(len(start), np.uint64))
    words = prose(3, 60).split()
    text = " ".join(words + words[:9] + ["x", "x"])
    slab = common.split_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert rules.repeated_words(slab).tolist() == [18] and rules.stutter_words(slab).tolist() == [1]


def test_budget_search_finds_the_best_sum():
    r = random.Random(8)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randint(1, 6))))
        counts = np.array([r.randint(0, 3) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()) + 5)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        take = fit_budget(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take <= counts).all() and (take >= 0).all() and got <= budget
        assert max(s for s in sums if s <= budget) - got <= max(lengths)


def best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + int(n) * k for s in sums for k in range(c + 1) if s + int(n) * k <= budget}
    return max(sums)


def test_budgets_about_the_table_s_size_are_met(monkeypatch):
    from rulespan.llm import mixing

    for lengths, counts, budget in (([70_001, 70_003], [5, 5], 420_010), ([60_000, 40_001, 3], [3, 3, 2], 120_003), ([200_000, 7], [2, 1], 200_007)):
        take = fit_budget(np.array(lengths), np.array(counts), budget)
        assert int((take * np.array(lengths)).sum()) == budget == best_sum(lengths, counts, budget)
    r = random.Random(4)
    monkeypatch.setattr(mixing, "SLACK", 64)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 90), r.randint(1, 5))))
        counts = np.array([r.randint(0, 12) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()) + 5)
        take = fit_budget(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take <= counts).all() and (take >= 0).all() and got <= budget
        best = best_sum(lengths, counts, budget)
        assert got == best if budget <= 64 + 2 * lengths.max() else best - got <= lengths.max()


def test_mix_targets_and_reruns(spark):
    r = random.Random(2)
    rows = [(i, prose(i, r.randint(1, 60)), None, s) for i in range(400) for s in [r.choices(["a", "b", "c", "d", None], [9, 3, 3, 1, 1])[0]]]
    docs = spark.createDataFrame(rows, DOCS)
    out = mix_sources(docs).collect()
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # share by weight, cap, share the excess anew
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weights[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    taken = Counter()
    for x in out:
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == sizes[x["source"]]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in out)


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(1)
    for capacity in (16, 64, 256):
        counts = np.zeros(capacity + 1, int)
        counts[1:] = r.integers(0, 7, capacity)
        plan = plan_packing(counts)
        used = Counter()
        for parts, n in plan:
            assert n > 0 and sum(parts) <= capacity
            for p in parts:
                used[p] += n
        assert all(used[i] == counts[i] for i in range(1, capacity + 1))
        need = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        need = max(need, counts[capacity // 2 + 1 :].sum())  # no two long pieces share a sequence
        assert sum(n for _, n in plan) <= 1.04 * need + 1


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("mean", [4.0, 5.0, 5.5, 6.0])
def test_complements_are_used_and_cost_nothing(mean):
    r = np.random.default_rng(int(mean * 10))
    lengths = np.clip(np.exp(r.normal(mean, 0.9, 900)).astype(int), 1, 1024)
    plan = plan_packing(np.bincount(lengths, minlength=1025))
    full = Counter(len(parts) for parts, n in plan for _ in range(n) if sum(parts) == 1024)
    assert sum(full.values()) > 20 and sum(v for k, v in full.items() if k >= 3) > 5
    assert sum(n for _, n in plan) <= best_fit_decreasing(lengths.tolist(), 1024) + 1


def test_chunks_tokenise_like_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    library.encode_special_tokens = True
    mine = tokenizer(default_tokenizer())
    for text in ("", " ", "  a  b ", "don't  stop\n\n now", "x \n y\t z ", "日本 語 é  b", "a" * 300, "<|endoftext|> b", " lead", "1 23 a1b2 #$% it's"):
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_the_library_s_by_default(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    texts = ["<|endoftext|> b", "a <|endoftext|>", "x<|endoftext|><|endoftext|>  y ", "<|endoftext", "plain text", ""]
    out = {r["doc_id"]: r for r in pack(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert (out[i]["length"], out[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_pieces_and_places(spark, monkeypatch):
    texts = [prose(i, n) for i, n in enumerate((1, 5, 40, 300, 900, 2000, 2, 2, 40))]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    out = pack(docs).collect()
    mine = tokenizer(packing.default_tokenizer())
    by_doc, by_sequence = {}, {}
    for x in out:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    for i, t in enumerate(texts):
        ids = mine.ids(t) + (2).to_bytes(4, "little")
        parts = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [p["length"] for p in parts[1:]] == [1024] * (len(parts) - 1)
        for p in parts:
            assert zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]
        assert sum(p["length"] for p in parts) == len(ids) // 4
    for rows in by_sequence.values():
        at = 0
        for x in sorted(rows, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 1024


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_search_equals_brute_force(spark, spread):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8))
    x = np.round(centres[r.integers(0, 12, 900)] + spread * r.normal(size=(900, 8)), 2).astype(np.float32)
    x[50:80] = x[50]  # many equal vectors
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    seen = {}
    out = top_k(table, block=32, pack=3, seen=seen).collect()
    ints = np.floor(1024 * x.astype(float)).astype(int)
    for q in range(0, 900, 100):
        scores = ints @ ints[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        got = sorted((x["rank"], -x["score"], x["vec_id"]) for x in out if x["query_id"] == q)
        assert [(s, i) for _, s, i in got] == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "32"
    assert seen["vectors"] == 900 and (spread == 1.0 or seen["second"] < 600)  # clusters are told apart


def test_index_blocks_and_packs():
    from rulespan.llm.topk import merge_annuli, pack_cells

    rows, of = merge_annuli([(0, 1, 5), (0, 3, 4), (0, 4, 9), (2, 0, 30), (2, 1, 1)], 10)
    assert rows.tolist() == [[0, 1, 3, 9], [0, 4, 4, 9], [2, 0, 0, 30], [2, 1, 1, 1]]
    assert of == [(0, 1, 0, 1), (0, 3, 0, 1), (0, 4, 1, 1), (2, 0, 2, 3), (2, 1, 3, 1)]
    packs = pack_cells({0: 3, 1: 3, 2: 9, 3: 1}, np.array([[0.0], [10.0], [1.0], [2.0]]), 4)
    taken = {}
    for cell, first, parts in packs:
        for p in range(parts):
            taken.setdefault(first + p, []).append(cell)
    assert sorted(c for c, *_ in packs) == [0, 1, 2, 3] and dict((c, p) for c, _, p in packs) == {0: 1, 1: 1, 2: 3, 3: 1}
    assert sorted(taken) == list(range(len(taken))) and pack_cells({}, np.zeros((0, 1)), 4) == []


def test_archive_round_trip():
    payloads = [b"", b"a\r\n\r\nb", bytes(range(256)) * 50]
    made = [record("response", str(i), i, "http://x", len(p), "d", p) for i, p in enumerate(payloads)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    stream = whole.compress(b"".join(made)) + whole.flush()
    members = b"".join(z.compress(m) + z.flush() for m in made for z in [zlib.compressobj(6, zlib.DEFLATED, 31)])
    for data in (stream, members):
        for step in (1, 7, 4096):
            cut = list(records(inflate(data[i : i + step] for i in range(0, len(data), step))))
            assert cut == made and [parse(c)[1] for c in cut] == payloads
    with pytest.raises(ValueError):
        list(records(iter([made[1][:-3]])))


def labelled_rows(n, bad_every=7, toxic_every=5):
    rows, labels = [], []
    for i in range(n):
        text = prose(i, 40 + i % 25)
        if i % bad_every == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % toxic_every == 0:
            text = text.replace(" ", " vile ", 2 + i % 3)
        rows.append((i, text, ("en", "de", None)[i % 3], "a"))
        labels.append((i, int(i % bad_every > 0), int(i % toxic_every == 0)))
    return rows, labels


def test_quality_scores_minimise_the_risk_over_all_rows(spark):
    """The model against a risk summed row by row over the whole table."""
    from rulespan.llm import quality_pu as pu
    from rulespan.llm.features import ONE, quality_features

    rows, labels = labelled_rows(300)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = pu.train(docs, known)
    x = quality_features(pa.array([r[1] for r in rows]), pu.DIMS)
    learn = np.array([zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows])
    good = learn & np.array([q == 1 for _, q, _ in labels])
    assert model.prior == pytest.approx((good.sum() + 1) / (learn.sum() + 2))

    def risk(w):
        p, u = x[good] @ w, x @ w
        loss = lambda z: (1 - z) ** 2 / 4
        return model.prior * (loss(p) - loss(-p)).mean() + loss(-u).mean(), loss(-u).mean() - model.prior * loss(-p).mean()

    value, negative = risk(model.weights)
    assert negative >= -pu.TOLERANCE * len(model.weights) / good.sum() - 1e-6
    spread = x.std(0) * ONE
    r = np.random.default_rng(1)
    for size in (0.01, 0.1, 1.0):  # what the ridge gives away apart, no weights nearby are better
        for _ in range(20):
            other = model.weights + size * r.normal(size=len(model.weights)) / np.maximum(spread, ONE)
            assert risk(other)[0] > value - 0.02
    out = {r["doc_id"]: r for r in quality_classifier(docs, known).collect()}
    for i, row in enumerate(rows):
        f = float(x[i] @ model.weights)
        assert out[i]["score"] == pytest.approx(float(pu.chance(np.array([f]))[0]))
        assert out[i]["predicted"] == int(out[i]["score"] >= 0.3)
    repeated = docs.union(docs.filter("doc_id = 1")).union(docs.filter("doc_id = 1"))
    again = {r["doc_id"]: r["predicted"] for r in quality_classifier(repeated, known).collect()}  # ids may repeat
    assert np.mean([again[i] == out[i]["predicted"] for i in again]) > 0.98


def test_chance_is_monotone_within_bounds():
    from rulespan.llm.quality_pu import chance

    f = np.linspace(-4, 4, 2001)
    p = chance(f)
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1 and chance(np.array([-0.4]))[0] == pytest.approx(0.3)


def test_ordinal_fit_is_the_most_likely_one():
    """Against the likelihood written out row by row."""
    from rulespan.llm.toxicity import fit_ordinal

    r = np.random.default_rng(2)
    x = (r.random((200, 3)) < 0.5).astype(np.float32)
    y = np.clip(np.floor(x @ [1.5, -1.0, 0.3] + r.logistic(size=200)), 0, 3).astype(int)

    def loss(w, cuts):
        total = 0.0
        for row, k in zip(x, y):
            above = [1.0, *(1 / (1 + np.exp(c - row @ w)) for c in cuts), 0.0]
            total -= np.log(above[k] - above[k + 1])
        return total / len(y) + 0.5e-3 * float(w @ w)

    w, cuts = fit_ordinal(x, y)
    assert list(cuts) == sorted(cuts)
    for _ in range(60):
        near, cuts_near = w + 0.1 * r.normal(size=3), np.sort(cuts + 0.1 * r.normal(size=3))
        assert loss(near, cuts_near) > loss(w, cuts) - 1e-4


def test_toxicity_sums_the_weights_of_each_text(spark):
    from rulespan.llm import toxicity as tox
    from rulespan.llm.features import word_buckets

    rows, labels = labelled_rows(250)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tox.train(docs, known)
    out = {r["doc_id"]: r for r in toxicity(docs, known).collect()}
    for i, text, *_ in rows:
        (n, _, bucket), *_ = word_buckets(pa.array([text]), tox.DIMS)
        assert n == 1 and len(set(bucket.tolist())) == len(bucket)
        score = sum(float(model.weights[b]) for b in bucket)
        above = [1 / (1 + np.exp(c - score)) for c in model.cuts]
        levels = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert out[i]["severity"] == pytest.approx(sum(above)) and out[i]["score"] == pytest.approx(above[0])
        assert out[i]["grade"] == int(np.argmax(levels)) and out[i]["toxic"] == (above[0] >= 0.5)
    repeated = docs.union(docs.filter("doc_id < 40")).union(docs.filter("doc_id < 40"))
    assert np.array_equal(tox.train(repeated, known).weights, model.weights)  # an id counts once


def test_languages_equal_a_plain_naive_bayes(spark):
    from rulespan.llm import language_id as li

    letters = {"en": "etaoin shrdlu", "de": "ßüäö enisratd", "fr": "éèçà esaitn"}
    r = random.Random(4)
    rows = [(i, "".join(r.choice(letters[k]) for _ in range(r.randint(5, 60))), k, None) for i in range(240) for k in [r.choice(sorted(letters))]]
    rows += [(900, "Éé ES", "fr", None), (901, "12 .", "en", None), (902, None, "en", None), (903, "", None, None), (904, "𝔘𝔫𝔦 en", None, None)]

    def buckets(text):
        points = [ord(c.lower()) if len(c.lower()) == 1 and ord(c) < 65536 else ord(c) for c in text]
        shift = 64 - li.DIMS.bit_length() + 1
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                code = 0
                for k in range(n):
                    code = (code * 0x100000001B3 + points[i + k] + k + 1) % (1 << 64)
                yield (code * 0x9E3779B97F4A7C15 % (1 << 64)) >> shift

    counts, seen = {k: Counter() for k in letters}, Counter()
    for i, text, k, _ in rows:
        if text is not None and k and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[k].update(buckets(text)), seen.update([k])
    names, total = sorted(counts), {k: sum(c.values()) + li.ALPHA * li.DIMS for k, c in counts.items()}
    out = {x["doc_id"]: x for x in li.language_id(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    right = []
    for i, text, k, _ in rows:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
            continue
        log = [np.log((seen[n] + 1) / (sum(seen.values()) + len(names))) + sum(np.log((counts[n][b] + li.ALPHA) / total[n]) for b in buckets(text)) for n in names]
        best = int(np.argmax(log))
        assert out[i]["lang_pred"] == names[best]
        assert out[i]["score"] == pytest.approx(1 / sum(np.exp(v - log[best]) for v in log), abs=1e-4)
        right += [out[i]["lang_pred"] == k] if out[i]["held_out"] else []
    assert np.mean(right) > 0.9


def test_a_column_that_is_no_language_is_refused(spark, monkeypatch):
    from rulespan.llm import language_id as li

    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc", f"l{i}", None) for i in range(20)], DOCS)
    with pytest.raises(ValueError, match="values of lang"):
        li.language_id(docs)


def test_equal_rows_share_the_draws_of_their_key(spark):
    from rulespan.llm.mixing import apply_mix

    rows = [(7, "a b c", None, "x")] * 9 + [(i, prose(i, 3), None, "x") for i in range(20)] + [(50 + i, prose(i, 40), None, "y") for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    marks, mixed = mix_sources(docs).collect(), apply_mix(docs).collect()
    assert len(marks) == len(rows)
    want = Counter()
    for m in marks:
        want[m["doc_id"]] += m["times"]
    assert Counter(r["doc_id"] for r in mixed) == +want


def test_classifiers_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 7 == 0, i % 5 == 0
        text = prose(i, 60)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text = text.replace(" ", " vile ", 2 + i % 3)
        rows.append((i, text, "en", "a"))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    held = [r for r in quality_classifier(docs, known).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.95
    graded = [r for r in toxicity(docs, known).collect() if r["held_out"]]
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]][1]) for r in graded]) > 0.95


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", "\n\n\t \n", " \xa0", " "])
def test_long_blank_runs_tokenise_like_the_library(monkeypatch, blank):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    mine = tokenizer(default_tokenizer())
    for cut in (packing.SLICE, 1001):
        monkeypatch.setattr(packing, "SLICE", cut)
        for n in (999, 1000, 1001, 2003, 20_000):
            run = (blank * n)[:n]
            for text in (run, f"a{run}", f"{run}b", f"a{run}b c{run} d{run}\n\ne's{run}", f"x {run} y"):
                assert np.frombuffer(mine.document_ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_blank_runs_of_millions_are_packed(spark):
    runs = [" " * 1_000_000, "\t" * 5_000_000, "\n" * 3_000_001, "a" + "\n" * 1_500_000 + "b", "　" * 1_000_000 + "c", "word " * 3]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    total = Counter()
    for r in pack(docs).collect():
        total[r["doc_id"]] += r["length"]
    assert [total[i] for i in (0, 1, 2, 3)] == [1_000_001, 5_000_001, 1_500_002, 750_004]
    mine = tokenizer(default_tokenizer())
    assert len(mine.document_ids("\n" * 50_000_000)) == 4 * 25_000_000
