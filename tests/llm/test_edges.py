"""Every operator on odd rows and on an empty table."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from helpers import no_docs, odd_docs, odd_rows, prose

from rulespan.llm.language_id import language_id
from rulespan.llm.mixing import apply_mix, mix_sources
from rulespan.llm.near_dedup import dedup, near_duplicates
from rulespan.llm.packing import pack
from rulespan.llm.quality_pu import quality_classifier, quality_rejects
from rulespan.llm.quality_rules import quality_rules
from rulespan.llm.substring_dedup import remove_repeats, strip_documents
from rulespan.llm.topk import top_k
from rulespan.llm.toxicity import toxicity
from rulespan.llm.warc import archive_pages


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, None), (7, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "near": lambda s, d: near_duplicates(d),
    "mix": lambda s, d: mix_sources(d),
    "quality": lambda s, d: quality_classifier(d, labels(s)),
    "toxic": lambda s, d: toxicity(d, labels(s)),
    "repeats": lambda s, d: remove_repeats(d),
    "language": lambda s, d: language_id(d),
    "rules": lambda s, d: quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, odd_docs(spark)).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted(r[0] for r in odd_rows() if r[0] is not None)
    assert len(out) == len(odd_rows())


@pytest.mark.parametrize("name", [*OPERATORS, "pack"])
def test_empty_table(spark, name):
    apply = OPERATORS.get(name) or (lambda s, d: pack(d))
    assert apply(spark, no_docs(spark)).count() == 0


def test_no_labels_at_all(spark):
    none = labels(spark, ())
    assert quality_classifier(odd_docs(spark), none).count() == len(odd_rows())
    assert toxicity(odd_docs(spark), none).filter("severity is null").count() == 0


def test_row_stages_keep_the_columns(spark):
    docs = odd_docs(spark)
    for out in (dedup(docs), strip_documents(docs), apply_mix(docs), quality_rejects(docs, labels(spark))):
        assert out.columns == docs.columns


def test_row_stages_take_columns_of_any_name(spark):
    names = ("_key", "_draws", "_place", "_again", "_did", "_tid", "_spans", "marks", "row", "times", "did", "tid", "spans", "a.b", "_part", "_order", "class_id", "keep")
    docs = odd_docs(spark).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for out in (dedup(docs), strip_documents(docs), apply_mix(docs), quality_rejects(docs, labels(spark))):
        assert out.columns == docs.columns
        assert all(r[n] == f"own {n}" for r in out.select(*(F.col(f"`{n}`") for n in names)).collect() for n in names)


def test_null_and_wordless_texts(spark):
    docs = odd_docs(spark)
    rules = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert (rules[2]["n_words"], rules[2]["base_failed"], rules[2]["kept"]) == (0, True, False)
    lang = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert [lang[i]["lang_pred"] for i in (2, 3, 4, 10)] == ["und"] * 4
    gone = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert gone[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and gone[2]["n_words"] == 0
    assert gone[8]["n_removed"] == gone[8]["n_words"] == 120
    mixed = {r["doc_id"]: r for r in mix_sources(docs).collect()}
    assert mixed[2]["size"] == 0 and mixed[11]["size"] == 36  # only six blanks part words


def test_pieces_of_odd_rows(spark):
    out = pack(odd_docs(spark)).collect()
    empty = [r for r in out if r["doc_id"] == 2]
    assert [(r["piece"], r["start"], r["length"]) for r in empty] == [(0, 0, 1)]
    assert sum(r["piece"] == 0 for r in out) == len(odd_rows())


def test_pages(spark):
    html = prose(3, 40)
    rows = [(5, "http://x/\r\nEvil: 1", html), (3, None, html), (3, "u", html), (9, "u", None), (1, "u", "short"), (2, "v", "short"), (None, "w", html), (4, "ü", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    out = archive_pages(pages).collect()
    assert len(out) == len(rows)
    kinds = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in out), key=str)
    want = [(5, "revisit", 3), (3, "response", None), (3, "revisit", 3), (9, "response", None), (1, "response", None), (2, "response", None), (-1, "revisit", 3), (4, "response", None)]
    assert kinds == sorted(want, key=str)
    for r in out:
        if r["page_id"] == 4:
            assert r["payload_bytes"] == 120 and r["payload_digest"] == hashlib.sha256(("é" * 60).encode()).hexdigest()
    assert archive_pages(pages.limit(0)).count() == 0


def test_archives_are_rewritten_apart(spark, tmp_path):
    from rulespan.llm import warc

    pages = spark.createDataFrame([(i, "u", prose(i % 4, 200)) for i in range(12)], "page_id long, url string, html string").repartition(3)
    made = warc.stage(warc.write_monolithic(pages, f"file://{tmp_path}/mono", 4000))
    out = warc.normalise(made, warc.revisits(made), f"file://{tmp_path}/mono", f"file://{tmp_path}/out")
    files = made.select("file").distinct().count()
    assert files >= 3 and out.rdd.getNumPartitions() == files
    assert out.rdd.glom().map(len).collect() == [1] * files


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [0.5, -1.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]), (5, [3.0]), (None, [1.0, 2.0]), (7, []), (8, [2.0, 2.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    out = top_k(table).collect()
    usable = 7
    assert {r["query_id"] for r in out} == {0, 100} and len(out) == 3 * (usable - 1)
    best = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 0), key=lambda r: r["rank"])]
    assert best[:2] == [8, 100] and best[2] is None  # the row without an id loses its tie
    assert top_k(table.limit(0)).count() == 0


def test_word_is_what_the_pattern_says(spark):
    from rulespan.llm.common import split_words

    import numpy as np

    for text in ("a\x1cb c d", " x\ty\nz\x0bu\x0cv\rw ", "", " ", "é è"):
        data = np.frombuffer(text.encode(), np.uint8)
        slab = split_words(data, np.array([0, len(data)]))
        assert len(slab.hash) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
