"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "keep")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.quality_pu import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.fill_middle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulespan.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_mixing, op3_quality_pu, op4_toxicity_ordinal, op5_substring_dedup,
        op6_language_id, op7_warc, op8_topk, op9_packing, op10_quality_rules,
        op11_centroids, op12_fill_middle, op13_neighbours,
    )
}

_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), win AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM rep) GROUP BY r
), ln AS (
  SELECT r, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(ls) AS l FROM w)
), dup AS (
  SELECT r, sum(c - 1) AS n_dup_lines FROM (SELECT r, l, count(*) AS c FROM ln WHERE n > 0 GROUP BY r, l) GROUP BY r
), frag AS (
  SELECT r, count(*) FILTER (n > 0) AS filled, count(*) FILTER (n IN (1, 2)) AS short FROM ln GROUP BY r
), st AS (
  SELECT r, count(*) AS stutter FROM (SELECT r, ws, unnest(range(2, len(ws) + 1)) AS i FROM w) WHERE ws[i] = ws[i - 1] GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters, filled, short, coalesce(stutter, 0) AS stutter
  FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN frag USING (r) LEFT JOIN st USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 20 * n_symbols > word_chars OR word_chars > 40 * n_words OR word_chars < 2 * n_words
       OR 2 * letters < word_chars OR (filled > 10 AND 10 * short > 9 * filled) OR 10 * stutter > 3 * n_words) AS kept
FROM b
"""

_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), rep AS (
  SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM (SELECT r, i, unnest(range(0, 35)) AS j FROM rep)
), w AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), k AS (
  SELECT w.r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS kept
  FROM w LEFT JOIN gone ON w.r = gone.r AND w.p = gone.p GROUP BY w.r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

_OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _op11(rounds: int = 10, clusters: int = 8) -> str:
    """The rounds one after another: ``a`` holds distance * clusters + number."""
    turns = """, a{i} AS MATERIALIZED (
  SELECT r, min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * {k} + c.n) AS best
  FROM v CROSS JOIN c{i} AS c GROUP BY r
)"""
    means = """, m{i} AS (
  SELECT n, i, CASE WHEN s % q < 0 THEN s // q - 1 ELSE s // q END AS y
  FROM (SELECT (best % {k})::INTEGER AS n, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS q FROM v JOIN a{i} USING (r), range(1, 65) AS t(i) GROUP BY ALL)
), c{j} AS MATERIALIZED (
  SELECT n, coalesce(y, c.x) AS x FROM c{i} AS c LEFT JOIN (SELECT n, list(y::BIGINT ORDER BY i) AS y FROM m{i} GROUP BY n) USING (n)
)"""
    steps = "".join((turns + means).format(i=i, j=i + 1, k=clusters) for i in range(rounds)) + turns.format(i=rounds, k=clusters)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS n, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters})
){steps}
SELECT vec_id, (best % {clusters})::INTEGER AS cluster, (best // {clusters})::BIGINT AS distance,
  sum(best // {clusters}) OVER (PARTITION BY best % {clusters})::BIGINT AS cluster_inertia, sum(best // {clusters}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} AS c ON c.n = best % {clusters}
"""


_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, len(us) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), s AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(us, 1, a), ''), '') AS prefix,
    coalesce(array_to_string(list_slice(us, a + 1, b), ''), '') AS middle, coalesce(array_to_string(list_slice(us, b + 1, n), ''), '') AS suffix
  FROM s
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op7_warc": _OP7, "op8_topk": _OP8, "op5_substring_dedup": _OP5, "op10_quality_rules": _OP10, "op11_centroids": _op11(), "op12_fill_middle": _OP12,
}
