"""Registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, kneser_ney, langid, packing, quality, setsketch, sharding, suffix_dedup, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"), spans=False)


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.length_buckets(table(spark, sf_dir, "documents"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(table(spark, sf_dir, "documents"))


def op4_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_vocabulary(table(spark, sf_dir, "pages"))


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = langid.held_out()
    model = langid.train(docs, ~test)
    out = langid.language_spans(docs, model, spans=False)
    return out.select("doc_id", test.alias("held_out"), "lang_pred", "score")


def op6_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classifier_chain(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = langid.held_out(parts=5)
    out = kneser_ney.perplexity(docs, kneser_ney.train(docs, ~test))
    return out.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op10_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.jump_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_suffix_array_dedup, op2_length_buckets, op3_compression_bands, op4_url_vocabulary, op5_language_spans, op6_classifier_chain, op7_benchmark_decontamination, op8_kneser_ney, op9_setsketch, op10_jump_hash]
    return {f.__name__: f for f in found}


#: Every window of 200 bytes, as hex; runs of those that start twice.
REPEATS_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - 199))) AS p FROM b)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, p FROM w JOIN t USING (m)),
o AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM g),
q AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o),
runs AS (SELECT doc_id, k, min(p) AS x, max(p) + 200 AS y FROM q GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS n, sum(y - x) AS gone, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM runs GROUP BY doc_id)
SELECT b.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda i: substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE ys[i - 1] END) + 1, 2 * ((CASE WHEN i = n + 1 THEN len(h) // 2 ELSE xs[i] END) - (CASE WHEN i = 1 THEN 0 ELSE ys[i - 1] END)))), '') END)) AS kept_sha256 FROM b LEFT JOIN cut USING (doc_id)"""

#: All pairs of rows that share a shingle, then everything that can be reached; rows of one key are linked.
GROUPS_SQL = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, text FROM documents),
w AS (SELECT i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM d),
sh AS MATERIALIZED (SELECT DISTINCT i, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) ELSE w END) AS s FROM w),
n AS MATERIALIZED (SELECT i, count(*) AS n FROM sh GROUP BY i),
p AS (SELECT a.i AS a, b.i AS b, count(*) AS both FROM sh a JOIN sh b ON a.s = b.s AND a.i < b.i GROUP BY a.i, b.i),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)),
k AS MATERIALIZED (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM e JOIN d x ON x.i = a JOIN d y ON y.i = b WHERE x.doc_id <> y.doc_id),
l AS MATERIALIZED (SELECT u, v FROM k UNION SELECT v, u FROM k),
r(node, top) AS (SELECT DISTINCT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT l.v, r.top FROM r JOIN l ON r.node = l.u),
m AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.top AS component_id, coalesce(d.doc_id = m.top, true) AS kept
FROM d LEFT JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.i = d.i"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for what it can express: the others need CRC-32, compression, models or alignment."""
    return {"op1_suffix_array_dedup": REPEATS_SQL, "op4_url_vocabulary": urlfilter.oracle(), "op9_setsketch": GROUPS_SQL}
