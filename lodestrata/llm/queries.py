"""Queries over the driver's tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import htmltext, langid, manifest, mixing, packing, ranking, simhash, substrings, surrogates, toxicity, urls, vectors
from lodestrata.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_mixing"] = mixing.oracle_sql()


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_k(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL["op3_topk"] = """
WITH sound AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.labelled(pages))).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op8_vectors"] = """
WITH RECURSIVE ids AS (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL),
sound AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id),
sized AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM sound WHERE list_inner_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) = vec_id AS kept
FROM ids"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_manifest"] = manifest.oracle_sql()


@query
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_ranking"] = ranking.oracle_sql()


@query
def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judged(table(spark, sf_dir, "documents"))
