"""A corpus from documents: toxicity, near-duplicates, surrogates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents, and drop any other. Null texts, sources, languages and ids, empty and very
long texts and no rows at all go through every stage: a null text counts as empty, a row without a doc_id is
nobody's copy, and rows that repeat a doc_id and text stay once after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import copies, mixing, packing, simhash, surrogates, toxicity
from lodestrata.llm.common import broadcast_if_small, cut, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score under the threshold, by a model learnt from the labelled ones; equal texts go alike."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, at a similarity of 0.8 over five-word shingles, keep the document of smallest id, once.

    SimHash fingerprints of five-word shingles give the groups within three bits. Most pairs at 0.8 differ in
    more bits, so bands add candidates; every link is verified by its exact similarity.
    """
    docs = docs.select(COLUMNS)
    groups = copies.near_copies(docs, simhash.near_duplicates(docs, copies.SHINGLE).select("doc_id", "component_id"))
    gone = cut(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(broadcast_if_small(gone, gone.count()), "doc_id", "left_anti")
    # Texts are moved only where an id is there more than once.
    again = cut(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    count = again.count()
    if not count:
        return kept.select(COLUMNS)
    more, same = broadcast_if_small(again, count), F.col("doc_id").eqNullSafe(F.col("again"))
    return kept.join(more, same, "left_anti").unionByName(kept.join(more, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put keyed surrogates in the place of personal data; no document goes."""
    return surrogates.replace(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics meet their target shares of tokens; a text without words goes."""
    return mixing.mix(docs.select(COLUMNS), carry=True).where("selected").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, as pieces of documents; every row gives one piece at least."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trees and a tokenizer are no SQL; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
