"""Stored indexes against the scans they stand for, and what their plans leave out."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import indexes, search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ranked(df, column="doc_id"):
    return [(r[column], round(r["score"], 6)) for r in df.collect()]


def documents(spark, n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the"] * 25 + ["rare"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 40, 200])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "The THE the-rare"), (n + 2, "The THE the-rare"), (None, "rare"), (n + 3, "the " * 5000), (n + 4, "é the_rare ü")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS term", "1 AS block", "2 AS len", "3 AS id")


QUERIES = ["the", "rare", "the rare w1", "w1 w2 w3 w4", "absent", "the absent THE", "", "the_rare"]


@pytest.mark.parametrize("size", [4096, 8])
def test_bm25_is_that_of_the_scan(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(indexes, "BLOCK_DOCS", size)
    docs, folder = documents(spark).where("doc_id IS NOT NULL").repartition(4), str(tmp_path / "index")
    indexes.add_documents(docs, folder)
    for query in QUERIES:
        for limit in (2, 1000) if query in ("the", "the rare w1") else (40,):
            want = search.bm25_top(docs, query, limit)
            got = indexes.bm25_top(spark, folder, query, limit)
            assert ranked(got) == ranked(want), (query, limit)


def test_documents_may_be_added_later(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path / "index")
    for some in ("doc_id < 200", "doc_id >= 200 AND doc_id < 201", "doc_id > 9999", "doc_id > 200 OR doc_id IS NULL"):
        indexes.add_documents(docs.where(some), folder)
    for query in ("the rare", "w1 w2"):
        assert ranked(indexes.bm25_top(spark, folder, query, 50)) == ranked(search.bm25_top(docs, query, 50))


def test_an_empty_index(spark, tmp_path):
    folder = str(tmp_path / "index")
    indexes.add_documents(documents(spark).limit(0), folder)
    assert indexes.bm25_top(spark, folder, "the", 5).count() == 0


def test_a_segment_that_never_ended_does_not_count(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path / "index")
    indexes.add_documents(docs, folder)
    held = spark.read.parquet(f"{folder}/postings")
    held.withColumn("block", F.regexp_replace("block", "^0:", "1:")).write.mode("append").partitionBy("folder").parquet(f"{folder}/postings")
    assert ranked(indexes.bm25_top(spark, folder, "the rare", 20)) == ranked(search.bm25_top(docs, "the rare", 20))


def test_a_query_reads_its_terms_folders_only(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path / "index")
    indexes.add_documents(docs, folder)
    shown = plan(indexes.Ranked(spark, folder, "the rare").postings)
    assert "PartitionFilters: [" in shown and "folder#" in shown.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term, [" in shown.split("PushedFilters: [")[1]
    read = indexes.Ranked(spark, folder, "the rare").postings.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) <= 4
    bounds = plan(indexes.Ranked(spark, folder, "the rare").bounds())
    assert "docs" not in bounds.split("ReadSchema: ")[1].split("\n")[0]  # numbers only, no documents


def test_blocks_that_cannot_win_are_not_scored(spark, tmp_path, monkeypatch):
    """Short documents score higher than long ones of one count: most blocks fall under the bound, and no better document is in them."""
    monkeypatch.setattr(indexes, "BLOCK_DOCS", 16)
    rows = [(i, "key " * (1 + i % 2) + "pad " * (i % 500)) for i in range(3000)]
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index")
    indexes.add_documents(docs, folder)
    ranked_ = indexes.Ranked(spark, folder, "key")
    every, left = ranked_.bounds().count(), ranked_.worthwhile(5, 6).count()
    assert every > 100 and left < every / 5
    assert ranked(indexes.bm25_top(spark, folder, "key", 5)) == ranked(search.bm25_top(docs, "key", 5))


def test_bounds_hold_for_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "BLOCK_DOCS", 32)
    folder = str(tmp_path / "index")
    indexes.add_documents(documents(spark), folder)
    found = indexes.Ranked(spark, folder, "the w1 rare")
    each = found.postings.select("block", "term", F.explode("docs").alias("doc")).withColumn("part", found._part(F.col("doc.tf"), F.col("doc.len")))
    best = each.groupBy("block", "doc.row").agg(F.sum("part").alias("s")).groupBy("block").agg(F.max("s").alias("s"))
    assert best.join(found.bounds(), "block").where("s > bound + 1e-9").count() == 0


def test_a_frequent_word_is_spread_over_its_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "BLOCK_DOCS", 10)
    folder = str(tmp_path / "index")
    indexes.add_documents(spark.range(2000).selectExpr("id AS doc_id", "'hot' AS text"), folder)
    sizes = [r.n for r in spark.read.parquet(f"{folder}/postings").where("term = 'hot'").collect()]
    assert sum(sizes) == 2000 and len(sizes) > 150 and max(sizes) < 40


NAMES = [
    ("billing::Load_Beam", "Load_Beam", "src/a.rs"), ("beam", "beam", "src/beam/b.rs"), ("x::BEAM", "BEAM", "src/a.rs"), ("é::ü", "ü", "vendor/é.go"), ("", "", ""), ("a", "a", "a"), ("two words", "two words", "src/w.rs"),
    ("beam", "beam", "src/beam/b.rs"), ("q::r", "r", "r/s/t/load.ts"), ("n", None, "src/n.rs"), (None, "solo_beam", "src/s.rs"),
]


def symbols(spark, more=0):
    rows = [(f, n, p, i) for i, (f, n, p) in enumerate(NAMES)] + [(f"m{i % 13}::f{i}", f"f{i}", f"dir{i % 7}/file{i % 101}.ts", 100 + i) for i in range(more)]
    return spark.createDataFrame(rows, "fqn string, name string, file_path string, ordinal long")


LOOKUPS = ["beam", " Beam ", "load_beam src", "two words", "a", "rs", "ü", "zzz", "", "--", "f12 dir3", "solo_beam", "beam zzz", "r"]


def test_names_are_found_as_by_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "FOLDER_SYMBOLS", 40)
    rows, folder = symbols(spark, 400), str(tmp_path / "names")
    indexes.store_symbols(rows, folder)
    for query in LOOKUPS:
        for limit in (3, 1000) if query in ("beam", "f12 dir3") else (30,):
            want = [(r.ordinal, r.exact, r.lexical_hits, r.score) for r in search.top(rows, query, limit).collect()]
            got = [(r.ordinal, r.exact, r.lexical_hits, r.score) for r in indexes.lexical_top(spark, folder, query, limit).collect()]
            assert got == want, (query, limit)
    monkeypatch.setattr(indexes, "BROADCAST_ROWS", 0)
    assert [r.ordinal for r in indexes.lexical_top(spark, folder, "dir3", 1000).collect()] == [r.ordinal for r in search.top(rows, "dir3", 1000).collect()]


def test_no_names(spark, tmp_path):
    folder = str(tmp_path / "names")
    indexes.store_symbols(symbols(spark).limit(0), folder)
    assert indexes.lexical_top(spark, folder, "beam", 5).count() == 0


def test_few_folders_are_read_for_a_rare_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "FOLDER_SYMBOLS", 20)
    folder = str(tmp_path / "names")
    indexes.store_symbols(symbols(spark, 400), folder)
    found = indexes.lexical_top(spark, folder, "solo_beam", 5)
    assert "dynamicpruning" in plan(found)
    candidates, bound = indexes.candidates(spark, folder, "solo_beam")
    assert "In(gram, [" in plan(candidates) and bound <= 3
    assert candidates.select("__part").distinct().count() <= 2
