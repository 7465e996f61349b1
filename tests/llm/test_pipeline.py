import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestrata.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestrata.llm import mixing, simhash, surrogates, toxicity  # noqa: E402
from test_copies import grams  # noqa: E402
from test_packing import check  # noqa: E402

PATH = "/root/testdata/sf0.01"


def test_every_stage_against_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    made = [docs]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(at))
        stage(spark, made[-1], PATH).write.parquet(out)
        made.append(spark.read.parquet(out))
    assert all(d.columns == docs.columns for d in made[:-1])
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in made[:-1]]
    assert all(len(i) == len(set(i)) for i in ids)
    scores = {r.doc_id: r.score for r in toxicity.judged(docs, labels).collect()}
    assert set(ids[1]) == {d for d, s in scores.items() if s < 0.3}
    text = {r.doc_id: r.text for r in made[1].collect()}
    sets = {d: grams(t or "") for d, t in text.items()}
    holders = {}
    for d, some in sets.items():
        for g in some:
            holders.setdefault(g, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for some in holders.values() for a in some for b in some if a < b}:
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(ids[2]) == sorted(d for d in sets if find(d) == d) and len(ids[2]) < len(ids[1])
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(made[1], 5).collect()}
    assert any(linked[d] != d and find(d) != d for d in sets), "the operator's own groups are among them"
    assert sorted(ids[3]) == sorted(ids[2])
    want = {r.doc_id: r.text for r in surrogates.replace(made[2]).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in made[3].collect()} == {d: (t, len(t)) for d, t in want.items()}
    assert set(ids[4]) == {r.doc_id for r in mixing.mix(made[3]).where("selected").collect()}
    assert check(made[5].collect(), [(r.doc_id, r.text) for r in made[4].collect()]) > 0.97


def test_edges(spark):
    rows = [(1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, None, None, None, None), (3, "", "en", "s", 0), (1, "a b c d", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, some, PATH).collect()
    kept = corpus_pipeline.drop_copies(spark, docs, PATH).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]


def test_very_long_and_odd_texts_pass_all_stages(spark):
    rows = [(1, " " * 1_000_000, "en", "s", 10**6), (2, "word " * 50_000, None, "s", 1), (3, "\n" * 20_000 + "x", "en", None, None), (4, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit(1)).withColumn("score", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, PATH)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() <= 4
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(rows, docs.schema), PATH).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4} and max(r.doc_tokens for r in packed) == 1_000_001
