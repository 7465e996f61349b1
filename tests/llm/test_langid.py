import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import langid  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"aa": "lorem ipsum dolor sit amet", "bb": "zwischen über straße größe häuser", "cc": "что это такое здесь слово", "dd": "一 二 三 四 五"}


def rows(n, langs=tuple(WORDS)):
    return [(i, " ".join(WORDS[x].split()[(i + k * k) % 5] for k in range(3 + i % 9)), x) for i in range(n) for x in [langs[i % len(langs)]]]


def plain_grams(text):
    """n-grams of one to three characters over runs of lower-case letters, as the docstring tells them."""
    low = " " + " ".join("".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()) + " "
    out = Counter()
    for i in range(len(low)):
        if low[i] != " ":
            out[low[i]] += 1
        if i >= 1 and low[i - 1 : i + 1].strip():
            out[low[i - 1 : i + 1]] += 1
        if i >= 2 and low[i - 1] != " ":
            out[low[i - 2 : i + 1]] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab c", "  été -- 12 X ", "Straße", "漢字 かな", "a" * 50, "İ I", "x1y2z3"])
def test_counts_are_those_of_plain_grams(text):
    want, made = plain_grams(text), langid.counts([text, None, "zz"])
    assert made[0].sum() == sum(want.values())
    single = {g: langid.counts([text])[0] for g in want}
    assert not made[1].any() and (not want or (made[0] > 0).sum() <= len(want) == len(single))


def test_slices_of_a_long_text_count_all_of_it(monkeypatch):
    text = "wort und satz " * 500
    whole = langid.counts([text])
    monkeypatch.setattr(langid, "AT_ONCE", 14 * 20)  # cut where a word ends
    assert np.array_equal(langid.counts([text, "x"])[:1], whole)


def test_clusters_are_those_of_plain_k_means():
    rng = np.random.default_rng(3)
    x = np.abs(np.concatenate([np.eye(8)[i] + 0.05 * rng.random((20, 8)) for i in (0, 3, 5)])).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, reach = langid.cluster(x, 3)
    assert sorted(np.argmax(c, axis=1).tolist()) == [0, 3, 5]
    for i, v in enumerate(c):
        own = x[np.argmax(x @ c.T, axis=1) == i]
        assert np.allclose(v, own.sum(0) / np.linalg.norm(own.sum(0)), atol=1e-5)
        assert reach[i] < (own @ v).min() + 1e-6
    assert len(langid.cluster(np.repeat(x[:1], 5, axis=0))[0]) == 1


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    made = langid.judged(docs.repartition(8)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    got = made.where("held_out").selectExpr("count(*) n", "count_if(lang = lang_pred) ok", "count_if(rejected) r", "count_if(n_chars > 200) wide", "count_if(n_chars > 200 AND lang = lang_pred) wide_ok").first()
    assert got.n > 1500 and got.ok > 0.98 * got.n and got.wide_ok > 0.99 * got.wide and got.r < 0.05 * got.n


def test_edges(spark):
    known = rows(400)
    odd = [(1001, None, "aa"), (1002, "", "bb"), (1003, "12 34 !!", "cc"), (None, "lorem ipsum dolor", "aa"), (1004, "lorem dolor sit " * 100_000, None), (1005, "что это слово", None), (1006, "xqj kvw", "aa"), (1006, "xqj kvw", "aa")]
    df = spark.createDataFrame(known + odd, SCHEMA).selectExpr("*", "'x' AS nearest", "1 AS score", "2 AS place", "3 AS held_out", "4 AS slots")
    made = langid.judged(df.repartition(4)).collect()
    assert len(made) == len(known) + len(odd)
    by = {}
    for r in made:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {by[i][0].lang_pred for i in (1001, 1002, 1003)} == {"und"} and {by[i][0].score for i in (1001, 1002, 1003)} == {0.0}
    assert (by[None][0].lang_pred, by[1004][0].lang_pred, by[1005][0].lang_pred, len(by[1006])) == ("aa", "aa", "cc", 2)
    assert all(by[i][0].lang_pred == x for i, _, x in known)
    assert langid.judged(df.limit(0)).count() == 0
    nothing = langid.judged(df.withColumn("lang", langid.F.lit(None).cast("string"))).select("lang_pred", "score", "rejected").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0, True)]


def test_held_out_labels_change_nothing(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    wrong = df.withColumn("lang", langid.F.when(langid.learnable(langid.F.col("doc_id")), langid.F.col("lang")).otherwise("zz"))
    key = lambda made: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in made.collect())
    assert key(langid.judged(df)) == key(langid.judged(wrong))


def test_blocks_of_languages_and_the_bound_of_the_sample_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(rows(300), SCHEMA)
    key = lambda made: sorted((r.doc_id, r.lang_pred, round(r.score, 5), r.rejected) for r in made.collect())
    want = key(langid.judged(df))
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert key(langid.judged(df)) == want
    monkeypatch.setattr(langid, "PER_LANG", 5)
    assert {(d, x) for d, x, *_ in key(langid.judged(df))} == {(d, x) for d, x, *_ in want}


def test_texts_beyond_reach_are_rejected(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    model = langid.train(df)
    asked = spark.createDataFrame([(1, "lorem ipsum dolor sit amet"), (2, "qqq xxx jjj vvv kkk"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.nearest, r.rejected) for r in langid.identify(asked, model).collect()}
    assert got[1] == ("aa", False) and got[2][1] and got[3] == (None, True)
