import random

import pytest

pytest.importorskip("lodestrata.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestrata.llm import copies  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def roots(texts, similar=0.8):
    """Smallest id of each id's group, by brute force."""
    root, sets = {d: d for d in texts}, {d: grams(t) for d, t in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            shared = len(sets[a] & sets[b])
            if shared >= similar * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in texts}


@pytest.mark.parametrize("chunk", [3, 1024])
def test_stage_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(copies, "CHUNK", chunk)
    rng = random.Random(11)
    texts = {}
    for k in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for j in range(6):
            w = list(base)
            for i in rng.sample(range(len(w)), rng.randrange(len(w) // 25)):
                w[i] = f"n{rng.randrange(10**6)}"
            texts[10 * k + j] = " ".join(w)
    texts |= {900: "one two three", 901: "One  two\nthree", 902: "one two four", 903: ""}
    want = roots(texts)
    assert len({d for d in texts if want[d] != d}) > 50
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert kept == {d for d in texts if want[d] == d}


def test_repeated_ids_join_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (6, b), (8, None), (9, ""), (None, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in copies.near_copies(df).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8), (9, 8)}
    assert copies.near_copies(df.limit(0)).count() == 0
