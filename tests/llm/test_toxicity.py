import numpy as np
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import toxicity  # noqa: E402
from lodestrata.llm.boosting import Isotonic, Trees  # noqa: E402
from lodestrata.llm.common import held_out  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def test_trees_learn_and_sql_agrees(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Trees(rounds=30).fit(x, y)
    m = trees.margin(x)
    assert ((m > 0) == (y > 0.5)).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r.m for r in df.select(F.expr(trees.sql(["a", "b", "c"])).alias("m")).collect()]
    assert np.allclose(got, m[:50])
    assert Trees().fit(x[:0], y[:0]).margin(x[:3]).shape == (3,)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    m = rng.standard_normal(500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    p = Isotonic().fit(m, y).apply(np.linspace(-5, 5, 200))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9
    assert hit / sum(r.predicted for r in rows) > 0.75


def test_fold_and_edges(spark):
    import zlib

    ids = spark.range(40).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids)
    docs = [(i, ("you stupid fool " if i % 3 == 0 else "a fine day ") * 4, "en", 0.5, 1) for i in range(60)]
    docs += [(None, "x", None, None, None), (61, None, None, None, None), (62, "", "", None, None), (63, "stupid " * 20000, "en", None, None), (1, "a fine day", "en", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.judged(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[63].predicted == 1 and by[62].predicted == 0 and by[None].held_out is False
    assert toxicity.judged(df.limit(0), labels).count() == 0
    assert toxicity.judged(df, labels.limit(0)).count() == len(docs)


def plain_features(text, lexicon):
    """The features by plain loops."""
    import math

    text = text or ""
    low = text.lower()
    words, now = [], ""
    for c in low + " ":
        if c.isalpha():
            now += c
        elif now:
            words, now = [*words, now], ""
    if not words:
        return [0.0] * len(toxicity.NAMES)

    def worth(w):
        return max([lexicon.get(w, 0.0), *[lexicon.get(w[:k] + "-", 0.0) for k in toxicity.STEMS if len(w) > k]])

    n = len(words)
    hits = [i for i, w in enumerate(words) if worth(w) > 0]
    exact = sum(w in lexicon for w in words)
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hits)
    masked = toxicity.MASKED.findall(low)
    hidden = sum(worth(w) > 0 for m in masked for w in {m.translate(toxicity.LOOKALIKE), m.replace("*", "")})
    weights = [worth(words[i]) for i in hits]
    upper = sum(a != b for a, b in zip(text, low)) if len(text) == len(low) else sum(c.isupper() for c in text)
    return [
        exact / n, math.log1p(exact), len(hits) / n, math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})),
        sum(weights) / n, max(weights, default=0.0), math.log1p(sum(weights)), len(you) / n, near / max(len(hits), 1), math.log1p(near),
        upper / len(text), sum(len(w) > 1 and w.isupper() for w in text.split()) / n if upper > 1 else 0.0,
        text.count("!") / n, text.count("?") / n, sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / len(text),
        len(masked) / n, math.log1p(hidden), math.log1p(n), sum(map(len, words)) / n, len(set(words)) / n,
    ]


def test_features_match_plain_loops(spark, sf_dir):
    import random

    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [" ".join((t or "").split()[:400]) for t in texts] + [None, "", "!!", "You f0ol, y0u id*ot YOU!? ÉÉ", "a" * 3000 + " you", "st%pid s7upid"]
    kinds = sorted({w for t in texts for w in toxicity.WORDS.findall((t or "").lower())})
    lexicon = {w: rng.random() * 4 + 0.1 for w in rng.sample(kinds, 60)} | {w[:4] + "-": rng.random() * 4 + 0.1 for w in rng.sample([k for k in kinds if len(k) > 5], 30)} | {"fool": 2.0, "idot": 1.0}
    for t in texts:
        assert np.allclose(toxicity.features(t, lexicon), plain_features(t, lexicon)), t


def test_lexicon_matches_plain_counts(spark):
    rows = [(i, f"word{i % 9} common {'awful beast' if i % 4 == 0 else 'calm field'}" + (" rare" if i == 8 else ""), int(i % 4 == 0), i % 3) for i in range(240)] + [(999, None, 0, 0), (998, "", 1, 1)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    got = toxicity._lexicons(sample)
    share = sum(r[2] for r in rows) / len(rows)
    for f, lexicon in zip([0, 1, 2, None], got, strict=True):
        bad, n = {}, {}
        for _, t, y, fold in rows:
            if fold != f:
                for w in toxicity.terms(set((t or "").split())):
                    bad[w], n[w] = bad.get(w, 0) + y, n.get(w, 0) + 1
        odds = {w: np.log((bad[w] + 0.25) / (n[w] - bad[w] + 0.5)) - np.log((share + 1e-3) / (1 - share + 1e-3)) for w in n}
        assert lexicon == {w: round(float(odds[w]), 4) for w in ("awful", "awfu-", "beast", "beas-")}


def test_the_first_tree_takes_the_best_split():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (80, 4)).astype(float)
    y = (x[:, 2] + rng.random(80) * 2 > 3.5).astype(float)
    trees = Trees(rounds=1, depth=1, rate=1.0, bins=400).fit(x, y)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 2.0)
    best = max((gain(x[:, j] <= v) + gain(x[:, j] > v), j, v) for j in range(4) for v in np.unique(x[:, j])[:-1] if min(h[x[:, j] <= v].sum(), h[x[:, j] > v].sum()) >= 2.0)
    _, j, v = best
    want = np.log(p / (1 - p)) + np.where(x[:, j] <= v, -g[x[:, j] <= v].sum() / (h[x[:, j] <= v].sum() + 2.0), -g[x[:, j] > v].sum() / (h[x[:, j] > v].sum() + 2.0))
    assert np.allclose(trees.margin(x), want)


def test_repeated_ids_do_not_multiply_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels).count() <= 2
