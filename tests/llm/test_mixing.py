import collections

import pytest

pytest.importorskip("lodestrata.llm")
import duckdb  # noqa: E402

from lodestrata.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, p double, topic int"


AXES = mixing.AXES


def cells_of(tokens):
    return [{"source": s, "lang": g, "topic": t, "tokens": tokens(i)} for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in "xy" for t in "pq")]


def solved(cells, goals, budgets=(0.5,)):
    whole = sum(r["tokens"] for r in cells)
    held = {a: collections.Counter() for a in AXES}
    for r in cells:
        for a in AXES:
            held[a][r[a]] += r["tokens"] / whole
    p, budget, aims = mixing._on_driver(cells, held, goals, list(budgets), mixing.TOLERANCE, mixing.SWEEPS)
    got = {a: collections.Counter() for a in AXES}
    for r, x in zip(cells, p, strict=True):
        for a in AXES:
            got[a][r[a]] += r["tokens"] / whole * x
    return p, budget, aims, got


def test_raking_meets_the_marginals_under_the_cap():
    goals = {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.3, "q": 0.7}}
    p, budget, aims, got = solved(cells_of(lambda i: 40 + 7 * i), goals)
    assert budget == 0.5 and max(p) <= 1.0 and min(p) > 0
    for a, goal in goals.items():
        for v, want in goal.items():
            assert abs(got[a][v] - 0.5 * want) < 1e-8


def test_a_target_beyond_what_is_held_is_lowered_and_the_rest_raised():
    goals = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.5, "q": 0.5}}
    p, budget, aims, got = solved(cells_of(lambda i: 10 if i < 4 else 100), goals)
    assert abs(aims["source"]["a"] - 40 / 440) < 1e-9 and abs(sum(aims["source"].values()) - budget) < 1e-9
    assert all(abs(got[a][v] - aims[a][v]) < 1e-8 for a in AXES for v in got[a])
    full = mixing.reachable({"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.2, "c": 0.7}, 0.9)
    assert full == ({"a": 0.1, "b": 0.2, "c": 0.0}, {"a", "b"})


def test_the_budget_is_lowered_where_axes_cannot_be_met_together():
    cells = [{"source": "a", "lang": "x", "topic": "p", "tokens": 45}, {"source": "b", "lang": "y", "topic": "p", "tokens": 45}, {"source": "a", "lang": "y", "topic": "p", "tokens": 5}, {"source": "b", "lang": "x", "topic": "p", "tokens": 5}]
    goals = {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"p": 1.0}}
    p, budget, aims, got = solved(cells, goals, [0.5, 0.25, 0.08, 0.02])
    assert budget == 0.08 and all(abs(got[a][v] - aims[a][v]) < 1e-8 for a in AXES for v in got[a])
    # No budget helps where the filled cells contradict the targets: the first is taken as far as it comes.
    p, budget, aims, got = solved(cells[:2], goals, [0.5, 0.25])
    assert budget == 0.5 and 0 <= min(p) and max(p) <= 1


def test_both_ways_of_raking_agree(spark):
    rows = [(i, "w " * (1 + i % 5), f"l{i % 3}", f"s{i % 7 % 2}", f"t{i % 5 % 2}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    ways = [{r.doc_id: (r.probability, r.selected) for r in mixing.mix(docs, tolerance=1e-3, budget=0.4, topic=docs["subject"], cells_on_driver=n).collect()} for n in (100, 0)]
    assert ways[0].keys() == ways[1].keys() and len({p for p, _ in ways[0].values()}) > 5
    assert max(abs(ways[0][d][0] - ways[1][d][0]) for d in ways[0]) < 1e-5


def test_sql_twin(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = mixing.mix(docs)
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({mixing.oracle_sql()})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_edges(spark):
    rows = [
        (1, None, None, None, "x", 0.5, 3),
        (None, "a b", "en", "s", None, None, None),
        (2, "", "en", "s", "x", 0.1, 1),
        (3, "word " * 30000, "en", "s", "x", 0.1, 1),
        (3, "a b c", "de", "t", "x", 0.1, 1),
        (3, "a b c", "de", "t", "x", 0.1, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == 6 and all(0 <= r.probability <= 1 for r in got)
    assert {(r.source, r.lang, r.n_tokens) for r in got if r.doc_id == 1} == {("unknown", "unknown", 0)}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("doc_id = 1")).count() == 1


@pytest.mark.parametrize("budget", [0.6, 0.3])
def test_kept_tokens_follow_the_targets(spark, budget):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs, budget=budget).collect()
    whole = sum(r.n_tokens for r in rows)
    kept = [r for r in rows if r.selected]
    total = sum(r.n_tokens for r in kept)
    assert abs(total / whole - budget) < 0.01
    for a in AXES:
        expected, got = collections.Counter(), collections.Counter()
        for r in rows:
            expected[r[a]] += r.n_tokens * r.probability / (budget * whole)
        for r in kept:
            got[r[a]] += r.n_tokens / total
        for r in rows:
            assert abs(expected[r[a]] - r[f"{a}_target"]) < 1e-4, "probabilities meet the targets"
            assert abs(got[r[a]] - r[f"{a}_kept"]) < 1e-5
            assert abs(r[f"{a}_kept"] - r[f"{a}_target"]) < 0.01, "and so does the sample"
    assert {r.lang: r.lang_wanted for r in rows}["en"] < 0.45


def test_given_targets_and_a_column_as_topic(spark):
    rows = [(i, "w " * 10, "en" if i % 3 else "de", "s", None if i % 7 == 0 else f"t{i % 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    goals = {"topic": {"t0": 0.5, "t1": 0.3, "unknown": 0.2, "absent": 0.0}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mix(docs, goals, budget=0.4, topic=docs["subject"]).collect()
    assert {r.topic: r.topic_target for r in got} == {"t0": 0.5, "t1": 0.3, "unknown": 0.2}
    assert all(abs(r.topic_kept - r.topic_target) < 0.03 and abs(r.lang_kept - 0.5) < 0.03 for r in got)
