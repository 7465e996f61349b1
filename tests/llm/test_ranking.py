import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import ranking  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in wanted.items():
        scores = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(k * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in want.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def got(docs, items, most=10):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.search(docs, items, most).collect()), key=repr)


def frames(spark, docs, items):
    clash = ["CAST(7 AS long) AS rank", "'x' AS term", "1 AS score", "2 AS n", "3 AS lot"]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *clash, "9 AS item_id").repartition(5), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *clash)


DOCS = [
    (None, "alpha beta"), (None, "alpha beta"), (1, None), (2, ""), (3, "!!! ..."), (4, "Alpha ALPHA alpha beta_beta"), (5, "été Été ÉTÉ naïve"), (6, "long " * 60_000 + "alpha"), (7, "same"), (7, "same"), (8, "same"),
    (9, "x\x00y z-9 9"), (10, "日本語 テキスト 日本語"), *((20 + i, f"alpha w{i % 7} w{i % 3} w{i}") for i in range(120)),
]
ITEMS = [(1, "alpha beta beta"), (2, None), (3, ""), (4, "nowhere at all"), (5, "SAME same"), (6, "été Été"), (7, "w1 w2 w3 w4 w5 w6"), (7, "w0 w0"), (None, "y z 9"), (8, "日本語"), (9, "alpha"), (9, "alpha")]


@pytest.mark.parametrize("bound", [dict(), dict(WIDE=3, ENTRIES=5), dict(TERMS=4), dict(TERMS=18)], ids=["plain", "small blocks", "texts once a pass", "two passes"])
def test_same_as_brute_force(spark, monkeypatch, bound):
    for name, value in bound.items():
        monkeypatch.setattr(ranking, name, value)
    assert got(*frames(spark, DOCS, ITEMS)) == brute(DOCS, ITEMS)


def test_a_large_vocabulary_is_read_once_for_several_passes(spark, monkeypatch):
    """More entries than one pass takes, fewer terms than that: the stored counts serve every pass."""
    items = [(i, "alpha beta w1 w2") for i in range(9)]
    monkeypatch.setattr(ranking, "TERMS", 10)
    calls, plain = [], ranking._postings
    monkeypatch.setattr(ranking, "_postings", lambda *a: calls.append(1) or plain(*a))
    assert got(*frames(spark, DOCS, items), most=3) == brute(DOCS, items, 3)
    assert len(calls) == 1


def test_no_rows(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert got(docs.limit(0), items) == got(docs, items.limit(0)) == []
    assert got(docs.where("doc_id IN (1, 2, 3)"), items) == []


def test_a_tie_of_all_documents(spark):
    docs = [(i, "tie one") for i in range(5000, 0, -1)] + [(6000, "other")] * 5001
    assert got(*frames(spark, docs, [(1, "tie")])) == brute(docs, [(1, "tie")])


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**7, 3 * 10**8], dtype=np.int64)
    assert ranking.length_part(n, 10**11, 10**13).tolist() == [25 + 75 * int(x) * 10**11 // 10**13 for x in n]


def test_query_and_sql_are_the_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(docs, items) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(con.execute(ranking.oracle_sql()).fetchall(), key=repr) == want
