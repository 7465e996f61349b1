import random

import numpy as np
import pytest
import xxhash

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import simhash  # noqa: E402
from lodestrata.llm.components import connected_components  # noqa: E402


def brute_components(ids, fps, radius=3):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                x, y = sorted((find(a), find(ids[j])))
                root[y] = x
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_triple():
    masks = simhash.covering(list(range(64)), 3)
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(3000):
        skip = sum(1 << p for p in rng.sample(range(64), 3))
        assert any(not m & skip for m in masks)


def test_fingerprint_matches_plain():
    for t in [None, "", " \t\n", "One", "One two", "É É é a B c d", "a b c " * 50, "x y z w q", "long " * 70000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("wide", [3, 4096])
def test_links_match_brute_force(spark, wide):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in fps[:6]:
        for _ in range(25):
            x = base
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    ids = list(range(100, 100 + len(fps)))
    rows = [(x - (1 << 64) if x >> 63 else x, i) for x, i in zip(fps, ids)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), 3, wide)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {i: got.get(i, i) for i in ids} == brute_components(ids, fps)


def test_edge_rows(spark):
    rows = [(5, None, "x"), (3, "", "y"), (7, "a b c d", "z"), (7, "e f g h", "z"), (9, "a b c d", None), (None, "a b c d", "q"), (8, "e f g h", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 7 and got[5, 0] == got[3, 0] == 3
    assert {v for (d, _), v in got.items() if d in (7, 8, 9)} == {7}
    assert [v for (d, _), v in got.items() if d is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    from lodestrata.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want_fp = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = brute_components(list(want_fp), list(want_fp.values()))
    got = QUERIES["op2_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in want_fp.items()}
    comps = {}
    for d, c in want.items():
        comps.setdefault(c, []).append(d)
    smallest = {d: min(v) for v in comps.values() for d in v}
    assert {r.doc_id: r.component_id for r in got} == smallest


def test_components_cost_the_driver_few_tasks(spark):
    """The driver keeps the state of every task: edges that are stars take no round, and a round reads and moves them little."""
    context, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "10", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}

    def tasks(edges):
        frame = spark.createDataFrame(edges, "a long, b long").repartition(10, "a")
        context.setJobGroup(group := f"components-{len(edges)}", "")
        try:
            got = {r.node: r.component for r in connected_components(frame).collect()}
        finally:
            context._jsc.clearJobGroup()
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return got, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        stars, for_stars = tasks([(100 * k, 100 * k + i) for k in range(1, 8) for i in range(1, 9)])
        assert stars == {100 * k + i: 100 * k for k in range(1, 8) for i in range(9)}
        assert for_stars <= 90
        # Two stars that share a leaf are one star after a round.
        crossed, for_crossed = tasks([(1, i) for i in range(3, 30)] + [(2, i) for i in range(29, 60)])
        assert crossed == dict.fromkeys(range(1, 60), 1)
        assert for_crossed - for_stars <= 220
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
