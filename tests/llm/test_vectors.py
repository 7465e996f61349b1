import numpy as np
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import vectors  # noqa: E402
from lodestrata.llm.queries import QUERIES  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, score long, component_id string"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [
        (None, [1.0, 0.0], None, 1, "x"),
        (1, None, None, None, None),
        (2, [], 1, None, "y"),
        (3, [1.0, None], 1, 2, None),
        (4, [nan, 1.0], 1, 2, None),
        (5, [inf, 1.0], 1, 2, None),
        (6, [0.0, 0.0], 1, 2, None),
        (50, [1.0, 0.01], 1, 2, None),
        (7, [1.0, 0.0], 1, 2, None),
        (7, [1.0, 0.0], 1, 2, None),
        (8, [-1.0, 0.0], 1, 2, None),
        (9, [1.0, 0.0, 0.0], 1, 2, None),
        (100, [3e8, 1e8], 1, 2, None),
    ]


def brute_top(rows, every=50, k=5):
    sound = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            v = [float(np.float32(x)) for x in e]
            sound[i] = min(sound.get(i, v), v)
    grid = {i: [int(np.floor(256 * x)) for x in v] for i, v in sound.items()}
    out = set()
    for q in grid:
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(grid[q], grid[c])), c) for c in grid if c != q and len(grid[c]) == len(grid[q])]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def test_top_k_edges(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = {tuple(r) for r in vectors.top_k(df).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top([(r[0], r[1]) for r in odd_rows()])
    assert vectors.top_k(df.limit(0)).count() == 0


def test_top_k_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 40)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    e = np.round(rng.standard_normal((300, 6)) * 2) / 4  # many ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in vectors.top_k(df, every=10, k=4).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 10, 4)


def test_scores_beyond_long_are_held_to_it(spark):
    big = float(np.float32(3e38))
    rows = [(0, [big, big, 1.0]), (1, [big, big, 0.0]), (2, [-big, -big, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [big, -big, 0.5]), (50, [1.0, 1.0, 1.0]), (51, [1e6, 1e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in vectors.top_k(df).select("query_id", "rank", "vec_id", "score").collect()]
    most = (1 << 63) - 1
    grid = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows}
    want = set()
    for q in (0, 50):
        scored = sorted((-min(max(sum(a * b for a, b in zip(grid[q], grid[c])), -most - 1), most), c) for c in grid if c != q)
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])}
    assert set(got) == want and {most} <= {r[3] for r in got}


def test_the_cutoff_spares_most_of_the_work():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((4000, 64)) * np.linspace(2, 0.05, 64))
    x[100:140] = x[100] + np.floor(10 * rng.standard_normal((40, 64)))
    block = vectors.Block(np.arange(len(x)), x)
    mine, q = np.arange(90, 150), x[90:150]
    first = dict(block.first(mine, q, 5))
    cutoff = np.array([first[i][4][0] for i in mine], dtype=float)
    got = dict(block.best(mine, q, cutoff, 5))
    whole = q @ x.T
    for i, me in enumerate(mine):
        want = sorted(((-s, j) for j, s in enumerate(whole[i]) if j != me))[:5]
        assert got[me] == [(int(-s), j) for s, j in want]
        assert first[me][4][0] <= got[me][4][0], "a cutoff that five entries reach"
    assert block.scored + block.skipped == 4 * whole.size and block.skipped > 0.4 * 4 * whole.size


def test_blocks_are_placed_once(spark, sf_dir):
    plan = vectors.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("CoGroup") :]
    assert cogroup.count("Exchange hashpartitioning(part") <= 1, "only the cutoffs move"


def brute_links(ids, e, t=0.9):
    u = np.asarray(e, dtype=np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= t
    np.fill_diagonal(hit, False)
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(hit[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(ids[j] for j in seen)
    return {ids[i]: (int(hit[i].sum()), comp[i], comp[i] == ids[i]) for i in range(len(ids))}, hit


@pytest.mark.parametrize("chunk", [5, 2048])
def test_near_duplicates_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 32))
    e = np.concatenate([c + 0.12 * rng.standard_normal((9, 32)) for c in centres])
    ids = [int(x) for x in rng.permutation(len(e)) + 1000]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, e)], "vec_id long, embedding array<float>")
    want, hit = brute_links(ids, e)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert hit.sum() > 400
    found, all_ = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= all_ and found >= 0.97 * all_
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(got[i] == want[i] for i in ids) >= 0.9 * len(ids)


def test_settings_keep_recall_and_buckets_at_any_size():
    for rows in (1, 1000, 10**6, 10**9, 10**11):
        tables, projections = vectors.settings(rows)
        far, near = vectors.chance(np.sqrt(2)), vectors.chance(np.sqrt(0.2))
        assert rows * far**projections <= vectors.STRANGERS + 1e-9
        assert 1 - (1 - near**projections) ** tables >= vectors.RECALL


def test_recall_at_the_settings_of_a_large_table(spark):
    rng = np.random.default_rng(4)
    e = rng.standard_normal((120, 48))
    noise = rng.standard_normal((120, 48))
    noise -= (noise * e).sum(1, keepdims=True) / (e * e).sum(1, keepdims=True) * e
    noise *= np.linalg.norm(e, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    both = np.concatenate([e, 0.905 * e + np.sqrt(1 - 0.905**2) * noise])  # pairs just above the threshold
    ids = list(range(len(both)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, both)], "vec_id long, embedding array<float>")
    want, hit = brute_links(ids, both)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, vectors.settings(10**8)).collect()}
    assert hit.sum() >= 240 and sum(got.values()) >= 0.9 * hit.sum()


def test_equal_vectors_count_as_copies(spark):
    rows = [(i, [1.0, 0.0, 0.2]) for i in range(300)] + [(1000 + i, [1.0, 0.1, 0.2]) for i in range(200)] + [(2000, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got[2000] == (0, 2000, True) and got[0] == (499, 0, True)
    assert all(got[i] == (499, 0, False) for i in [*range(1, 300), *range(1000, 1200)])


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 50, 100]
    assert got[6] == (0, 6, True) and got[9] == (0, 9, True) and got[1] == (0, 1, True)
    assert got[7] == (2, 7, True) and got[50] == (2, 7, False) and got[100] == (2, 7, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_query_recall_on_the_tables(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    want, _ = brute_links([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op8_vectors"](spark, path).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["op3_topk", "op8_vectors"])
def test_sql_twins_on_linked_vectors(spark, tmp_path, name):
    import duckdb

    from lodestrata.llm.queries import ORACLE_SQL

    rng = np.random.default_rng(11)
    e = np.concatenate([c + 0.04 * rng.standard_normal((8, 24)) for c in rng.standard_normal((12, 24))])
    rows = [(int(i), [float(x) for x in v], None) for i, v in enumerate(e)] + [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (None, [1.0] * 24, 1), (3, [float(x) for x in e[3]], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*names).collect())
    assert got == want and len(got) > 9
