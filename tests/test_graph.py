import random

from lodestrata.operators import graph, ranges, search

SCHEMA = "versioned_symbol_id string, stable_symbol_id string, repo_id string, commit_sha string, file_path string, language string, kind string, name string, fqn string, start_line int, start_col int, end_line int, end_col int, ordinal long"


def sym(i, path, name, start=1, end=2, kind="function", fqn=None, cols=(0, 1)):
    return (f"v{i}", f"s{i}", "r", "c", path, "rust", kind, name, fqn or name, start, cols[0], end, cols[1], i)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_innermost(spark):
    rows = [sym(0, "a", "outer", 1, 10), sym(1, "a", "inner", 4, 6), sym(2, "a", "twin", 4, 6, cols=(5, 2)), sym(3, "b", "other", 1, 99)]
    lines = spark.createDataFrame([("a", 5, 1), ("a", 2, 2), ("a", 11, 3), ("c", 1, 4)], "file_path string, line int, ordinal_in_diff int")
    got = {r.ordinal_in_diff: r.name for r in ranges.changed_symbols(lines, frame(spark, rows), ["name"]).collect()}
    assert got == {1: "twin", 2: "outer"}


def test_innermost_matches_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        a = rng.randrange(1, 400)
        rows.append(sym(i, rng.choice("xy"), f"n{i}", a, a + rng.choice([0, 1, 3, 20, 300]), cols=(rng.randrange(5), rng.randrange(9))))
    asked = [(rng.choice("xyz"), rng.randrange(1, 700), i) for i in range(300)]
    want = {}
    for path, line, n in asked:
        inside = [r for r in rows if r[4] == path and r[9] <= line <= r[11]]
        if inside:
            want[n] = min(inside, key=lambda r: (r[11] - r[9], max(r[12] - r[10], 0), r[13]))[0]
    lines = spark.createDataFrame(asked, "file_path string, line int, ordinal_in_diff int")
    got = {r.ordinal_in_diff: r.versioned_symbol_id for r in ranges.changed_symbols(lines, frame(spark, rows), ["versioned_symbol_id"]).collect()}
    assert got == want


def test_call_resolution(spark):
    rows = [sym(0, "a", "main", 1, 9), sym(1, "b", "go", 1, 2), sym(2, "a", "go", 20, 22), sym(3, "a", "lone", 30, 31)]
    calls = spark.createDataFrame([(1, "a", "go", 3, 0, 3, 4), (2, "a", "none", 3, 0, 3, 4), (3, "z", "go", 3, 0, 3, 4), (4, "b", "go", 1, 0, 1, 4), (5, "a", "lone", 30, 0, 30, 2)], "call_id int, file_path string, target_name string, start_line int, start_col int, end_line int, end_col int")
    got = {r.call_id: (r.source_symbol_id, r.target_symbol_id) for r in graph.resolve_calls(calls, frame(spark, rows)).collect()}
    assert got == {1: ("v0", "v2"), 4: ("v1", "v2")}


def test_contains_and_imports_and_covers(spark):
    rows = [sym(0, "src/lib.rs", "trestle", 1, 1, "module"), sym(1, "src/trestle.rs", "load_beam"), sym(2, "src/trestle.rs", "load_beam_adds_mass", 5, 6, "test_case")]
    df = frame(spark, rows)
    assert graph.nodes(df).count() == 5 and graph.contains_edges(df).count() == 3
    files = spark.createDataFrame([("src/trestle.rs",), ("src/lib.rs",)], "file_path string")
    edge = graph.import_edges(df, files).collect()
    assert len(edge) == 1 and edge[0].confidence == 0.85
    covers = graph.test_cover_edges(df).collect()
    assert len(covers) == 1 and covers[0].file_path == "src/trestle.rs" and covers[0].start_line == 5


def test_impact(spark):
    rows = [sym(0, "b", "target"), sym(1, "a", "caller"), sym(2, "b", "mate"), sym(3, "b", "mod", kind="module")]
    calls = spark.createDataFrame([("v1", "v0"), ("v1", "v0"), ("v9", "v0")], "source_symbol_id string, target_symbol_id string")
    df = frame(spark, rows)
    r = graph.impact(df, calls, graph.find_symbol(df, "target")).first()
    assert (r.related, r.direct_callers, r.direct_callees, r.affected_files, r.impact_score) == (1, ["caller"], [], ["a", "b"], 3)
    plan = graph.refactor_plan(graph.impact(df, calls, graph.find_symbol(df, "target"))).collect()
    assert {p.risk for p in plan} == {"medium"} and not any(p.execution_allowed for p in plan) and len(plan) == 2
    assert graph.find_symbol(df, "unknown").count() == 0


def test_related_stops_at_sixteen(spark):
    df = frame(spark, [sym(i, "a", f"n{i:02}", i + 1, i + 1) for i in range(30)])
    got = graph.related_symbols(df, df.where("ordinal = 5")).orderBy("place").collect()
    assert [r.related_id for r in got] == [f"v{i}" for i in range(17) if i != 5]


def test_test_context(spark):
    rows = [sym(0, "a", "load_beam"), sym(1, "t", "test_loadbeam", kind="test_case"), sym(2, "a", "same_file", kind="test_case"), sym(3, "z", "linked", kind="test_case"), sym(4, "z", "unrelated", kind="test_case")]
    covers = spark.createDataFrame([("v3", "v0", 0.65)], "test_symbol_id string, target_symbol_id string, confidence double")
    segments = spark.createDataFrame([("a", 2, 3), ("a", 5, 6), ("b", 1, 2)], "file_path string, segment_start int, segment_end int")
    tests, covered = graph.test_context(frame(spark, rows), covers, segments, "load_beam")
    assert [(r.fqn, r.confidence) for r in tests.collect()] == [("same_file", "low"), ("test_loadbeam", "medium"), ("linked", "medium")]
    assert [r.segment_start for r in covered.collect()] == [2]


def test_lexical_order(spark):
    rows = [sym(0, "src/trestle_total.rs", "other"), sym(1, "z.rs", "trestle_total")]
    got = search.top(frame(spark, rows), "trestle_total", 5).collect()
    assert [(r.name, r.exact, r.score) for r in got] == [("trestle_total", True, 110), ("other", False, 10)]
    assert search.top(frame(spark, rows), "  ", 5).count() == 0


def test_context_pack(spark):
    rows = [sym(0, "a", "alpha"), sym(1, "a", "beta")]
    calls = spark.createDataFrame([("v0", "v1")], "source_symbol_id string, target_symbol_id string")
    got = search.context_pack(frame(spark, rows), calls, "alpha", 8).collect()
    assert len(got) == 1 and got[0].direct_callees == ["beta"] and got[0].impact_score == 3


def test_a_crowded_window_grows_to_the_whole_name(spark):
    """Names and tests that all share one window of three letters: the pairs are those of brute force, and no other pair is made."""
    rows = [sym(i, "t.rs", f"t{i}", kind="test_case", fqn=f"abc_{i % 97}_loads_{i}") for i in range(300)]
    rows += [sym(1000 + i, "s.rs", f"abc{i}") for i in range(300)] + [sym(5000 + i, "s.rs", "abc") for i in range(50)] + [sym(6000, "s.rs", "x"), sym(6001, "s.rs", "lo"), sym(6002, "s.rs", "zzz")]
    df = frame(spark, rows)
    want = {(r.test_id, r.target_id) for r in graph.test_covers(df).collect()}
    assert {(r.test_id, r.target_id) for r in graph.test_covers(df, most=10).collect()} == want
    low = lambda s: "".join(c for c in s.lower() if c.isalnum())
    plain = {(f"v{t[0]}", f"v{s[0]}") for t, s in (((i, f"abc_{i % 97}_loads_{i}"), (j, n)) for i in range(300) for j, n in [*((1000 + k, f"abc{k}") for k in range(300)), *((5000 + k, "abc") for k in range(50)), (6000, "x"), (6001, "lo"), (6002, "zzz")]) if low(s[1]) in low(t[1])}
    assert len(want) == len(plain)


def test_counts_of_impact_are_those_of_its_lists(spark):
    rows = [sym(i, f"f{i % 5}.rs", f"n{i}", start=i) for i in range(40)]
    df = frame(spark, rows)
    calls = spark.createDataFrame([(f"v{i}", "v0") for i in range(40)] + [("v0", "v3"), ("v0", "v3"), ("v1", "v99")], "source_symbol_id string, target_symbol_id string")
    lists = {r.versioned_symbol_id: (r.related, len(r.direct_callers), len(r.direct_callees), len(r.affected_files), r.impact_score) for r in graph.impact(df, calls, df).collect()}
    got = {r.versioned_symbol_id: (r.related, r.callers, r.callees, r.files, r.impact_score) for r in graph.impact_counts(df, calls, df).collect()}
    assert got == lists and lists["v0"][1] == 40
