import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import aggregates, embeddings, snapshot

T0 = dt.datetime(2024, 1, 1)


def test_manifest_generations(spark):
    schema = "repo_id string, commit_sha string, file_path string, generation_id string, stale_at timestamp"
    old = spark.createDataFrame([("r", "c", "a", "g1", None), ("r", "c", "b", "g1", None), ("s", "c", "a", "g1", None)], schema)
    new = spark.createDataFrame([("r", "c", "a", "g2", None)], schema)
    after = snapshot.replace_manifest(old, new, F.lit(T0)).collect()
    assert sorted((r.repo_id, r.file_path, r.generation_id, r.stale_at is None) for r in after) == [("r", "a", "g1", False), ("r", "a", "g2", True), ("r", "b", "g1", False), ("s", "a", "g1", True)]


def test_latest_generation_by_kind_and_failure(spark):
    rows = [("r", "g1", "succeeded", T0, "file_manifest"), ("r", "g2", "succeeded", T0, "file_manifest"), ("r", "g3", "failed", T0 + dt.timedelta(1), "file_manifest"), ("r", "g4", "succeeded", T0 + dt.timedelta(2), "coverage")]
    gens = spark.createDataFrame(rows, "repo_id string, generation_id string, status string, started_at timestamp, index_kind string")
    assert snapshot.latest_generations(gens).first().generation_id == "g4"
    assert snapshot.latest_generations(gens, index_kind="file_manifest").first().generation_id == "g2"
    assert snapshot.latest_generations(gens, succeeded=False, index_kind="file_manifest").first().generation_id == "g3"


def test_only_a_started_generation_ends(spark):
    gens = spark.createDataFrame([("g1", "started", None, None, None), ("g2", "succeeded", T0, None, None)], "generation_id string, status string, finished_at timestamp, failed_at timestamp, error string")
    after, moved = snapshot.end_generation(gens, "g1", "failed", F.lit(T0), "boom")
    assert moved.count() == 1 and {r.generation_id: (r.status, r.error) for r in after.collect()} == {"g1": ("failed", "boom"), "g2": ("succeeded", None)}
    assert snapshot.end_generation(gens, "g2", "failed", F.lit(T0))[1].count() == 0


def test_upsert_clears_staleness(spark):
    schema = "id int, v string, version int, stale_at timestamp"
    old = spark.createDataFrame([(1, "a", 1, T0), (2, "b", 1, T0)], schema)
    new = spark.createDataFrame([(1, "c", 2, None), (1, "d", 3, None)], schema)
    got = {r.id: (r.v, r.stale_at is None) for r in snapshot.upsert(old, new, ["id"], "version").collect()}
    assert got == {1: ("d", True), 2: ("b", False)}


def test_runs_keep_an_empty_list(spark):
    runs = spark.createDataFrame([("r1", T0, "a"), ("r2", T0 + dt.timedelta(1), "b")], "test_run_id string, created_at timestamp, source_path string")
    results = spark.createDataFrame([("r1", "s", "b", "passed"), ("r1", "s", "a", "failed")], "test_run_id string, suite_name string, fqn string, status string")
    got = aggregates.runs_with_results(runs, results).collect()
    assert [(r.test_run_id, [x.fqn for x in r.results]) for r in got] == [("r2", []), ("r1", ["a", "b"])]


def test_architecture_entities(spark):
    files = spark.createDataFrame([("docs/adr/1.md", "a\nb\n"), ("src/a.rs", "x"), ("CODEOWNERS", "")], "file_path string, body string")
    got = aggregates.architecture_entities(files).collect()
    assert [(r.file_path, r.kind, r.name, r.end_line) for r in got] == [("CODEOWNERS", "codeowners", "CODEOWNERS", 1), ("docs/adr/1.md", "adr", "1.md", 2)]


def test_embedding_cache_misses_then_hits(spark):
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>, touched_at timestamp")
    asked = spark.createDataFrame([("p", "m", "x", 2, [1.0, 2.0]), ("p", "m", "y", 3, [1.0])], "provider string, model string, input string, dimensions int, embedding array<float>")
    cache, first = embeddings.put_or_touch(empty, asked, F.lit(T0))
    assert {(r.input, r.cache_hit, r.error) for r in first.collect()} == {("x", False, None), ("y", False, "dimensions differ")}
    _, second = embeddings.put_or_touch(cache, asked.where("input = 'x'"), F.lit(T0))
    assert [r.cache_hit for r in second.collect()] == [True]


def test_vectors(spark):
    df = spark.createDataFrame([("1, 2.5",), ("",), ("1,,2",), ("1,nan",), ("1,inf",), (None,)], "t string")
    assert [r.v for r in df.select(embeddings.parse_vector(F.col("t")).alias("v")).collect()] == [[1.0, 2.5], None, None, None, None, None]
    blob = spark.createDataFrame([(bytearray(b"\x00\x00\x80?"),), (bytearray(b"abc"),)], "b binary")
    assert [r.v for r in blob.select(embeddings.decode(F.col("b")).alias("v")).collect()] == [[1.0], None]
