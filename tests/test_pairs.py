"""Keys that make very many pairs: same rows as a join, made by many tasks."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.operators import graph, ranges, snapshot
from lodestrata.operators.pairs import crossed

SYMBOL = "versioned_symbol_id string, repo_id string, commit_sha string, file_path string, kind string, name string, fqn string, start_line int, start_col int, end_line int, end_col int, ordinal long"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def most_of_a_task(df):
    """The share of the rows that the fullest task makes."""
    made = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(made) / sum(made)


def symbol(i, name, fqn, kind="function", line=1, repo="r"):
    return (f"v{i}", repo, "c", "a.rs", kind, name, fqn, line, 0, line + 3, 1, i * 10 + line)


def test_same_rows_as_a_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, i % 5, None if i % 4 == 0 else f"a{i % 11}") for i in range(120)], "k int, a int, s string")
    right = spark.createDataFrame([(i % 4, i % 6, i % 10) for i in range(90)], "k int, b int, t int")
    want = left.join(right, "k").where("a >= b").select("k", "a", "s", "b", "t")
    assert rows_of(crossed(left, right, ["k"], (["a"], ["b"]), F.expr("a >= b"), block=4).select(*want.columns)) == rows_of(want)
    assert rows_of(crossed(left, right, ["k"])) == rows_of(left.join(right, "k"))
    assert crossed(left.where("k > 9"), right, ["k"]).count() == 0


def test_pairs_of_two_blocks_are_not_held_together(spark, no_broadcast):
    """A key of many blocks on both sides, with equal rows; only the few rows of one list are unfolded at once, not a list in a list."""
    left = spark.createDataFrame([(i % 2, f"a{i % 90}") for i in range(200)], "k int, s string")
    right = spark.createDataFrame([(i % 3, i % 70) for i in range(150)], "k int, t int")
    pairs = crossed(left, right, ["k"], block=8)
    assert rows_of(pairs) == rows_of(left.join(right, "k"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Exchange")].count("Generate inline") == 1


def test_sides_without_other_columns(spark):
    """Equal rows of a side that has only keys, or keys and columns alike, make as many pairs as in a join."""
    left = spark.createDataFrame([(i % 3, i % 5) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(i % 4, i % 2) for i in range(40)], "k int, b int")
    want = left.join(right, "k").where("a >= b")
    assert rows_of(crossed(left, right, ["k"], (["a"], ["b"]), F.expr("a >= b"), block=4)) == rows_of(want)
    assert rows_of(crossed(left.select("k"), right.select("k"), ["k"], block=4)) == rows_of(left.select("k").join(right.select("k"), "k"))
    segments = spark.createDataFrame([("f", 1, 3), ("f", 1, 3), ("f", 5, 9), ("g", 1, 9)], "file_path string, segment_start int, segment_end int")
    found = ranges.overlaps(segments, spark.createDataFrame([("f", 2, 4), ("f", 2, 4)], "file_path string, start_line int, end_line int"))
    assert rows_of(found) == rows_of(spark.createDataFrame([("f", 2, 4, 1, 3)] * 4, found.schema))


def test_overlaps_of_one_file_are_made_by_many_tasks(spark, no_broadcast):
    segments = spark.createDataFrame([(i, "f", 3 + i % 3, 9) for i in range(9000)], "s int, file_path string, segment_start int, segment_end int")
    symbols = spark.createDataFrame([(i, "f", 4, 8) for i in range(200)] + [(1000, "f", 8, 4), (1001, "g", 4, 8)], "id int, file_path string, start_line int, end_line int")
    found = ranges.overlaps(segments, symbols)
    assert found.count() == 9000 * 200 and most_of_a_task(found) < 0.6


def test_covers_of_one_name_are_made_by_many_tasks(spark, no_broadcast):
    rows = [symbol(i, f"t{i}", "one_name", "test_case") for i in range(9000)] + [symbol(9000 + i, "name", "x") for i in range(100)]
    found = graph.test_covers(spark.createDataFrame(rows, SYMBOL))
    assert found.count() == 9000 * 100 and most_of_a_task(found) < 0.6


def test_cover_edges_of_ids_that_stand_for_several_symbols(spark):
    """First span, last span and number of sites are those of every pair grouped."""
    rows = [symbol(1, "t", "abc::one", "test_case", 5), symbol(1, "t", "abc::two", "test_case", 2), symbol(1, "t", "abc::two", "test_case", 8), symbol(2, "t", "one", "test_case"), symbol(2, "t", "one", "test_case", 4, "q"), symbol(3, "o", "abc::one", "test_case")]
    rows += [symbol(4, "one", "x"), symbol(4, "abc", "x", line=3), symbol(5, "abc", "x"), symbol(6, "two", "x"), symbol(6, "two", "x", line=9), symbol(1, "abc", "x", line=7), symbol(7, "zzz", "x")]
    df = spark.createDataFrame(rows, SYMBOL)
    spans = df.select(F.col("versioned_symbol_id").alias("test_id"), "repo_id", "commit_sha", "file_path", *graph.SPAN, "ordinal")
    want = graph._edges(graph.test_covers(df).join(spans, "test_id"), ids.symbol_node(F.col("test_id")), ids.symbol_node(F.col("target_id")), "test_covers")
    got = graph.test_cover_edges(df)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and want.count() > 6
    unique = df.where("versioned_symbol_id IN ('v3', 'v5', 'v7')")
    assert graph.test_cover_edges(unique).count() == 1


def test_edges_of_covers_are_not_moved(spark, no_broadcast):
    rows = [symbol(i, f"t{i}", "one_name", "test_case") for i in range(300)] + [symbol(9000 + i, "name", "x") for i in range(40)]
    edges = graph.test_cover_edges(spark.createDataFrame(rows, SYMBOL))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == 300 * 40
    assert plan.index("Generate inline(__left") < plan.index("Exchange")  # unfolded after the last exchange


def test_rows_that_generations_share(spark):
    gens = spark.createDataFrame([(r, g, "succeeded" if g % 3 else "failed", g % 5) for r in range(4) for g in range(r * 10, r * 10 + 9)], "repo_id int, generation_id int, status string, started_at int")
    owners = gens.select("repo_id", "generation_id", (F.col("repo_id") % 2).alias("k"))
    rows = spark.createDataFrame([(i, i % 2, "x" if i % 3 == 0 else None) for i in range(30)], "id int, k int, stale_at string")
    want = snapshot.active(rows.join(owners, "k"), gens).select("k", "repo_id", "generation_id", "id")
    got = snapshot.active_shared(rows, owners, gens, "k")
    assert rows_of(got.select(*want.columns)) == rows_of(want) and want.count() > 0
