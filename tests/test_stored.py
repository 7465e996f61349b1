"""Stored snapshots: the rows of ``snapshot``, and the files that a change leaves alone."""

import datetime as dt
import hashlib
import os
from itertools import count

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import snapshot
from lodestrata.operators.stored import KeyedTable

SCHEMA = "repo string, id long, value string, version long, generation_id long, stale_at timestamp"
NOW = dt.datetime(2024, 1, 1)
NUMBER = count()


@pytest.fixture
def held(spark, tmp_path):
    folder = str(tmp_path / f"t{next(NUMBER)}")
    rows = spark.createDataFrame([(f"r{i % 9}", i, f"v{i}", 10, i % 3, NOW if i % 4 == 0 else None) for i in range(200)], SCHEMA)
    table = KeyedTable(spark, folder, SCHEMA, ["repo", "id"], place=["repo"], folders=16, buckets=3)
    table.load(rows)
    return table, rows, folder


def files(folder):
    """Every data file with the hash of its bytes, by folder."""
    out = {}
    for at, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{at}/{n}", "rb") as f:
                    out[f"{os.path.basename(at)}/{n}"] = hashlib.sha256(f.read()).hexdigest()
    return out


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def check(table, want, folder, before, touched):
    assert same(table.rows(), want)
    after = files(folder)
    names = {f"__folder={t}" for t in touched}
    kept = {k: v for k, v in before.items() if k.split("/")[0] not in names}
    assert kept and all(after.get(k) == v for k, v in kept.items())
    assert {k for k in after if k.split("/")[0] not in names} == set(kept)


def test_load_and_open_again(spark, held):
    table, rows, folder = held
    assert same(table.rows(), rows)
    again = KeyedTable(spark, folder, SCHEMA, ["repo", "id"], place=["repo"], folders=16, buckets=3)
    assert same(again.rows(), rows)


def test_upsert_rewrites_touched_folders_only(spark, held):
    table, rows, folder = held
    new = spark.createDataFrame([("r1", 1, "new", 11, 7, NOW), ("r1", 1, "newer", 12, 7, NOW), ("r1", 10, "old", 9, 7, NOW), ("r1", 999, "added", 1, 7, NOW), ("r4", 4, "same version", 10, 7, NOW)], SCHEMA)
    before = files(folder)
    touched = table.upsert(new, "version")
    want = snapshot.upsert(rows, new.where("NOT (id = 1 AND version = 11)").withColumn("stale_at", F.lit(None).cast("timestamp")), ["repo", "id"], "version")
    # At an equal version the change counts; the plain step leaves that open.
    want = want.withColumns({"value": F.when(F.col("id") == 4, "same version").otherwise(F.col("value")), "generation_id": F.when(F.col("id") == 4, 7).otherwise(F.col("generation_id"))})
    want = want.withColumn("stale_at", F.when(F.col("id").isin(1, 10, 4, 999) & F.col("repo").isin("r1", "r4"), F.lit(None)).otherwise(F.col("stale_at")))
    check(table, want, folder, before, touched)
    assert len(touched) <= 2


def test_nothing_to_change(spark, held):
    table, rows, folder = held
    before = files(folder)
    assert table.upsert(rows.limit(0), "version") == [] and table.replace_scope(rows.limit(0), ["repo"]) == [] and table.stale_out(F.lit(1), F.lit(NOW), repo=F.lit("absent")) == []
    assert files(folder) == before


def test_a_change_shuffles_itself_only(spark, held):
    """The stored side is read by its buckets: one exchange is the change's, none the table's."""
    table, rows, _ = held
    old_setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        touched = table._touched(table._placed(rows.where("repo = 'r1'")))
        old = table.held(touched)
        new = spark.range(500).selectExpr("concat('r', id) AS repo", "id", "'x' AS more")
        shown = old.join(new, ["repo", "id"], "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_setting)
    assert shown.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in shown and "SelectedBucketsCount: 3 out of 3" in shown


def test_stale_out(spark, held):
    table, rows, folder = held
    before = files(folder)
    touched = table.stale_out(F.lit(1), F.lit(NOW), repo=F.lit("r2"))
    check(table, snapshot.stale_out(rows, F.lit(1), F.lit(NOW), repo=F.lit("r2")), folder, before, touched)
    assert len(touched) == 1


@pytest.mark.parametrize("scope", [["repo"], ["value"]])
def test_replace(spark, held, scope):
    table, rows, folder = held
    new = rows.where("id IN (5, 14, 23)").withColumn("version", F.lit(99).cast("long"))
    before = files(folder)
    touched = table.replace_scope(new, scope)
    check(table, snapshot.replace_scope(rows, new, scope), folder, before, touched)


def test_a_folder_that_loses_all_its_rows(spark, tmp_path):
    schema = "repo string, id long, tag string"
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["repo", "id"], place=["id"], folders=64, buckets=2)
    rows = spark.createDataFrame([(f"r{i % 2}", i, "x") for i in range(30)], schema)
    table.load(rows)
    new = spark.createDataFrame([("r0", 1000, "y")], schema)
    table.replace_scope(new, ["repo"])
    assert same(table.rows(), rows.where("repo = 'r1'").unionByName(new))


def test_manifest(spark, tmp_path):
    schema = "repo_id string, commit_sha string, path string, stale_at timestamp"
    rows = spark.createDataFrame([(f"r{i % 5}", "c", f"p{i}", None) for i in range(50)], schema)
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["repo_id", "commit_sha", "path"], place=["repo_id"], folders=16, buckets=2)
    table.load(rows)
    new = spark.createDataFrame([("r1", "c", "fresh", None), ("r7", "c", "first", None)], schema)
    before = files(str(tmp_path / "t"))
    touched = table.replace_manifest(new, F.lit(NOW))
    check(table, snapshot.replace_manifest(rows, new, F.lit(NOW)), str(tmp_path / "t"), before, touched)
    assert len(touched) <= 2
