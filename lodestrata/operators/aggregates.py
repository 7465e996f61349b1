"""Counts over evidence, and runs with their results nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_counts(generations: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """One count for each table and generation, zero where there is none; one aggregation for each table."""
    out = generations.select(key).distinct()
    for name, rows in tables.items():
        out = out.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.na.fill(0, list(tables))


def local_summary(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Counts of a local index: nodes are files and symbols, edges are symbols and calls, chunks are symbols."""
    told = symbols.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))
    made = calls.agg(F.count(F.lit(1)).alias("calls"))
    both = told.withColumn("k", F.lit(1)).join(made.withColumn("k", F.lit(1)), "k")
    return both.select("files", "symbols", "calls", (F.col("files") + F.col("symbols")).alias("nodes"), (F.col("symbols") + F.col("calls")).alias("edges"), F.col("symbols").alias("chunks"))


def runs_with_results(runs: DataFrame, results: DataFrame, key: str = "test_run_id") -> DataFrame:
    """Runs, newest first, each with its results by suite and fqn; an empty list where it has none."""
    fields = [c for c in results.columns if c not in (key, "suite_name", "fqn")]
    listed = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("suite_name", "fqn", *fields))).alias("results"))
    full = runs.join(listed, key, "left")
    return full.withColumn("results", F.coalesce("results", F.expr("array()").cast(full.schema["results"].dataType))).orderBy(F.desc("created_at"), "source_path")


def newest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("generation_id")).limit(limit)


def health(parts: DataFrame, status: str = "status") -> DataFrame:
    """The worst of all parts: unhealthy, else degraded, else ok."""
    told = parts.agg(F.max(F.col(status) == "unhealthy").alias("bad"), F.max(F.col(status) == "degraded").alias("weak"))
    return told.select(F.when(F.col("bad"), "unhealthy").when(F.col("weak"), "degraded").otherwise("ok").alias("status"))


def architecture_entities(files: DataFrame) -> DataFrame:
    """Architecture documents among files (file_path, body): kind, base name and span; ordered by path and kind."""
    from lodestrata.functions.text import architecture_kind, basename, line_count

    rows = files.withColumn("kind", architecture_kind(F.col("file_path"))).where("kind IS NOT NULL")
    return rows.select("file_path", "kind", basename(F.col("file_path")).alias("name"), F.lit(1).alias("start_line"), line_count(F.col("body")).alias("end_line")).orderBy("file_path", "kind")
