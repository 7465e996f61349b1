"""Snapshots: the latest generation, active rows, upserts, soft staleness and state changes.

Rows are never changed in place; each function gives the next snapshot from the present one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.pairs import crossed


def latest_generations(generations: DataFrame, key: str = "repo_id", index_kind: str | None = None, succeeded: bool = True) -> DataFrame:
    """(key, generation_id): each repository's newest generation by start, ties to the larger id.

    By default any kind counts, as readers of the reference see it; a kind may be asked for.
    """
    rows = generations.where(F.col("status") == "succeeded") if succeeded else generations
    if index_kind is not None:
        rows = rows.where(F.col("index_kind") == index_kind)
    newest = F.max_by("generation_id", F.struct("started_at", "generation_id"))
    return rows.groupBy(key).agg(newest.alias("generation_id"))


def active(rows: DataFrame, generations: DataFrame, key: str = "repo_id", index_kind: str | None = None) -> DataFrame:
    """Rows that are not stale and belong to their repository's latest generation."""
    latest = latest_generations(generations, key, index_kind)
    return rows.where("stale_at IS NULL").join(latest, [key, "generation_id"], "left_semi")


def active_shared(rows: DataFrame, owners: DataFrame, generations: DataFrame, share: str, key: str = "repo_id") -> DataFrame:
    """``active`` over rows that many generations share: (share, generation_id, ..) of each active row and latest generation.

    ``owners`` has key, generation_id and ``share``, ``rows`` has ``share`` and stale_at. Both are reduced to what is
    active before they meet, so rows of older generations are never made, and no row of the result is moved.
    """
    live = active(owners.withColumn("stale_at", F.lit(None).cast("string")), generations, key).drop("stale_at")
    return crossed(live, rows.where("stale_at IS NULL").drop("stale_at"), [share])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The union of both with one row for each key: that of the greatest ``order``; it is not stale any more."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    kept = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    out = kept.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*both.columns)
    if "stale_at" in out.columns:
        touched = new.select(*keys).distinct().withColumn("__new", F.lit(True))
        out = out.join(touched, keys, "left").withColumn("stale_at", F.when(F.col("__new"), F.lit(None)).otherwise(F.col("stale_at"))).select(*both.columns)
    return out


def stale_out(rows: DataFrame, generation_id: Column, now: Column, **scope: Column) -> DataFrame:
    """Rows of the scope (same repository and commit, or narrower) from other generations become stale."""
    inside = F.col("generation_id") != generation_id
    for name, value in scope.items():
        inside = inside & (F.col(name) == value)
    return rows.withColumn("stale_at", F.when(inside & F.col("stale_at").isNull(), now).otherwise(F.col("stale_at")))


def replace_manifest(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """A new generation's manifest over the old rows of its repository and commit, all of which go stale."""
    scope = new.select("repo_id", "commit_sha").distinct().withColumn("__hit", F.lit(True))
    marked = old.join(scope, ["repo_id", "commit_sha"], "left")
    aged = marked.withColumn("stale_at", F.when(F.col("__hit") & F.col("stale_at").isNull(), now).otherwise(F.col("stale_at"))).drop("__hit")
    return aged.unionByName(new)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """The new rows in the place of all old rows of their scope (delete and insert)."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def begin_generation(generations: DataFrame, row: DataFrame) -> DataFrame:
    return generations.unionByName(row)


def end_generation(generations: DataFrame, generation_id: str, status: str, now: Column, error: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rows that moved). Only a started generation ends; no moved row means an error."""
    mine = (F.col("generation_id") == generation_id) & (F.col("status") == "started")
    moved = generations.where(mine)
    stamp = "finished_at" if status == "succeeded" else "failed_at"
    after = generations.withColumns(
        {
            stamp: F.when(mine, now).otherwise(F.col(stamp)),
            "error": F.when(mine, F.lit(error)).otherwise(F.col("error")),
            "status": F.when(mine, status).otherwise(F.col("status")),
        }
    )
    return after, moved


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the first broken rule's name; a rule that is null is broken."""
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.withColumn("violation", broken).where("violation IS NOT NULL")


def range_rules() -> dict[str, Column]:
    return {
        "start_line": F.col("start_line") >= 1,
        "end_line": F.col("end_line") >= F.col("start_line"),
        "start_col": F.col("start_col") >= 0,
        "end_col": F.col("end_col") >= 0,
    }


def with_manifest(symbols: DataFrame, manifests: DataFrame) -> DataFrame:
    """``symbols`` with file_manifest_id and content_hash of their file's active manifest row; a file without one has null and an empty hash."""
    keys = ["repo_id", "commit_sha", "file_path"]
    live = manifests.where("stale_at IS NULL").groupBy(*keys).agg(F.min_by(F.struct("file_manifest_id", "content_sha256"), "file_manifest_id").alias("__m"))
    found = symbols.join(live, keys, "left")
    return found.select(*symbols.columns, F.col("__m.file_manifest_id").alias("file_manifest_id"), F.coalesce("__m.content_sha256", F.lit("")).alias("content_hash"))


def existing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among the others', such as generations that have runs, or repositories that exist."""
    return rows.join(others.select(*keys), keys, "left_semi")


def unseen(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the others'."""
    return rows.join(others.select(*keys), keys, "left_anti")


def flagged(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """All rows, with a flag whether their keys are among the others'."""
    return rows.join(others.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").na.fill({name: False})
