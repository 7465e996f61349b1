"""Overlays: a head's file changes over the files of a base generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inputs(changed: DataFrame, head: DataFrame) -> DataFrame:
    """Changed files (file_path, previous_file_path, status, ordinal) with the head's language, hash and size.

    Deleted files take nothing from the head; files that it lacks have an unknown language.
    """
    have = head.select("file_path", F.col("language").alias("h_language"), F.col("content_sha256").alias("h_hash"), F.col("size_bytes").alias("h_size"))
    live = F.col("status") != "deleted"
    return changed.join(have, "file_path", "left").select(
        "ordinal",
        "file_path",
        "previous_file_path",
        "status",
        F.coalesce(F.when(live, F.col("h_language")), F.lit("unknown")).alias("language"),
        F.when(live, F.col("h_hash")).alias("content_sha256"),
        F.when(live, F.col("h_size")).alias("size_bytes"),
    )


def merge(base: DataFrame, overlay: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The files that remain, as (scope.., file_path, content_sha256, source), after entries in order of ``ordinal``.

    Added and modified files are the head's; deleted ones go; a rename takes its previous path away and
    adds its own; a changed mode makes a base file the head's with the base's hash, and takes away a file
    that is the head's already. The result's order is by path.
    """
    keys = [*(scope or []), "file_path"]
    entries = overlay.select(*(scope or []), "file_path", "previous_file_path", "status", "content_sha256", "ordinal")
    starts = base.select(*keys, F.lit(-1).cast("long").alias("ordinal"), F.lit("base").alias("event"), "content_sha256")
    event = F.when(F.col("status") == "deleted", "drop").when(F.col("status") == "mode_only", "mode").otherwise("put")
    own = entries.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), event.alias("event"), "content_sha256")
    left = entries.where((F.col("status") == "renamed") & F.col("previous_file_path").isNotNull()).select(
        *(scope or []), F.col("previous_file_path").alias("file_path"), F.col("ordinal").cast("long").alias("ordinal"), F.lit("away").alias("event"), F.lit(None).cast("string").alias("content_sha256")
    )
    events = starts.unionByName(own).unionByName(left)
    # Of one entry, the removal of the previous path comes before the new path.
    listed = events.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.when(F.col("event") == "away", 0).otherwise(1).alias("second"), "event", "content_sha256"))).alias("events")
    )
    nothing = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("hash"))

    def step(state, e):
        return (
            F.when(e["event"] == "base", F.struct(F.lit("base").alias("source"), e["content_sha256"].alias("hash")))
            .when(e["event"] == "put", F.struct(F.lit("head").alias("source"), e["content_sha256"].alias("hash")))
            .when((e["event"] == "mode") & (state["source"] == "base"), F.struct(F.lit("head").alias("source"), state["hash"].alias("hash")))
            .otherwise(nothing)
        )

    done = listed.withColumn("s", F.aggregate("events", nothing, step)).where("s.source IS NOT NULL")
    return done.select(*keys, F.col("s.hash").alias("content_sha256"), F.col("s.source").alias("source"))
