"""Unified diffs as changed lines and changed files, by prefix scans over the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.storage import before_parts, carried, ranged


def lines(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, pos, line): carriage returns before line feeds are dropped, as is the end after the last one."""
    parts = F.split(F.regexp_replace(F.col(text), r"\r?\n\z", ""), r"\r?\n", -1)
    return diffs.select(key, F.posexplode(parts).alias("pos", "line"))


def _path(raw):
    """Without one leading a/ or b/; null for the null device."""
    plain = F.regexp_replace(raw, r"^[ab]/", "")
    return F.when(raw != "/dev/null", plain)


def file_lines(spark: SparkSession, path: str, key: str = "diff_id") -> DataFrame:
    """(key, pos, line) of diffs that are files of any size: the key is the file's path. Files are split; no task reads a whole one."""
    read = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return read.select(F.col("_metadata.file_path").alias(key), place.alias("pos"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def changed_lines(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, pos, file_path, line) of diffs as texts: see ``changed_lines_of``."""
    return changed_lines_of(lines(diffs, key, text), key)


def changed_lines_of(rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, pos, file_path, line): every added line, with its line number in the new file, from ``rows`` (key, pos, line).

    A line that starts ``+++ `` sets the path wherever it stands, so an added line ``++ x`` reads as a
    header. A hunk header sets the counter, or clears it where it can't be read; only then do lines count.

    Lines are sorted by ranges; path, hunk and counter are carried from range to range, so one diff of any
    length is worked on by all tasks.
    """
    rows = ranged(rows.select(key, "pos", "line"), [key, "pos"], "lines")
    line = F.col("line")
    header, hunk = line.startswith("+++ "), ~line.startswith("+++ ") & line.startswith("@@")
    first_plus = F.regexp_extract(F.substring(line, 3, 1 << 20), r"(?:^|\s)\+(\S*)", 1)
    number = F.regexp_extract(F.split_part(first_plus, F.lit(","), F.lit(1)), r"^\+?([0-9]+)$", 1).try_cast("long")
    plain = ~header & ~hunk
    advances = (plain & (line.startswith("+") | ~(line.startswith("-") | line.startswith("\\")))).cast("int")
    earlier = before_parts(rows.groupBy("part").agg(F.sum(advances).alias("__sum")), [], ["__sum"])
    upto = Window.partitionBy("part").orderBy("spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.join(earlier, "part").withColumn("__passed", F.col("__sum") + F.sum(advances).over(upto))  # lines of new files up to this one
    marked = carried(counted, key, "spot", __path=F.when(header, F.struct(_path(F.substring(line, 5, 1 << 20)).alias("p"))), __hunk=F.when(hunk, F.struct(number.alias("n"), F.col("__passed").alias("at"))))
    at = F.col("__hunk.n") + F.col("__passed") - advances - F.col("__hunk.at")
    added = plain & line.startswith("+") & F.col("__path.p").isNotNull() & at.isNotNull()
    return marked.where(added).select(key, "pos", F.col("__path.p").alias("file_path"), at.cast("long").alias("line"))


def changed_files(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, ordinal, file_path, previous_file_path, status) of diffs as texts: see ``changed_files_of``."""
    return changed_files_of(lines(diffs, key, text), key)


def changed_files_of(rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, ordinal, file_path, previous_file_path, status): one row for each file block, from ``rows`` (key, pos, line).

    A rename counts first, then the last new or deleted mode, then a hunk, which makes a file modified,
    then a changed mode. Header paths end at white space; content paths, where given, take their place.
    """
    rows = ranged(rows.select(key, "pos", "line"), [key, "pos"], "lines")
    line = F.col("line")
    parts = F.split(F.trim(F.substring(line, 12, 1 << 20)), r"\s+")
    old, new = _path(F.try_element_at(parts, F.lit(1))), _path(F.try_element_at(parts, F.lit(2)))
    opens = F.coalesce(line.startswith("diff --git ") & (old != "") & (new != ""), F.lit(False))
    blocks = carried(rows, key, "spot", block=F.when(opens, F.col("spot"))).where("block IS NOT NULL")
    last = lambda value, test: F.max_by(F.when(test, F.struct(value.alias("v"))), F.when(test, F.col("pos")))["v"]
    after = lambda prefix: (F.substring(line, len(prefix) + 1, 1 << 20), line.startswith(prefix))
    path_after = lambda prefix: (_path(F.substring(line, len(prefix) + 1, 1 << 20)), line.startswith(prefix))
    file_mode = F.when(line.startswith("new file mode "), "added").when(line.startswith("deleted file mode "), "deleted")
    told = blocks.groupBy(key, "block").agg(
        F.min("pos").alias("ordinal"),
        last(old, opens).alias("head_old"),
        last(new, opens).alias("head_new"),
        last(*path_after("--- ")).alias("content_old"),
        last(*path_after("+++ ")).alias("content_new"),
        last(*after("rename from ")).alias("rename_from"),
        last(*after("rename to ")).alias("rename_to"),
        F.max_by(file_mode, F.when(file_mode.isNotNull(), F.col("pos"))).alias("mode"),
        F.max(line.startswith("old mode ") | line.startswith("new mode ")).alias("has_mode"),
        F.max(line.startswith("@@")).alias("has_hunk"),
    )
    status = (
        F.when(F.col("rename_to").isNotNull(), "renamed")
        .when(F.col("mode").isNotNull(), F.col("mode"))
        .when(F.col("has_mode") & ~F.col("has_hunk"), "mode_only")
        .otherwise("modified")
    )
    path = (
        F.when(F.col("status") == "renamed", F.col("rename_to"))
        .when(F.col("status") == "deleted", F.coalesce("content_old", "head_old"))
        .otherwise(F.coalesce("content_new", "head_new"))
    )
    previous = F.when(F.col("status") == "renamed", F.coalesce("rename_from", "head_old"))
    return told.withColumn("status", status).select(key, "ordinal", path.alias("file_path"), previous.alias("previous_file_path"), "status")
