"""Line ranges: innermost matches and overlaps, as equi joins with a residual range test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.pairs import crossed


def _saturating(a: str, b: str):
    return F.greatest(F.col(a) - F.col(b), F.lit(0))


def innermost(lines: DataFrame, ranges: DataFrame, line_keys: list[str], keep: list[str]) -> DataFrame:
    """Each line's innermost range of its file.

    ``lines`` has file_path, line and ``line_keys`` (its identity); ``ranges`` has file_path, start_line,
    end_line, start_col, end_col, ordinal and ``keep``. The smallest line span wins, then the smallest
    column span, then the first in order. Lines outside all ranges drop.

    Ranges are put in bins as wide as a power of two near their own length, so a line meets only the
    ranges near it, not all of its file. A line that many rows name is looked up once.
    """
    width = F.pow(F.lit(2), F.ceil(F.log2((F.col("end_line") - F.col("start_line") + 1).cast("double")))).cast("long")
    sized = ranges.where("end_line >= start_line").withColumn("w", width)
    binned = sized.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / F.col("w")), F.floor(F.col("end_line") / F.col("w")))))
    used = sized.select("file_path", "w").distinct()  # a few widths for each file
    points = lines.select("file_path", "line").distinct().join(used, "file_path").withColumn("bin", F.floor(F.col("line") / F.col("w")))
    hits = points.join(binned, ["file_path", "w", "bin"]).where("line BETWEEN start_line AND end_line")
    order = F.struct((F.col("end_line") - F.col("start_line")).alias("a"), _saturating("end_col", "start_col").alias("b"), F.col("ordinal").alias("c"))
    best = hits.groupBy("file_path", "line").agg(F.min_by(F.struct(*keep), order).alias("best"))
    return lines.select("file_path", "line", *line_keys).join(best, ["file_path", "line"]).select("file_path", "line", *line_keys, "best.*")


def changed_symbols(changed_lines: DataFrame, symbols: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each changed line inside a symbol; lines are not merged by symbol."""
    return innermost(changed_lines, symbols, ["ordinal_in_diff"], keep)


def _inside(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Pairs of points and ranges of one file, the point inside the range: by bins of each range's own size class."""
    sized = ranges.where(F.col(end) >= F.col(start)).withColumn("__w", F.pow(F.lit(2), F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double")))).cast("long"))
    binned = sized.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("__w")), F.floor(F.col(end) / F.col("__w")))))
    used = sized.select("file_path", "__w").distinct()  # a few widths for each file
    spread = points.join(used, "file_path").withColumn("__bin", F.floor(F.col(at) / F.col("__w")))
    return crossed(spread, binned, ["file_path", "__w", "__bin"], ([at], [start, end]), F.col(at).between(F.col(start), F.col(end))).drop("__w", "__bin")


def overlaps(segments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Segments that share a line with a symbol of their file.

    ``segments`` has file_path, segment_start, segment_end; ``symbols`` has file_path, start_line, end_line.
    Two ranges share a line if one of them begins inside the other, so both sides are looked up as points.
    A file's pairs may be many times its ranges; they are made by all tasks (``pairs.crossed``).
    """
    whole = segments.where("segment_end >= segment_start")
    later = _inside(whole, symbols, "segment_start", "start_line", "end_line")
    earlier = _inside(symbols.where("end_line >= start_line"), whole, "start_line", "segment_start", "segment_end").where("segment_start < start_line")
    columns = [*symbols.columns, *[c for c in segments.columns if c != "file_path"]]
    return later.select(*columns).unionByName(earlier.select(*columns))
