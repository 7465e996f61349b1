"""Folders that driver and executors share, and counts along ranges of a sorted table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return (folder or tempfile.gettempdir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes with the application."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start from the copy."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranged(df: DataFrame, order: list, name: str = "ranged") -> DataFrame:
    """``df`` sorted over all of its ranges and kept, with part (the range) and spot (the place in it, ascending).

    Rows of a part are in the order of their spots, and parts in the order of their numbers.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id())
    return kept(dealt.withColumn("part", F.shiftright("spot", 33).cast("int")), name)


def before_parts(totals: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows (keys, part, sums) of per-part totals as what came in earlier parts of the same keys; a row for each part and key it holds."""
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sums])


def carried(rows: DataFrame, key: str, spot: str, inclusive: bool = True, **marks: Column) -> DataFrame:
    """``rows`` (key, part, spot, ..) with the last value of each mark up to the row, of its own key; null before the first.

    A prefix scan: each part's last marks are carried over the parts after it, then each row takes the last
    one of its part or what was carried. A mark knows its key, so no key needs a part to itself. ``inclusive``
    says whether a row's own mark counts for it.
    """
    rows = rows.withColumns({n: F.when(m.isNotNull(), F.struct(F.col(key).alias("k"), m.alias("v"))) for n, m in marks.items()})
    tops = rows.groupBy("part").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(spot))).alias(n) for n in marks])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    tops = tops.select("part", *[F.last(n, ignorenulls=True).over(before).alias(f"__{n}") for n in marks])
    upto = Window.partitionBy("part").orderBy(spot).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    last = {n: F.coalesce(F.last(n, ignorenulls=True).over(upto), F.col(f"__{n}")) for n in marks}
    found = rows.join(tops, "part").withColumns(last).drop(*[f"__{n}" for n in marks])
    return found.withColumns({n: F.when(F.col(f"{n}.k").eqNullSafe(F.col(key)), F.col(f"{n}.v")) for n in marks})
