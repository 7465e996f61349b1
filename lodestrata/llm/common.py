"""Shared helpers: table access, checkpoint folder, shipping code to workers, size checks."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that workers need not have it on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

#: Words of the text contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; only a local session without one (tests) gets a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestrata-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_share(value: Column) -> Column:
    """A number from 0 up to, not with, 1 by a hash of the value, fine enough for a sample of any table."""
    return F.pmod(F.xxhash64(value, F.lit("share")), F.lit(1 << 52)) / float(1 << 52)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table in the same folder: for wide rows, and to read single columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    saved = context._jvm.org.apache.hadoop.fs.Path(path)
    saved.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(saved)  # it goes with the application
    return spark.read.parquet(path)


#: Rows of a few numbers that may be broadcast, some ten megabytes.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast where its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@contextmanager
def parser_caches_dropped(spark: SparkSession):
    """Within it, Spark's SQL parser drops what it has learnt from long expressions, some 50 MB that the driver would keep for good."""
    now = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "500"}
    old = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
