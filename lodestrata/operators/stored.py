"""Snapshots kept as tables: a change reads and rewrites the folders it touches, and no other.

``snapshot`` says what the next state of a table is; here it is stored. Rows lie in folders by a hash of some key
columns (the scope that changes usually stay in, such as the repository), and inside a folder in buckets by the
whole key. A change looks up the folders of its keys, joins them with the stored rows bucket by bucket, so that only
the change is shuffled, and writes them anew (dynamic partition overwrite). Files of other folders stay as they are.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.storage import kept

MODE = "spark.sql.sources.partitionOverwriteMode"


class KeyedTable:
    """A stored table of one row for each key. One writer at a time; a change that failed is made again.

    ``place`` names the key columns that choose the folder, all of them by default. Keys are not null.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], place: list[str] | None = None, folders: int = 32, buckets: int = 8):
        self.spark, self.keys, self.place, self.folders, self.buckets = spark, keys, place or keys, folders, buckets
        self.none = spark.createDataFrame([], schema)
        self.columns = self.none.columns
        self.name = f"keyed_{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        key = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {self.name} ({schema}, __folder int) USING parquet PARTITIONED BY (__folder) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")  # of a table that is there already

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns, F.pmod(F.xxhash64(*self.place), F.lit(self.folders)).cast("int").alias("__folder"))

    def _touched(self, rows: DataFrame) -> list[int]:
        """The folders of these rows: at most ``folders`` numbers."""
        return sorted(r[0] for r in rows.select("__folder").distinct().collect())

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def held(self, folders: list[int]) -> DataFrame:
        """The stored rows of some folders, with __folder, still in their buckets."""
        return self.spark.table(self.name).where(F.col("__folder").isin(folders) if folders else F.lit(False))

    @contextmanager
    def _only_written_folders(self):
        before = self.spark.conf.get(MODE)
        self.spark.conf.set(MODE, "dynamic")
        try:
            yield
        finally:
            self.spark.conf.set(MODE, before)

    def _write(self, rows: DataFrame) -> None:
        with self._only_written_folders():
            rows.select(*self.columns, "__folder").write.mode("overwrite").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _clear(self, folder: int) -> None:
        """Leave a folder without rows; a dynamic overwrite passes over folders that it has no rows for."""
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (__folder = {folder}) SELECT * FROM {{none}}", none=self.none)

    def load(self, rows: DataFrame) -> None:
        """Store ``rows``, one for each key, in a table that is empty."""
        self._write(self._placed(rows).repartition(self.buckets, *self.keys))

    def upsert(self, changes: DataFrame, order: str) -> list[int]:
        """Store what ``snapshot.upsert`` says; gives the folders written. Of changes to one key the greatest ``order`` counts.

        A changed key is not stale any more, even where its stored row has the greater order and stays; at an equal
        order the change counts.
        """
        rest = [c for c in self.columns if c not in self.keys]
        once = self._placed(changes).groupBy(*self.keys, "__folder").agg(F.max_by(F.struct(*rest), F.col(order)).alias("__new"))
        touched = self._touched(self._placed(changes))
        if not touched:
            return []
        old = self.held(touched).select(*self.keys, F.col("__folder").alias("__at"), F.struct(*rest).alias("__old"))
        both = old.join(once, self.keys, "full")
        newer = F.col("__old").isNull() | (F.col("__new").isNotNull() & F.coalesce(F.col(f"__new.{order}") >= F.col(f"__old.{order}"), F.col(f"__old.{order}").isNull()))
        value = lambda c: F.when(newer, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
        live = lambda c: F.when(F.col("__new").isNull(), value(c)) if c == "stale_at" else value(c)
        self._write(both.select(*self.keys, *[live(c).alias(c) for c in rest], F.coalesce("__at", "__folder").alias("__folder")))
        return touched

    def stale_out(self, generation_id: Column, now: Column, **scope: Column) -> list[int]:
        """Store what ``snapshot.stale_out`` says. Folders where no row becomes stale are not written."""
        from lodestrata.operators import snapshot

        ages = (F.col("generation_id") != generation_id) & F.col("stale_at").isNull()
        for name, value in scope.items():
            ages = ages & (F.col(name) == value)
        touched = self._touched(self.spark.table(self.name).where(ages))
        if touched:
            self._write(snapshot.stale_out(self.held(touched), generation_id, now, **scope))
        return touched

    def replace_scope(self, changes: DataFrame, scope: list[str]) -> list[int]:
        """Store what ``snapshot.replace_scope`` says. A scope that holds ``place`` lies in the changes' folders, any other may lie anywhere."""
        fresh = self._placed(changes)
        gone = self.spark.table(self.name).join(changes.select(*scope).distinct(), scope, "left_semi")
        if set(self.place) <= set(scope):
            touched = self._touched(fresh)
        else:
            touched = sorted({*self._touched(gone), *self._touched(fresh)})
        if not touched:
            return []
        left = self.held(touched).join(changes.select(*scope).distinct(), scope, "left_anti").select(*self.columns, "__folder")
        after = kept(left.unionByName(fresh), "replace")  # whether a folder loses all its rows is asked before it is written
        full = self._touched(after)
        self._write(after)
        for folder in sorted({*touched} - {*full}):
            self._clear(folder)
        return touched

    def replace_manifest(self, changes: DataFrame, now: Column) -> list[int]:
        """Store what ``snapshot.replace_manifest`` says: old rows of the repositories and commits of ``changes`` go stale, and the new ones join them."""
        scope = changes.select("repo_id", "commit_sha").distinct().withColumn("__hit", F.lit(True))
        fresh = self._placed(changes)
        aged = self.spark.table(self.name).where("stale_at IS NULL").join(scope, ["repo_id", "commit_sha"], "left_semi")
        touched = sorted({*self._touched(aged), *self._touched(fresh)})
        if not touched:
            return []
        marked = self.held(touched).join(scope, ["repo_id", "commit_sha"], "left")
        stale = F.when(F.col("__hit") & F.col("stale_at").isNull(), now).otherwise(F.col("stale_at"))
        self._write(marked.withColumn("stale_at", stale).select(*self.columns, "__folder").unionByName(fresh))
        return touched
