"""The queue and the derived index as streams: one writer applies each micro-batch to a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import search


class StoredTable:
    """A table kept as numbered versions of a folder; a version is complete when the next step names it.

    A micro-batch writes the version of its own number, so that a batch that runs again writes the same
    folder and its result counts once.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def at(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{version}")

    def newest(self) -> int:
        """The number of the newest version whose write has ended; -1 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(path(f"{self.root}/{n}/_SUCCESS"))), default=-1)

    def last(self) -> DataFrame:
        """The newest version; an empty table before the first."""
        return self.at(self.newest())

    def put(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/v{version}")


def apply_batches(stream: DataFrame, table: StoredTable, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``step(table so far, batch)`` for each micro-batch of ``stream``; ``once`` ends when all input is used."""

    def one(batch: DataFrame, number: int) -> None:
        table.put(number, step(table.at(number - 1), batch))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


class SearchIndex:
    """Derived search indexes as one stored table, partitioned by index name; each step writes the next version.

    An instance over a folder that holds versions goes on from the newest; one writer at a time.
    """

    COLUMNS = "target_index string, entity_id string, payload string"

    def __init__(self, spark: SparkSession, root: str):
        self.table = StoredTable(spark, root, self.COLUMNS)
        self.version = self.table.newest()

    def rows(self) -> DataFrame:
        return self.table.at(self.version)

    def _next(self, rows: DataFrame) -> None:
        rows.select("target_index", "entity_id", "payload").write.mode("overwrite").partitionBy("target_index").parquet(f"{self.table.root}/v{self.version + 1}")
        self.version += 1

    def drop(self, name: str) -> None:
        """The index and its documents go; one that is not there is no error."""
        if self.version >= 0:
            self._next(self.rows().where(F.col("target_index") != name))

    def apply(self, changes: DataFrame) -> None:
        """Upserts and deletes (target_index, entity_id, operation, payload, created_at, outbox_id); the last one of a document counts."""
        key = ["target_index", "entity_id"]
        last = changes.groupBy(*key).agg(F.max_by(F.struct("operation", "payload"), F.struct("created_at", "outbox_id")).alias("x"))
        kept = self.rows().join(last.select(*key), key, "left_anti")
        self._next(kept.unionByName(last.where("x.operation = 'upsert'").select(*key, F.col("x.payload").alias("payload"))))

    def refresh(self) -> DataFrame:
        """The documents as of the last step; earlier readers keep the version that they read."""
        return self.rows()

    def count(self, name: str) -> int:
        """Documents of an index, which is there once it holds one; zero for any other."""
        return self.rows().where(F.col("target_index") == name).count()


def sync_stream(stream: DataFrame, index: StoredTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the search index in step with outbox rows (entity_id, operation, payload, created_at, outbox_id)."""
    return apply_batches(stream, index, lambda old, batch: search.sync_index(old, batch), checkpoint, once)
