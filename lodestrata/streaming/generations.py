"""Generations as a stream of events: keyed state that survives restarts, and timers for those that never end.

A generation begins, and then succeeds or fails, once. ``transformWithState`` keeps one small row of state for each
generation; every event gives a row that tells whether it moved the generation, and where it stands now. A sink that
is written exactly once then holds the same rows after any number of restarts as one run without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "generation_id string, seq long, event string, moved boolean, status string, at_ms long, error string"
#: The error of a generation that did not end in time, and the event that tells it.
TIMED_OUT, EXPIRED = "timed out", "expired"


class Lifecycle(StatefulProcessor):
    """Started by the first ``begin``; ended by the first ``succeed`` or ``fail`` after it, or by time. Nothing else moves it."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("generation", "status string, deadline long")

    def _row(self, key: Any, seq: int | None, event: str, moved: bool, status: str | None, at: int, error: str | None = None) -> Row:
        return Row(generation_id=key[0], seq=seq, event=event, moved=moved, status=status, at_ms=at, error=error)

    def _expire(self, key: Any, deadline: int) -> Row:
        self.state.update(("failed", None))
        return self._row(key, None, EXPIRED, True, "failed", deadline, TIMED_OUT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["seq"])):
            status, deadline = self.state.get() if self.state.exists() else (None, None)
            if status == "started" and deadline is not None and r["at_ms"] >= deadline:
                self.handle.deleteTimer(deadline)
                yield self._expire(key, deadline)
                status, deadline = "failed", None
            moved = status is None if r["event"] == "begin" else status == "started"
            if moved and r["event"] == "begin":
                status, deadline = "started", r["at_ms"] + self.patience if self.patience is not None else None
                if deadline is not None:
                    self.handle.registerTimer(deadline)
            elif moved:
                if deadline is not None:
                    self.handle.deleteTimer(deadline)
                status, deadline = "succeeded" if r["event"] == "succeed" else "failed", None
            if moved:
                self.state.update((status, deadline))
            yield self._row(key, r["seq"], r["event"], moved, status, r["at_ms"], r["error"] if moved and r["event"] == "fail" else None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, deadline = self.state.get() if self.state.exists() else (None, None)
        if status == "started" and deadline is not None:
            yield self._expire(key, deadline)


def moves(events: DataFrame, patience_seconds: int | None = None, late: str = "0 seconds") -> DataFrame:
    """``MOVES`` rows of a stream of events (generation_id, seq, event, at, error); event is begin, succeed or fail.

    Events of one generation come in order of (at, seq) from micro-batch to micro-batch; inside one they are sorted.
    With ``patience_seconds`` a generation that has not ended so long after it began fails, once an event of its own
    or the watermark, ``late`` behind the latest event, has passed that time.
    """
    events = events.withColumn("at", F.col("at").cast("timestamp"))
    rows = events.select(F.col("generation_id").cast("string"), F.col("seq").cast("long"), F.col("event").cast("string"), "at", F.unix_millis("at").alias("at_ms"), F.col("error").cast("string"))
    timed = patience_seconds is not None
    if timed:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("generation_id").transformWithState(
        statefulProcessor=Lifecycle(patience_seconds * 1000 if timed else None), outputStructType=MOVES, outputMode="Append", timeMode="EventTime" if timed else "None"
    )


def follow(events: DataFrame, folder: str, patience_seconds: int | None = None, late: str = "0 seconds") -> StreamingQuery:
    """Append the moves of a stream to ``folder``/moves until its input is used; goes on where an earlier run ended."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = moves(events, patience_seconds, late).writeStream.format("parquet").outputMode("append")
        return writer.option("path", f"{folder}/moves").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def standing(rows: DataFrame) -> DataFrame:
    """(generation_id, status, at_ms, error): where each generation of ``MOVES`` rows stands; null where none of its events moved it."""
    place = F.when(F.col("moved"), F.struct(F.when(F.col("status") == "started", 0).otherwise(1), "at_ms"))  # a generation moves twice at most
    last = F.max_by(F.struct("status", "at_ms", "error"), place).alias("x")
    return rows.groupBy("generation_id").agg(last).select("generation_id", "x.*")
