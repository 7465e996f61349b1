"""Durable queues as pure steps: each function gives the next snapshot of the jobs or the outbox.

A single writer applies them (see ``lodestrata.streaming``); the clock is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.storage import before_parts, kept, ranged

OPEN = ("queued", "failed")
CANCELLABLE = ("queued", "leased", "failed")
FINAL = ("succeeded", "dead_lettered", "cancelled")


def enqueue(jobs: DataFrame, new: DataFrame, key: tuple[str, ...] = ("queue", "kind", "idempotency_key")) -> DataFrame:
    """New jobs whose key is not there yet; a job that is there stays as it is. Of new twins the smallest id counts."""
    first = Window.partitionBy(*key).orderBy("job_id")
    once = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return jobs.unionByName(once.join(jobs.select(*key), list(key), "left_anti").select(*jobs.columns))


def ready(now: Column, states: tuple[str, ...] = OPEN) -> Column:
    """Due jobs of these states, and leased ones whose lease has run out."""
    due = F.col("state").isin(*states) & (F.col("run_after") <= now)
    return due | ((F.col("state") == "leased") & (F.col("lease_expires_at") <= now))


def heads(jobs: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """The next job of each queue: highest priority, then earliest due, then oldest, then smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("priority"), "run_after", "created_at", "job_id")
    return jobs.where(ready(now)).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def lease(jobs: DataFrame, now: Column, worker: str, seconds: int = 300, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(next jobs, attempts to append): the head of each queue is leased and its attempt counted."""
    taken = heads(jobs, now, keys or ["queue"]).select("job_id", F.lit(True).alias("__taken"))
    until = now + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    mine = F.coalesce("__taken", F.lit(False))
    after = jobs.join(taken, "job_id", "left").withColumns(
        {
            "state": F.when(mine, "leased").otherwise(F.col("state")),
            "lease_owner": F.when(mine, worker).otherwise(F.col("lease_owner")),
            "lease_expires_at": F.when(mine, until).otherwise(F.col("lease_expires_at")),
            "attempts": F.col("attempts") + mine.cast("int"),
        }
    )
    attempts = after.where(mine).select("job_id", F.col("attempts").alias("attempt_no"), F.lit(worker).alias("worker_id"), F.lit("leased").alias("status"), F.lit(None).cast("string").alias("error"))
    return after.select(*jobs.columns), attempts


def finish(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Outcomes (job_id, attempt_no, ok, error) on leased jobs; an outcome of another attempt is too late and ignored.

    A failure waits out its back-off and fails, or is dead-lettered at the last attempt.
    """
    said = outcomes.select("job_id", F.col("attempt_no").alias("__no"), F.col("ok").alias("__ok"), F.col("error").alias("__error"))
    mine = F.coalesce((F.col("state") == "leased") & (F.col("attempts") == F.col("__no")), F.lit(False))
    lost = mine & ~F.col("__ok")
    dead = lost & (F.col("attempts") >= F.col("max_attempts"))
    wait = F.make_dt_interval(secs=F.col("backoff_seconds").cast("decimal(18,6)"))
    state = F.when(dead, "dead_lettered").when(lost, "failed").when(mine, "succeeded").otherwise(F.col("state"))
    after = jobs.join(said, "job_id", "left")
    return after.withColumns(
        {
            "state": state,
            "run_after": F.when(lost & ~dead, now + wait).otherwise(F.col("run_after")),
            "completed_at": F.when(mine & (dead | F.col("__ok")), now).otherwise(F.col("completed_at")),
            "lease_owner": F.when(mine, F.lit(None)).otherwise(F.col("lease_owner")),
            "lease_expires_at": F.when(mine, F.lit(None)).otherwise(F.col("lease_expires_at")),
            "last_error": F.when(lost, F.col("__error")).otherwise(F.col("last_error")),
        }
    ).select(*jobs.columns)


def cancel(jobs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Queued, leased and failed jobs among the ids asked for are cancelled."""
    hit = jobs.join(asked.select("job_id", F.lit(True).alias("__hit")).distinct(), "job_id", "left")
    mine = F.coalesce("__hit", F.lit(False)) & F.col("state").isin(*CANCELLABLE)
    return hit.withColumns({"completed_at": F.when(mine, now).otherwise(F.col("completed_at")), "state": F.when(mine, "cancelled").otherwise(F.col("state"))}).select(*jobs.columns)


def outbox_enqueue(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by outbox id: a known row is queued anew for its new generation, without attempts, lease or error."""
    fresh = new.withColumns({"state": F.lit("queued"), "attempts": F.lit(0), "lease_expires_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")})
    old = outbox.join(new.select("outbox_id").distinct(), "outbox_id", "left_anti")
    return old.unionByName(fresh.select(*outbox.columns))


def outbox_lease(outbox: DataFrame, now: Column, keys: list[str], broad: bool = False, seconds: int = 60) -> DataFrame:
    """The oldest due row of each key is leased. Only queued rows count, or failed and expired ones too (``broad``)."""
    can = ready(now) if broad else (F.col("state") == "queued") & (F.col("run_after") <= now)
    order = Window.partitionBy(*keys).orderBy("created_at", "outbox_id")
    head = outbox.where(can).withColumn("__n", F.row_number().over(order)).where("__n = 1").select("outbox_id", F.lit(True).alias("__taken"))
    mine = F.coalesce("__taken", F.lit(False))
    until = now + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return (
        outbox.join(head, "outbox_id", "left")
        .withColumns(
            {
                "state": F.when(mine, "leased").otherwise(F.col("state")),
                "lease_expires_at": F.when(mine, until).otherwise(F.col("lease_expires_at")),
                "attempts": F.col("attempts") + mine.cast("int"),
            }
        )
        .select(*outbox.columns)
    )


def outbox_outcome(ok: Column) -> Column:
    """The state after an attempt: succeeded, else dead at the last attempt, else failed."""
    return F.when(ok, "succeeded").when(F.col("attempts") >= F.col("max_attempts"), "dead_lettered").otherwise("failed")


def state_counts(rows: DataFrame, keys: list[str], states: tuple[str, ...], column: str = "state") -> DataFrame:
    """A count of each state and their total for each key."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(column) == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def nested_attempts(attempts: DataFrame, key: str = "job_id", order: str = "attempt_no") -> DataFrame:
    """(key, attempts_made): the attempts of each job as a list, in order."""
    rest = [c for c in attempts.columns if c not in (key, order)]
    return attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("attempts_made"))


def dead_letters(jobs: DataFrame, generations: DataFrame, attempts: DataFrame, limit: int = 50) -> DataFrame:
    """Dead jobs with their generation and attempts in order: newest completion first, those without last."""
    listed = nested_attempts(attempts.select("job_id", "attempt_no", "worker_id", "status", "error"))
    dead = jobs.where("state = 'dead_lettered'").join(generations, "generation_id").join(listed, "job_id", "left")
    return dead.orderBy(F.desc_nulls_last("completed_at"), F.desc("updated_at"), "job_id").limit(limit)


def sync_generation(outbox: DataFrame, generation_id: str, now: Column, refused: Column, error: Column, broad: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next outbox, rows applied to the index): the due rows of a generation in order, up to the first that the index refuses.

    Rows before it succeed. The refused one has failed, or is dead at its last attempt, with its error; those
    after it stay as they are. Each row that was tried counts an attempt and holds no lease afterwards.
    """
    due = (ready(now) if broad else (F.col("state") == "queued") & (F.col("run_after") <= now)) & (F.col("generation_id") == generation_id)
    place, bad = F.struct("created_at", "outbox_id"), F.coalesce(refused, F.lit(False))
    first = outbox.where(due & bad).agg(F.min(place).alias("__first")).withColumn("__k", F.lit(1))  # one row
    both = outbox.withColumn("__k", F.lit(1)).join(F.broadcast(first), "__k")
    tried = due & (F.col("__first").isNull() | (place <= F.col("__first")))
    lost = tried & bad
    dead = F.col("attempts") + 1 >= F.col("max_attempts")
    after = both.withColumns(
        {
            "state": F.when(lost & dead, "dead_lettered").when(lost, "failed").when(tried, "succeeded").otherwise(F.col("state")),
            "attempts": F.col("attempts") + F.coalesce(tried, F.lit(False)).cast("int"),
            "lease_expires_at": F.when(tried, F.lit(None)).otherwise(F.col("lease_expires_at")),
            "last_error": F.when(lost, error).when(tried, F.lit(None)).otherwise(F.col("last_error")),
        }
    )
    return after.select(*outbox.columns), both.where(tried & ~bad).select(*outbox.columns)


def run_once(jobs: DataFrame, now: Column, worker: str, synced: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(next jobs, attempts): one poll of a worker. The head of each queue is leased and done by its kind.

    A noop succeeds. A search_sync_once has the outcome that ``synced`` (job_id, processed, error) tells: an
    error or nothing processed fails it, as does no outcome at all. Any other kind fails as unsupported.
    """
    leased, attempts = lease(jobs, now, worker, keys=keys)
    mine = attempts.select("job_id", "attempt_no").join(jobs.select("job_id", "kind"), "job_id").join(synced.select("job_id", "processed", "error"), "job_id", "left")
    sync = F.col("kind") == "search_sync_once"
    error = (
        F.when(F.col("kind") == "noop", F.lit(None))
        .when(~sync, "unsupported job kind")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce("processed", F.lit(False)), "no search sync outbox was processed")
    )
    outcomes = mine.select("job_id", "attempt_no", error.isNull().alias("ok"), error.alias("error"))
    told = attempts.drop("status", "error").join(outcomes.select("job_id", "ok", "error"), "job_id")
    return finish(leased, outcomes, now), told.select("job_id", "attempt_no", "worker_id", F.when(F.col("ok"), "succeeded").otherwise("failed").alias("status"), "error")


def _latest_mark(rows: DataFrame, mark: Column, name: str) -> DataFrame:
    """``rows`` (part, pos, ..) with ``name``: the pos of the last marked row up to each one, over all parts."""
    carried = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    tops = rows.groupBy("part").agg(F.max(F.when(mark, F.col("pos"))).alias("__top")).select("part", F.max("__top").over(carried).alias("__before"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(tops, "part").withColumn(name, F.coalesce(F.max(F.when(mark, F.col("pos"))).over(inside), "__before")).drop("__before")


def _next_windows(rows: DataFrame, width: int) -> DataFrame:
    """(pos, to) of ``rows`` (__k, t, pos, session): the first request that is ``width`` later or more, in the same session.

    Requests and the ends of their windows are sorted into one table. As many requests as come before an end, at
    that place stands the request after it.
    """
    both = rows.select("__k", "t", F.lit(1).alias("kind"), "pos", "session").unionByName(rows.select("__k", (F.col("t") + width).alias("t"), F.lit(0).alias("kind"), "pos", "session"))
    merged = ranged(both, ["__k", "t", "kind", "pos"], "ends")
    earlier = before_parts(merged.groupBy("part").agg(F.sum("kind").alias("__sum")), [], ["__sum"])
    inside = Window.partitionBy("part").orderBy("spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = merged.join(earlier, "part").withColumn("to", F.sum("kind").over(inside) + F.col("__sum")).where("kind = 0")
    there = rows.select(F.col("pos").alias("to"), F.col("session").alias("__there"))
    return ends.join(there, "to").where("session = __there").select("pos", "to")


def rate_limited(requests: DataFrame, key: str, at: str, budget: int = 600, seconds: int = 60, order: str = "ordinal") -> DataFrame:
    """``requests`` (key, order) with allowed: at most ``budget`` in a window that starts with the first request after the last one's end.

    All requests are sorted by ranges and numbered, so that a key of any size is spread over tasks. A request that
    comes a window or more after the one before it surely opens a window; these cut a key into sessions. Every other
    request knows the one that opens the next window if it opens one itself. Following these pointers from the
    sessions' heads marks all openers: each round doubles the reach of the pointers, so a session of n windows
    takes log n rounds, all sessions together. A request is allowed by its distance from the last opener.

    A null key is a key. Requests of equal time go by ``order``; ``at`` is not null.
    """
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = ranged(requests.select(F.col(key).alias("__k"), F.col(order).cast("long").alias("__o"), micros.alias("t")), ["__k", "t", "__o"], "requests")
    over_parts = Window.orderBy("part")  # a row for each part
    parts = rows.groupBy("part").agg(F.min("spot").alias("__first"), F.count(F.lit(1)).alias("__n"), F.max_by(F.struct("__k", "t"), "spot").alias("__last"))
    parts = parts.select("part", "__first", (F.sum("__n").over(over_parts) - F.col("__n")).alias("__before"), F.lag("__last").over(over_parts).alias("__prior"))
    inside = Window.partitionBy("part").orderBy("spot")
    prior = F.when(F.col("spot") == F.col("__first"), F.col("__prior")).otherwise(F.lag(F.struct("__k", "t")).over(inside))
    numbered = rows.join(parts, "part").select("__k", "__o", "t", "part", (F.col("__before") + F.col("spot") - F.col("__first")).alias("pos"), prior.alias("prior"))
    heads = F.col("prior").isNull() | ~F.col("prior.__k").eqNullSafe(F.col("__k")) | (F.col("t") - F.col("prior.t") >= width)
    placed = kept(_latest_mark(numbered.withColumn("head", heads).drop("prior"), F.col("head"), "session"))
    jumps = kept(_next_windows(placed, width), "jumps")
    openers = placed.where("head").select("pos")
    while not jumps.isEmpty():
        reached = jumps.join(openers, "pos", "left_semi").select(F.col("to").alias("pos"))
        openers = kept(openers.unionByName(reached).distinct(), "openers")
        jumps = kept(jumps.join(jumps.select(F.col("pos").alias("to"), F.col("to").alias("__far")), "to").select("pos", F.col("__far").alias("to")), "jumps")
    marked = placed.join(openers.withColumn("__opens", F.lit(True)), "pos", "left")
    counted = _latest_mark(marked, F.col("__opens"), "__since")
    return counted.select(F.col("__k").alias(key), F.col("__o").alias(order), (F.col("pos") - F.col("__since") < budget).alias("allowed"))
