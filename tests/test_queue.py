import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import queue

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, queue string, kind string, idempotency_key string, state string, priority int, run_after timestamp, created_at timestamp, attempts int, max_attempts int, backoff_seconds int, lease_owner string, lease_expires_at timestamp, completed_at timestamp, last_error string"


def job(i, state="queued", priority=0, after=0, created=0, attempts=0, most=2, owner=None, until=None):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    return (i, "q", "noop", f"k{i}", state, priority, at(after), at(created), attempts, most, 30, owner, None if until is None else at(until), None, None)


def now(s):
    return F.lit(T0 + dt.timedelta(seconds=s))


def test_lease_order_and_expiry(spark):
    jobs = spark.createDataFrame([job("a"), job("b", priority=5, after=99), job("c", priority=1, created=5), job("d", priority=1, created=4), job("e", "leased", 9, owner="w", until=50)], SCHEMA)
    head = lambda s: [r.job_id for r in queue.heads(jobs, now(s), ["queue"]).collect()]
    assert head(10) == ["d"] and head(60) == ["e"]
    after, attempts = queue.lease(jobs, now(10), "w1", 300)
    r = {x.job_id: x for x in after.collect()}
    assert (r["d"].state, r["d"].attempts, r["d"].lease_owner) == ("leased", 1, "w1") and r["c"].state == "queued"
    assert [(a.job_id, a.attempt_no) for a in attempts.collect()] == [("d", 1)]


def test_failures_back_off_then_die(spark):
    jobs = spark.createDataFrame([job("a")], SCHEMA)
    outcome = lambda n, ok: spark.createDataFrame([("a", n, ok, "e")], "job_id string, attempt_no int, ok boolean, error string")
    leased, _ = queue.lease(jobs, now(0), "w")
    failed = queue.finish(leased, outcome(1, False), now(1))
    r = failed.first()
    assert (r.state, r.run_after) == ("failed", T0 + dt.timedelta(seconds=31)) and r.lease_owner is None
    assert queue.heads(failed, now(5), ["queue"]).count() == 0
    again, _ = queue.lease(failed, now(40), "w")
    assert queue.finish(again, outcome(1, True), now(41)).first().state == "leased"  # a late outcome of the first attempt
    dead = queue.finish(again, outcome(2, False), now(41))
    assert dead.first().state == "dead_lettered"
    assert queue.heads(dead, now(9999), ["queue"]).count() == 0


def test_cancel_and_enqueue(spark):
    jobs = spark.createDataFrame([job("a"), job("b", "succeeded")], SCHEMA)
    ids = spark.createDataFrame([("a",), ("b",)], "job_id string")
    done = {r.job_id: r.state for r in queue.cancel(jobs, ids, now(0)).collect()}
    assert done == {"a": "cancelled", "b": "succeeded"}
    twin = spark.createDataFrame([job("x")[:3] + ("ka",) + job("x")[4:], job("n2")[:3] + ("kn",) + job("n2")[4:], job("n1")[:3] + ("kn",) + job("n1")[4:]], SCHEMA)
    assert sorted(r.job_id for r in queue.enqueue(jobs, twin).collect()) == ["a", "b", "n1"]


def test_outbox_moves_to_the_new_generation(spark):
    schema = "outbox_id string, generation_id string, state string, attempts int, lease_expires_at timestamp, last_error string"
    old = spark.createDataFrame([("o", "g1", "dead_lettered", 3, T0, "e"), ("p", "g1", "queued", 0, None, None)], schema)
    new = spark.createDataFrame([("o", "g2", "x", 9, None, None)], schema)
    r = {x.outbox_id: x for x in queue.outbox_enqueue(old, new).collect()}
    assert (r["o"].generation_id, r["o"].state, r["o"].attempts, r["o"].last_error) == ("g2", "queued", 0, None) and r["p"].generation_id == "g1"


def test_rate_limit_windows_hang_on_requests(spark):
    times = [0, 10, 59, 60, 61, 125, 126]
    df = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(times)], "k string, at timestamp, ordinal long")
    got = [r.allowed for r in queue.rate_limited(df, "k", "at", budget=2, seconds=60).orderBy("ordinal").collect()]
    assert got == [True, True, False, True, True, True, True]


def test_dead_letters_without_completion_come_last(spark):
    jobs = spark.createDataFrame([("a", "dead_lettered", None, 1, "g"), ("b", "dead_lettered", 5, 1, "g"), ("c", "queued", 9, 1, "g")], "job_id string, state string, completed_at int, updated_at int, generation_id string")
    gens = spark.createDataFrame([("g", "r")], "generation_id string, repo_id string")
    tries = spark.createDataFrame([("b", 2, "w", "failed", "e"), ("b", 1, "w", "failed", "e")], "job_id string, attempt_no int, worker_id string, status string, error string")
    got = queue.dead_letters(jobs, gens, tries).collect()
    assert [r.job_id for r in got] == ["b", "a"] and [x.attempt_no for x in got[0].attempts_made] == [1, 2]


def test_a_poll_dispatches_by_kind(spark):
    rows = [job(i)[:1] + (f"q{i}", kind) + job(i)[3:] for i, kind in (("a", "noop"), ("b", "search_sync_once"), ("c", "search_sync_once"), ("d", "paint"), ("e", "search_sync_once"))]
    jobs = spark.createDataFrame(rows, SCHEMA)
    synced = spark.createDataFrame([("b", True, None), ("c", False, None), ("e", True, "refused")], "job_id string, processed boolean, error string")
    after, attempts = queue.run_once(jobs, now(1), "w", synced)
    got = {r.job_id: (r.state, r.last_error) for r in after.collect()}
    assert got == {"a": ("succeeded", None), "b": ("succeeded", None), "c": ("failed", "no search sync outbox was processed"), "d": ("failed", "unsupported job kind"), "e": ("failed", "refused")}
    assert {(r.job_id, r.status) for r in attempts.collect()} == {("a", "succeeded"), ("b", "succeeded"), ("c", "failed"), ("d", "failed"), ("e", "failed")}


def limited_plain(rows, budget, seconds):
    """The requests one by one: a window starts with the first request after the last one's end."""
    out, since, n, me = {}, None, 0, object()
    for k, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if k != me or (t - since).total_seconds() >= seconds:
            me, since, n = k, t, 0
        n += 1
        out[i] = n <= budget
    return out


def test_a_hot_key_is_spread_and_gives_the_rows_of_a_walk(spark):
    """One key of thousands of windows without a pause, some others, equal times and a null key."""
    import random

    rng = random.Random(5)
    rows = [("hot", T0 + dt.timedelta(seconds=rng.randrange(40_000)), i) for i in range(3000)]
    rows += [(rng.choice(["a", "b", None, ""]), T0 + dt.timedelta(seconds=rng.randrange(0, 9000, 20)), 5000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t timestamp, ordinal long").repartition(5)
    got = queue.rate_limited(df, "k", "t", 3, 60)
    assert {r.ordinal: r.allowed for r in got.collect()} == limited_plain(rows, 3, 60)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == ["k", "ordinal", "allowed"]


def test_windows_of_requests(spark):
    rows = [("a", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 59, 60, 61, 62, 119, 120, 121, 300, 301])] + [("b", T0, 90), (None, T0, 91)]
    df = spark.createDataFrame(rows, "k string, t timestamp, ordinal long")
    got = {r.ordinal: r.allowed for r in queue.rate_limited(df, "k", "t", 2, 60).collect()}
    assert queue.rate_limited(df.limit(0), "k", "t").count() == 0
    assert got == limited_plain(rows, 2, 60) == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: True, 9: True, 10: True, 11: True, 90: True, 91: True}


def test_a_search_index_is_counted_dropped_and_opened_again(spark, tmp_path):
    from lodestrata.streaming.worker import SearchIndex

    index = SearchIndex(spark, str(tmp_path / "index"))
    assert index.count("one") == 0 and index.count("absent") == 0
    change = lambda *rows: spark.createDataFrame(rows, "target_index string, entity_id string, operation string, payload string, created_at int, outbox_id int")
    index.apply(change(("one", "a", "upsert", "x", 1, 1), ("one", "a", "upsert", "y", 2, 2), ("two", "b", "upsert", "z", 1, 3)))
    index.apply(change(("one", "c", "upsert", "w", 3, 4), ("two", "b", "delete", None, 3, 5)))
    assert {(r.target_index, r.entity_id, r.payload) for r in index.refresh().collect()} == {("one", "a", "y"), ("one", "c", "w")}
    assert index.count("one") == 2 and index.count("two") == 0
    again = SearchIndex(spark, str(tmp_path / "index"))
    assert again.count("one") == 2
    again.apply(change(("it's", "d", "upsert", "q", 4, 6)))
    assert again.count("it's") == 1 and again.count("one") == 2 and SearchIndex(spark, str(tmp_path / "index")).count("one") == 2
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.drop("one")
    index.drop("absent")
    assert index.count("one") == 0
