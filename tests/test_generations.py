"""The stream of generations against a plain walk over its events, in one run, in many, and after a replay."""

import datetime as dt
import random

from lodestrata.streaming import generations

SCHEMA = "generation_id string, seq long, event string, at timestamp, error string"
T0 = dt.datetime(2024, 1, 1)


def plain(events, patience=None, upto=None):
    """(status, error) of each generation; ``upto`` is the time that the watermark reaches."""
    out, since = {}, {}
    for g, _, event, at, error in sorted(events, key=lambda e: (e[3], e[1])):
        out.setdefault(g, (None, None))
        if out[g][0] == "started" and patience and at >= since[g] + patience:
            out[g] = ("failed", generations.TIMED_OUT)
        if event == "begin" and out[g][0] is None:
            out[g], since[g] = ("started", None), at
        elif event != "begin" and out[g][0] == "started":
            out[g] = ("succeeded", None) if event == "succeed" else ("failed", error)
    if patience and upto:
        out = {g: ("failed", generations.TIMED_OUT) if s == "started" and since[g] + patience <= upto else (s, e) for g, (s, e) in out.items()}
    return out


def made(seed, n=160):
    rng = random.Random(seed)
    return [(f"g{rng.randrange(40)}", i, rng.choice(["begin", "begin", "succeed", "fail"]), T0 + dt.timedelta(seconds=30 * i), f"e{i}") for i in range(n)]


def run(spark, tmp_path, batches, **options):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for some in batches:  # each a run of its own, from the state that the last one left
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        generations.follow(spark.readStream.schema(SCHEMA).parquet(source), folder, **options).awaitTermination()
    rows = spark.read.schema(generations.MOVES).parquet(f"{folder}/moves")
    return {r.generation_id: (r.status, r.error) for r in generations.standing(rows).collect()}, rows


def test_restarts_give_the_rows_of_one_run(spark, tmp_path):
    events = made(1)
    once, rows = run(spark, tmp_path / "one", [events])
    many, _ = run(spark, tmp_path / "many", [events[:50], events[50:120], events[120:]])
    assert once == many == plain(events)
    assert rows.count() == len(events) and rows.where("moved").groupBy("generation_id").count().where("count > 2").count() == 0
    # Nothing new: a further run adds nothing.
    again = generations.follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "one" / "in")), str(tmp_path / "one" / "out"))
    again.awaitTermination()
    assert spark.read.schema(generations.MOVES).parquet(str(tmp_path / "one" / "out" / "moves")).count() == len(events)


def test_timers_end_what_never_ends(spark, tmp_path):
    events = made(2)
    patience = dt.timedelta(seconds=600)
    got, rows = run(spark, tmp_path, [events[:80], events[80:]], patience_seconds=600)
    assert got == plain(events, patience, upto=events[-1][3])
    assert rows.where("event = 'expired'").count() > 0
