"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed for every cell of source, language and topic. A document of a cell is kept with the
cell's probability, by a hash of its id, so that the same documents are kept on every run. The
probabilities are raked: the cells of every source, then of every language, then of every topic are
scaled until their expected tokens meet the target, again and again, and no probability counts for more
than one. The sweeps end when every marginal is within ``TOLERANCE`` of its target.

A value can't give more than it holds. Targets beyond that are lowered to it, and the others raised in
proportion, so that each axis by itself can be met (``reachable``). Where the three axes can't be met
together, or not in ``SWEEPS`` sweeps, the budget is lowered by the steps of ``LOWER``; where no budget
helps, the first is taken as far as it came. What was wanted, what was aimed at and what the selected
documents hold is part of the output.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, cut, stored

BUDGET, TEMPERATURE, TOLERANCE, SWEEPS = 0.6, 0.5, 1e-9, 500
#: Sweeps in which the distance from the targets must halve; where it does not, they can't be met together.
PATIENCE = 25
#: Shares of the budget that are tried in turn.
LOWER = tuple(0.9**i for i in range(16))
#: Cells up to which the raking runs on the driver; beyond, it runs on the cells where they are.
CELLS = 200_000
#: Bounds of a cell's factor, and of a target that nothing is left for.
MOST, LEAST = 1e12, 1e-15
AXES = ("source", "lang", "topic")

# Kinds of text in the order of their tests, each with an expression that a text may match, and
# strings of which every match holds one.
TOPICS = (
    ("contact", r"[A-Za-z0-9_.+-]@[A-Za-z0-9]|[+][0-9]{1,3} ?[(]", ("@", "+")),
    ("secret", r"(?:token|secret|passwd|password|api_key|apikey) ?[=:] ?[\"']", ("token", "secret", "passw", "api")),
    ("licence", r"[Ll]icen[cs]e|Copyright|CC BY", ("icen", "Copyright", "CC BY")),
    ("tabular", r" [|] ", (" | ",)),
    ("shouted", r"!! ", ("!! ",)),
    ("marked", r"(?:###|%%%) ", ("### ", "%%% ")),
)
REST = "prose"


def topic_of(text: Column) -> Column:
    """The first kind whose expression the text matches; ``mix`` takes any other column instead."""
    out = None
    for name, mark, held in TOPICS:
        hit = reduce(or_, [text.contains(h) for h in held]) & text.rlike(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise(REST), F.lit(REST))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column) -> Column:
    """A number from 0 up to 1 for each id, the same in every run and in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def measured(docs: DataFrame, carry: bool = False, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens[, row]); a null source, language or topic is a value called unknown."""
    text = F.col("text").cast("string")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.select(
        *[F.struct(*docs.columns).alias("row")] * carry,
        F.col("doc_id").cast("long").alias("doc_id"),
        named(F.col("source")).alias("source"),
        named(F.col("lang")).alias("lang"),
        (topic_of(text) if topic is None else named(topic)).alias("topic"),
        tokens_of(text).alias("n_tokens"),
    )


def tempered(tokens: dict[str, float], temperature: float) -> dict[str, float]:
    """Shares of each value: its token share, raised to ``temperature`` and scaled to one."""
    raised = {v: float(t) ** temperature for v, t in tokens.items() if t > 0}
    whole = sum(raised[v] for v in sorted(raised))
    return {v: r / whole for v, r in raised.items()}


def reachable(wanted: dict[str, float], held: dict[str, float], budget: float) -> tuple[dict[str, float], set[str]]:
    """(targets, values that give all they hold) of one axis, as shares of all tokens that sum up to the budget."""
    asked = {v: w for v, w in wanted.items() if w > 0 and held.get(v, 0.0) > 0}
    order = sorted(asked, key=lambda v: (held[v] / asked[v], v))
    given, open_, scale = 0.0, sum(asked[v] for v in order), 0.0
    for v in order:  # values fill up in the order of what they hold for what is asked
        scale = max(budget - given, 0.0) / open_
        if scale * asked[v] <= held[v]:
            break
        given += held[v]
        open_ -= asked[v]
        scale = float("inf")
    full = {v for v in order if scale * asked[v] >= held[v]}
    return {v: held[v] if v in full else scale * asked[v] if v in asked else 0.0 for v in held}, full


def rake(held: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], fixed: np.ndarray, budget: float, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """(probability of each cell, the largest distance of a marginal from its target in the last sweep).

    ``held`` are shares of all tokens, as are the targets of each axis by code; ``fixed`` cells are kept whole.
    """
    factor = np.where(fixed, MOST, budget)
    gap = mark = np.inf
    for at in range(1, sweeps + 1):
        gap = 0.0
        for code, target in zip(codes, targets, strict=True):
            size = len(target)
            now = np.bincount(code, held * np.minimum(factor, 1.0), minlength=size)
            sure = np.bincount(code, held * fixed, minlength=size)
            gap = max(gap, float(np.abs(now - target).max(initial=0.0)))
            step = np.where(now - sure > 0, np.maximum(target - sure, LEAST) / np.where(now - sure > 0, now - sure, 1.0), 1.0)
            factor = np.where(fixed, MOST, np.clip(factor * step[code], 1 / MOST, MOST))
        if gap <= tolerance or (at % PATIENCE == 0 and gap > mark / 2):
            break
        mark = gap if at % PATIENCE == 0 else mark
    return np.minimum(factor, 1.0), gap


def _on_driver(cells: list, held: dict, wanted: dict, budgets: list[float], tolerance: float, sweeps: int):
    """(probability of each cell, budget, targets by axis) of the first budget whose targets are met, else of the first."""
    whole = float(sum(r["tokens"] for r in cells))
    share = np.array([float(r["tokens"]) / whole for r in cells])
    names = {a: {v: i for i, v in enumerate(sorted(held[a]))} for a in AXES}
    codes = [np.array([names[a][r[a]] for r in cells], dtype=np.int64) for a in AXES]
    first = None
    for budget in budgets:
        aims = {a: reachable(wanted[a], held[a], budget) for a in AXES}
        fixed = np.logical_or.reduce([np.array([r[a] in aims[a][1] for r in cells]) for a in AXES])
        p, gap = rake(share, codes, [np.array([aims[a][0][v] for v in names[a]]) for a in AXES], fixed, budget, tolerance, sweeps)
        found = (p, budget, {a: aims[a][0] for a in AXES})
        first = first or found
        if gap <= tolerance:
            return found
    return first


def _in_place(cells: DataFrame, held: dict, wanted: dict, budgets: list[float], tolerance: float, sweeps: int):
    """The same for any number of cells: (cells with p, budget, targets by axis). Sums by axis are joined, and cut after each sweep."""
    spark = cells.sparkSession
    whole = float(cells.agg(F.sum("tokens")).first()[0])
    first = None
    for budget in budgets:
        aims = {a: reachable(wanted[a], held[a], budget) for a in AXES}
        goals = {}
        now = cells.withColumn("held", F.col("tokens") / whole).withColumn("fixed", F.lit(False))
        for a in AXES:
            goals[a] = spark.createDataFrame([(v, float(t), v in aims[a][1]) for v, t in aims[a][0].items()], f"{a} string, goal double, full boolean")
            now = now.join(goals[a], a).withColumn("fixed", F.col("fixed") | F.col("full")).drop("goal", "full")
        now = cut(now.withColumn("factor", F.when(F.col("fixed"), MOST).otherwise(budget)))
        gap = mark = float("inf")
        for at in range(1, sweeps + 1):
            gaps = F.lit(0.0)
            for a in AXES:
                give = F.col("held") * F.least(F.col("factor"), F.lit(1.0))
                sums = now.groupBy(a).agg(F.sum(give).alias("now"), F.sum(F.when(F.col("fixed"), F.col("held")).otherwise(0.0)).alias("sure")).join(goals[a], a)
                step = F.when(F.col("now") > F.col("sure"), F.greatest(F.col("goal") - F.col("sure"), F.lit(LEAST)) / (F.col("now") - F.col("sure"))).otherwise(1.0)
                sums = sums.select(a, step.alias("step"), F.abs(F.col("now") - F.col("goal")).alias(f"gap_{a}"))
                now = now.drop(f"gap_{a}").join(sums, a)
                now = now.withColumn("factor", F.when(F.col("fixed"), MOST).otherwise(F.least(F.greatest(F.col("factor") * F.col("step"), F.lit(1 / MOST)), F.lit(MOST)))).drop("step")
                gaps = F.greatest(gaps, F.col(f"gap_{a}"))
            now = cut(now)
            gap = now.agg(F.max(gaps)).first()[0] or 0.0
            if gap <= tolerance or (at % PATIENCE == 0 and gap > mark / 2):
                break
            mark = gap if at % PATIENCE == 0 else mark
        found = (now.select(*AXES, F.least(F.col("factor"), F.lit(1.0)).alias("p")), budget, {a: aims[a][0] for a in AXES})
        first = first or found
        if gap <= tolerance:
            return found
    return first


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    temperature: float = TEMPERATURE,
    topic: Column | None = None,
    tolerance: float = TOLERANCE,
    sweeps: int = SWEEPS,
    cells_on_driver: int = CELLS,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, selected, ..), one row for each row of ``docs``.

    With ``carry`` the first column is the whole input row as a struct, so that keeping the selected rows
    takes no join, and nothing more follows ``selected``. Else three columns follow for each axis, about the
    row's own value: <axis>_wanted, its share as asked for; <axis>_target, its share of the kept tokens as
    aimed at; <axis>_kept, its share of the tokens of all selected rows. No document is shuffled.

    ``targets`` gives the shares wanted for the values of source, lang and topic; by default each value's
    token share raised to ``temperature``, which lifts small ones. ``budget`` is the share of all tokens to
    keep at most. ``topic`` is a column of ``docs`` to use in place of ``topic_of``. Values without a target,
    and texts without tokens in cells without tokens, have probability zero. Null sources, languages and
    topics are a value called unknown; a null text has no tokens; rows that repeat or lack a doc_id keep a
    row each, alike for alike ids. No documents give no rows. Columns other than those four are not read.
    """
    spark = docs.sparkSession
    marked = measured(docs, carry, topic)
    if not carry:
        marked = stored(marked)  # some numbers and names for each document: texts are read once
    cells = cut(marked.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    sums = {a: {r[a]: float(r["t"]) for r in cells.groupBy(a).agg(F.sum("tokens").alias("t")).collect()} for a in AXES}
    whole = sum(sums["source"].values())
    held = {a: {v: t / whole for v, t in of.items()} for a, of in sums.items()}
    wanted = {a: (targets or {}).get(a) or tempered(sums[a], temperature) for a in AXES}
    wanted = {a: {v: w / sum(of.values()) for v, w in of.items()} for a, of in wanted.items()}
    budgets = [budget * step for step in LOWER]
    if not whole:
        kept, budget, aims = spark.createDataFrame([], ", ".join(f"{a} string" for a in AXES) + ", p double"), 0.0, {a: {} for a in AXES}
    elif cells.count() <= cells_on_driver:
        rows = sorted(cells.collect(), key=lambda r: tuple(r[a] for a in AXES))
        p, budget, aims = _on_driver(rows, held, wanted, budgets, tolerance, sweeps)
        kept = spark.createDataFrame([(*(r[a] for a in AXES), float(x)) for r, x in zip(rows, p, strict=True)], ", ".join(f"{a} string" for a in AXES) + ", p double")
        kept = F.broadcast(kept)  # at most cells_on_driver rows
    else:
        kept, budget, aims = _in_place(cells, held, wanted, budgets, tolerance, sweeps)
    p = F.coalesce("p", F.lit(0.0))
    base = ["doc_id", *AXES, "n_tokens"]
    out = marked.join(kept, list(AXES), "left").select(*["row"] * carry, *base, F.round(p, 6).alias("probability"), (place_of(F.col("doc_id")) < p).alias("selected"))
    if carry:
        return out
    got = cut(out.where("selected").groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")))
    total = float(got.agg(F.sum("tokens")).first()[0] or 0)
    for a in AXES:
        have = {r[a]: float(r["t"]) / total for r in got.groupBy(a).agg(F.sum("tokens").alias("t")).collect()} if total else {}
        told = [(v, round(wanted[a].get(v, 0.0), 6), round(aims[a].get(v, 0.0) / budget, 6), round(have.get(v, 0.0), 6)) for v in held[a]]
        told = spark.createDataFrame(told, f"{a} string, {a}_wanted double, {a}_target double, {a}_kept double")
        out = out.join(told, a, "left").na.fill(0.0, [f"{a}_wanted", f"{a}_target", f"{a}_kept"])
    return out.select(*base, "probability", "selected", *[f"{a}_{c}" for a in AXES for c in ("wanted", "target", "kept")])


def oracle_sql(budget: float = BUDGET, temperature: float = TEMPERATURE, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> str:
    """DuckDB SQL of ``mix`` over the table documents, with targets by temperature."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN regexp_matches(text, {quoted(mark)}) THEN {quoted(name)}" for name, mark, _ in TOPICS)
    sums = " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS v, sum(tokens)::DOUBLE AS s FROM cells GROUP BY {a}" for a in AXES)
    aims = ", ".join(f"{a}_aim.goal AS {a}_goal, {a}_aim.whole AS {a}_whole" for a in AXES)
    joins = " ".join(f"JOIN aim {a}_aim ON {a}_aim.b = t.b AND {a}_aim.axis = '{a}' AND {a}_aim.v = c.{a}" for a in AXES)
    carried = "b, i, mark, source, lang, topic, held, fixed, " + ", ".join(f"{a}_goal" for a in AXES)
    inner = f"SELECT *, 0.0::DOUBLE AS far FROM (SELECT {carried}, factor FROM raked WHERE gap > {tolerance!r} AND i < {sweeps} AND NOT stalled)"
    for a in AXES:
        inner = f"SELECT *, sum(held * least(factor, 1.0)) OVER w AS now_, sum(CASE WHEN fixed THEN held ELSE 0 END) OVER w AS sure FROM ({inner}) WINDOW w AS (PARTITION BY b, {a})"
        inner = f"""SELECT {carried}, CASE WHEN fixed THEN {MOST!r} ELSE least(greatest(factor * CASE WHEN now_ - sure > 0 THEN greatest({a}_goal - sure, {LEAST!r}) / (now_ - sure) ELSE 1 END, {1 / MOST!r}), {MOST!r}) END AS factor,
  greatest(far, abs(now_ - {a}_goal)) AS far FROM ({inner})"""
    kept = " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS v, sum(n_tokens)::DOUBLE AS s FROM chosen WHERE selected GROUP BY {a}" for a in AXES)
    told = ", ".join(f"coalesce({a}_t.wanted, 0)::DOUBLE AS {a}_wanted, coalesce({a}_t.target, 0)::DOUBLE AS {a}_target, coalesce({a}_t.kept, 0)::DOUBLE AS {a}_kept" for a in AXES)
    told_joins = " ".join(f"LEFT JOIN told {a}_t ON {a}_t.axis = '{a}' AND {a}_t.v = chosen.{a}" for a in AXES)
    return f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE {whens} ELSE '{REST}' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM marked GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT sum(tokens)::DOUBLE AS s FROM cells),
axis AS ({sums}),
wanted AS (SELECT axis, v, s / (SELECT s FROM total) AS held, power(s, {temperature}) / sum(power(s, {temperature})) OVER (PARTITION BY axis) AS w FROM axis),
tried AS (SELECT b, budget FROM (VALUES {", ".join(f"({i}, {budget * step!r}::DOUBLE)" for i, step in enumerate(LOWER))}) t(b, budget)),
filled AS (SELECT *, (budget - coalesce(sum(held) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale,
  row_number() OVER x AS place FROM wanted, tried WINDOW x AS (PARTITION BY b, axis ORDER BY held / w, v)),
scale AS (SELECT b, axis, arg_min(scale, place) AS scale FROM filled WHERE scale * w <= held GROUP BY ALL),
aim AS (SELECT f.b, f.axis, f.v, f.budget, f.held, f.w, coalesce(s.scale * f.w >= f.held, TRUE) AS whole, coalesce(least(f.held, s.scale * f.w), f.held) AS goal
  FROM filled f LEFT JOIN scale s ON s.b = f.b AND s.axis = f.axis),
start AS (SELECT t.b, t.budget, c.source, c.lang, c.topic, c.tokens / (SELECT s FROM total) AS held, {aims} FROM cells c CROSS JOIN tried t {joins}),
raked AS (
  SELECT b, 0 AS i, 'inf'::DOUBLE AS mark, FALSE AS stalled, source, lang, topic, held, {" OR ".join(f"{a}_whole" for a in AXES)} AS fixed, {", ".join(f"{a}_goal" for a in AXES)},
    CASE WHEN {" OR ".join(f"{a}_whole" for a in AXES)} THEN {MOST!r} ELSE budget END AS factor, 1e300::DOUBLE AS gap FROM start
  UNION ALL SELECT b, i + 1, CASE WHEN (i + 1) % {PATIENCE} = 0 THEN gap ELSE mark END, (i + 1) % {PATIENCE} = 0 AND gap > mark / 2, source, lang, topic, held, fixed,
    {", ".join(f"{a}_goal" for a in AXES)}, factor, gap FROM (SELECT *, max(far) OVER (PARTITION BY b) AS gap FROM ({inner}))),
ended AS (SELECT b, max(i) AS i, arg_max(gap, i) AS gap FROM raked GROUP BY b),
best AS (SELECT coalesce(min(b) FILTER (WHERE gap <= {tolerance!r}), 0) AS b FROM ended),
chance AS (SELECT r.source, r.lang, r.topic, least(r.factor, 1.0) AS p FROM raked r JOIN best USING (b) JOIN ended e ON e.b = r.b AND e.i = r.i),
chosen AS (SELECT m.*, round(coalesce(p, 0.0), 6)::DOUBLE AS probability,
  ('0x' || substr(md5(coalesce(m.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(p, 0.0) AS selected
  FROM marked m LEFT JOIN chance USING (source, lang, topic)),
kept AS ({kept}),
told AS (SELECT a.axis, a.v, round(a.w, 6) AS wanted, round(a.goal / a.budget, 6) AS target, round(coalesce(k.s, 0) / (SELECT sum(n_tokens)::DOUBLE FROM chosen WHERE selected), 6) AS kept
  FROM aim a JOIN best USING (b) LEFT JOIN kept k ON k.axis = a.axis AND k.v = a.v)
SELECT doc_id, source, lang, topic, n_tokens, probability, selected, {told} FROM chosen {told_joins}"""
