"""A Merkle manifest of a dataset: every row a leaf, a tree for each language, a tree over the languages.

A leaf is the hash of a row's fields. Inside a group, leaves stand in order and every ``FAN`` consecutive
nodes make one node of the next level, until one is left, the subroot. The subroots, in order of their
groups, make the root the same way. A row's proof is the list of its steps up to the root: what stands
before and after its node in each run.

Leaves are hashed where they are read, and the texts never move. Rows of hashes are dealt by ranges, so
that a group of any size is spread over many tasks, and their places are counted from the ranges' sizes.
``BLOCK`` consecutive leaves are an aligned block: its subtree is whole whatever the rest holds. Executors
work out the levels of a block by DuckDB queries over its Arrow rows; Spark puts the roots of the blocks
together, level by level, and hands each block the steps above it.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import ascii_lower, cut, ship, stored

ship(__name__)

FAN, LEVELS = 8, 4
#: Consecutive leaves whose levels one DuckDB run works out.
BLOCK = FAN**LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before: string, after: string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields; ``changed`` gives other values for some of them."""
    return F.sha2(F.concat(*[_field(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda now, step: F.sha2(F.concat(step["before"], now, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, from the leaf's run up, left to right."""
    return F.concat_ws("", F.transform(proof, lambda step: F.concat(step["before"], step["after"])))


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place in their group (from 0) and the group's size, by ranges of (group, order).

    Rows alike in all of these are told apart by where they are read, so that no range is forced to hold them
    all; which of them comes first makes no difference. The counts are a row for each group in each range.
    """
    told = rows.withColumn("twin", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(group, *order, "twin").sortWithinPartitions(group, *order, "twin").drop("twin")
    fixed = cut(dealt.withColumn("spot", F.monotonically_increasing_id())).withColumn("part", F.shiftright("spot", 33))
    starts = fixed.groupBy(group, "part").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"))
    every, sofar = Window.partitionBy(group), Window.partitionBy(group).orderBy("part")
    starts = starts.select(group, "part", "first", (F.sum("n").over(sofar) - F.col("n")).alias("before"), F.sum("n").over(every).alias("size"))
    return fixed.join(starts, [group, "part"]).withColumn("place", F.col("before") + F.col("spot") - F.col("first")).drop("part", "spot", "first", "before")


@lru_cache(maxsize=1)
def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})


def _levels(rows: pa.Table, many: bool) -> int:
    """Tables level0, level1, .. of a block, as (spot, digest); the number of steps to its root.

    ``many`` says that the group has other blocks: then the steps are LEVELS, however few leaves it holds.
    """
    con, nodes, steps = _engine(), rows.num_rows, 0
    con.register("leaves", rows)
    con.execute(f"CREATE OR REPLACE TEMP TABLE level0 AS SELECT place % {BLOCK} AS spot, leaf AS digest FROM leaves")
    while steps < LEVELS and (many or nodes > 1):
        con.execute(f"CREATE OR REPLACE TEMP TABLE level{steps + 1} AS SELECT spot // {FAN} AS spot, sha256(string_agg(digest, '' ORDER BY spot)) AS digest FROM level{steps} GROUP BY ALL")
        nodes, steps = -(-nodes // FAN), steps + 1
    return steps


def _root(rows: pa.Table) -> pa.Table:
    """(branch, block, size, digest) of one block of leaves."""
    first = {c: rows.column(c)[0].as_py() for c in ("branch", "block", "size")}
    steps = _levels(rows, first["size"] > BLOCK)
    digest = _engine().execute(f"SELECT digest FROM level{steps}").fetchall()[0][0]
    return pa.table({"branch": [first["branch"]], "block": pa.array([first["block"]], pa.int64()), "size": pa.array([first["size"]], pa.int64()), "digest": [digest]})


_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("shown", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(_STEP))])


def _proofs(rows: pa.Table, outer: pa.Table) -> pa.Table:
    """The rows of one block with their whole proofs: the steps inside the block, then those of ``outer``."""
    if not rows.num_rows:
        return _OUT.empty_table()
    con, steps = _engine(), _levels(rows, rows.column("size")[0].as_py() > BLOCK)
    above = {c: outer.column(c)[0].as_py() for c in ("steps", "subroot", "root")}
    run = f"PARTITION BY spot // {FAN} ORDER BY spot ROWS BETWEEN"
    sides = ", ".join(
        f"side{i} AS (SELECT spot, {{'before': coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), ''), "
        f"'after': coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')}} AS step FROM level{i})"
        for i in range(steps)
    )
    joined = " ".join(f"JOIN side{i} ON side{i}.spot = place % {BLOCK} // {FAN**i}" for i in range(steps))
    inner = ", ".join(f"side{i}.step" for i in range(steps))
    got = con.sql(f"{f'WITH {sides}' if steps else ''} SELECT doc_id, leaf, shown, [{inner}] AS proof FROM leaves {joined}").to_arrow_table()
    proofs = got.column("proof").combine_chunks()
    if above["steps"] or not steps:
        outside = above["steps"] or []
        proofs = pa.array([[*p, *outside] for p in proofs.to_pylist()], pa.list_(_STEP))
    n = got.num_rows
    made = {"doc_id": got.column("doc_id"), "leaf": got.column("leaf"), "shown": got.column("shown"), "subroot": pa.array([above["subroot"]] * n), "root": pa.array([above["root"]] * n), "proof": proofs}
    return pa.table([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in made.values()], names=list(made)).cast(_OUT)


def _climb(nodes: DataFrame, largest: int) -> DataFrame:
    """(branch, at, steps, top) of every node (branch, at, size, digest): its steps up to its branch's one top node.

    ``size`` is the number of nodes of the branch, ``largest`` the largest one. Runs of FAN nodes are gathered,
    never a whole level. Steps go down again from the top, so every level costs a join of its own nodes.
    """
    levels, tops, now = [], [], nodes
    while largest > 1:
        tops.append(now.where("size = 1").select("branch", "digest", F.lit(len(levels)).alias("level")))
        runs = now.where("size > 1").groupBy("branch", "size", F.expr(f"at div {FAN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("held"))
        runs = cut(runs)
        digests = lambda some: F.concat_ws("", F.transform(some, lambda x: x["digest"]))
        levels.append(
            runs.select("branch", "run", F.posexplode("held").alias("i", "node"), "held").select(
                "branch", "run", F.col("node.at").alias("at"),
                F.struct(digests(F.expr("slice(held, 1, i)")).alias("before"), digests(F.expr(f"slice(held, i + 2, {FAN})")).alias("after")).alias("step"),
            )
        )
        now = runs.select("branch", F.col("run").alias("at"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size"), F.sha2(digests(F.col("held")), 256).alias("digest"))
        largest = -(-largest // FAN)
    tops.append(now.select("branch", "digest", F.lit(len(levels)).alias("level")))
    down = lambda i: tops[i].select("branch", F.lit(0).cast("long").alias("at"), F.expr(f"CAST(array() AS {STEPS})").alias("steps"), F.col("digest").alias("top"))
    made = down(len(levels))
    for i in reversed(range(len(levels))):
        above = made.withColumnRenamed("at", "run")
        below = levels[i].join(above, ["branch", "run"]).select("branch", "at", F.concat(F.array("step"), F.col("steps")).alias("steps"), "top")
        made = cut(below.unionByName(down(i)))
    return made


def manifest(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """Rows (doc_id, leaf, shown, subroot, root, proof), one for each row of ``docs``.

    ``shown`` is the leaf that a reader of the dataset has now (default: the leaf itself); ``fold(shown, proof)``
    equals the root where nothing has changed. Proofs always lead from the leaf at hand to the root.

    Branches are the values of lang: null first, then by their UTF-8 bytes; leaves of a branch stand by doc_id
    (null first), equal ids by leaf. Null fields are marked, so a null and an empty text differ; texts may have
    any length. Rows that are alike are leaves of their own, with one place each. No rows give no rows. Only the
    five fields are read, so other columns may have any name.
    """
    docs = docs.select(*[F.col(f).cast("long" if f in ("doc_id", "n_chars") else "string").alias(f) for f in FIELDS])
    branch = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    own = leaf()
    # The leaf is told from the one shown only where they differ.
    hashed = stored(docs.select("doc_id", branch.alias("branch"), own.alias("leaf"), (shown if shown is not None else F.lit(None).cast("string")).alias("shown")))
    placed = _placed(hashed, "branch", ["doc_id", "leaf"]).withColumn("block", F.expr(f"place div {BLOCK}"))
    rows = cut(placed.repartition("branch", "block"))
    roots = cut(rows.groupBy("branch", "block").applyInArrow(_root, "branch string, block long, size long, digest string"))
    blocks = roots.select("branch", F.col("block").alias("at"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), "digest")
    inner = _climb(blocks, blocks.agg(F.max("size")).first()[0] or 0)
    tops = cut(inner.select("branch", F.col("top").alias("digest")).distinct().withColumn("all", F.lit("")))
    ordered = _placed(tops, "all", ["branch"])
    over = ordered.select("branch", F.col("place").alias("at"))
    outer = _climb(ordered.select(F.col("all").alias("branch"), F.col("place").alias("at"), "size", "digest"), tops.count())
    outer = outer.drop("branch").join(over, "at").select("branch", F.col("steps").alias("more"), F.col("top").alias("root"))
    above = inner.join(outer, "branch").select("branch", F.col("at").alias("block"), F.concat("steps", "more").alias("steps"), F.col("top").alias("subroot"), "root")
    schema = f"doc_id long, leaf string, shown string, subroot string, root string, proof {STEPS}"
    made = rows.groupBy("branch", "block").cogroup(cut(above).groupBy("branch", "block")).applyInArrow(_proofs, schema)
    return made.withColumn("shown", F.coalesce("shown", "leaf"))


def tampered() -> Column:
    """The leaf of a row whose doc_id a fixed rule picks and whose text then is in lower case; null elsewhere."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(picked, leaf(text=ascii_lower(F.col("text"))))


def audited(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of a manifest against tampered rows."""
    made = manifest(docs, tampered())
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold(F.col("shown"), F.col("proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 8) -> str:
    """DuckDB SQL for ``audited``, over branches of at most FAN ** levels rows."""
    # Fixed value: the reversed polynomial of CRC-32, bit by bit.
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, (x & 1) * 3988292384))))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    run = lambda name, keys: f"(PARTITION BY {keys}spot // {FAN} ORDER BY spot ROWS BETWEEN {name})"

    def climb(start: str, name: str, branch: str) -> str:
        keys = f"{branch}, " if branch else ""
        parts, now = [], start
        for i in range(levels):
            many = f"count(*) OVER ({f'PARTITION BY {branch}' if branch else ''}) > 1"
            parts.append(
                f"{name}{i} AS (SELECT {keys}spot, digest, {many} AS many, coalesce(string_agg(digest, '') OVER {run('UNBOUNDED PRECEDING AND 1 PRECEDING', keys)}, '') AS before, "
                f"coalesce(string_agg(digest, '') OVER {run('1 FOLLOWING AND UNBOUNDED FOLLOWING', keys)}, '') AS after FROM {now})"
            )
            now = f"(SELECT {keys}spot // {FAN} AS spot, CASE WHEN any_value(many) THEN sha256(string_agg(digest, '' ORDER BY spot)) ELSE any_value(digest) END AS digest FROM {name}{i} GROUP BY {keys}spot // {FAN}, many)"
        parts.append(f"{name}_top AS (SELECT {keys}digest FROM {now})")
        return ",\n".join(parts)

    def joins(name: str, alias: str, branch: str) -> str:
        return " ".join(f"JOIN {name}{i} {alias}{i} ON {alias}{i}.spot = {{spot}} // {FAN**i}" + (f" AND {alias}{i}.{branch} = r.{branch}" if branch else "") for i in range(levels))

    # One column for each step, as nested steps would double at every level.
    folds, source = [], "steps"
    for i, t in enumerate([f"i{k}" for k in range(levels)] + [f"o{k}" for k in range(levels)]):
        folds.append(f"fold{i} AS (SELECT * REPLACE (CASE WHEN {t}.many THEN sha256({t}.before || shown || {t}.after) ELSE shown END AS shown) FROM {source})")
        source = f"fold{i}"
    sides = lambda a: " || ".join(f"CASE WHEN {a}{i}.many THEN {a}{i}.before || {a}{i}.after ELSE '' END" for i in range(levels))
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS branch, {hashed('text')} AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS shown
  FROM documents),
placed AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves),
{climb('placed', 'inner', 'branch')},
subroots AS (SELECT branch, digest, row_number() OVER (ORDER BY encode(branch)) - 1 AS spot FROM inner_top),
{climb('subroots', 'outer', '')},
steps AS (
  SELECT r.doc_id, r.leaf, r.shown, s.digest AS subroot, t.digest AS root, {', '.join(f'i{i}' for i in range(levels))}, {', '.join(f'o{i}' for i in range(levels))}
  FROM placed r JOIN subroots s ON s.branch = r.branch CROSS JOIN outer_top t {joins('inner', 'i', 'branch').replace('{spot}', 'r.spot')} {joins('outer', 'o', '').replace('{spot}', 's.spot')}),
{', '.join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({sides('i')} || {sides('o')}) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM {source}"""
