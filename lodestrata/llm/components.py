"""Connected components over a distributed edge list, by alternating star contractions.

Each round rewrites every edge towards the smallest neighbour of its larger end (large star), then
of its smaller neighbours (small star), until the edges form one star for each component. Rounds grow
with the logarithm of the longest path. Nothing is gathered on the driver but a count of each round: of the
nodes that are no star's centre or leaf, so edges that are stars take no round. Each round costs the driver the
state of its tasks, so edges are read and moved as few times as the steps allow; minima are combined before they are shuffled, so a node of very high degree costs one
row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, stored


def _ends(edges: DataFrame, one: str, other: str) -> DataFrame:
    """Two rows for each edge, by expressions over (hi, lo)."""
    return edges.selectExpr(f"inline(array({one}, {other}))")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct edges (hi, lo) with hi > lo."""
    nearest = _ends(edges, "struct(hi AS u, lo AS v)", "struct(lo AS u, hi AS v)").groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = edges.withColumnRenamed("lo", "u").join(nearest, "u").select("hi", F.col("m").alias("lo")).distinct()
    root = large.groupBy("hi").agg(F.min("lo").alias("m"))
    return _ends(large.join(root, "hi"), "struct(hi AS hi, m AS lo)", "struct(lo AS hi, m AS lo)").where("hi <> lo").distinct()


def _open(edges: DataFrame) -> int:
    """How many nodes keep distinct edges (hi, lo) from being stars: larger than one neighbour and smaller than another, or larger than two."""
    sides = _ends(edges, "struct(hi AS u, 1L AS up, 0L AS down)", "struct(lo AS u, 0L AS up, 1L AS down)")
    return sides.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node reachable.

    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    rounds = 0
    while _open(now):
        rounds += 1
        # A checkpoint keeps its plan's statistics; a table every few rounds ends their chain.
        now = (stored if rounds % 4 == 0 else cut)(_stars(now))
    return _ends(now, "struct(hi AS node, lo AS component)", "struct(lo AS node, lo AS component)").distinct()
