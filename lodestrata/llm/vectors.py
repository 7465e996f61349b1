"""Vector operators: exact top-k search and Euclidean near-duplicates.

Both take (vec_id, embedding) and read no other column. A vector is sound when neither it nor a
component is null and every component is finite. Rows that repeat a vec_id count once, with the
smallest of their sound embeddings; rows without a vec_id are left out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import cut, ship
from lodestrata.llm.components import connected_components

ship(__name__)


def sound(embedding: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite)


def sound_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id").isNotNull() & sound(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min("embedding").alias("embedding")
    )


# ---------------------------------------------------------------------------------------------
# Exact top-k by a three-phase uniform threshold
# ---------------------------------------------------------------------------------------------

#: Rows of a block of candidates and of a block of queries; a task holds one of each.
CANDIDATES, QUERIES_AT_ONCE, SLICE, SEGMENTS = 8192, 8192, 256, 4
#: Share of entries above the bound up to which they are resolved one by one, not by whole rows.
FEW = 0.1
LONG = float(1 << 53)


def _grid(column: pd.Series) -> np.ndarray:
    return np.floor(256 * np.stack(column.to_numpy()).astype(np.float64))


def _segments(width: int) -> list[slice]:
    cuts = np.linspace(0, width, min(SEGMENTS, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _highest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _rest(m: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """(rows, segments): the norm of what lies beyond each segment, rounded up."""
    squares = np.stack([(m[:, c] ** 2).sum(axis=1) for c in cuts], axis=1)
    beyond = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1] - squares
    return np.sqrt(np.maximum(beyond, 0.0)) * (1 + 1e-9) + 1e-3


class Block:
    """The candidates of a block, as integers in doubles, their heaviest components first.

    Rows with a component too large for exact sums of doubles are left to Python's integers (``huge``).
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.limit = np.sqrt(LONG / x.shape[1]) / 2
        plain = np.abs(x).max(axis=1) <= self.limit
        self.huge_ids, self.huge = ids[~plain], x[~plain]
        self.order = np.argsort(-(x[plain] ** 2).sum(axis=0), kind="stable")
        self.ids, self.x = ids[plain], x[plain][:, self.order]
        self.cuts = _segments(x.shape[1])
        self.beyond = _rest(self.x, self.cuts)
        self.scored = self.skipped = 0  # parts of entries that were worked out, and that were not

    def _whole(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of every row, by Python's integers, held to long."""
        mine = [int(v) for v in q]
        return [(min(max(sum(a * int(b) for a, b in zip(mine, row, strict=True)), -(1 << 63)), (1 << 63) - 1), int(i)) for row, i in zip(x, ids, strict=True)]

    def _odd(self, q: np.ndarray, me: int, k: int, plain: bool) -> list[tuple[int, int]]:
        """The k best of the entries that doubles can't score: huge rows, and all rows of a huge query."""
        found = self._whole(q, self.huge_ids, self.huge)
        if not plain:
            back = np.argsort(self.order)
            found += self._whole(q, self.ids, self.x[:, back])
        return sorted(((s, i) for s, i in found if i != me), key=lambda e: (-e[0], e[1]))[:k]

    def first(self, mine: np.ndarray, q: np.ndarray, k: int):
        """Phase one: the k best entries of each query in the list of the first segment, with their whole scores."""
        plain = np.abs(q).max(axis=1) <= self.limit
        p = q[:, self.order]
        part = p[plain][:, self.cuts[0]] @ self.x[:, self.cuts[0]].T
        row = iter(part)
        for i, me in enumerate(mine):
            out = self._odd(q[i], me, k, plain[i])
            if plain[i] and len(self.ids):
                at = next(row)
                at = np.where(self.ids == me, -np.inf, at)
                best = np.argpartition(at, len(at) - k - 1)[-k - 1 :] if len(at) > k + 1 else np.arange(len(at))
                best = best[self.ids[best] != me]
                out += [(int(s), int(j)) for s, j in zip(self.x[best] @ p[i], self.ids[best], strict=True)]
            yield me, sorted(out, key=lambda e: (-e[0], e[1]))[:k]

    def best(self, mine: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int):
        """Phases two and three: the k best entries of each query among all that can reach its cutoff.

        Segments are scored in turn. What the parts still open can add is at most the product of the norms
        beyond, so an entry whose sum and that bound stay under the cutoff is dropped; the rest are resolved
        to the end. No entry whose parts all stay under their uniform share of the cutoff outlives this test.
        """
        plain = np.abs(q).max(axis=1) <= self.limit
        p, rows = q[plain][:, self.order], np.flatnonzero(plain)
        beyond, limits, own = _rest(p, self.cuts), cutoff[plain], mine[plain]
        found: dict[int, list[tuple[int, int]]] = {int(i): [] for i in range(len(mine))}
        if len(p) and len(self.ids):
            whole = np.zeros((len(p), len(self.ids)))
            pairs = None
            for s, c in enumerate(self.cuts):
                if pairs is None:
                    whole += p[:, c] @ self.x[:, c].T
                    self.scored += whole.size
                    open_ = whole + beyond[:, s, None] * self.beyond[None, :, s] >= limits[:, None]
                    if open_.mean() <= FEW or s == len(self.cuts) - 1:
                        a, b = np.nonzero(open_)
                        pairs, sums = (a, b), whole[a, b]
                        self.skipped += (whole.size - len(a)) * (len(self.cuts) - 1 - s)
                else:
                    a, b = pairs
                    sums = sums + np.einsum("ij,ij->i", p[a][:, c], self.x[b][:, c])
                    self.scored += len(a)
                    keep = sums + beyond[a, s] * self.beyond[b, s] >= limits[a]
                    self.skipped += int((~keep).sum()) * (len(self.cuts) - 1 - s)
                    pairs, sums = (a[keep], b[keep]), sums[keep]
            a, b = pairs
            other = self.ids[b] != own[a]
            a, b, sums = a[other], b[other], sums[other]
            edges = np.searchsorted(a, np.arange(len(p) + 1))  # pairs come by query
            for i in range(len(p)):
                at = slice(edges[i], edges[i + 1])
                top = _highest(sums[at], self.ids[b[at]], k)
                found[int(rows[i])] = [(int(sums[at][j]), int(self.ids[b[at]][j])) for j in top]
        for i, me in enumerate(mine):
            out = found[i] + self._odd(q[i], me, k, plain[i])
            yield me, sorted(out, key=lambda e: (-e[0], e[1]))[:k]


def _entries(pdf: pd.DataFrame, cutoffs: pd.DataFrame | None, k: int) -> pd.DataFrame:
    """The entries of one block of queries in one block of candidates: of phase one, or with cutoffs of phase three."""
    ask, have = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    out = []
    if len(ask) and len(have):
        block = Block(have["vec_id"].to_numpy(), _grid(have["embedding"]))
        limits = None if cutoffs is None else ask["vec_id"].map(cutoffs.set_index("of")["cutoff"]).astype(np.float64).fillna(-np.inf).to_numpy()
        for at in range(0, len(ask), SLICE):
            mine, q = ask["vec_id"].to_numpy()[at : at + SLICE], _grid(ask["embedding"].iloc[at : at + SLICE])
            found = block.first(mine, q, k) if limits is None else block.best(mine, q, limits[at : at + SLICE], k)
            out += [(int(me), j, s) for me, entries in found for s, j in entries]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest integer inner products, exactly.

    Components count as floor(256 * x); queries are the ids divisible by ``every``; candidates are all
    other vectors of the same length; ties go to the smaller vec_id; a query with fewer candidates gets
    all. A whole score outside the range of long is held to it, and ranks as such.

    The components are cut into ``SEGMENTS`` segments, heaviest first, each a list of partial scores.
    (1) Every block of candidates scores the first segment and gives each query's k best of that list, with
    their whole scores; the k-th best of all blocks' is a cutoff that k candidates reach. (2) The cutoffs go
    back to the blocks, which drop every entry whose partial sum and bound stay under them. (3) The parts
    still open are resolved for the entries left, and each block keeps its k best.

    Queries and candidates meet in blocks of bounded size, one task for each pair of blocks. The blocks are
    placed once, for both passes; only entries and cutoffs move between them, and none reaches the driver.
    """
    clean = cut(sound_vectors(vectors))
    asks = F.col("vec_id") % every == 0
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("q")).first()
    parts, asked = -(-size["n"] // CANDIDATES) or 1, -(-size["q"] // QUERIES_AT_ONCE) or 1
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("embedding").alias("width")
    have = clean.select("vec_id", "embedding", width, block(parts).alias("part"), to_all(asked).alias("group"), F.lit(False).alias("asks"))
    questions = clean.where(asks).select("vec_id", "embedding", width, to_all(parts).alias("part"), block(asked).alias("group"), F.lit(True).alias("asks"))
    keys = ["part", "group", "width"]
    placed = cut(have.unionByName(questions).repartition(max(parts * asked, 1), *keys))
    fields = "query_id long, vec_id long, score long"

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = placed.groupBy(*keys).applyInPandas(lambda pdf: _entries(pdf, None, k), fields)
    cutoff = cut(
        local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    )
    sent = clean.where(asks).select("vec_id", width).join(cutoff, "vec_id")
    sent = sent.select(F.col("vec_id").alias("of"), "cutoff", to_all(parts).alias("to_part"), block(asked).alias("to_group"), F.col("width").alias("to_width"))
    entries = placed.groupBy(*keys).cogroup(sent.groupBy("to_part", "to_group", "to_width")).applyInPandas(lambda pdf, cutoffs: _entries(pdf, cutoffs, k), fields)
    return entries.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# ---------------------------------------------------------------------------------------------
# Near-duplicates by p-stable projections
# ---------------------------------------------------------------------------------------------

#: Cosine of a link, the probability with which a pair at just that cosine meets in some table, the bucket
#: width, and the number of unrelated vectors that a vector meets in one table on average: one small matrix
#: product costs less than the further tables, and moves, that smaller buckets ask for.
THRESHOLD, RECALL, BUCKET, STRANGERS = 0.9, 0.95, 2.0, 200.0
#: Projections of a key, at least.
LEAST_PROJECTIONS = 10
#: Vectors of a bucket compared in one task; larger buckets are compared chunk by chunk.
CHUNK = 2048
#: Buckets up to this size are compared many at a time; pairs that are worked on at once.
SMALL, PAIRS = 48, 1 << 16
GRID = 1 << 20


def _unit(column: pd.Series) -> np.ndarray:
    e = np.stack(column.to_numpy()).astype(np.float64)
    e /= np.abs(e).max(axis=1, keepdims=True)  # no overflow in the squares
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def chance(distance: float) -> float:
    """The probability that two vectors at this distance fall in one bucket of one projection."""
    r = BUCKET / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def settings(rows: int) -> tuple[int, int]:
    """(tables, projections of a key) for so many different vectors.

    Projections grow with the logarithm of the rows, so that a bucket holds ``STRANGERS`` unrelated vectors
    at most on average, whatever the size; tables make up for what that costs of ``RECALL`` (they grow with
    the rows to the power of 0.27). Neither has a cap.
    """
    far, near = chance(math.sqrt(2.0)), chance(math.sqrt(2 * (1 - THRESHOLD)))
    projections = max(LEAST_PROJECTIONS, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(far)))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - near**projections)), projections


@lru_cache(maxsize=4)
def _lines(width: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(width)
    lines = np.rint(rng.standard_normal((width, tables * projections)) * 4096)
    return lines, rng.integers(0, int(BUCKET * GRID * 4096), tables * projections)


def _table_keys(unit: np.ndarray, tables: int, projections: int) -> np.ndarray:
    """(rows, tables) keys. Integer projections of a grid: sums are exact, so a key never depends on the batch."""
    lines, shift = _lines(unit.shape[1], tables, projections)
    keys = []
    step = max(1, (1 << 22) // (tables * projections))
    for at in range(0, len(unit), step):
        some = np.rint(unit[at : at + step] * GRID)
        cell = np.floor((some @ lines + shift) / (BUCKET * GRID * 4096)).astype(np.int64).astype(np.uint64)
        cell = cell.reshape(len(some), tables, projections)
        key = np.zeros((len(some), tables), dtype=np.uint64)
        for p in range(projections):
            key = (key ^ cell[:, :, p]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(key)
    return np.concatenate(keys).view(np.int64) if keys else np.zeros((0, tables), dtype=np.int64)


def _candidates(starts: np.ndarray, sizes: np.ndarray):
    """Pairs (i, j), i before j, of rows of one bucket, some at a time. Buckets up to SMALL go together by size."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(size, 1)
        of_size = starts[sizes == size]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(of_size), step):
            base = of_size[at : at + step, None]
            yield (base + i).ravel(), (base + j).ravel(), None
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for at in range(0, size, 256):
            yield np.arange(start + at, start + min(at + 256, size)), np.arange(start + at, start + size), "block"


def _compare(pdf: pd.DataFrame, made: tuple[int, int]) -> pd.DataFrame:
    """Links inside the buckets of ``pdf``, whose rows lie together, each in its pair's first table: counts, and a forest."""
    part = pdf[["t", "key", "lo", "hi"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(pdf)])
    ids, own, crossed = pdf["vec_id"].to_numpy(), pdf["own"].to_numpy(), (pdf["lo"] != pdf["hi"]).to_numpy()
    table, unit, copies = pdf["t"].to_numpy(), _unit(pdf["embedding"]), pdf["copies"].to_numpy()
    count, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for i, j, block in _candidates(starts, sizes):
        if block:
            a, b = np.nonzero(unit[i] @ unit[j].T >= THRESHOLD)
            i, j = i[a], j[b]
            i, j = i[i < j], j[i < j]
        else:
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= THRESHOLD
            i, j = i[near], j[near]
        apart = ~crossed[i] | (own[i] != own[j])  # a chunk's own pairs are counted where it meets itself
        i, j = i[apart], j[apart]
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            rows, back = np.unique(np.r_[a, b], return_inverse=True)
            keys = _table_keys(unit[rows], *made)
            first = (keys[back[: len(a)]] == keys[back[len(a) :]]).argmax(axis=1) == table[a]
            a, b = a[first], b[first]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            while len(a):  # join the roots of linked rows until each pair has one
                x, y = root[a], root[b]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root != root[root]).any():
                    root = root[root]
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
    keep = count > 0
    return pd.DataFrame({"vec_id": ids[keep], "n": count[keep], "root": ids[root[keep]]})


def _buckets(batches, made: tuple[int, int]):
    """Whole buckets from batches of sorted rows; a bucket that a batch cuts waits for the next one."""
    waiting = None
    for pdf in batches:
        pdf = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
        last = pdf[["t", "width", "key", "lo", "hi"]].to_numpy()
        cut_at = len(pdf) - int((last == last[-1]).all(axis=1)[::-1].cumprod().sum()) if len(pdf) else 0
        waiting = pdf.iloc[cut_at:]
        if cut_at:
            yield from _by_width(pdf.iloc[:cut_at], made)
    if waiting is not None and len(waiting):
        yield from _by_width(waiting, made)


def _by_width(pdf: pd.DataFrame, made: tuple[int, int]):
    for _, same in pdf.groupby("width", sort=False):
        yield _compare(same.reset_index(drop=True), made)


def near_duplicates(vectors: DataFrame, made: tuple[int, int] | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each distinct vec_id that is not null.

    Vectors that are not sound, or zero, have no links. Vectors of unequal length never link. Equal vectors
    link with each other, and are one vector with a number of copies from then on: a group of copies of any
    size meets nothing twice.

    Normalised vectors are projected on random lines, quantised, and bucketed in as many tables as their
    number asks for (``settings``, or ``made``). Keys that one vector holds alone go first; only vectors of
    shared buckets move, once for each such bucket. Inside a bucket cosines are taken in doubles, and a pair
    counts only in the first table where it meets, so link counts add up without a list of pairs; what
    leaves a task is a count and a forest. A bucket beyond ``CHUNK`` vectors is compared chunk against chunk
    in separate tasks, all of it. A pair at a cosine of just 0.9 is found with probability ``RECALL``; every
    link returned is exact.
    """
    ids = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    clean = cut(sound_vectors(vectors).where(F.exists("embedding", lambda x: x != 0)))
    # A group of copies is known by a hash of its vector and by the vector itself.
    classes = clean.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select(F.col("rep").alias("vec_id"), "embedding", "copies"))
    made = made or settings(classes.count())

    def keys_of(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pdf["embedding"].map(len)):
                found = _table_keys(_unit(same["embedding"]), *made)
                yield pd.DataFrame({"vec_id": same["vec_id"], "width": same["embedding"].map(len), "keys": list(found)})

    keyed = (
        classes.select("vec_id", "embedding").mapInPandas(keys_of, "vec_id long, width int, keys array<long>").select("vec_id", "width", F.posexplode("keys").alias("t", "key"))
    )
    keyed = cut(keyed)
    shared = cut(keyed.groupBy("t", "width", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("c")).cast("int")
    members = (
        keyed.join(shared, ["t", "width", "key"])
        .join(classes, "vec_id")
        .withColumn("c", chunks)
        .withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("vec_id", "embedding", "copies", "t", "width", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )

    bucket = ["t", "width", "key", "lo", "hi"]
    placed = members.repartition(*bucket).sortWithinPartitions(*bucket, "vec_id")
    found = cut(placed.mapInPandas(lambda batches: _buckets(batches, made), "vec_id long, n long, root long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    whole = connected_components(found, "vec_id", "root").withColumnRenamed("node", "vec_id")
    told = classes.join(counts, "vec_id", "left").join(whole, "vec_id", "left")
    told = told.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    linked = told.where("n_links > 0")
    members_of = clean.join(linked, "embedding").select("vec_id", "n_links", "component")
    return ids.join(members_of, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )
