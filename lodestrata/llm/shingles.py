"""Words, shingles and MinHash bands as arrays, and the links inside band groups, verified exactly.

A paragraph or a text is known by a 64-bit hash of its words. Two of them are linked at a Jaccard similarity
of ``SIMILAR`` or more over shingles of ``SHINGLE`` words; a shorter text is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, ship

ship(__name__)

SHINGLE, SIMILAR = 5, 0.8
#: Characters that are worked on at once.
AT_ONCE = 1_000_000

_MULTIPLY = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLY[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLY[1]
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=np.uint64, count=len(words))


BASES = (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)


class Spans:
    """Hashes of any spans of a row of word hashes, by sums of powers; the words and their order count."""

    def __init__(self, h: np.ndarray, base: int = BASES[0]):
        size = len(h)
        self.back = np.cumprod(np.full(size + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(h + np.uint64(base)) * np.cumprod(np.full(size, base, dtype=np.uint64)))])

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[starts + sizes] - self.sums[starts]) * self.back[starts] + np.asarray(sizes).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """The hash of the span of ``size`` words at every word that has one."""
        n = max(len(self.sums) - size, 0)
        return _mix((self.sums[size:] - self.sums[:n]) * self.back[:n] + np.uint64(size))


def _shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in a row, and where each text's begin. A short text is one shingle."""
    split = [t.encode().split() or [b""] for t in texts]
    sizes = np.array([len(w) for w in split])
    begins = np.cumsum(sizes) - sizes
    h = _hashes([w for words in split for w in words])
    padded = np.concatenate([h, np.zeros(SHINGLE, dtype=np.uint64)])
    left = np.repeat(begins + sizes, sizes) - np.arange(len(h))  # words from each one to its text's end
    made = np.zeros(len(h), dtype=np.uint64)
    for i in range(SHINGLE):
        made = _mix(made * _MULTIPLY[2] + np.where(left > i, padded[i : i + len(h)], np.uint64(0)))
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    keep = (left >= SHINGLE) | (np.arange(len(h)) == np.repeat(begins, sizes))
    return made[keep], np.cumsum(counts) - counts


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a paragraph's shingles."""
    return np.unique(_shingles([text])[0])


def lowest(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """The least salted hash of each range of grams; ranges may overlap, and are not empty."""
    salted = np.append(_mix(grams ^ _mix(np.array([salt + 1], dtype=np.uint64) * _MULTIPLY[2])), np.uint64(0))
    return np.minimum.reduceat(salted, np.stack([starts, starts + sizes], axis=1).reshape(-1))[::2] if len(starts) else np.zeros(0, dtype=np.uint64)


def bands(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: int, rows: int) -> np.ndarray:
    """(ranges, number) band values: each mixes the least hashes of ``rows`` salts and its own place."""
    out = np.zeros((len(starts), number), dtype=np.uint64)
    for b in range(number):
        key = np.full(len(starts), b, dtype=np.uint64)
        for r in range(rows):
            key = _mix(key * _MULTIPLY[2] + lowest(grams, starts, sizes, b * rows + r))
        out[:, b] = key
    return out.view(np.int64)


def _links(ids: np.ndarray, texts: list[str], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A forest over ids that connects as the pairs of left and right of similarity SIMILAR do."""
    sets = [shingles(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    side = np.zeros(len(ids), dtype=np.int8)
    side[left] |= 1
    side[right] |= 2
    unseen = np.ones(len(ids), dtype=bool)
    out = []
    for root in range(len(ids)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            me = queue.pop()
            rest = np.flatnonzero(unseen & ((side & (3 if side[me] == 3 else 3 - side[me])) > 0))
            rest = rest[np.minimum(sizes[rest], sizes[me]) >= SIMILAR * np.maximum(sizes[rest], sizes[me])]
            for at in range(0, len(rest), 512):
                some = rest[at : at + 512]
                every = np.concatenate([sets[i] for i in some])
                starts = np.cumsum([0, *sizes[some][:-1]])
                shared = np.add.reduceat(np.isin(every, sets[me], assume_unique=False).astype(np.int64), starts)
                near = some[shared >= SIMILAR * (sizes[some] + sizes[me] - shared)]
                unseen[near] = False
                queue.extend(near.tolist())
                out.extend((int(ids[i]), int(ids[root])) for i in near)
    return out


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links inside the band groups of ``pdf``, whose rows lie together.

    All rows are first compared with the head of their group at once, which settles pairs and groups of
    one kind; a group where some row is unlike its head is then compared in full.
    """
    part = pdf[["key", "lo", "hi"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(pdf)])
    group = np.repeat(np.arange(len(starts)), sizes)
    head = starts[group]
    uid, own, texts = pdf["uid"].to_numpy(), pdf["own"].to_numpy(), pdf["text"].tolist()
    every, at = _shingles(texts)
    row = np.repeat(np.arange(len(pdf)), np.diff(np.r_[at, len(every)]))
    order = np.lexsort((every, row))
    every, row = every[order], row[order]
    new = np.r_[True, (every[1:] != every[:-1]) | (row[1:] != row[:-1])]
    every, row = every[new], row[new]
    in_group = _mix(every ^ _mix(group[row].astype(np.uint64) * _MULTIPLY[2]))
    shared = np.bincount(row, np.isin(in_group, in_group[row == head[row]]), minlength=len(pdf))
    count = np.bincount(row, minlength=len(pdf))
    near = shared >= SIMILAR * (count + count[head] - shared)
    crossed = (pdf["lo"] != pdf["hi"]).to_numpy()
    alike = near & ~crossed & (head != np.arange(len(pdf)))
    out = list(zip(uid[alike].tolist(), uid[head[alike]].tolist(), strict=True))
    open_ = np.flatnonzero((np.add.reduceat((~near).astype(np.int64), starts) > 0) & (sizes > 2) | crossed[starts])
    for g in open_:
        rows = np.arange(starts[g], starts[g] + sizes[g])
        inside = np.arange(len(rows))
        sides = (inside[own[rows] == pdf["lo"].iat[rows[0]]], inside[own[rows] == pdf["hi"].iat[rows[0]]]) if crossed[rows[0]] else (inside, inside)
        out += _links(uid[rows], [texts[i] for i in rows], *sides)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _groups(batches):
    """Whole band groups from batches of sorted rows; a group that a batch cuts waits for the next one."""
    waiting = None
    for pdf in batches:
        pdf = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
        last = pdf[["key", "lo", "hi"]].to_numpy()
        cut_at = len(pdf) - int((last == last[-1]).all(axis=1)[::-1].cumprod().sum()) if len(pdf) else 0
        waiting = pdf.iloc[cut_at:]
        if cut_at:
            yield _linked(pdf.iloc[:cut_at].reset_index(drop=True))
    if waiting is not None and len(waiting):
        yield _linked(waiting.reset_index(drop=True))


def _slices(sizes: list[int]):
    """(from, to) of consecutive rows of about ``AT_ONCE`` characters, one row at least."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > AT_ONCE:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _verified(batches):
    """A forest of the links in band groups, whose rows lie together; memory is bounded by slices."""
    return _groups(pdf.iloc[a:b] for pdf in batches for a, b in _slices(pdf["text"].str.len().tolist()))


def linked(keyed: DataFrame, reps: DataFrame, texts: Callable[[DataFrame], DataFrame], chunk: int) -> DataFrame:
    """Edges (a, b) between uids, which connect as all pairs of similarity ``SIMILAR`` that share a band do.

    ``keyed`` has rows (uid, key), one for each band of each text; ``reps`` has (uid, rep), a document for each.
    Bands that hold the same texts are one group. ``texts`` gives (uid, text) of the asked (uid, rep); each text
    is read once, and moves once for each group that needs it. A group of more than ``chunk`` texts is compared
    chunk against chunk in separate tasks, all of it. All joins are plain: none broadcasts by a size of its own.
    """
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("uid")).alias("x"))
    shared = cut(groups.where("m > 1").groupBy("m", "x").agg(F.min("key").alias("key")).select("key", "m"))
    candidates = cut(keyed.join(shared, "key"))
    asked = candidates.select("uid").distinct()
    asked = cut(reps.join(asked, "uid"))
    members = (
        texts(asked)
        .join(candidates, "uid")
        .withColumn("c", F.ceil(F.col("m") / chunk).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("uid"), F.col("c")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("uid", "text", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    placed = members.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "uid")
    return placed.mapInPandas(_verified, "a long, b long")
