"""Harmonic packing of token sequences.

Lengths are put in reciprocal classes: class k holds the pieces longer than C/(k+1) and no longer than
C/k of the capacity C, and every bin of class k takes k pieces. A bin is full when it has its k pieces,
whatever the other workers do, so each worker packs alone.

A document may be cut freely. Whole capacities are cut off first. Of what is left, a piece of class k
stays whole when k of its kind fill a bin to ``FILL``; else floor(C/(k+1)) tokens are cut off, of which
k+1 fill a bin but for a few tokens, and the rest is classed anew.

Pieces of bins that a worker could not complete are packed again by fewer workers, until one is left;
its open bins are then put together, longest piece first, wherever they fit.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, ship

ship(__name__)

CAPACITY, FILL, END = 2048, 0.97, 1
#: Pieces left over that one worker packs again.
AGAIN = 200_000
VOCABULARY = "byte_bpe_50k"
#: White space from this length on overflows the stack of the faster reader's expressions.
BLANKS = 10_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The ids of the vocabulary file, by the faster of the two libraries that read it.

    The file is a byte-level BPE, so tiktoken gives the ids that tokenizers gives; tests compare both.
    tokenizers reads texts that hold ``BLANKS`` characters of white space in a row.
    """
    import json
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    safe = lambda text: whole.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    known = (saved.get("normalizer"), saved["pre_tokenizer"].get("type"), saved["pre_tokenizer"].get("add_prefix_space"), saved["pre_tokenizer"].get("use_regex"))
    if known != (None, "ByteLevel", False, True) or saved["model"]["type"] != "BPE":
        return safe
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in saved["added_tokens"]}
    ranks = {bytes(letter[c] for c in word): i for word, i in saved["model"]["vocab"].items() if word not in special}
    pairs = ("".join(m if isinstance(m, list) else m.split(" ", 1)) for m in saved["model"]["merges"])
    order = [saved["model"]["vocab"].get(p, -1) for p in pairs]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)):  # the faster library merges in the order of ids
        return safe
    made = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names, blanks = set(special), re.compile(rf"\s{{{BLANKS}}}")

    def encode(text: str) -> list[int]:
        if len(text) >= BLANKS and blanks.search(text):
            return safe(text)
        return made.encode(text, allowed_special=names, disallowed_special=()) if any(s in text for s in names) else made.encode_ordinary(text)

    return encode


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text and the end id, as little-endian unsigned 32-bit integers."""
    return np.array([*_encoder(path)(text or ""), END], dtype="<u4")


def cuts(length: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths of the pieces of a document of ``length`` tokens."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        take = rest if k * rest >= fill * capacity else capacity // (k + 1)
        out.append(take)
        rest -= take
    return out


class Bins:
    """The open bin of each class, and the bins that are full."""

    def __init__(self, capacity: int, worker: int, round_: int):
        self.capacity, self.open, self.made = capacity, {}, 0
        self.base = (round_ << 56) | (worker << 34)

    def add(self, piece: tuple) -> list[tuple]:
        """Rows of the bin that this piece fills, else none. piece: (doc_id, start, length, crc, doc_tokens)."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.close(held)

    def close(self, held: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for p in held:
            out.append((*p, self.base | self.made, at))
            at += p[2]
        self.made += 1
        return out

    def left(self) -> list[tuple]:
        return [(*p, None, None) for held in self.open.values() for p in held]


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{f} long" for f in FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], FIELDS)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, fill: float = FILL) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    A null text counts as empty and gives its end id. Rows that repeat a doc_id, or have none, are packed
    as documents of their own. A text may have any length and hold anything. No rows give no pieces. Only
    doc_id and text are read, so other columns may have any name.
    """
    path = path or vocabulary_path()

    def first(batches):
        bins = Bins(capacity, TaskContext.get().partitionId(), 0)
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                name, ids, start = name.as_py(), encode(text.as_py(), path), 0
                for n in cuts(len(ids), capacity, fill):
                    rows += bins.add((name, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
                    start += n
            if rows:
                yield _batch(rows)
        yield _batch(bins.left())

    made = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, SCHEMA))
    whole, rest, round_ = made.where("sequence_id is not null"), made.where("sequence_id is null"), 1
    workers = -(-rest.count() // AGAIN)
    while workers > 1:
        again = cut(_repack(rest.repartition(workers, "doc_id", "start"), capacity, round_))
        whole, rest = whole.unionByName(again.where("sequence_id is not null")), again.where("sequence_id is null")
        before, workers, round_ = workers, -(-rest.count() // AGAIN), round_ + 1
        workers = min(workers, before - 1)
    return whole.unionByName(_last(rest, capacity, round_))


def _ordered(pieces: DataFrame) -> DataFrame:
    """A fixed order in each partition, so that a task that runs again gives the same bins."""
    return pieces.sortWithinPartitions("length", "doc_id", "start", "ids_crc32", "doc_tokens")


def _repack(pieces: DataFrame, capacity: int, round_: int) -> DataFrame:
    def again(batches):
        bins = Bins(capacity, TaskContext.get().partitionId(), round_)
        for batch in batches:
            rows = [r for p in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for r in bins.add(p)]
            if rows:
                yield _batch(rows)
        yield _batch(bins.left())

    return _ordered(pieces).mapInArrow(again, SCHEMA)


def _last(pieces: DataFrame, capacity: int, round_: int) -> DataFrame:
    """The remaining pieces, by one worker: full bins of each class, then first fit, longest first."""

    def end(batches):
        bins = Bins(capacity, TaskContext.get().partitionId(), round_)
        rows = []
        for batch in batches:
            rows += [r for p in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for r in bins.add(p)]
        if rows:
            yield _batch(rows)
        loose = sorted((p[:5] for p in bins.left()), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3]))
        open_: list[tuple[int, list]] = []
        for p in loose:
            at = next((i for i, (room, _) in enumerate(open_) if room >= p[2]), None)
            if at is None:
                open_.append((capacity - p[2], [p]))
            else:
                room, held = open_[at]
                open_[at] = (room - p[2], [*held, p])
        for _, held in open_:
            yield _batch(bins.close(held))

    return _ordered(pieces.coalesce(1)).mapInArrow(end, SCHEMA)
