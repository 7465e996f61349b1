"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit where more than half of its shingle hashes have it. Fingerprints within
``RADIUS`` bits are linked. Every bit position is given a non-zero vector of RADIUS + 1 bits; each
non-zero vector v makes one mask, of the positions whose vector has an odd product with v. For any
RADIUS differing positions some v is orthogonal to all of their vectors, so its mask skips all of
them: two fingerprints within the radius agree under at least one of the 2^(RADIUS + 1) - 1 masks, and
none is missed.

Exact copies share a fingerprint and count once, so their number does not matter. A bucket of many
different fingerprints (``WIDE`` or more) is split again by a covering family over the positions that
its mask leaves free; what is then still free allows a bounded number of fingerprints only, whatever
the size of the corpus. Within a bucket only a forest of the links leaves the task.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, ship
from lodestrata.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Different fingerprints from which on a bucket is split by a second covering family.
WIDE = 4096

ship(__name__)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text; null and wordless texts give zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded scratch space for texts of any length
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp); fp is the fingerprint as a signed long. One row for each input row."""

    def of(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "doc_id long, fp long"
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``; any ``radius`` of them are all skipped by at least one mask."""
    size = 1 << (radius + 1)
    vector = {p: 1 + i % (size - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if bin(vector[p] & v).count("1") % 2) for v in range(1, size)]


def _forest(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (member, root) that connect just what links within ``radius`` connect."""
    order = np.argsort(rep, kind="stable")
    fp, rep, out = fp[order], rep[order], []
    while len(fp):
        root, queue = rep[0], [fp[0]]
        fp, rep = fp[1:], rep[1:]
        while queue and len(fp):
            near = np.bitwise_count(fp ^ queue.pop()) <= radius
            if near.any():
                queue.extend(fp[near])
                out.extend((int(m), int(root)) for m in rep[near])
                fp, rep = fp[~near], rep[~near]
    return out


def links(fps: DataFrame, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """Edges (a, b) between representatives of different fingerprints, connecting as all links do.

    ``fps`` has distinct rows (fp, rep). Buckets with two fingerprints are compared in place; larger
    ones in one task each, up to ``wide`` fingerprints; the rest is split again, exactly.
    """

    def compare(keys, df):
        def forest(pdf: pd.DataFrame) -> pd.DataFrame:
            found = _forest(pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), radius)
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        return df.groupBy(*keys).applyInPandas(forest, "a long, b long")

    masks = covering(list(range(BITS)), radius)
    keyed = fps.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")
    ).select("fp", "rep", "k.t", "k.key")
    pair = F.struct("fp", "rep")
    sizes = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min(pair).alias("x"), F.max(pair).alias("y")).where("n > 1"))
    twos = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")
    )
    large = sizes.where("n > 2").select("t", "key", "n")
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return twos
    members = keyed.join(large, ["t", "key"])
    found = twos.unionByName(compare(["t", "key"], members.where(F.col("n") < wide).select("fp", "rep", "t", "key")))
    if most < wide:
        return found
    second = [
        F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m | free))).alias("sub"))
        for t, m in enumerate(masks)
        for s, free in enumerate(covering([p for p in range(BITS) if not m >> p & 1], radius))
    ]
    split = (
        members.where(F.col("n") >= wide)
        .select("fp", "rep", "t", F.explode(F.filter(F.array(*second), lambda k: k["t"] == F.col("t"))).alias("k"))
        .select("fp", "rep", "t", "k.s", "k.sub")
    )
    again = split.groupBy("t", "s", "sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "s", "sub")
    return found.unionByName(compare(["t", "s", "sub"], split.join(again, ["t", "s", "sub"])))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each input row.

    component_id is the smallest doc_id reachable over links, itself included. Rows that repeat a
    doc_id keep a row each, and link their texts. A null doc_id takes part in no link and has no
    component. Only doc_id and text are read, so other columns may have any name.
    """
    marked = cut(fingerprints(docs, shingle))
    reps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull()))
    same_id = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    repeated = (
        marked.join(same_id.select("doc_id"), "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    whole = connected_components(links(reps, radius, wide).unionByName(repeated))
    classes = reps.join(whole, reps["rep"] == whole["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = marked.join(classes, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def hex_fingerprint(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
