"""Near copies of whole documents: candidates by SimHash groups and MinHash bands, then exact similarity.

Texts are lower-cased (A-Z) and split into words at ASCII white space. Two texts are linked at a Jaccard
similarity of ``SIMILAR`` or more over shingles of ``SHINGLE`` words; a shorter text is one shingle.
``BANDS`` bands of ``ROWS`` rows find a pair of similarity 0.8 with probability 0.9998, and every pair found
is verified on its shingle sets. Groups of SimHash fingerprints are candidates like those of a band: their
few bits find the nearest copies, whatever the bands miss, and are verified too. Texts of equal words are merged by their 64-bit hash before anything is
compared, and bands that hold the same texts are verified once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import shingles
from lodestrata.llm.common import ascii_lower, broadcast_if_small, ship, stored
from lodestrata.llm.components import connected_components
from lodestrata.llm.shingles import _MULTIPLY, _mix, _shingles, _slices, bands, linked

ship(__name__)

SHINGLE, SIMILAR = shingles.SHINGLE, shingles.SIMILAR
BANDS, ROWS = 16, 4
#: Texts of one band value that one task compares; more are compared chunk against chunk.
CHUNK = 1024


def marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's words in their order, and its (texts, BANDS) band values. Texts are lower-cased."""
    every, at = _shingles(texts)
    counts = np.diff(np.r_[at, len(every)])
    inside = (np.arange(len(every)) - np.repeat(at, counts)).astype(np.uint64)
    whole = _mix(np.add.reduceat(_mix(every + _mix(inside + _MULTIPLY[2])), at) + counts.astype(np.uint64))
    return whole.view(np.int64), bands(every, at, counts, BANDS, ROWS)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, bands) of every row that has a doc_id."""

    def of(batches):
        for batch in batches:
            sizes = [len(t.as_py()) for t in batch.column(1)]
            for a, b in _slices(sizes):
                part = batch.slice(a, b - a)
                uid, made = marks(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(uid), lists], ["doc_id", "uid", "bands"])

    return _lowered(docs).mapInArrow(of, "doc_id long, uid long, bands array<long>")


def _lowered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(ascii_lower(F.col("text").cast("string")), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _with_uid(docs: DataFrame) -> DataFrame:
    """(uid, text) of some documents."""

    def of(batches):
        for batch in batches:
            for a, b in _slices([len(t.as_py()) for t in batch.column(1)]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(marks(part.column(1).to_pylist())[0]), part.column(1)], ["uid", "text"])

    return docs.mapInArrow(of, "uid long, text string")


def near_copies(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of every document that has a near copy, once; component_id is its group's smallest doc_id.

    ``groups`` has (doc_id, component_id) of more candidates, such as ``simhash.near_duplicates`` gives. Rows
    that repeat a doc_id link their texts. Rows without one take part in no link. Null and wordless texts are
    copies of each other. No documents give no rows. Only doc_id and text are read.
    """
    marked = stored(_marked(docs))
    reps = marked.groupBy("uid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = stored(reps)
    keyed = reps.select("uid", F.explode("bands").alias("key"))
    if groups is not None:
        named = groups.where("component_id is not null").select("doc_id", F.xxhash64(F.lit("group"), "component_id").alias("key"))
        keyed = keyed.unionByName(marked.select("doc_id", "uid").join(named, "doc_id").select("uid", "key").distinct())

    def texts(asked: DataFrame) -> DataFrame:
        """The texts of the representatives; what else their documents hold is known by its uid and drops."""
        ids = asked.select(F.col("rep").alias("doc_id")).distinct()
        return _with_uid(_lowered(docs).join(broadcast_if_small(ids, asked.count()), "doc_id", "left_semi"))

    found = linked(keyed, reps.select("uid", "rep"), texts, CHUNK)
    # A document of several texts joins them.
    ids = marked.groupBy("doc_id").agg(F.min("uid").alias("b"), F.max("uid").alias("z")).where("b <> z").select("doc_id", "b")
    several = marked.join(ids, "doc_id").select(F.col("uid").alias("a"), "b")
    whole = connected_components(found.unionByName(several))
    classes = marked.select("doc_id", "uid").join(whole, marked["uid"] == whole["node"], "left")
    classed = classes.select("doc_id", F.coalesce("component", "uid").alias("cluster"))
    first = classed.groupBy("cluster").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last")).where("component_id <> last")
    return classed.join(first, "cluster").select("doc_id", "component_id").distinct()
