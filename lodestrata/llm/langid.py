"""Language identification by the nearest centroid of normalised TF-IDF n-gram vectors.

A text's letters, in lower case, give its n-grams of one to three characters, a run of anything else counting
as one boundary. Counts are damped, weighed by how rare a gram is, and the vector is brought to length one.
Every language has several centroids, found by spherical k-means; the nearest by cosine names the language.
Each centroid has a reach, taken from how near its own texts lie: a text beyond it is rejected.

Gram counts are taken over all documents that may be learnt from. The centroids come from a sample: of every
language the ``PER_LANG`` documents of smallest hash. Scoring reads whole texts in slices, without a shuffle, and
takes languages in blocks of ``BLOCK``, so that what goes to a task is bounded whatever the language column holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import broadcast_if_small, cut, ship, stored

ship(__name__)

UNKNOWN = "und"
#: Dimensions of the hashed n-grams, as a power of two; documents worked on at once, and their characters.
BITS, ROWS, AT_ONCE = 14, 256, 1 << 20
#: Bound of the sample: documents of each language that centroids are learnt from.
PER_LANG = 500
#: Centroids of a language, rounds of k-means, languages of one scoring pass.
CENTROIDS, ROUNDS, BLOCK = 4, 12, 512
#: A centroid reaches as far as this share of its own texts, and a little further.
INSIDE, SLACK = 0.005, 0.8

DIMS = 1 << BITS
_MULTIPLY = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """The lower case of every letter, zero for any other character."""
    if not _FOLD:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    """Lower-case letters as numbers, runs of anything else as one zero, with a zero at both ends."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    return codes[(codes != 0) | (np.append(codes[1:], 1) != 0)]


def _slots(codes: np.ndarray, owner: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of every gram of one to three characters; a gram belongs to the owner of its last one."""
    one = codes * _MULTIPLY[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MULTIPLY[1] + codes[1:] * _MULTIPLY[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MULTIPLY[0] + codes[2:] * _MULTIPLY[1]
    is_letter = codes != 0
    same = owner[1:] == owner[:-1]
    parts = [
        (owner, one, is_letter),
        (owner[1:], two ^ np.uint32(0x5BD1E995), same & (is_letter[1:] | is_letter[:-1])),
        (owner[2:], three, same[1:] & same[:-1] & is_letter[1:-1]),
    ]
    owners, slots = [], []
    for who, h, keep in parts:
        h = h[keep]
        h = (h ^ (h >> np.uint32(16))) * _MULTIPLY[2]
        slots.append((h >> np.uint32(32 - (dims.bit_length() - 1))).astype(np.int64))
        owners.append(who[keep])
    return np.concatenate(owners), np.concatenate(slots)


def counts(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """(texts, dims) gram counts; a null text counts as empty. Long texts are read in slices, whole."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    codes, owners, size = [], [], 0

    def put():
        nonlocal codes, owners, size
        if codes:
            who, slot = _slots(np.concatenate(codes), np.concatenate(owners), dims)
            out[:] += np.bincount(who * dims + slot, minlength=out.size).reshape(out.shape)
        codes, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), AT_ONCE):
            made = letters(text[at : at + AT_ONCE])
            codes.append(made)
            owners.append(np.full(len(made), i, dtype=np.int64))
            size += len(made)
            if size >= AT_ONCE:
                put()
    put()
    return out


def unit(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one (or zero) from counts: damped, weighed, normalised."""
    made = np.log1p(found, out=found)
    made *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", made, made))
    made /= np.where(norm > 0, norm, 1)[:, None].astype(np.float32)
    return made


def _groups(batches, column: str):
    """(batch, from, to): rows in parts of at most ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch, at, batch.column(column).slice(at, ROWS).to_pylist()


def _weights(texts: DataFrame) -> np.ndarray:
    """How rare every slot is over all texts (column text): one row of each slot for each task, added up by slot."""

    def held(batches):
        seen, n = np.zeros(DIMS, dtype=np.int64), 0
        for _, _, some in _groups(batches, "text"):
            found = counts(some)
            seen += (found > 0).sum(axis=0)
            n += int(found.any(axis=1).sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS)), pa.array(np.append(seen[at], n))], ["slot", "n"])

    rows = texts.mapInArrow(held, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows at most
    df = np.zeros(DIMS + 1)
    for r in rows:
        df[r["slot"]] = r["n"]
    return (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit rows, and each one's reach, by spherical k-means from far-apart rows; fewer for few rows."""
    mean = x.mean(axis=0)
    first = [int(np.argmax(x @ mean))]
    while len(first) < min(k, len(x)):
        near = (x @ x[first].T).max(axis=1)
        near[first] = 2
        if near.min() > 1 - 1e-6:  # only repeats are left
            break
        first.append(int(np.argmin(near)))
    c = x[first].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        kept = norm > 0
        c = sums[kept] / norm[kept, None]
    sims = x @ c.T
    own = np.argmax(sims, axis=1)
    kept = np.unique(own)
    reach = np.array([np.quantile(sims[own == i, i], INSIDE) * SLACK for i in kept], dtype=np.float32)
    return c[kept], reach


class Model:
    """Slot weights, and the centroids (lang, reach, vector) as a stored table."""

    def __init__(self, idf: np.ndarray, centroids: DataFrame, languages: int):
        self.idf, self.centroids, self.languages = idf, centroids, languages

    def blocks(self):
        """(languages, reaches, centroids) of at most BLOCK languages each, in order of the language."""
        for at in range(0, self.languages, BLOCK):
            rows = self.centroids.where((F.col("place") > at) & (F.col("place") <= at + BLOCK)).orderBy("place", "i").collect()
            yield [r["lang"] for r in rows], np.array([r["reach"] for r in rows], dtype=np.float32), np.array([np.frombuffer(r["vector"], dtype=np.float32) for r in rows]).reshape(-1, DIMS)


def train(docs: DataFrame) -> Model:
    """A model of the languages that the rows (doc_id, text, lang) name; rows without a language, an id or a letter teach nothing.

    Documents of a repeated doc_id and language are sampled together or not at all.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    idf = _weights(known)
    # Twice the bound passes a threshold on the hash, whatever the language's size; of these the least are taken.
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).alias("spot"))
    sizes = cut(ids.groupBy("lang").agg((F.lit(float(1 << 62)) * F.least(F.lit(1.0), 2.0 * PER_LANG / F.count(F.lit(1)))).alias("below")))
    few = ids.join(broadcast_if_small(sizes, sizes.count()), "lang").where("spot <= below")
    first = Window.partitionBy("lang").orderBy("spot", "doc_id")
    chosen = cut(few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PER_LANG).select("doc_id", "lang").distinct())
    taken = known.join(broadcast_if_small(chosen, chosen.count()), ["doc_id", "lang"])
    # A repeated id gives one text, so a language holds PER_LANG vectors at most.
    once = taken.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def vectors(batches):
        for batch, at, some in _groups(batches, "text"):
            made = unit(counts(some), idf)
            rows = [np.flatnonzero(v) for v in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(at, ROWS), pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([v[r].tobytes() for v, r in zip(made, rows, strict=True)], pa.binary())],
                ["lang", "slots", "parts"],
            )

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), DIMS), dtype=np.float32)
        for row, slots, parts in zip(x, pdf["slots"], pdf["parts"], strict=True):
            row[np.frombuffer(slots, dtype=np.int32)] = np.frombuffer(parts, dtype=np.float32)
        x = x[np.lexsort(x[:, np.argsort(-x.sum(axis=0), kind="stable")[:8]].T)]  # one order, however the rows arrive
        c, reach = cluster(x)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "i": np.arange(len(c)), "reach": reach, "vector": [v.astype(np.float32).tobytes() for v in c]})

    made = once.mapInArrow(vectors, "lang string, slots binary, parts binary").groupBy("lang").applyInPandas(learn, "lang string, i long, reach float, vector binary")
    made = stored(made)
    places = _places(made.select("lang").distinct())
    centroids = cut(made.join(places, "lang"))
    return Model(idf, centroids, places.count())


def _places(langs: DataFrame) -> DataFrame:
    """(lang, place): languages by their order, from 1, counted over ranges."""
    dealt = cut(langs.repartitionByRange("lang").sortWithinPartitions("lang").withColumn("spot", F.monotonically_increasing_id())).withColumn("part", F.shiftright("spot", 33))
    starts = dealt.groupBy("part").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = starts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return cut(dealt.join(starts, "part").select("lang", (F.col("before") + F.col("spot") - F.col("first") + 1).alias("place")))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with nearest, score and rejected added; no shuffle.

    ``nearest`` is the language of the nearest centroid (equally near: the first in order), null for a text without
    a letter, a null text included, or where nothing was learnt; ``score`` is the cosine, from 0 to 1, 0 where nearest
    is null; ``rejected`` says that the text lies beyond that centroid's reach, or that nearest is null. Columns of
    these names are replaced.
    """
    context = docs.sparkSession.sparkContext
    made = docs.drop("nearest", "score", "rejected").withColumns({"nearest": F.lit(None).cast("string"), "score": F.lit(0.0), "rejected": F.lit(True)})
    for langs, reach, centroids in model.blocks():
        sent = context.broadcast((langs, reach, np.ascontiguousarray(centroids.T), model.idf))

        def nearest(batches, sent=sent):
            langs, reach, across, idf = sent.value
            names = np.array(langs, dtype=object)
            for batch in batches:
                text_, before, score, out = (batch.column(batch.schema.get_field_index(c)) for c in (text, "nearest", "score", "rejected"))
                before, score, out = before.to_numpy(zero_copy_only=False).copy(), score.to_numpy(zero_copy_only=False).copy(), out.to_numpy(zero_copy_only=False).copy()
                for at in range(0, batch.num_rows, ROWS):
                    found = counts(text_.slice(at, ROWS).to_pylist())
                    sound = found.any(axis=1)
                    sims = unit(found, idf) @ across
                    best = np.argmax(sims, axis=1)
                    now = np.clip(sims[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
                    some = slice(at, at + len(best))
                    better = sound & ((now > score[some]) | pd.isna(before[some]))
                    before[some] = np.where(better, names[best], before[some])
                    score[some] = np.where(better, now, score[some])
                    out[some] = np.where(better, now < reach[best], out[some])
                held = {"nearest": pa.array(before, pa.string(), from_pandas=True), "score": pa.array(score, pa.float64()), "rejected": pa.array(out.astype(bool))}
                yield pa.RecordBatch.from_arrays([held.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

        made = made.mapInArrow(nearest, made.schema)
    return made


def learnable(doc_id: Column) -> Column:
    """Outside the held-out fold: crc32 of the id as text, modulo 5, is not 0. A null id is in neither."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def judged(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected), one for each row of ``docs``.

    ``lang_pred`` is the nearest learnt language, ``und`` for a null text or one without a letter, or where there is
    nothing to learn from. Empty texts score 0; very long ones are read whole. A null doc_id is not held out and
    teaches nothing; rows that repeat a doc_id keep a row each. No documents give no rows. Only doc_id, text and
    lang are read, so other columns may have any name.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs.where(learnable(F.col("doc_id"))))
    made = identify(docs.select("doc_id", "text"), model)
    return made.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce("nearest", F.lit(UNKNOWN)).alias("lang_pred"), "score", "rejected")
