"""Ranked lexical search as a sparse matrix product: items x terms times terms x documents, in whole numbers.

The left matrix holds how often an item has a term, the right one a term's impact in a document. Documents are
the blocks of columns: each task takes some thousands of them, sorts their entries by term, and merges the
rows of an item's terms into one row of sums (Gustavson). Of every sum row only the best entries stay, first of
the block, then of the task, then of the item.

Texts are read once. What a text has of the wanted terms is stored; the counts over all documents, which the
impacts need, are taken from that. The terms and items of one pass are bounded by ``TERMS``; a larger item
table takes several passes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import cut, ship, stored

ship(__name__)

BEST = 10
#: Terms with repeats of the items of one pass; an item of more is a pass of its own.
TERMS = 1 << 20
#: Documents, and entries, of one block of columns.
WIDE, ENTRIES = 8192, 1 << 20
#: Fixed values of the score: tf saturates as in BM25 with k1 1.2 and b 0.75, in whole numbers.
SCALE, TF, LENGTH, PERCENT = 1_000_000_000, 1000, 8, 75

#: Terms are runs of these bytes: ASCII letters and digits, and all of every character beyond ASCII.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    """The terms of a whole text, as UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): how often each item holds a term; rows of one item_id are one item."""

    def split(batches):
        for batch in batches:
            ids, terms, times = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(words(text.as_py()))
                ids += [name] * len(found)
                terms += found.keys()
                times += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    split_ = chosen.mapInArrow(split, "item_id long, term binary, times long")
    return split_.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _held(lot: DataFrame) -> tuple[list, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The rows of the left matrix: item ids, where each one's entries begin, the terms, and of every entry its term and times."""
    rows = lot.orderBy("item_id", "term").collect()
    terms = sorted({bytes(r["term"]) for r in rows})
    place = {t: i for i, t in enumerate(terms)}
    starts = [i for i, r in enumerate(rows) if not i or r["item_id"] != rows[i - 1]["item_id"]]
    ids = [rows[i]["item_id"] for i in starts]
    return ids, np.array([*starts, len(rows)]), terms, np.array([place[bytes(r["term"])] for r in rows], dtype=np.int64), np.array([r["times"] for r in rows], dtype=np.int64)


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, times): of every document its terms with repeats, and how often it has each wanted one, by place in ``terms``."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches):
        place = sent.value.get
        for batch in batches:
            n, ends, held, times = [], [0], [], []
            for text in batch.column(1):
                every = words(text.as_py())
                found = Counter(map(place, every))
                found.pop(None, None)
                n.append(len(every))
                held += found.keys()
                times += found.values()
                ends.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((held, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


def length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - PERCENT + PERCENT * n * docs div total; products beyond 64 bits are worked out by unbounded integers."""
    if n.size and int(n.max()) * PERCENT * docs >= 1 << 63:
        return np.array([100 - PERCENT + PERCENT * int(x) * docs // total for x in n], dtype=np.int64)
    return 100 - PERCENT + PERCENT * n * docs // total


class Best:
    """The best entries of each item so far: score descending, then doc_id, null last."""

    def __init__(self, items: int, most: int):
        self.most, self.rows = most, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item: int, sums: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        some = np.flatnonzero(sums >= self.least[item])
        if len(some) > self.most:
            some = some[sums[some] >= np.partition(sums[some], -self.most)[-self.most]]
        if not len(some):
            return
        score, id_, null = (np.concatenate(x) for x in zip(self.rows[item], (sums[some], ids[some], none[some]), strict=True))
        order = np.lexsort((id_, null, -score))[: self.most]
        self.rows[item] = score[order], id_[order], null[order]
        if len(order) == self.most:
            self.least[item] = score[order[-1]]


def _blocks(batches):
    """(ids, none, n, document of each entry, term, times) of at most WIDE documents, and of about ENTRIES entries."""
    for batch in batches:
        none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        n = batch.column(1).to_numpy()
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term, times = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        ends = np.cumsum(sizes)
        at, begun = 0, 0
        while at < len(ids):
            to = min(at + WIDE, max(int(np.searchsorted(ends, begun + ENTRIES, "right")), at + 1))
            some = slice(begun, int(ends[to - 1]))
            yield ids[at:to], none[at:to], n[at:to], np.repeat(np.arange(to - at), sizes[at:to]), term[some], times[some]
            at, begun = to, int(ends[to - 1])


def _product(postings: DataFrame, left: tuple, weights: np.ndarray, docs: int, total: int, most: int) -> DataFrame:
    """(item_id, doc_id, score), of each task at most ``most`` rows of an item."""
    sent = postings.sparkSession.sparkContext.broadcast((left[0], left[1], left[3], left[4], weights))

    def multiply(batches):
        items, starts, wanted, factor, weight = sent.value
        best = Best(len(items), most)
        for ids, none, n, doc, term, times in _blocks(batches):
            impact = weight[term] * ((SCALE * times) // (TF * times + LENGTH * length_part(n, docs, total)[doc]))
            order = np.argsort(term, kind="stable")
            term, doc, impact = term[order], doc[order], impact[order]
            low, high = np.searchsorted(term, wanted), np.searchsorted(term, wanted, "right")
            for i in range(len(items)):
                sums = np.zeros(len(ids), dtype=np.int64)
                for e in range(starts[i], starts[i + 1]):
                    a, b = low[e], high[e]
                    if a < b:  # a document stands once in a term's row
                        sums[doc[a:b]] += factor[e] * impact[a:b]
                best.add(i, sums, ids, none)
        for i, (score, id_, null) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([items[i]] * len(score), pa.int64()), pa.array(id_, mask=null), pa.array(score)], ["item_id", "doc_id", "score"])

    return postings.mapInArrow(multiply, "item_id long, doc_id long, score long")


def _ranked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``most`` best documents with a score above 0.

    Ranks count from 1 without gaps; equal scores go by doc_id, null last. Rows of ``items`` that share an
    item_id, or have none, are one item of all their terms; rows of ``docs`` are documents of their own, whatever
    their ids. Null and empty texts have no terms: such items find nothing, such documents count nowhere. Texts
    may have any length. No rows on either side give no rows. Only the id and text are read, so other columns may
    have any name.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = cut(_item_terms(items))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms")).first()
    lots = max(1, -(-2 * size["n"] // TERMS)) if size["n"] > TERMS else 1
    lot = F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(lots))
    found, postings, known = [], None, None
    for i in range(lots):
        left = _held(wanted.where(lot == i))
        if not left[0]:
            continue
        shared = size["terms"] <= TERMS
        if postings is None or not shared:
            known = sorted(bytes(r["term"]) for r in wanted.select("term").distinct().collect()) if shared and lots > 1 else left[2]
            postings = stored(_postings(docs, known))
            sums = postings.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
            if not sums["docs"]:
                break
            weights = np.zeros(len(known), dtype=np.int64)
            held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            weight = F.floor(1000 * F.log(F.lit(2.0 * sums["docs"] + 2) / (2 * F.col("df") + 1)))
            for r in held.select("term", weight.alias("w")).collect():  # at most TERMS, or the terms of the largest item
                weights[r["term"]] = r["w"]
        place = {t: k for k, t in enumerate(known)}
        entries = np.array([place[t] for t in left[2]], dtype=np.int64)[left[3]]
        made = _product(postings, (*left[:3], entries, left[4]), weights, sums["docs"], sums["total"], most)
        found.append(cut(made.withColumn("lot", F.spark_partition_id() % 256)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    few = _ranked(every, ["item_id", "lot"], most).drop("rank", "lot")
    return _ranked(few, ["item_id"], most).select("item_id", "rank", "doc_id", "score")


def oracle_sql(most: int = BEST) -> str:
    """DuckDB SQL for ``search`` of all documents for the benchmark items."""
    terms = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"
    return f"""
WITH words AS (SELECT row, doc_id, {terms} AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
counted AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY row, term),
sized AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, row, any_value(c.doc_id) AS doc_id,
    sum(times * w * (({SCALE} * tf) // ({TF} * tf + {LENGTH} * ({100 - PERCENT} + ({PERCENT} * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN counted c USING (term) JOIN weights USING (term) JOIN sized USING (row), totals GROUP BY item_id, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= {most}"""
