"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learnt: words, and beginnings of words, that labelled toxic texts use far more often than
others. Features are lexicon densities, their closeness to second-person words, capitals, punctuation
and obfuscation rates, and a few plain counts. Nothing but the text is an input.

Learning uses labelled rows outside the held-out fold (see ``held_out``), at most about ``TRAIN_ROWS`` of
them, taken by a hash of the id. Features of a training row come from a lexicon learnt without its own
fold, as does the margin that calibrates the scores. The term counts, the lexicon and the matrix on the
driver are bounded by ``TRAIN_ROWS`` and the number of features; the corpus itself is only scanned.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.boosting import Isotonic, Trees
from lodestrata.llm.common import cut, hash_share, held_out, ship

ship(__name__)

TRAIN_ROWS, FOLDS, THRESHOLD = 12_000, 3, 0.3
#: Standard deviations by which a term's toxic texts exceed chance; fewer make the lexicon noise.
SURE = 4.2
#: Lengths of the beginnings of words that count as terms.
STEMS = (4, 5, 6, 7)

# Second-person words of the four languages, and look-alike characters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros os".split())
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

WORDS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[0-9@$!|*]+[^\W\d_]+")
MASKS = re.compile(r"[0-9@$!|*]")
MARKS = re.compile(r"[^\w\s]")
NAMES = (
    "words_share words_log stems_share stems_log kinds_log weight_mean weight_max weight_sum you_share you_near you_hits capitals "
    "shouted exclaims asks marks masked masked_hits words_all word_length words_new"
).split()


def terms(words: set[str]) -> set[str]:
    """The words, and their beginnings marked by a final hyphen."""
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def _changed(text: str, low: str) -> int:
    """Characters that lower case changes."""
    if len(text) != len(low):
        return sum(map(str.isupper, text))
    return int(np.count_nonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")))


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """One number for each of NAMES; an empty or null text gives zeros."""
    text = text or ""
    low = text.lower()
    words = WORDS.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = set(words)
    worth: dict[str, float] = {}
    whole = set()
    for w in kinds:
        best = lexicon.get(w, 0.0)
        if best:
            whole.add(w)
        for k in STEMS:
            if len(w) > k:
                stem = lexicon.get(f"{w[:k]}-", 0.0)
                best = max(best, stem)
        if best:
            worth[w] = best
    at = [i for i, w in enumerate(words) if w in worth] if worth else []
    weights = [worth[words[i]] for i in at]
    exact = sum(words[i] in whole for i in at)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if not kinds.isdisjoint(SECOND_PERSON) else []
    near = 0
    if at and you:
        hits, others = np.array(at), np.array(you)
        right = np.searchsorted(others, hits)
        after = np.abs(others[np.minimum(right, len(you) - 1)] - hits)
        before = np.abs(hits - others[np.maximum(right - 1, 0)])
        near = int((np.minimum(after, before) <= 5).sum())
    masked = MASKED.findall(low) if MASKS.search(low) else []
    hidden = 0
    for m in masked:
        for w in {m.translate(LOOKALIKE), m.replace("*", "")}:
            hidden += w in lexicon or any(f"{w[:k]}-" in lexicon for k in STEMS if len(w) > k)
    size = len(text)
    upper = _changed(text, low)
    return [
        exact / n,
        float(np.log1p(exact)),
        len(at) / n,
        float(np.log1p(len(at))),
        float(np.log1p(len(worth))),
        sum(weights) / n,
        max(weights, default=0.0),
        float(np.log1p(sum(weights))),
        len(you) / n,
        near / max(len(at), 1),
        float(np.log1p(near)),
        upper / size,
        sum(len(w) > 1 and w.isupper() for w in text.split()) / n if upper > 1 else 0.0,
        text.count("!") / n,
        text.count("?") / n,
        len(MARKS.findall(text)) / size,
        len(masked) / n,
        float(np.log1p(hidden)),
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(kinds) / n,
    ]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text, toxic, fold) to learn from, in the checkpoint folder; a repeated doc_id is one row."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    count = known.count()
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.where(hash_share(F.col("doc_id")) < min(1.0, TRAIN_ROWS / max(count, 1))).select("doc_id", "toxic", (spot % FOLDS).cast("int").alias("fold"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most about TRAIN_ROWS rows of three numbers, whatever the corpus: a bounded broadcast.
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
    return cut(once.select("doc_id", "text", "toxic", "fold"))


def _lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Term weights without each fold, and last those of all folds."""

    def count(batches):
        for batch in batches:
            text, toxic, fold = (batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))
            seen: dict[tuple, Counter] = {}
            for t, y, f in zip(text, toxic, fold, strict=True):
                seen.setdefault((f, y), Counter()).update(terms(set(WORDS.findall((t or "").lower()))))
            for (f, y), counter in seen.items():
                n = np.fromiter(counter.values(), dtype=np.int64, count=len(counter))
                columns = [pa.array(list(counter), pa.string()), pa.array(np.full(len(n), f, dtype=np.int32)), pa.array(n * int(y)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "fold", "bad", "n"])

    counted = sample.mapInArrow(count, "term string, fold int, bad long, n long").groupBy("term").agg(
        *[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("bad", "n")],
        F.sum("bad").alias("bad"),
        F.sum("n").alias("n"),
    )
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    share = sum(v for (_, t), v in sizes.items() if t) / max(sum(sizes.values()), 1)
    lift = (F.col("bad") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-3))
    often = F.col("bad") > 4 * share / (1 - share + 1e-3) * (F.col("n") - F.col("bad") + 0.5)
    rows = counted.where((F.col("bad") >= 2) & often & (lift > SURE)).orderBy(F.desc(lift), "term").collect()
    out = []
    for without in [*range(FOLDS), None]:
        weights = {}
        for r in rows:
            bad = r["bad"] - (r[f"bad{without}"] if without is not None else 0)
            n = r["n"] - (r[f"n{without}"] if without is not None else 0)
            odds = np.log((bad + 0.25) / (n - bad + 0.5)) - np.log((share + 1e-3) / (1 - share + 1e-3))
            if bad >= 2 and odds > 1:
                weights[r["term"]] = round(float(odds), 4)
        out.append(weights)
    return out


class Model:
    """A lexicon, trees and a calibration; small enough to travel in a task."""

    def __init__(self, lexicon: dict[str, float], trees: Trees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        return self.calibration.apply(self.trees.margin(x))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model learnt from labelled rows outside the held-out fold. Without labels it scores a constant."""
    sample = _sample(docs, labels)
    lexicons = _lexicons(sample)

    def measure(batches):
        for pdf in batches:
            made = [features(t, lexicons[f]) for t, f in zip(pdf["text"], pdf["fold"], strict=True)]
            yield pd.DataFrame({"x": made, "toxic": pdf["toxic"], "fold": pdf["fold"], "at": pdf["doc_id"]})

    rows = sample.mapInPandas(measure, "x array<double>, toxic int, fold int, at long").toPandas().sort_values("at", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(NAMES))
    y, fold = rows["toxic"].to_numpy(dtype=np.float64), rows["fold"].to_numpy()
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            margin[fold == f] = Trees().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(lexicons[-1], Trees().fit(x, y), Isotonic().fit(margin, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` as (doc_id, text, ..) with every column kept, and ``score``; no shuffle.

    A column of the input that is called score is replaced. Null and empty texts get a score too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(text))

    return docs.withColumn("score", of(F.col("text").cast("string")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Null and empty texts are scored like texts without a word, and very long ones whole. A null doc_id is not
    held out; rows that repeat a doc_id keep a row each. Without labels, or with labels of one kind, every
    text has the same score. No documents give no rows. Only doc_id and text are read, and of labels doc_id
    and toxic, so other columns may have any name.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
