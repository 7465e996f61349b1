"""Embedding inputs, vectors and the cache. The byte codec is the only Python here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import ids
from lodestrata.functions.text import trim


def input_error() -> Column:
    """The first broken rule of an input (provider, model, input_kind, input, dimensions); null if none."""
    blank = lambda c: F.when(F.coalesce(trim(F.col(c)), F.lit("")) == "", F.lit(f"empty:{c}"))
    size = F.when(F.coalesce(F.col("dimensions"), F.lit(0)) <= 0, F.lit("range:dimensions"))
    return F.coalesce(*[blank(c) for c in ("provider", "model", "input_kind", "input")], size)


def parse_vector(text: Column) -> Column:
    """A comma list as floats; null when it is empty, or an entry is no finite number."""
    parts = F.transform(F.split(text, ",", -1), lambda x: trim(x).try_cast("float"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when((F.coalesce(text, F.lit("")) != "") & F.forall(parts, finite), parts)


@F.pandas_udf(T.BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blobs: pd.Series) -> pd.Series:
    """The floats of a blob; null where its length is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def put_or_touch(cache: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next cache, answers with cache_hit). The kind of input does not count in the key.

    ``asked`` has provider, model, input, dimensions and embedding; a vector of another length is an
    error row. A hit is touched, a miss inserted once.
    """
    key = ids.embedding_key(F.col("provider"), F.col("model"), F.col("input"), F.col("dimensions"))
    keyed = asked.withColumn("cache_key", key).withColumn("error", F.when(F.size("embedding") != F.col("dimensions"), "dimensions differ"))
    known = cache.select("cache_key", F.lit(True).alias("__known"))
    answers = keyed.join(known, "cache_key", "left").withColumn("cache_hit", F.coalesce("__known", F.lit(False)) & F.col("error").isNull()).drop("__known")
    hits = answers.where("cache_hit").select("cache_key", F.lit(True).alias("__hit")).distinct()
    touched = cache.join(hits, "cache_key", "left").withColumn("touched_at", F.when(F.col("__hit"), now).otherwise(F.col("touched_at"))).drop("__hit")
    new = answers.where("NOT cache_hit AND error IS NULL").groupBy("cache_key").agg(F.min("embedding").alias("embedding")).withColumn("touched_at", now)
    return touched.unionByName(new.select(*cache.columns)), answers
