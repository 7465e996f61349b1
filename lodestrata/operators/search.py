"""Lexical ranking, BM25, search chunks, context packs and index drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import ids
from lodestrata.functions.text import ascii_lower, ascii_lower_text, json_language, query_terms
from lodestrata.operators.graph import impact
from lodestrata.storage import kept

K1, B = 1.2, 0.75
MODES = ("exact_symbol", "lexical", "graph")


def lexical_scores(symbols: DataFrame, query: str) -> DataFrame:
    """``symbols`` (fqn, name, file_path, ..) that match, with exact, lexical_hits and score.

    Exact is the whole query as fqn or name; a hit is a term, repeats counted, in fqn, name or path.
    """
    whole = ascii_lower_text(query.strip())
    fqn, name, path = (ascii_lower(F.col(c)) for c in ("fqn", "name", "file_path"))
    hit = lambda t: (fqn.contains(t) | name.contains(t) | path.contains(t)).cast("int")
    hits = sum((hit(t) for t in query_terms(query)), F.lit(0))
    exact = (fqn == whole) | (name == whole)
    found = symbols.withColumns({"exact": exact, "lexical_hits": hits}).where("exact OR lexical_hits > 0")
    return found.withColumn("score", (F.col("exact").cast("int") * 100 + F.col("lexical_hits") * 10).cast("long"))


def top(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best, by score, then path, then fqn; equal rows in their given order."""
    tie = ["ordinal"] if "ordinal" in symbols.columns else []
    return lexical_scores(symbols, query).orderBy(F.desc("score"), "file_path", "fqn", *tie).limit(limit)


def context_pack(symbols: DataFrame, calls: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The best symbols with the impact of the first symbol, in graph order, that each one's fqn names.

    A name can lead to another symbol than the one found; symbols without an answer keep null impact.
    """
    hits = top(symbols, query, limit)
    wanted = hits.select(F.col("fqn").alias("asked")).distinct()
    keys = symbols.select("versioned_symbol_id", F.explode(F.array_distinct(F.array("fqn", "name"))).alias("asked"), "file_path", "start_line", "fqn", "ordinal")
    first = keys.join(F.broadcast(wanted), "asked").groupBy("asked").agg(F.min_by("versioned_symbol_id", F.struct("file_path", "start_line", "fqn", "ordinal")).alias("impact_id"))
    chosen = symbols.join(F.broadcast(first.select(F.col("impact_id").alias("versioned_symbol_id")).distinct()), "versioned_symbol_id", "left_semi")  # at most ``limit`` rows
    reports = impact(symbols, calls, chosen).select(F.col("versioned_symbol_id").alias("impact_id"), "related", "direct_callers", "direct_callees", "affected_files", "impact_score")
    return hits.join(first.withColumnRenamed("asked", "fqn"), "fqn", "left").join(reports, "impact_id", "left")


def bm25(docs: DataFrame, query: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of documents that hold a term of the query; repeated terms count once.

    Terms are runs of ASCII letters and digits. Counts are expressions over the lower-cased text: the corpus
    is neither split into words nor shuffled, and one row of totals gives the averages. Texts are read once; their
    counts are kept.
    """
    terms = list(dict.fromkeys(query_terms(query.replace("_", " "))))
    if not terms:
        return docs.select(id_column, F.lit(0.0).alias("score")).limit(0)
    low = docs.select(id_column, ascii_lower(F.col(text)).alias("low"))
    times = lambda t: F.when(F.contains("low", F.lit(t)), F.regexp_count("low", F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])"))).otherwise(0)
    counts = kept(low.select(id_column, F.regexp_count("low", F.lit("[a-z0-9]+")).alias("len"), *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)]), "counts")
    total = counts.agg(F.count("len").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = counts.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).withColumn("k", F.lit(1)).join(F.broadcast(total.withColumn("k", F.lit(1))), "k")  # one row
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return scored.select(id_column, sum((part(i) for i in range(1, len(terms))), part(0)).alias("score"))


def bm25_top(docs: DataFrame, query: str, limit: int, id_column: str = "doc_id", text: str = "text", digits: int = 6) -> DataFrame:
    scored = bm25(docs, query, id_column, text).withColumn("score", F.round("score", digits))
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def chunks(symbols: DataFrame, repo_id: Column, generation_id: Column) -> DataFrame:
    """(chunk_id, text, payload, payload_hash) of each symbol; the hash leaves the generation out."""
    language = json_language(F.col("language"))
    spot = ["start_line", "start_col", "end_line", "end_col"]
    chunk_id = F.concat_ws(":", F.lit("chunk:symbol"), "versioned_symbol_id", "kind", *[F.col(c).cast("string") for c in spot])
    text = F.concat_ws(" ", "fqn", "kind", language, "file_path")
    span = F.struct(F.col("end_col").alias("end_column"), "end_line", F.col("start_col").alias("start_column"), "start_line")
    symbol = F.struct("file_path", "fqn", "kind", language.alias("language"), "name", span.alias("range"), "stable_symbol_id", "versioned_symbol_id")
    keep = {"ignoreNullFields": "false"}
    hashed = F.to_json(F.struct(chunk_id.alias("chunk_id"), repo_id.alias("repo_id"), symbol.alias("symbol"), text.alias("text")), keep)
    payload = F.to_json(F.struct(chunk_id.alias("chunk_id"), generation_id.alias("generation_id"), repo_id.alias("repo_id"), symbol.alias("symbol"), text.alias("text")), keep)
    return symbols.select(chunk_id.alias("chunk_id"), text.alias("text"), payload.alias("payload"), ids.payload_hash(hashed).alias("payload_hash"))


def enqueue_chunks(symbols: DataFrame, repo_id: Column, generation_id: Column, target_index: str, now: Column) -> DataFrame:
    """An outbox row for each symbol: an upsert of its chunk, queued, without attempts. The id depends on the payload's hash."""
    made = chunks(symbols, repo_id, generation_id)
    outbox_id = ids.outbox(F.lit(target_index), F.lit("symbol_chunk"), F.col("chunk_id"), F.lit("upsert"), F.col("payload_hash"))
    fixed = {"target_index": target_index, "entity_type": "symbol_chunk", "operation": "upsert", "state": "queued"}
    return made.select(
        outbox_id.alias("outbox_id"), repo_id.alias("repo_id"), generation_id.alias("generation_id"), *[F.lit(v).alias(c) for c, v in fixed.items()],
        F.col("chunk_id").alias("entity_id"), "payload", F.lit(0).alias("attempts"), now.alias("run_after"), now.alias("created_at"),
    )


def active_chunk_count(outbox: DataFrame, repo_id: str, generation_id: str) -> DataFrame:
    kept = outbox.where((F.col("repo_id") == repo_id) & (F.col("generation_id") == generation_id) & (F.col("operation") == "upsert") & (F.col("state") != "cancelled"))
    return kept.agg(F.count_distinct("entity_id").alias("chunks"))


def drift(outbox: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, actual, has_drift): distinct entities that should be indexed, against the index."""
    live = (F.col("operation") == "upsert") & (F.col("state") != "cancelled")
    expected = outbox.where(live).groupBy(*keys).agg(F.count_distinct("entity_id").alias("expected"))
    actual = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    full = expected.join(actual, keys, "full").na.fill(0, ["expected", "actual"])
    return full.withColumn("has_drift", F.col("expected") != F.col("actual"))


def remediation(report: DataFrame, generation_id: Column, rebuild: str = "search rebuild", check: str = "search drift-check") -> DataFrame:
    """A drift report with remediation: a summary, the two commands and the steps; null where there is no drift."""
    steps = ["Rebuild the index from the stored rows.", "Run the sync worker if queued rows remain.", "Check the same generation for drift again."]
    told = F.struct(
        F.lit("The index is out of sync with the stored rows.").alias("summary"),
        F.concat(F.lit(f"{rebuild} --generation "), generation_id).alias("rebuild_command"),
        F.concat(F.lit(f"{check} --generation "), generation_id).alias("verify_command"),
        F.array(*map(F.lit, steps)).alias("steps"),
    )
    return report.withColumn("remediation", F.when(F.col("has_drift"), told))


def rebuild(outbox: DataFrame, key: str = "entity_id", generation_id: str | None = None) -> DataFrame:
    """The whole index from live upserts, the newest payload of each entity."""
    live = outbox.where((F.col("operation") == "upsert") & (F.col("state") != "cancelled"))
    if generation_id is not None:
        live = live.where(F.col("generation_id") == generation_id)
    return live.groupBy("target_index", key).agg(F.max_by("payload", F.struct("created_at", "outbox_id")).alias("payload"))


def sync_index(index: DataFrame, changes: DataFrame, key: str = "entity_id") -> DataFrame:
    """The index after upserts and deletes, the last change of each entity winning by created_at."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("operation", "payload"), F.struct("created_at", "outbox_id")).alias("x"))
    kept = index.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("x.operation = 'upsert'").select(key, F.col("x.payload").alias("payload")))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit)
