"""Deterministic identifiers: a prefix and the SHA-256 of length-prefixed parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """SHA-256 over ``bytes:part;`` for each part; lengths count UTF-8 bytes."""
    pieces = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(";"))]
    return F.sha2(F.concat(*pieces).cast("binary"), 256)


def prefixed(prefix: str, *parts: Column) -> Column:
    """An id whose prefix is not hashed."""
    return F.concat(F.lit(prefix + ":"), digest(*parts))


def typed(prefix: str, *parts: Column) -> Column:
    """An id whose prefix is the first part that is hashed."""
    return F.concat(F.lit(prefix + ":"), digest(F.lit(prefix), *parts))


def stable_symbol(repo: Column, path: Column, fqn: Column) -> Column:
    return typed("sym", repo, path, fqn)


def versioned_symbol(repo: Column, commit: Column, path: Column, fqn: Column, content_hash: Column) -> Column:
    return typed("symv", repo, commit, path, fqn, content_hash)


def stable_entity(repo: Column, path: Column, kind: Column, name: Column) -> Column:
    return typed("ent", repo, path, kind, name)


def versioned_entity(repo: Column, commit: Column, path: Column, kind: Column, name: Column, content_hash: Column) -> Column:
    return typed("entv", repo, commit, path, kind, name, content_hash)


def evidence_edge(repo: Column, commit: Column, source: Column, target: Column, kind: Column, path: Column, *positions: Column) -> Column:
    return typed("edge", repo, commit, source, target, kind, path, *(p.cast("string") for p in positions))


def file_node(repo: Column, commit: Column, path: Column) -> Column:
    return prefixed("gn", repo, commit, F.lit("file"), path)


def symbol_node(versioned_id: Column) -> Column:
    return prefixed("gn", F.lit("symbol"), F.lit("versioned"), F.lit("symbol"), versioned_id)


def graph_edge(repo: Column, commit: Column, source: Column, target: Column, kind: Column) -> Column:
    return prefixed("ge", repo, commit, source, target, kind)


def file_manifest(repo: Column, commit: Column, generation: Column, path: Column, content_hash: Column) -> Column:
    return prefixed("fm", repo, commit, generation, path, content_hash)


def overlay_row(repo: Column, base_generation: Column, head: Column, path: Column, status: Column) -> Column:
    return prefixed("fo", repo, base_generation, head, path, status)


def coverage_segment(repo: Column, commit: Column, generation: Column, source: Column, fmt: Column, path: Column, start: Column, end: Column) -> Column:
    return prefixed("covseg", repo, commit, generation, source, fmt, path, start.cast("string"), end.cast("string"))


def test_run(repo: Column, commit: Column, generation: Column, source: Column, framework: Column) -> Column:
    return prefixed("trun", repo, commit, generation, source, framework)


def test_result(run: Column, suite: Column, fqn: Column) -> Column:
    return prefixed("tres", run, suite, fqn)


def outbox(index: Column, entity_type: Column, entity_id: Column, operation: Column, payload_hash: Column) -> Column:
    return prefixed("search_outbox", index, entity_type, entity_id, operation, payload_hash)


def embedding_key(provider: Column, model: Column, text: Column, dimensions: Column) -> Column:
    """Parts joined by NUL; the input counts by its own hash."""
    joined = F.concat_ws("\u0000", provider, model, F.sha2(text.cast("binary"), 256), dimensions.cast("string"))
    return F.concat(F.lit("emb:"), F.sha2(joined.cast("binary"), 256))


def payload_hash(payload_json: Column) -> Column:
    """The hash of a payload without its generation, keys sorted and written compactly."""
    return F.concat(F.lit("sha256:"), F.sha2(payload_json.cast("binary"), 256))
