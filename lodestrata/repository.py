"""One repository's evidence and the questions it answers, assembled from the operators.

``scan`` builds the evidence from a worktree; a stored snapshot gives the same tables. Each question
returns a DataFrame; nothing is collected here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import ids, text
from lodestrata.operators import aggregates, graph, overlay, ranges, search
from lodestrata.sources import diffs, syntax, worktree
from lodestrata.storage import kept

LIMIT, MOST = 8, 50


@dataclass
class Repository:
    repo_id: str
    commit: str
    files: DataFrame  # file_path, content_sha256, size_bytes, language, flags, body
    symbols: DataFrame
    calls: DataFrame  # resolved calls
    failed: DataFrame  # files that the syntax source could not read

    @classmethod
    def scan(cls, spark: SparkSession, root: str, repo_id: str | None = None, commit: str = "HEAD", fail_fast: bool = True) -> Repository:
        """The evidence of a worktree. A file that can't be read fails the scan, or is set aside (``fail_fast`` false)."""
        repo = repo_id or f"local:{root.rstrip('/')}"
        try:
            sha = worktree.revision(root, commit)
        except OSError:
            sha = "working-tree"
        # Read, parsed and resolved once: every question starts from these copies.
        files = kept(worktree.manifest(spark, root).withColumn("body", F.decode("content", "UTF-8")).drop("content"), "files")
        sources = files.where(text.is_indexable(F.col("file_path"), F.col("language")))
        found = kept(syntax.symbols(sources), "symbols")
        failed = syntax.failed(found)
        if fail_fast:
            first = failed.orderBy("file_path").head()
            if first is not None:
                raise ValueError(f"{first['file_path']}: {first['error']}")
        lit = F.lit
        hashes = files.select("file_path", "content_sha256")
        rows = found.where("error IS NULL").drop("error").join(hashes, "file_path")
        # Ids that grow along a global sort: the documented order, without a single-partition window.
        ordered = rows.orderBy("file_path", "fqn", "ordinal").withColumn("ordinal", F.monotonically_increasing_id())
        symbols = kept(ordered.select(
            ids.versioned_symbol(lit(repo), lit(sha), F.col("file_path"), F.col("fqn"), F.col("content_sha256")).alias("versioned_symbol_id"),
            ids.stable_symbol(lit(repo), F.col("file_path"), F.col("fqn")).alias("stable_symbol_id"),
            lit(repo).alias("repo_id"),
            lit(sha).alias("commit_sha"),
            *["file_path", "language", "kind", "name", "fqn", "start_line", "start_col", "end_line", "end_col", "ordinal"],
        ), "ordered")
        raw = kept(syntax.calls(sources).where("error IS NULL").drop("error"), "raw").withColumn("call_id", F.struct("file_path", "ordinal"))
        resolved = graph.resolve_calls(raw, symbols).join(raw.select("call_id", "ordinal"), "call_id")
        resolved = kept(resolved.withColumns({"repo_id": lit(repo), "commit_sha": lit(sha)}).drop("call_id"), "calls")
        return cls(repo, sha, files, symbols, resolved, failed)

    def architecture(self) -> DataFrame:
        return aggregates.architecture_entities(self.files)

    def symbol(self, query: str) -> DataFrame:
        return graph.find_symbol(self.symbols, text.required(query, "symbol"))

    def references(self, query: str) -> DataFrame:
        """Calls of the first symbol, in list order, that the query names."""
        chosen = F.broadcast(self.symbol(query).select(F.col("versioned_symbol_id").alias("chosen")))  # one row
        incoming = self.calls.join(chosen, F.col("target_symbol_id") == F.col("chosen")).withColumn("direction", F.lit("incoming"))
        outgoing = self.calls.where("source_symbol_id <> target_symbol_id").join(chosen, F.col("source_symbol_id") == F.col("chosen")).withColumn("direction", F.lit("outgoing"))
        ends = lambda e: self.symbols.select(F.col("versioned_symbol_id").alias(f"{e}_symbol_id"), F.col("fqn").alias(f"{e}_fqn"))
        known = incoming.unionByName(outgoing).join(ends("source"), "source_symbol_id").join(ends("target"), "target_symbol_id")
        return known.withColumns({"relation": F.lit("calls"), "confidence": F.lit("medium")})

    def impact(self, query: str) -> DataFrame:
        """The impact of the first symbol in graph order; no row where none is named so."""
        return graph.impact(self.symbols, self.calls, graph.find_symbol(self.symbols, text.required(query, "symbol"), "graph"))

    def refactor_plan(self, query: str) -> DataFrame:
        return graph.refactor_plan(self.impact(query))

    def context(self, query: str, limit: int = LIMIT) -> DataFrame:
        return search.context_pack(self.symbols, self.calls, text.required(query, "query"), max(1, min(limit, MOST)))

    def test_context(self, query: str, covers: DataFrame | None = None, segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        spark = self.symbols.sparkSession
        covers = covers if covers is not None else spark.createDataFrame([], "test_symbol_id string, target_symbol_id string, confidence double")
        segments = segments if segments is not None else spark.createDataFrame([], "file_path string, segment_start int, segment_end int")
        return graph.test_context(self.symbols, covers, segments, text.required(query, "symbol"))

    def changed_symbols(self, diff: str) -> DataFrame:
        """One row for each changed line inside a symbol."""
        one = self.symbols.sparkSession.createDataFrame([(0, diff)], "diff_id int, text string")
        lines = diffs.changed_lines(one).select("file_path", "line", F.col("pos").alias("ordinal_in_diff"))
        return ranges.changed_symbols(lines, self.symbols, ["versioned_symbol_id", "fqn", "kind"])

    def overlay(self, diff: str) -> DataFrame:
        """The files after a diff whose head is this worktree, over this worktree as the base."""
        one = self.symbols.sparkSession.createDataFrame([(0, diff)], "diff_id int, text string")
        entries = overlay.inputs(diffs.changed_files(one).drop("diff_id"), self.files)
        return overlay.merge(self.files.select("file_path", "content_sha256"), entries)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): contains, calls, imports and test covers."""
        edges = graph.contains_edges(self.symbols).unionByName(graph.call_edges(self.calls))
        edges = edges.unionByName(graph.import_edges(self.symbols, self.files)).unionByName(graph.test_cover_edges(self.symbols))
        return graph.nodes(self.symbols), edges

    def summary(self) -> DataFrame:
        return aggregates.local_summary(self.symbols, self.calls)

    def chunks(self, generation_id: str) -> DataFrame:
        return search.chunks(self.symbols, F.lit(self.repo_id), F.lit(generation_id))


as_json = text.as_json
