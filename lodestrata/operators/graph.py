"""The evidence graph: call resolution, edge builders, and one-hop questions.

Symbols have versioned_symbol_id, stable_symbol_id, repo_id, commit_sha, file_path, language, kind, name,
fqn, start_line, start_col, end_line, end_col and ordinal, their place in the documented order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import ids
from lodestrata.functions.text import confidence_tier, normalized
from lodestrata.operators.pairs import crossed
from lodestrata.operators.ranges import innermost, overlaps
from lodestrata.storage import kept

# Confidence and method of each kind of edge.
METHODS = {
    "contains": (1.000, "tree_sitter_contains"),
    "calls": (0.700, "tree_sitter_call_name"),
    "imports": (0.850, "rust_mod_file"),
    "test_covers": (0.650, "static_test_name_match"),
}
RELATED, SHOWN_EACH_WAY, SHOWN_EDGES = 16, 12, 24
EDGE_COLUMNS = ["edge_id", "source_node_id", "target_node_id", "edge_type", "confidence", "resolution_method", "file_path", "start_line", "start_col", "end_line", "end_col"]
SPAN = ["start_line", "start_col", "end_line", "end_col"]


def find_symbol(symbols: DataFrame, query: str, order: str = "list") -> DataFrame:
    """The first symbol whose fqn or name is the query, in list order or in graph order; none or one row.

    The two orders differ, and can choose different symbols for an ambiguous name.
    """
    by = ["file_path", "start_line", "fqn", "ordinal"] if order == "graph" else ["ordinal"]
    return symbols.where((F.col("fqn") == query) | (F.col("name") == query)).orderBy(*by).limit(1)


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, source_symbol_id, target_symbol_id, file_path, span): calls with both ends known.

    ``calls`` has call_id, file_path, target_name and a span. The source is the innermost symbol at the
    call's first line; the target is another symbol of that name: one of the same file first, then by
    path, fqn and order.
    """
    lines = calls.select("file_path", F.col("start_line").alias("line"), "call_id", "target_name")
    sources = innermost(lines, symbols, ["call_id", "target_name"], ["versioned_symbol_id"]).select(
        "call_id", "target_name", F.col("file_path").alias("call_path"), F.col("versioned_symbol_id").alias("source_symbol_id")
    )
    # Of a name's symbols only the first two can be chosen, in the call's file or in all files: one may be the source.
    own = symbols.groupBy(F.col("name").alias("target_name"), F.col("file_path").alias("call_path"), F.col("versioned_symbol_id").alias("id")).agg(F.min(F.struct("fqn", "ordinal")).alias("o"))

    def first_two(order: list, *keys: str) -> DataFrame:
        ranked = own.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n <= 2")
        return ranked.groupBy(*keys).agg(F.min_by("id", "n").alias("one"), F.max_by("id", F.when(F.col("n") == 2, 1)).alias("two"))

    def other(ends: DataFrame, name: str, *keys: str) -> DataFrame:
        chosen = F.when(F.col("one") != F.col("source_symbol_id"), F.col("one")).otherwise(F.col("two"))
        return sources_with.join(ends, list(keys), "left").withColumn(name, chosen).drop("one", "two")

    sources_with = sources
    sources_with = other(first_two(["o", "id"], "target_name", "call_path"), "near", "target_name", "call_path")
    sources_with = other(first_two(["call_path", "o", "id"], "target_name"), "far", "target_name")
    best = sources_with.select("call_id", "source_symbol_id", F.coalesce("near", "far").alias("target_symbol_id")).where("target_symbol_id IS NOT NULL")
    return best.join(calls.select("call_id", "file_path", *SPAN), "call_id")


def file_nodes(symbols: DataFrame) -> DataFrame:
    files = symbols.select("repo_id", "commit_sha", "file_path").distinct()
    return files.select(
        ids.file_node(F.col("repo_id"), F.col("commit_sha"), F.col("file_path")).alias("graph_node_id"),
        F.lit("file").alias("node_type"),
        F.col("file_path").alias("subject_id"),
        F.col("file_path").alias("display_name"),
        "file_path",
    )


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        ids.symbol_node(F.col("versioned_symbol_id")).alias("graph_node_id"),
        F.lit("symbol").alias("node_type"),
        F.col("versioned_symbol_id").alias("subject_id"),
        F.col("fqn").alias("display_name"),
        "file_path",
    )


def nodes(symbols: DataFrame) -> DataFrame:
    """One node for each file with symbols and one for each symbol id."""
    return file_nodes(symbols).unionByName(symbol_nodes(symbols).distinct())


def _edges(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    """Edges of a kind: of one id the first span in order of ``ordinal`` stays."""
    made = rows.withColumns({"source_node_id": source, "target_node_id": target})
    first = made.groupBy("repo_id", "commit_sha", "source_node_id", "target_node_id").agg(F.min_by(F.struct("file_path", *SPAN), "ordinal").alias("at"), F.count(F.lit(1)).alias("sites"), F.max_by(F.struct("file_path", *SPAN), "ordinal").alias("last"))
    return _shown(first.withColumn("evidence", F.to_json("last")), kind)


def _shown(edges: DataFrame, kind: str) -> DataFrame:
    confidence, method = METHODS[kind]
    return edges.select(
        ids.graph_edge(F.col("repo_id"), F.col("commit_sha"), F.col("source_node_id"), F.col("target_node_id"), F.lit(kind)).alias("edge_id"),
        "source_node_id",
        "target_node_id",
        F.lit(kind).alias("edge_type"),
        F.lit(confidence).alias("confidence"),
        F.lit(method).alias("resolution_method"),
        "at.*",
        "sites",
        "evidence",
    )


def contains_edges(symbols: DataFrame) -> DataFrame:
    source = ids.file_node(F.col("repo_id"), F.col("commit_sha"), F.col("file_path"))
    return _edges(symbols, source, ids.symbol_node(F.col("versioned_symbol_id")), "contains")


def call_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each pair of symbols: the first call's span, the last call's evidence, and the number of calls.

    ``resolved`` has repo_id, commit_sha, the two symbol ids, file_path, a span and ordinal.
    """
    return _edges(resolved, ids.symbol_node(F.col("source_symbol_id")), ids.symbol_node(F.col("target_symbol_id")), "calls")


def module_candidates(path: Column, module: Column) -> Column:
    """The two files a module declared in a Rust file may live in; null for other files."""
    stem = F.regexp_extract(path, r"([^/]*)\.rs$", 1)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")
    base = F.when(stem.isin("lib", "main", "mod"), folder).when(folder == "", stem).otherwise(F.concat_ws("/", folder, stem))
    prefix = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
    return F.when(path.endswith(".rs"), F.array(F.concat(prefix, module, F.lit(".rs")), F.concat(prefix, module, F.lit("/mod.rs"))))


def module_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``modules`` (file_path, name, ..) with target_path, the first candidate among the files; others drop."""
    asked = modules.select("*", F.posexplode(module_candidates(F.col("file_path"), F.col("name"))).alias("choice", "target_path"))
    found = asked.join(files.select(F.col("file_path").alias("target_path")).distinct(), "target_path", "left_semi")
    rest = [c for c in modules.columns]
    return found.groupBy(*rest).agg(F.min_by("target_path", "choice").alias("target_path"))


def import_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    modules = symbols.where((F.col("kind") == "module") & (F.col("language") == "rust"))
    found = module_files(modules.select("repo_id", "commit_sha", "file_path", "name", *SPAN, "ordinal"), files)
    source = ids.file_node(F.col("repo_id"), F.col("commit_sha"), F.col("file_path"))
    return _edges(found, source, ids.file_node(F.col("repo_id"), F.col("commit_sha"), F.col("target_path")), "imports")


def _grams(of: str, n: int) -> Column:
    """Every window of ``n`` letters."""
    every = F.transform(F.sequence(F.lit(1), F.length(of) - (n - 1)), lambda i: F.substring(of, i, F.lit(n)))
    return F.when(F.length(of) >= n, every).otherwise(F.array().cast("array<string>"))


#: Pairs of a name and a text that one window of letters may bring together.
PAIRS = 1 << 20


def _holding(needles: DataFrame, hays: DataFrame, most: int) -> DataFrame:
    """(needle, hay): distinct needles and the distinct hays that hold them.

    A needle of three letters or more is looked up by that of its windows of three that the fewest hays hold,
    and verified; a shorter one by itself among windows of its length. Where needles and hays of one window make
    more than ``most`` pairs, the window grows to the whole needle: those hays are cut into windows of just the
    lengths that such needles have, so a needle meets the hays that hold it, and no other.
    """
    windows = F.array_distinct(F.flatten(F.array(_grams("hay", 1), _grams("hay", 2), _grams("hay", 3))))
    held = hays.select("hay", F.explode(windows).alias("gram"))
    common = held.groupBy("gram").agg(F.count(F.lit(1)).alias("hays"))
    asked = needles.select("needle", F.explode(F.when(F.length("needle") < 3, F.array("needle")).otherwise(F.array_distinct(_grams("needle", 3)))).alias("gram"))
    rarest = asked.join(common, "gram").groupBy("needle").agg(F.min_by(F.struct("gram", "hays"), F.struct("hays", "gram")).alias("x")).select("needle", "x.*")
    crowds = rarest.where(F.length("needle") >= 3).groupBy("gram").agg(F.count(F.lit(1)).alias("needles"), F.first("hays").alias("hays")).where(F.col("needles") * F.col("hays") > most).select("gram")
    lengths = sorted(r["n"] for r in rarest.join(crowds, "gram", "left_semi").select(F.length("needle").alias("n")).distinct().collect())  # as many as a name has letters
    if not lengths:
        return held.join(rarest, "gram").where(F.contains("hay", "needle")).select("needle", "hay")
    hot = kept(rarest.join(crowds, "gram", "left_semi"), "crowds")
    few = held.join(rarest.join(hot.select("needle"), "needle", "left_anti"), "gram").where(F.contains("hay", "needle"))
    whole = held.join(hot.select("gram").distinct(), "gram", "left_semi").select("hay").distinct()
    pieces = whole.select("hay", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("hay", n) for n in lengths])))).alias("needle"))
    return few.select("needle", "hay").unionByName(pieces.join(hot.select("needle"), "needle").select("needle", "hay"))


def _cover_sides(symbols: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tests, targets, pairs): (test_id, hay), (target_id, needle), and which needles a hay holds, each pair once."""
    tests = symbols.where("kind = 'test_case'").select(F.col("versioned_symbol_id").alias("test_id"), normalized(F.col("fqn")).alias("hay"))
    targets = symbols.where("kind <> 'test_case'").select(F.col("versioned_symbol_id").alias("target_id"), normalized(F.col("name")).alias("needle")).where("needle <> ''")
    return tests, targets, _holding(targets.select("needle").distinct(), tests.select("hay").distinct(), most)


def test_covers(symbols: DataFrame, most: int = PAIRS) -> DataFrame:
    """(test_id, target_id): tests whose normalised fqn holds a target's normalised name.

    A containment join without a cross product, see ``_holding``. Names and fqns are compared once each, however
    many symbols share them, and the pairs of such symbols are made by all tasks (``pairs.crossed``).
    """
    tests, targets, pairs = _cover_sides(symbols, most)
    return crossed(tests.join(pairs, "hay").select("needle", "test_id"), targets, ["needle"]).select("test_id", "target_id")


def _told(rows: DataFrame, symbol: str, name: str) -> DataFrame:
    """(symbol, name, rows, repeated): distinct rows, their number, and whether the symbol has other names too."""
    return rows.groupBy(symbol, name).agg(F.count(F.lit(1)).alias(f"{symbol}_rows")).withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy(symbol)) > 1)


def test_cover_edges(symbols: DataFrame, most: int = PAIRS) -> DataFrame:
    """One edge for each test and target of ``test_covers``, with the test's span.

    A test has its span, and a symbol its node, before tests and targets meet. Only pairs of an id that stands for
    symbols of several names can be the same edge twice; they alone are grouped.
    """
    tests, targets, pairs = _cover_sides(symbols, most)
    span = F.struct("file_path", *SPAN)
    spans = symbols.groupBy(F.col("versioned_symbol_id").alias("test_id"), "repo_id", "commit_sha").agg(F.min_by(span, "ordinal").alias("at"), F.count(F.lit(1)).alias("spans"), F.to_json(F.max_by(span, "ordinal")).alias("evidence"))
    tests, targets = _told(tests, "test_id", "hay"), _told(targets, "target_id", "needle")
    asked = tests.join(pairs, "hay").join(spans, "test_id").withColumn("source_node_id", ids.symbol_node(F.col("test_id"))).drop("hay", "test_id")
    found = targets.withColumn("target_node_id", ids.symbol_node(F.col("target_id"))).drop("target_id")

    def made(one: DataFrame, other: DataFrame) -> DataFrame:
        both = crossed(one.drop("repeated"), other.drop("repeated"), ["needle"])
        return both.withColumn("sites", F.col("test_id_rows") * F.col("target_id_rows") * F.col("spans")).drop("needle", "test_id_rows", "target_id_rows", "spans")

    edge = ["repo_id", "commit_sha", "source_node_id", "target_node_id"]
    edges = made(asked.where("NOT repeated"), found.where("NOT repeated"))
    if not tests.select("repeated").unionByName(targets.select("repeated")).where("repeated").isEmpty():
        more = made(asked.where("repeated"), found).unionByName(made(asked.where("NOT repeated"), found.where("repeated")))
        edges = edges.unionByName(more.groupBy(*edge).agg(F.first("at").alias("at"), F.sum("sites").alias("sites"), F.first("evidence").alias("evidence")).select(*edges.columns))
    return _shown(edges, "test_covers")


def local_graph(symbols: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without a store: contains and calls only, one edge for each id, the first in order."""
    known = symbols.select(F.col("versioned_symbol_id").alias("id")).distinct()
    both = resolved.join(known.withColumnRenamed("id", "source_symbol_id"), "source_symbol_id", "left_semi").join(
        known.withColumnRenamed("id", "target_symbol_id"), "target_symbol_id", "left_semi"
    )
    edges = contains_edges(symbols).unionByName(call_edges(both))
    return nodes(symbols), edges


def symbol_edges(edges: DataFrame, graph_nodes: DataFrame, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """Edges of these kinds with source_symbol_id and target_symbol_id; ends that are no symbol drop."""
    known = graph_nodes.where("subject_id IS NOT NULL AND node_type = 'symbol'").select("graph_node_id", "subject_id")
    source = known.select(F.col("graph_node_id").alias("source_node_id"), F.col("subject_id").alias("source_symbol_id"))
    target = known.select(F.col("graph_node_id").alias("target_node_id"), F.col("subject_id").alias("target_symbol_id"))
    return edges.where(F.col("edge_type").isin(*kinds)).join(source, "source_node_id").join(target, "target_node_id")


def related_symbols(symbols: DataFrame, chosen: DataFrame) -> DataFrame:
    """(versioned_symbol_id, related_id, place): the first symbols of the same file but itself and modules."""
    mine = chosen.select("versioned_symbol_id", "file_path")
    others = symbols.where("kind <> 'module'").select("file_path", F.col("versioned_symbol_id").alias("related_id"), "start_line", "fqn", "ordinal")
    # Only the first of a file can be related to anything: sixteen, and as many as one id has rows.
    in_file = Window.partitionBy("file_path").orderBy("start_line", "fqn", "ordinal")
    twins = F.count(F.lit(1)).over(Window.partitionBy("file_path", "related_id"))
    leading = others.withColumns({"rank": F.row_number().over(in_file), "twins": twins})
    leading = leading.withColumn("most", F.max("twins").over(Window.partitionBy("file_path"))).where(F.col("rank") <= RELATED + F.col("most"))
    order = Window.partitionBy("versioned_symbol_id").orderBy("start_line", "fqn", "ordinal")
    pairs = mine.join(leading, "file_path").where("related_id <> versioned_symbol_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= RELATED).select("versioned_symbol_id", "related_id", "place")


def impact(symbols: DataFrame, calls: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each chosen symbol: related, direct_callers, direct_callees, affected_files, impact_score.

    ``calls`` has the two symbol ids. Callers and callees are distinct, known, ordered by id and named by
    fqn. The score is one more than all three counts.
    """
    known = symbols.select(F.col("versioned_symbol_id").alias("id"), F.col("fqn").alias("o_fqn"), F.col("file_path").alias("o_path"))
    me = chosen.select("versioned_symbol_id")

    def side(mine: str, theirs: str, name: str) -> DataFrame:
        pairs = calls.select(F.col(mine).alias("versioned_symbol_id"), F.col(theirs).alias("id")).distinct()
        found = me.join(pairs, "versioned_symbol_id").join(known, "id")
        return found.groupBy("versioned_symbol_id").agg(F.array_sort(F.collect_list(F.struct("id", "o_fqn", "o_path"))).alias(name))

    related = related_symbols(symbols, chosen).groupBy("versioned_symbol_id").agg(F.count(F.lit(1)).alias("related"))
    told = (
        chosen.select("versioned_symbol_id", "fqn", "file_path")
        .join(related, "versioned_symbol_id", "left")
        .join(side("target_symbol_id", "source_symbol_id", "inbound"), "versioned_symbol_id", "left")
        .join(side("source_symbol_id", "target_symbol_id", "outbound"), "versioned_symbol_id", "left")
    )
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["o_fqn"]), F.array().cast("array<string>"))
    paths = lambda c: F.coalesce(F.transform(c, lambda x: x["o_path"]), F.array().cast("array<string>"))
    files = F.array_sort(F.array_distinct(F.concat(F.array("file_path"), paths("inbound"), paths("outbound"))))
    out = told.select(
        "versioned_symbol_id", "fqn", "file_path", F.coalesce("related", F.lit(0)).alias("related"), names("inbound").alias("direct_callers"), names("outbound").alias("direct_callees"), files.alias("affected_files")
    )
    return out.withColumn("impact_score", (F.col("related") + F.size("direct_callers") + F.size("direct_callees") + 1).cast("long"))


def impact_counts(symbols: DataFrame, calls: DataFrame, chosen: DataFrame) -> DataFrame:
    """(versioned_symbol_id, related, callers, callees, files, impact_score): the numbers of ``impact`` without its lists.

    Callers, callees and files are counted as distinct rows, in parts before they meet, so a symbol that all
    others call makes no long row. The lists of one symbol are ``impact`` of that symbol.
    """
    known = symbols.select(F.col("versioned_symbol_id").alias("id"), F.col("file_path").alias("path"))
    me = chosen.select("versioned_symbol_id", "file_path")
    ends = [("target_symbol_id", "source_symbol_id", "callers"), ("source_symbol_id", "target_symbol_id", "callees")]
    sides = [calls.select(F.col(mine).alias("versioned_symbol_id"), F.col(theirs).alias("id")).distinct().join(known, "id") for mine, theirs, _ in ends]
    counted = [s.groupBy("versioned_symbol_id").agg(F.count(F.lit(1)).alias(name)) for s, (_, _, name) in zip(sides, ends, strict=True)]
    paths = sides[0].unionByName(sides[1]).select("versioned_symbol_id", "path").unionByName(me.select("versioned_symbol_id", F.col("file_path").alias("path"))).where("path IS NOT NULL").distinct()
    files = paths.groupBy("versioned_symbol_id").agg(F.count(F.lit(1)).alias("files"))
    related = related_symbols(symbols, chosen).groupBy("versioned_symbol_id").agg(F.count(F.lit(1)).alias("related"))
    told = me.select("versioned_symbol_id")
    for more in (related, *counted, files):
        told = told.join(more, "versioned_symbol_id", "left")
    told = told.na.fill(0, ["related", "callers", "callees", "files"])
    return told.withColumn("impact_score", F.col("related") + F.col("callers") + F.col("callees") + 1)


def references(symbols: DataFrame, calls: DataFrame, symbol_id: str) -> DataFrame:
    """Calls of one symbol: incoming where it is the target, else outgoing; calls with an unknown end drop."""
    name = lambda end: symbols.select(F.col("versioned_symbol_id").alias(f"{end}_symbol_id"), F.col("fqn").alias(f"{end}_fqn"))
    mine = calls.where((F.col("target_symbol_id") == symbol_id) | (F.col("source_symbol_id") == symbol_id))
    return (
        mine.join(name("source"), "source_symbol_id")
        .join(name("target"), "target_symbol_id")
        .withColumn("direction", F.when(F.col("target_symbol_id") == symbol_id, "incoming").otherwise("outgoing"))
        .withColumns({"relation": F.lit("calls"), "confidence": F.lit("medium")})
    )


def graph_references(symbols: DataFrame, edges: DataFrame, graph_nodes: DataFrame, symbol_id: str) -> DataFrame:
    """The same from stored edges, calls and test covers, with tiers; edges without a full span drop."""
    found = symbol_edges(edges, graph_nodes, ("calls", "test_covers")).dropna(subset=SPAN)
    out = references(symbols, found.withColumn("tier", confidence_tier(F.col("confidence"))), symbol_id)
    return out.withColumns({"relation": F.col("edge_type"), "confidence": F.col("tier"), "evidence": F.col("resolution_method")}).drop("tier")


def shown_calls(found: DataFrame) -> DataFrame:
    """References of one symbol as drawn: the first twelve each way as nodes, the first 24 as edges.

    ``found`` has ordinal and ``symbol``, the symbol that each row is a reference of.
    """
    order = lambda *keys: F.row_number().over(Window.partitionBy("symbol", *keys).orderBy("ordinal"))
    calls = found.where("relation = 'calls'")
    return calls.withColumns({"node_shown": order("direction") <= SHOWN_EACH_WAY, "edge_shown": order() <= SHOWN_EDGES})


def refactor_risk(score: Column, files: Column) -> Column:
    return F.when((score >= 5) | (files >= 4), "high").when((score >= 3) | (files >= 2), "medium").otherwise("low")


# The gates of every plan.
GATES = ("format", "lint", "test", "impact-diff")


def refactor_plan(report: DataFrame) -> DataFrame:
    """One slice for each affected file of an impact report, with the plan's risk; nothing may be executed."""
    risk = refactor_risk(F.col("impact_score"), F.size("affected_files"))
    own = F.col("slice_file") == F.col("file_path")
    rows = report.withColumn("risk", risk).withColumn("slice_file", F.explode("affected_files"))
    return rows.select(
        F.col("fqn").alias("symbol"),
        "risk",
        F.lit(False).alias("execution_allowed"),
        F.concat(F.lit("Update "), "slice_file").alias("title"),
        "slice_file",
        F.when(own, "target symbol definition lives in this file").otherwise("direct caller/callee or same-file related symbol may be affected").alias("rationale"),
        F.array(*map(F.lit, GATES)).alias("gates"),
    )


def test_context(symbols: DataFrame, covers: DataFrame, segments: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """(related tests, coverage segments) of the first symbol that the query names.

    Tests linked by stored edges come with their tier, repeats kept; then other tests whose normalised
    fqn holds the target's name (medium) or that share its file (low), each fqn once. Order: path, fqn.
    """
    target = find_symbol(symbols, query).select(
        F.col("versioned_symbol_id").alias("target_symbol_id"), F.col("file_path").alias("t_path"), F.col("start_line").alias("t_start"), F.col("end_line").alias("t_end"), normalized(F.col("name")).alias("needle")
    )
    tests = symbols.select(F.col("versioned_symbol_id").alias("test_symbol_id"), "fqn", "name", "file_path", "kind", "ordinal")
    edges = covers.join(target.select("target_symbol_id"), "target_symbol_id")
    linked = edges.join(tests, "test_symbol_id").select("fqn", "name", "file_path", confidence_tier(F.col("confidence")).alias("confidence"))
    free = tests.where("kind = 'test_case'").join(edges.select("test_symbol_id"), "test_symbol_id", "left_anti").join(linked.select("fqn"), "fqn", "left_anti")
    one = F.broadcast(target)  # one row
    by_file = free.join(one, F.col("file_path") == F.col("t_path"))
    by_name = free.withColumn("one", F.lit(1)).join(one.withColumn("one", F.lit(1)), "one").where((F.col("needle") != "") & F.contains(normalized(F.col("fqn")), F.col("needle"))).drop("one")
    named = by_name.select("fqn", "name", "file_path", "ordinal", F.lit("medium").alias("confidence"), F.lit(0).alias("rank"))
    near = by_file.select("fqn", "name", "file_path", "ordinal", F.lit("low").alias("confidence"), F.lit(1).alias("rank"))
    # A test that both rules find counts as named; of tests with one fqn the first in order counts.
    per_test = named.unionByName(near).groupBy("fqn", "name", "file_path", "ordinal").agg(F.min_by("confidence", "rank").alias("confidence"))
    single = per_test.groupBy("fqn").agg(F.min_by(F.struct("name", "file_path", "confidence"), "ordinal").alias("x")).select("fqn", "x.*")
    covered = overlaps(segments, target.select(F.col("t_path").alias("file_path"), F.col("t_start").alias("start_line"), F.col("t_end").alias("end_line")))
    return linked.unionByName(single.select(*linked.columns)).orderBy("file_path", "fqn"), covered
