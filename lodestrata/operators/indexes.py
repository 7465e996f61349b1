"""Stored indexes for ranked search: postings of words for BM25, postings of letter windows for symbol names.

Both are plain parquet tables, sorted so that a query's filters leave out the folders, files and row groups that
hold none of its terms. What an index finds is checked or scored by the rules of ``search``, so its answers are
those of the scan.

BM25: documents are dealt to blocks of about ``BLOCK_DOCS`` of similar length. The postings of a term in a
block are one row, with the largest count of the term and the shortest document: no document of the block can
score more than these two allow. A query first reads these numbers only, scores the most promising blocks, and
then only those blocks that could still hold one of the best.

Names: every window of one to three letters of the full name, the name and the path, and both names whole. A
term looks up its rarest window; the symbols found are read from the folders that hold them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.functions.text import ascii_lower, ascii_lower_text, query_terms
from lodestrata.operators import search
from lodestrata.operators.search import K1, B

#: Folders of an index; documents of a block, and how many lengths of blocks there are to a factor of two.
FOLDERS, BLOCK_DOCS, STEPS = 64, 4096, 4
#: Symbols of one stored folder; found symbols that may be broadcast, some megabytes of two numbers.
FOLDER_SYMBOLS, BROADCAST_ROWS = 50_000, 200_000

WORDS = "[a-z0-9]+"


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _folders(terms: list[str]) -> Column:
    """The folder is one of the terms'; a constant, so that other folders are not even listed."""
    return F.col("folder").isin(*[_folder(F.lit(t)) for t in terms])


def _length_class(length: Column) -> Column:
    return F.floor(F.log2(F.greatest(length, F.lit(1))) * STEPS).cast("int")


def add_documents(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text") -> None:
    """Add ``docs`` to the index in ``folder``, which need not be there yet. Rows with a null text are left out.

    Words are runs of ASCII letters and digits in lower case. Each row is a document of its own, whatever its id.
    Postings move once, by word and block: a word that most documents hold is spread over all of their blocks.
    """
    low = ascii_lower(F.col(text))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), low.alias("low"))
    sized = rows.select(F.regexp_count("low", F.lit(WORDS)).alias("len")).groupBy(_length_class(F.col("len")).alias("class"))
    classes = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).collect()  # a factor of two gives STEPS classes: some 150 at most
    spark = docs.sparkSession
    segment = spark.read.parquet(f"{folder}/totals").count() if _exists(spark, f"{folder}/totals") else 0
    spread = F.create_map(*[x for r in classes for x in (F.lit(r["class"]), F.lit(-(-r["n"] // BLOCK_DOCS)))]) if classes else F.lit(None)
    split = rows.withColumn("words", F.regexp_extract_all("low", F.lit(f"({WORDS})"), 1)).withColumn("len", F.size("words")).withColumn("class", _length_class(F.col("len")))
    # Blocks are numbered by segment, class of length, and a hash of the row.
    block = F.concat_ws(":", F.lit(segment), "class", F.pmod(F.xxhash64("row"), spread[F.col("class")])) if classes else F.lit("")
    each = split.select("id", "row", "len", block.alias("block"), F.explode("words").alias("term")).repartition("term", "block")
    counted = each.groupBy("term", "block", "row").agg(F.first("id").alias("id"), F.first("len").alias("len"), F.count(F.lit(1)).cast("int").alias("tf"))
    held = counted.groupBy("term", "block").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest"), F.collect_list(F.struct("row", "id", "len", "tf")).alias("docs")
    )
    sorted_ = held.withColumn("folder", _folder(F.col("term"))).repartitionByRange("folder", "term", "block").sortWithinPartitions("folder", "term", "block")
    sorted_.write.mode("append").partitionBy("folder").option("compression", "zstd").parquet(f"{folder}/postings")
    kind = rows.schema["id"].dataType.simpleString()
    total = spark.createDataFrame([(segment, sum(r["n"] for r in classes), sum(r["words"] for r in classes), kind)], "segment int, n long, words long, kind string")
    total.coalesce(1).write.mode("append").parquet(f"{folder}/totals")  # a segment counts from here on


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _postings(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The postings, and the totals of all segments. Postings of a segment whose totals are missing are of a write that never ended."""
    total = spark.read.parquet(f"{folder}/totals").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("segments"), F.first("kind").alias("kind")).first()
    schema = f"term string, block string, n int, most int, shortest int, docs array<struct<row: bigint, id: {total['kind']}, len: int, tf: int>>, folder int"
    reader = spark.read.schema(schema)
    rows = reader.parquet(f"{folder}/postings") if _exists(spark, f"{folder}/postings") else spark.createDataFrame([], schema)
    return rows.where(F.substring_index("block", ":", 1).cast("int") < total["segments"]), total.asDict()


class Ranked:
    """A query against the index in ``folder``: its postings, and what is known of them without their documents."""

    def __init__(self, spark: SparkSession, folder: str, query: str):
        self.terms = list(dict.fromkeys(query_terms(query.replace("_", " "))))
        postings, total = _postings(spark, folder)
        self.average = total["words"] / total["n"] if total["n"] and total["words"] else 1.0
        self.postings = postings.where(_folders(self.terms) & F.col("term").isin(*self.terms) if self.terms else F.lit(False))
        df = {r["term"]: r["df"] for r in self.postings.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each term of the query
        self.weight = {t: F.log(F.lit(1 + (total["n"] - n + 0.5) / (n + 0.5))) for t, n in df.items()}

    def _weight(self) -> Column:
        return F.coalesce(*[F.when(F.col("term") == t, w) for t, w in self.weight.items()], F.lit(0.0))

    def _part(self, tf: Column, length: Column) -> Column:
        return self._weight() * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.average)))

    def bounds(self) -> DataFrame:
        """(block, bound, n): no document of the block scores more than the bound. Reads no documents."""
        return self.postings.groupBy("block").agg(F.sum(self._part(F.col("most"), F.col("shortest"))).alias("bound"), F.max("n").alias("n"))

    def scores(self, blocks: DataFrame | None = None) -> DataFrame:
        """(id, score) of the documents of these blocks, or of all."""
        rows = self.postings if blocks is None else self.postings.join(blocks.select("block"), "block", "left_semi")
        each = rows.select("block", "term", F.explode("docs").alias("doc"))
        part = self._part(F.col("doc.tf"), F.col("doc.len"))
        return each.groupBy("block", F.col("doc.row").alias("row")).agg(F.first("doc.id").alias("id"), F.sum(part).alias("score")).select("id", "score")

    def worthwhile(self, limit: int, digits: int) -> DataFrame:
        """The blocks that could hold one of the ``limit`` best: those above the last of the best of the most promising blocks."""
        first = self.bounds().orderBy(F.desc("bound"), "block").limit(limit)  # a block holds a document at least
        best = self.scores(first).orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
        least = best["least"] if best["n"] == limit else 0.0
        return self.bounds().where(F.col("bound") >= least - 2 * 10.0**-digits)


def bm25_top(spark: SparkSession, folder: str, query: str, limit: int, id_column: str = "doc_id", digits: int = 6) -> DataFrame:
    """The rows of ``search.bm25_top`` over all documents added to the index."""
    ranked = Ranked(spark, folder, query)
    scored = ranked.scores(ranked.worthwhile(limit, digits)).select(F.col("id").alias(id_column), F.round("score", digits).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(term, df, cf): documents that hold each word, and its occurrences."""
    postings, _ = _postings(spark, folder)
    return postings.select("term", "n", F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["tf"]).alias("cf")).groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


# --- names ------------------------------------------------------------------------------------


def _windows(value: Column) -> Column:
    low = ascii_lower(value)

    def of(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(low) - (k - 1)), lambda i: F.substring(low, i, F.lit(k)))
        return F.when(F.length(low) >= k, every).otherwise(F.array().cast("array<string>"))

    return F.concat(of(1), of(2), of(3))


def store_symbols(symbols: DataFrame, folder: str) -> None:
    """Write ``symbols`` (fqn, name, file_path, ..) and their index to ``folder``, which is new.

    Symbols lie in folders by ranges of their path, so that what a term finds is mostly in few of them. A
    window's postings are a row for each of these folders, so no row grows with the table.
    """
    spark, parts = symbols.sparkSession, max(1, -(-symbols.count() // FOLDER_SYMBOLS))
    dealt = symbols.repartitionByRange(parts, "file_path", "fqn", "name").withColumns({"__row": F.monotonically_increasing_id(), "__part": F.spark_partition_id()})
    dealt.write.partitionBy("__part").option("compression", "zstd").parquet(f"{folder}/symbols")
    spark.createDataFrame([(dealt.schema.json(),)], "json string").write.parquet(f"{folder}/columns")
    rows = _symbols(spark, folder)
    names = [F.coalesce(F.col(c), F.lit("")) for c in ("fqn", "name", "file_path")]
    windows = F.filter(F.array_distinct(F.concat(*map(_windows, names))), lambda w: w.rlike("^[a-z0-9_]+$"))  # terms hold nothing else
    whole = F.array_distinct(F.array(*[F.concat(F.lit("="), ascii_lower(n)) for n in names[:2]]))
    each = rows.select("__part", "__row", F.explode(F.concat(windows, whole)).alias("gram"))
    held = each.groupBy("gram", "__part").agg(F.collect_list("__row").alias("rows")).withColumns({"n": F.size("rows"), "folder": _folder(F.col("gram"))})
    sorted_ = held.repartitionByRange("folder", "gram", "__part").sortWithinPartitions("folder", "gram", "__part")
    sorted_.write.partitionBy("folder").option("compression", "zstd").parquet(f"{folder}/windows")


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(spark.read.parquet(f"{folder}/columns").first()["json"]))).parquet(f"{folder}/symbols")


def _grams(term: str) -> list[str]:
    k = min(3, len(term))
    return list(dict.fromkeys(term[i : i + k] for i in range(len(term) - k + 1)))


def candidates(spark: SparkSession, folder: str, query: str) -> tuple[DataFrame, int]:
    """(__part, __row) of the symbols that hold the rarest window of some term, or have the query as a name; and a bound of their number."""
    index = spark.read.schema("gram string, __part int, rows array<bigint>, n int, folder int").parquet(f"{folder}/windows")
    terms, exact = list(dict.fromkeys(query_terms(query))), "=" + ascii_lower_text(query.strip())
    asked = list(dict.fromkeys([exact, *[g for t in terms for g in _grams(t)]]))
    mine = lambda grams: index.where(_folders(grams) & F.col("gram").isin(*grams))
    sizes = {r["gram"]: r["n"] for r in mine(asked).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each window of the query
    rarest = {min(_grams(t), key=lambda g: (sizes.get(g, 0), g)) for t in terms} | {exact}
    chosen = sorted(g for g in rarest if sizes.get(g))
    if not chosen:
        return index.select("__part", F.lit(0).cast("long").alias("__row")).limit(0), 0
    return mine(chosen).select("__part", F.explode("rows").alias("__row")).distinct(), sum(sizes[g] for g in chosen)


def lexical_top(spark: SparkSession, folder: str, query: str, limit: int) -> DataFrame:
    """The rows of ``search.top`` over the stored symbols. Few found ones are broadcast, and then only their folders are read."""
    found, bound = candidates(spark, folder, query)
    found = F.broadcast(found) if bound <= BROADCAST_ROWS else found
    rows = _symbols(spark, folder).join(found, ["__part", "__row"], "left_semi")
    return search.top(rows.drop("__part", "__row"), query, limit)
