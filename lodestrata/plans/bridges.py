"""The driver's tables seen as evidence tables: plain projections, written alike for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts as symbols: the brand is the file, the size the length; keys of ten are modules, even ones tests.
SYMBOLS = """
  concat('v', p_partkey) AS versioned_symbol_id, concat('s', p_partkey) AS stable_symbol_id,
  'repo' AS repo_id, 'c0' AS commit_sha, p_brand AS file_path, 'typescript' AS language,
  CASE WHEN p_partkey % 10 = 0 THEN 'module' WHEN p_partkey % 2 = 0 THEN 'test_case' ELSE 'function' END AS kind,
  p_name AS name, concat(p_type, '::', p_name) AS fqn,
  CAST(p_partkey % 50 + 1 AS INT) AS start_line, CAST(p_partkey % 7 AS INT) AS start_col,
  CAST(p_partkey % 50 + p_size AS INT) AS end_line, CAST(p_partkey % 7 + p_size % 5 AS INT) AS end_col,
  p_partkey AS ordinal"""
SYM = f"sym AS (SELECT {SYMBOLS} FROM part)"

#: Line items as resolved calls: the part calls the part after its supplier's key.
CALLS = """
  l_orderkey * 10 + l_linenumber AS ordinal, concat('v', l_partkey) AS source_symbol_id,
  concat('v', l_suppkey) AS target_symbol_id, 'repo' AS repo_id, 'c0' AS commit_sha,
  concat('f', l_linenumber) AS file_path, CAST(l_quantity AS INT) AS start_line, l_linenumber AS start_col,
  CAST(l_quantity AS INT) + 1 AS end_line, l_linenumber + 3 AS end_col"""
CAL = f"""cal AS (SELECT {CALLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS twin FROM lineitem) WHERE twin = 1)"""

#: Line items as unresolved calls: the file is the part's brand, the line its quantity, the callee a part name.
RAW = """raw AS (SELECT call_id, p_brand AS file_path, line, t_name AS target_name FROM (
  SELECT l_orderkey * 10 + l_linenumber AS call_id, l_partkey, CAST(l_quantity AS INT) AS line, l_suppkey AS t_key FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS twin FROM lineitem)
  WHERE twin = 1) l
  JOIN part p ON p.p_partkey = l.l_partkey JOIN (SELECT p_partkey AS t_key2, p_name AS t_name FROM part) t ON t.t_key2 = l.t_key)"""

#: Events as jobs of a queue named by their type.
JOBS = """
  event_id AS job_id, event_type AS queue, CAST(event_id % 3 AS INT) AS priority, ts AS run_after, ts AS created_at, ts AS updated_at,
  CASE WHEN event_id % 7 = 0 THEN 'leased' WHEN event_id % 7 = 1 THEN 'succeeded' WHEN event_id % 7 = 2 THEN 'failed'
       WHEN event_id % 7 = 3 THEN 'dead_lettered' WHEN event_id % 7 = 4 THEN 'cancelled' ELSE 'queued' END AS state,
  CAST(event_id % 4 AS INT) AS attempts, 3 AS max_attempts, 30 AS backoff_seconds, user_id AS generation_id"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_columns(SYMBOLS))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("*", "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS twin")
    return rows.where("twin = 1").selectExpr(*_columns(CALLS))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS twin").where("twin = 1")
    part = table(spark, sf_dir, "part")
    own = part.selectExpr("p_partkey AS l_partkey", "p_brand AS file_path")
    target = part.selectExpr("p_partkey AS l_suppkey", "p_name AS target_name")
    return rows.join(own, "l_partkey").join(target, "l_suppkey").selectExpr(
        "l_orderkey * 10 + l_linenumber AS call_id", "file_path", "CAST(l_quantity AS INT) AS start_line", "0 AS start_col", "CAST(l_quantity AS INT) AS end_line", "1 AS end_col", "target_name"
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(JOBS))


def _columns(projection: str) -> list[str]:
    """Split a projection at its top-level commas."""
    out, depth, now, quoted = [], 0, "", False
    for c in projection.strip():
        if c == "'":
            quoted = not quoted
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and depth == 0 and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
