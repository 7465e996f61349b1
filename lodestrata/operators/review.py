"""Review findings: verification, and export payloads with secrets hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import redact, token_slug, trim

# Levels of each export by severity, and the names that an export carries.
ANNOTATION = {"low": "notice", "medium": "warning"}
SARIF = {"low": "note", "medium": "warning"}
QUALITY = {"low": "minor", "medium": "major", "high": "critical"}
TOOL, RULE, RULE_NAME = "lodestrata", "lodestrata.review_finding", "Evidence-backed review finding"
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"


def _level(severity: Column, levels: dict[str, str], rest: str) -> Column:
    out = F
    for name, level in levels.items():
        out = out.when(severity == name, level)
    return out.otherwise(rest)


def annotation_level(severity: Column) -> Column:
    return _level(severity, ANNOTATION, "failure")


def sarif_level(severity: Column) -> Column:
    return _level(severity, SARIF, "error")


def quality_severity(severity: Column) -> Column:
    return _level(severity, QUALITY, "blocker")


def _text_error(value: Column, field: str) -> Column:
    return F.when(F.coalesce(trim(value), F.lit("")) == "", F.concat(F.lit("empty:"), F.lit(field)))


def _path_error(value: Column, field: str) -> Column:
    return F.coalesce(F.when(value.isNull(), F.lit(f"missing:{field}")), _text_error(value, field))


def _line_error(value: Column, field: str) -> Column:
    return F.when(value.isNull(), F.lit(f"missing:{field}")).when(value == 0, F.lit(f"range:{field}"))


def _first(items: Column, check) -> Column:
    found = F.filter(F.transform(items, check), lambda e: e.isNotNull())
    return F.try_element_at(found, F.lit(1))


def finding_error() -> Column:
    """The first rule that a finding breaks, as ``missing:``, ``empty:`` or ``range:`` and the field; null if none."""

    def evidence(e: Column) -> Column:
        return F.coalesce(
            _line_error(e["start_line"], "evidence.start_line"),
            _line_error(e["end_line"], "evidence.end_line"),
            F.when(e["end_line"] < e["start_line"], F.lit("range:evidence")),
            _path_error(e["file_path"], "evidence.file_path"),
            _text_error(e["summary"], "evidence.summary"),
        )

    def step(s: Column) -> Column:
        return F.coalesce(*[_text_error(s[f], f"impact_path.{f}") for f in ("source", "relation", "target")])

    return F.coalesce(
        _path_error(F.col("file_path"), "file_path"),
        _line_error(F.col("start_line"), "start_line"),
        _line_error(F.col("end_line"), "end_line"),
        F.when(F.col("end_line") < F.col("start_line"), F.lit("range:location")),
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, F.lit("missing:evidence")),
        _first(F.col("evidence"), evidence),
        F.when(F.coalesce(F.size("impact_path"), F.lit(0)) <= 0, F.lit("missing:impact_path")),
        _first(F.col("impact_path"), step),
        _text_error(F.col("recommendation"), "recommendation"),
        _text_error(F.col("title"), "title"),
    )


def verify(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified findings with trimmed texts, the batch's error: that of its first bad finding, else null).

    A batch is rejected whole by its error; callers that quarantine take the verified rows.
    """
    checked = findings.withColumn("error", finding_error())
    good = checked.where("error IS NULL").drop("error").withColumns(
        {
            "title": trim(F.col("title")),
            "recommendation": trim(F.col("recommendation")),
            "file_path": trim(F.col("file_path")),
            "evidence": F.transform("evidence", lambda e: e.withField("file_path", trim(e["file_path"])).withField("summary", trim(e["summary"]))),
        }
    )
    bad = F.col("error").isNotNull()
    return good, checked.agg(F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("ordinal"))).alias("error"))


def evidence_details() -> Column:
    line = lambda e: F.concat(e["file_path"], F.lit(":"), e["start_line"], F.lit("-"), e["end_line"], F.lit(" "), redact(e["summary"]))
    return F.array_join(F.transform("evidence", line), "\n")


def annotations(findings: DataFrame) -> DataFrame:
    return findings.select(
        "ordinal",
        F.col("file_path").alias("path"),
        "start_line",
        "end_line",
        annotation_level(F.col("severity")).alias("annotation_level"),
        redact(F.col("title")).alias("title"),
        redact(F.col("recommendation")).alias("message"),
        evidence_details().alias("raw_details"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region"))
    row = F.struct(
        F.lit(RULE).alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(redact(F.col("title")).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )
    return findings.select("ordinal", row.alias("result"))


def sarif_log(findings: DataFrame) -> DataFrame:
    """One JSON document for the findings of one review, which is small; results in order."""
    results = sarif_results(findings).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "result"))), lambda x: x["result"]).alias("results"))
    return results.select(F.to_json(_sarif(F.col("results"))).alias("sarif"))


def _sarif(results: Column) -> Column:
    rule = F.struct(F.lit(RULE).alias("id"), F.lit(RULE_NAME).alias("name"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.array(rule).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))
    return F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))


def sarif_lines(findings: DataFrame) -> DataFrame:
    """(place, ordinal, line): the document of ``sarif_log`` as lines, one for each finding, however many there are.

    In the order of (place, ordinal) the lines make the document; written in that order by ranges, it is a text
    in parts. Only the least ordinal is looked up, as the first result has no comma before it.
    """
    spark = findings.sparkSession
    frame = spark.range(1).select(F.split(F.to_json(_sarif(F.array().cast("array<string>"))), r'(?<="results":\[)').alias("halves"))
    edges = frame.select(F.posexplode("halves").alias("half", "line")).select(F.when(F.col("half") == 0, 0).otherwise(2).alias("place"), F.lit(None).cast("long").alias("ordinal"), "line")
    rows = sarif_results(findings).select(F.lit(1).alias("place"), F.col("ordinal").cast("long").alias("ordinal"), F.to_json("result").alias("line"))
    least = rows.agg(F.min("ordinal").alias("least")).withColumn("place", F.lit(1))  # one row
    commas = rows.join(F.broadcast(least), "place").withColumn("line", F.concat(F.when(F.col("ordinal") > F.col("least"), ",").otherwise(""), "line")).drop("least")
    return edges.unionByName(commas)


def discussions(findings: DataFrame) -> DataFrame:
    body = F.concat(redact(F.col("title")), F.lit("\n\nRecommendation: "), redact(F.col("recommendation")), F.lit("\n\nEvidence:\n"), evidence_details())
    return findings.select("ordinal", body.alias("body"), F.lit("text").alias("position_type"), F.col("file_path").alias("new_path"), F.col("start_line").alias("new_line"))


def code_quality(findings: DataFrame) -> DataFrame:
    title = redact(F.col("title"))
    return findings.select(
        "ordinal",
        title.alias("description"),
        F.lit(RULE).alias("check_name"),
        F.concat_ws(":", F.lit(TOOL), "file_path", F.col("start_line").cast("string"), token_slug(title)).alias("fingerprint"),
        quality_severity(F.col("severity")).alias("severity"),
        F.col("file_path").alias("path"),
        F.col("start_line").alias("begin"),
        F.col("end_line").alias("end"),
    )
