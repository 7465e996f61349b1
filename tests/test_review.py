import json

from lodestrata.operators import review

SCHEMA = "ordinal int, title string, severity string, file_path string, start_line int, end_line int, evidence array<struct<file_path:string,start_line:int,end_line:int,summary:string>>, impact_path array<struct<source:string,relation:string,target:string>>, recommendation string"
GOOD = (1, " token=abc leaks ", "high", " a.rs ", 3, 5, [("a.rs", 3, 4, "password=x")], [("a", "calls", "b")], " rotate ghp_123 ")


def with_(**changes):
    names = [f.split()[0] for f in ("ordinal title severity file_path start_line end_line evidence impact_path recommendation").split()]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_first_broken_rule(spark):
    rows = [GOOD, with_(file_path=None), with_(file_path=" "), with_(start_line=0), with_(end_line=2), with_(evidence=[]), with_(evidence=[("a", 3, 1, "s")]), with_(evidence=[("a", 1, 1, " ")]), with_(impact_path=[]), with_(recommendation=" "), with_(title="\u3000")]
    got = [r.e for r in spark.createDataFrame(rows, SCHEMA).coalesce(1).select(review.finding_error().alias("e")).collect()]
    assert got == [None, "missing:file_path", "empty:file_path", "range:start_line", "range:location", "missing:evidence", "range:evidence", "empty:evidence.summary", "missing:impact_path", "empty:recommendation", "empty:title"]


def test_batch_error_and_exports(spark):
    df = spark.createDataFrame([GOOD, with_(ordinal=2, impact_path=[]), with_(ordinal=3, title="")], SCHEMA)
    good, error = review.verify(df)
    assert error.first().error == "missing:impact_path" and good.first().title == "token=abc leaks"
    note = review.annotations(good).first()
    assert (note.annotation_level, note.title, note.message, note.raw_details) == ("failure", "token=[redacted] leaks", "rotate [redacted]", "a.rs:3-4 password=[redacted]")
    log = json.loads(review.sarif_log(good).first().sarif)
    result = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "endLine": 5}
    quality = review.code_quality(good).first()
    assert quality.severity == "critical" and quality.fingerprint.endswith(":a.rs:3:token--redacted--leaks")
    assert "Evidence:\na.rs:3-4" in review.discussions(good).first().body


def test_a_log_as_lines_is_the_log(spark):
    df = spark.createDataFrame([with_(ordinal=i, title=f"t{i}") for i in (5, 3, 9)], SCHEMA)
    lines = sorted(review.sarif_lines(df).collect(), key=lambda r: (r.place, r.ordinal or 0))
    assert json.loads("".join(r.line for r in lines)) == json.loads(review.sarif_log(df).first().sarif)
    none = sorted(review.sarif_lines(df.limit(0)).collect(), key=lambda r: r.place)
    assert json.loads("".join(r.line for r in none))["runs"][0]["results"] == []
