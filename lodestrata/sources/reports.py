"""Test and coverage reports: XML, JSON and text columns parsed by built-in expressions.

Every reader takes a DataFrame with a report key and its text, and gives flat rows. Malformed input gives
rows in ``bad_records`` style: where a whole report can't be read, ``error`` is set and the rest is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import seconds_to_millis
from lodestrata.storage import carried, ranged

RESULT_FIELDS = ["suite_name", "class_name", "name", "fqn", "file_path", "status", "duration_ms", "message"]

_MESSAGE = "struct<_message:string,_VALUE:string>"
_CASE = f"struct<_name:string,_classname:string,_file:string,_time:string,error:array<{_MESSAGE}>,failure:array<{_MESSAGE}>,skipped:array<{_MESSAGE}>>"
_SUITE = f"struct<_name:string,testcase:array<{_CASE}>>"


def _first_message(kind: str) -> Column:
    return F.coalesce(F.col(f"c.{kind}")[0]["_message"], F.col(f"c.{kind}")[0]["_VALUE"])


def junit(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """One row for each test case. Errors count before failures, these before skips; the message follows."""
    options = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}
    many = F.from_xml(F.col(text), f"struct<testsuite:array<{_SUITE}>>", options)
    one = F.from_xml(F.col(text), _SUITE, options)
    suites = F.when(F.contains(F.col(text), F.lit("<testsuites")), many["testsuite"]).otherwise(F.array(one))
    cases = reports.select(key, F.explode(suites).alias("s")).select(key, F.col("s._name").alias("suite_name"), F.posexplode("s.testcase").alias("pos", "c"))
    return cases.select(key, "suite_name", *_case_columns())


def _case_columns() -> list[Column]:
    """The fields of a test case c, but for its suite."""
    has = lambda kind: F.size(F.coalesce(F.col(f"c.{kind}"), F.array().cast(f"array<{_MESSAGE}>"))) > 0
    given = F.col("c._classname")
    return [
        given.alias("class_name"),
        F.col("c._name").alias("name"),
        F.when(given != "", F.concat(given, F.lit("::"), F.col("c._name"))).otherwise(F.col("c._name")).alias("fqn"),
        F.col("c._file").alias("file_path"),
        F.when(has("error"), "error").when(has("failure"), "failed").when(has("skipped"), "skipped").otherwise("passed").alias("status"),
        seconds_to_millis(F.col("c._time")).alias("duration_ms"),
        F.when(has("error"), _first_message("error")).when(has("failure"), _first_message("failure")).when(has("skipped"), _first_message("skipped")).alias("message"),
    ]


def pytest_json(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """One row for each test. The part before the name is its class where it starts with a capital."""
    schema = "struct<tests:array<struct<nodeid:string,outcome:string,call:struct<crash:struct<message:string>>>>>"
    tests = reports.select(key, F.posexplode(F.from_json(F.col(text), schema)["tests"]).alias("pos", "t"))
    parts = F.split(F.col("t.nodeid"), "::")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    spot = F.greatest(F.size(rest) - 1, F.lit(1))
    owner = F.try_element_at(rest, spot)
    status = F.col("t.outcome")
    return tests.select(
        key,
        F.lit("pytest").alias("suite_name"),
        F.when(owner.rlike("^[A-Z]"), owner).alias("class_name"),
        F.element_at(parts, -1).alias("name"),
        F.col("t.nodeid").alias("fqn"),
        F.element_at(parts, 1).alias("file_path"),
        F.when(status.isin("passed", "failed", "skipped"), status).when(status == "xfailed", "skipped").otherwise("error").alias("status"),
        F.lit(None).cast("long").alias("duration_ms"),
        F.col("t.call.crash.message").alias("message"),
    )


#: Levels of nested suites that one schema reads; what lies deeper stays text, and is read by the next round.
DEPTH = 8


def _playwright_suite() -> str:
    result = "struct<status:string,duration:bigint,error:struct<message:string>,errors:array<struct<message:string>>>"
    spec = f"struct<title:string,tests:array<struct<projectName:string,status:string,results:array<{result}>>>>"
    suite = f"struct<title:string,file:string,specs:array<{spec}>,suites:array<string>>"
    for _ in range(DEPTH - 1):
        suite = f"struct<title:string,file:string,specs:array<{spec}>,suites:array<{suite}>>"
    return suite


def playwright_json(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """One row for each test of each spec; suites may nest to any depth and inherit their file.

    The worst result gives the status, or the test's own where there is none; durations add up. Whether any
    suite lies deeper than ``DEPTH`` levels is looked up once for every so many levels.
    """
    suite = _playwright_suite()
    level = reports.select(key, F.explode(F.from_json(F.col(text), f"struct<suites:array<{suite}>>")["suites"]).alias("s"))
    level = level.select(key, "s", F.col("s.file").alias("file"), F.array(F.col("s.title")).alias("titles"))
    inner = lambda rows: rows.select(
        key, F.col("n").alias("s"), F.coalesce("n.file", "file").alias("file"), F.concat("titles", F.array("n.title")).alias("titles")
    )
    found, left = None, True
    while left:
        for depth in range(DEPTH):
            here = level.select(key, "file", "titles", F.explode("s.specs").alias("spec"))
            found = here if found is None else found.unionByName(here)
            below = level.select(key, "file", "titles", F.explode("s.suites").alias("n"))
            if depth < DEPTH - 1:
                level = inner(below)
        left = not below.isEmpty()
        level = inner(below.withColumn("n", F.from_json("n", suite)))
    rows = found.select(key, "file", "titles", F.col("spec.title").alias("name"), F.explode("spec.tests").alias("t"))
    worst = lambda kinds: F.exists("t.results", lambda r: r["status"].isin(*kinds))
    own = F.col("t.status")
    from_test = F.when(own.isin("expected", "flaky", "passed"), "passed").when(own == "skipped", "skipped").when(own.isin("unexpected", "failed"), "failed").otherwise("error")
    status = (
        F.when(F.size(F.coalesce("t.results", F.array())) <= 0, from_test)
        .when(F.exists("t.results", lambda r: ~r["status"].isin("passed", "expected", "flaky", "skipped", "failed", "unexpected")), "error")
        .when(worst(("failed", "unexpected")), "failed")
        .when(worst(("skipped",)), "skipped")
        .otherwise("passed")
    )
    titles = F.filter("titles", lambda x: x.isNotNull() & (x != ""))
    owner = F.when(F.size(titles) > 0, F.array_join(titles, "::"))
    messages = F.filter(F.transform("t.results", lambda r: F.coalesce(r["error"]["message"], r["errors"][0]["message"])), lambda m: m.isNotNull())
    return rows.select(
        key,
        F.lit("playwright").alias("suite_name"),
        owner.alias("class_name"),
        "name",
        F.concat_ws("::", "file", owner, "name", F.when(F.col("t.projectName") != "", F.col("t.projectName"))).alias("fqn"),
        F.col("file").alias("file_path"),
        status.alias("status"),
        F.aggregate(F.coalesce("t.results", F.array()), F.lit(0).cast("long"), lambda a, r: F.try_add(a, F.coalesce(r["duration"], F.lit(0).cast("long")))).alias("duration_ms"),
        F.try_element_at(messages, F.lit(1)).alias("message"),
    )


def go_test_json(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """One row for each package and test that ended, with all its output in order, plus ``error`` rows.

    The last pass, fail or skip gives the status and the time. A line that is no JSON makes its report an
    error row that names the line, and the report gives no tests.
    """
    schema = "struct<Action:string,Package:string,Test:string,Elapsed:string,Output:string>"
    rows = reports.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), r"\r?\n", -1)).alias("pos", "raw")).where(F.trim("raw") != "")
    rows = rows.withColumn("e", F.from_json("raw", schema)).withColumn("bad", F.coalesce(~F.is_valid_json("raw") if hasattr(F, "is_valid_json") else F.get_json_object("raw", "$").isNull(), F.lit(True)))
    broken = rows.groupBy(key).agg(F.min(F.when(F.col("bad"), F.col("pos") + 1)).alias("line"))
    ends = F.col("e.Action").isin("pass", "fail", "skip")
    kept = rows.where("e.Test IS NOT NULL")
    told = kept.groupBy(key, F.col("e.Package").alias("package"), F.col("e.Test").alias("test")).agg(
        F.max_by(F.when(ends, F.struct(F.col("e.Action").alias("action"), F.col("e.Elapsed").alias("elapsed"))), F.when(ends, F.col("pos"))).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("e.Output").isNotNull(), F.struct("pos", F.col("e.Output").alias("text"))))).alias("outputs"),
    )
    good = told.where("last IS NOT NULL").join(broken.where("line IS NULL"), key, "left_semi")
    output = F.array_join(F.transform("outputs", lambda o: o["text"]), "")
    tests = good.select(
        key,
        F.lit("go_test").alias("suite_name"),
        F.col("package").alias("class_name"),
        F.col("test").alias("name"),
        F.concat_ws("::", "package", "test").alias("fqn"),
        F.lit(None).cast("string").alias("file_path"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("pass", "passed", "fail", "failed", "skip", "skipped")]), F.col("last.action")).alias("status"),
        seconds_to_millis(F.col("last.elapsed")).alias("duration_ms"),
        F.when(output != "", output).alias("message"),
        F.lit(None).cast("string").alias("error"),
    )
    wrong = broken.where("line IS NOT NULL").select(
        key, *[F.lit(None).cast("long" if f == "duration_ms" else "string").alias(f) for f in RESULT_FIELDS], F.concat(F.lit("line "), "line").alias("error")
    )
    return tests.unionByName(wrong)


def lcov(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """(key, file_path, start_line, end_line, hit_count, error): one row for each line record of a file.

    A record of three fields is an error row, as is one that is no number; lines before a file drop.
    """
    rows = reports.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "raw")).select(key, "pos", F.trim("raw").alias("line"))
    return lcov_lines(rows, key)


def lcov_lines(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """The rows of ``lcov`` from ``rows`` (key, pos, line), pos a number from 0. The file of a line is carried from range to range, so one report of any length is worked on by all tasks."""
    rows = ranged(rows, [key, "pos"], "lcov")
    opens, ends = F.col("line").startswith("SF:"), F.col("line") == "end_of_record"
    state = F.when(opens, F.struct(F.substring("line", 4, 1 << 20).alias("f"))).when(ends, F.struct(F.lit(None).cast("string").alias("f")))
    marked = carried(rows, key, "spot", file_path=state).withColumn("file_path", F.col("file_path.f")).where(F.col("line").startswith("DA:"))
    body = F.substring("line", 4, 1 << 20)
    number = F.split_part(body, F.lit(","), F.lit(1)).try_cast("int")
    hits = F.when(F.instr(body, ",") > 0, F.substring(body, F.instr(body, ",") + 1, F.length(body))).try_cast("long")
    bad = number.isNull() | hits.isNull() | (number < 0) | (hits < 0)
    return marked.where(bad | F.col("file_path").isNotNull()).select(
        key,
        "file_path",
        F.when(~bad, number).alias("start_line"),
        F.when(~bad, number).alias("end_line"),
        F.when(~bad, hits).alias("hit_count"),
        F.when(bad, F.concat(F.lit("line "), F.col("pos") + 1)).alias("error"),
    )


def cobertura(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """(key, file_path, start_line, end_line, hit_count): lines of each class; classes are not merged."""
    schema = "struct<packages:struct<package:array<struct<classes:struct<class:array<struct<_filename:string,lines:struct<line:array<struct<_number:string,_hits:string>>>>>>>>>>"
    parsed = F.from_xml(F.col(text), schema, {"attributePrefix": "_"})
    classes = reports.select(key, F.explode(parsed["packages"]["package"]).alias("p")).select(key, F.explode("p.classes.class").alias("c"))
    rows = classes.select(key, F.col("c._filename").alias("file_path"), F.explode("c.lines.line").alias("l"))
    line = F.col("l._number").try_cast("int")
    return rows.select(key, "file_path", line.alias("start_line"), line.alias("end_line"), F.col("l._hits").try_cast("long").alias("hit_count"))


def jacoco(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """(key, file_path, start_line, end_line, hit_count): covered instructions and branches of each line."""
    schema = "struct<package:array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:string,_ci:string,_cb:string>>>>>>>"
    clean = F.regexp_replace(F.col(text), r"(?s)<!DOCTYPE[^>]*>", "")
    packages = reports.select(key, F.explode(F.from_xml(clean, schema, {"attributePrefix": "_"})["package"]).alias("p"))
    files = packages.select(key, F.col("p._name").alias("package"), F.explode("p.sourcefile").alias("f"))
    rows = files.select(key, _jacoco_path(F.col("package"), F.col("f._name")), F.explode("f.line").alias("l"))
    return rows.select(key, "file_path", *_jacoco_line())


def _jacoco_path(package: Column, name: Column) -> Column:
    return F.when(package != "", F.concat_ws("/", package, name)).otherwise(name).alias("file_path")


def _jacoco_line() -> list[Column]:
    """The line l, and the instructions and branches covered in it."""
    line = F.col("l._nr").try_cast("int")
    covered = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    total = F.coalesce(F.try_add(covered("l._ci"), covered("l._cb")), F.lit((1 << 63) - 1))
    return [line.alias("start_line"), line.alias("end_line"), total.alias("hit_count")]


# --- reports as files -------------------------------------------------------------------------

#: The start of a tag, up to its end and with it; a quoted value may hold any character but its quote.
_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_CORRUPT = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def elements(spark: SparkSession, path: str, tag: str, key: str = "report_id") -> DataFrame:
    """(key, pos, head, element, after) of every ``tag`` in XML files of any size; the key is the file's path.

    Files are cut where the tag opens, so a file is split over tasks and none holds more than one element. ``head``
    is what stands before the first element (one row without an element), ``after`` what follows one. An element that
    never ends is null. The tag must not nest in itself or stand in comments.
    """
    read = spark.read.option("lineSep", f"<{tag}").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = read.select(F.col("_metadata.file_path").alias(key), place.alias("pos"), "value", (F.col("_metadata.file_block_start") == 0).alias("leads"))
    first = F.col("leads") & (F.col("value").rlike(r"^\s*(?:\x{FEFF})?<[?!a-zA-Z]") | (F.trim("value") == ""))
    is_tag = F.col("value").rlike(r"^[\s/>]") & ~first  # else the name only begins like the tag
    whole = F.regexp_extract("value", rf"(?s)^({_TAG.removesuffix('>')}(?<=/)>|.*?</{tag}\s*>)", 1)
    rows, whole = rows.withColumn("whole", whole), F.col("whole")
    return rows.select(
        key, "pos", F.when(~is_tag, F.col("value")).alias("head"), is_tag.alias("is_element"), F.when(is_tag & (whole != ""), F.concat(F.lit(f"<{tag}"), whole)).alias("element"),
        F.when(is_tag, F.substring("value", F.length(whole) + 1, F.length("value"))).otherwise(F.col("value")).alias("after"),
    )


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """The elements of ``rows`` with e, the parsed one, and error for one that can't be read.

    The parsed one comes out of an explode of one, below which no filter on it goes: it would parse every element again.
    """
    given = rows.where("is_element").withColumn("e", F.explode(F.array(F.from_xml("element", f"struct<{schema},_broken:string>", _CORRUPT))))
    broken = F.col("element").isNull() | F.col("e").isNull() | F.col("e._broken").isNotNull()
    return given.withColumn("error", F.when(broken, F.concat(F.lit("broken element: "), F.substring(F.coalesce("element", "after"), 1, 60))))


def _line_rows(parsed: DataFrame, lines: str, fields: str, key: str, path: Column) -> DataFrame:
    """(key, file_path, l, error): a row for each of the ``lines`` of an element, one without a line for an element that can't be read."""
    sound = F.col("error").isNull()
    each = F.when(sound, F.col(lines)).otherwise(F.array(F.lit(None).cast(fields)))
    return parsed.select(key, F.when(sound, path).alias("file_path"), F.explode(each).alias("l"), "error")


def _last_name(text: Column, tag: str) -> Column:
    """The name attribute of the last ``tag`` that opens in a text, unescaped; null where none does."""
    opened = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"<{tag}(?=[\s>])({_TAG})"), F.lit(1)), F.lit(-1))
    value = F.regexp_extract(opened, r"""(?:^|\s)name\s*=\s*("[^"]*"|'[^']*')""", 1)
    plain = F.substring(value, 2, F.greatest(F.length(value) - 2, F.lit(0)))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    return F.when(opened.isNotNull(), F.struct(F.when(value != "", plain).alias("name")))


def _named(rows: DataFrame, tag: str, key: str) -> DataFrame:
    """``rows`` with owner: the name of the ``tag`` that last opened before each element, in its file."""
    placed = ranged(rows, [key, "pos"], "elements").withColumn("opens", _last_name(F.col("after"), tag))
    # What follows an element counts from the next one on.
    return carried(placed, key, "spot", inclusive=False, owner=F.col("opens")).withColumn("owner", F.col("owner.name"))


def junit_files(spark: SparkSession, path: str, key: str = "report_id") -> DataFrame:
    """The rows of ``junit`` with error, from files of any size: a test case belongs to the suite that opened last before it.

    A test case that can't be read is a row with its error alone; the others of its file stay.
    """
    cases = _parsed(_named(elements(spark, path, "testcase", key), "testsuite", key), _CASE.removeprefix("struct<").removesuffix(">"))
    rows = cases.select(key, F.col("owner").alias("suite_name"), F.col("e").alias("c"), "error")
    return rows.select(key, "suite_name", *_case_columns(), "error").withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in RESULT_FIELDS})


def cobertura_files(spark: SparkSession, path: str, key: str = "report_id") -> DataFrame:
    """The rows of ``cobertura`` with error, from files of any size, a class at a time."""
    line = "struct<_number:string,_hits:string>"
    classes = _parsed(elements(spark, path, "class", key), f"_filename:string,lines:struct<line:array<{line}>>")
    number = F.col("l._number").try_cast("int")
    rows = _line_rows(classes, "e.lines.line", line, key, F.col("e._filename"))
    return rows.select(key, "file_path", number.alias("start_line"), number.alias("end_line"), F.col("l._hits").try_cast("long").alias("hit_count"), "error")


def jacoco_files(spark: SparkSession, path: str, key: str = "report_id") -> DataFrame:
    """The rows of ``jacoco`` with error, from files of any size, a source file at a time, in the package that opened last before it."""
    line = "struct<_nr:string,_ci:string,_cb:string>"
    files = _parsed(_named(elements(spark, path, "sourcefile", key), "package", key), f"_name:string,line:array<{line}>")
    rows = _line_rows(files, "e.line", line, key, _jacoco_path(F.col("owner"), F.col("e._name")))
    return rows.select(key, "file_path", *[F.when(F.col("error").isNull(), c).alias(n) for c, n in zip(_jacoco_line(), ("start_line", "end_line", "hit_count"), strict=True)], "error")


def status_counts(results: DataFrame, runs: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, total, passed, failed, error, skipped, status): counts of every run, also of empty ones."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    told = results.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[count(s) for s in ("passed", "failed", "error", "skipped")])
    full = runs.select(key).distinct().join(told, key, "left").na.fill(0)
    return full.withColumn("status", roll_up())


def roll_up() -> Column:
    """Any error, else any failure, else all skipped, else passed; an empty run has passed."""
    return (
        F.when(F.col("error") > 0, "error")
        .when(F.col("failed") > 0, "failed")
        .when((F.col("total") > 0) & (F.col("skipped") == F.col("total")), "skipped")
        .otherwise("passed")
    )


def segment_count(segments: DataFrame, key: str = "report_id") -> DataFrame:
    return segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"))
