from lodestrata.sources import reports


def one(spark, text):
    return spark.createDataFrame([(1, text)], "report_id int, text string")


def test_junit(spark):
    xml = '<testsuite name="s"><testcase name="ok" classname="C" time="0.0129"/><testcase name="bad" classname=""><failure message="boom">long</failure></testcase><testcase name="skip"><skipped/></testcase></testsuite>'
    got = reports.junit(one(spark, xml)).collect()
    assert [(r.fqn, r.status, r.duration_ms, r.message) for r in got] == [("C::ok", "passed", 12, None), ("bad", "failed", None, "boom"), ("skip", "skipped", None, None)]
    counts = reports.status_counts(reports.junit(one(spark, xml)), one(spark, xml)).first()
    assert (counts.total, counts.passed, counts.failed, counts.skipped, counts.status) == (3, 1, 1, 1, "failed")
    many = "<testsuites>" + xml + xml + "</testsuites>"
    assert reports.junit(one(spark, many)).count() == 6


def test_pytest(spark):
    text = '{"tests":[{"nodeid":"t/a.py::TestX::test_a","outcome":"passed"},{"nodeid":"t/a.py::test_b","outcome":"failed","call":{"crash":{"message":"no"}}},{"nodeid":"t/a.py::Upper","outcome":"odd"}]}'
    got = reports.pytest_json(one(spark, text)).collect()
    assert [(r.class_name, r.name, r.status, r.message, r.duration_ms) for r in got] == [("TestX", "test_a", "passed", None, None), (None, "test_b", "failed", "no", None), ("Upper", "Upper", "error", None, None)]


def test_playwright(spark):
    text = '{"suites":[{"title":"login","file":"a.spec.ts","specs":[{"title":"works","tests":[{"projectName":"chrome","status":"expected","results":[{"status":"passed","duration":12}]}]}],"suites":[{"title":"","specs":[{"title":"fails","tests":[{"projectName":"","status":"flaky","results":[{"status":"failed","duration":3,"error":{"message":"m"}},{"status":"passed","duration":4}]},{"projectName":"","status":"skipped","results":[]}]}]}]}]}'
    got = sorted(reports.playwright_json(one(spark, text)).collect(), key=lambda r: (r.fqn, r.status))
    assert [(r.fqn, r.status, r.duration_ms, r.message) for r in got] == [("a.spec.ts::login::fails", "failed", 7, "m"), ("a.spec.ts::login::fails", "skipped", 0, None), ("a.spec.ts::login::works::chrome", "passed", 12, None)]


def test_go(spark):
    lines = ['{"Action":"run","Package":"p","Test":"A"}', '{"Action":"output","Package":"p","Test":"A","Output":"x\\n"}', '{"Action":"pass","Package":"p","Test":"A","Elapsed":0.012}', '{"Action":"fail","Package":"p","Test":"B","Elapsed":1}', '{"Action":"skip","Package":"p","Test":"C"}', '{"Action":"run","Package":"p","Test":"D"}', '{"Action":"pass","Package":"p"}']
    got = sorted(reports.go_test_json(one(spark, "\n".join(lines) + "\n")).collect(), key=lambda r: r.fqn)
    assert [(r.fqn, r.status, r.duration_ms, r.message) for r in got] == [("p::A", "passed", 12, "x\n"), ("p::B", "failed", 1000, None), ("p::C", "skipped", None, None)]
    bad = reports.go_test_json(one(spark, lines[0] + "\nnot json\n")).collect()
    assert [r.error for r in bad] == ["line 2"]


def test_lcov(spark):
    text = "DA:9,9\nTN:\nSF:a.rs\nDA:3,1\nDA:4,0\nLH:1\nend_of_record\nDA:7,7\nSF:b.rs\nDA:5,2\nSF:c.rs\nDA:1,1,abc\n"
    got = reports.lcov(one(spark, text)).collect()
    assert [(r.file_path, r.start_line, r.hit_count) for r in got if not r.error] == [("a.rs", 3, 1), ("a.rs", 4, 0), ("b.rs", 5, 2)]
    assert [r.error for r in got if r.error] == ["line 12"]


def test_cobertura_and_jacoco(spark):
    xml = '<coverage><packages><package><classes><class filename="a.py"><lines><line number="3" hits="1"/><line number="4" hits="0"/></lines></class></classes></package></packages></coverage>'
    assert [(r.file_path, r.start_line, r.hit_count) for r in reports.cobertura(one(spark, xml)).collect()] == [("a.py", 3, 1), ("a.py", 4, 0)]
    xml = '<?xml version="1.0"?><!DOCTYPE report PUBLIC "a" "b"><report name="r"><package name="com/x"><sourcefile name="A.java"><line nr="5" mi="0" ci="3" mb="0" cb="1"/></sourcefile></package></report>'
    assert [(r.file_path, r.start_line, r.hit_count) for r in reports.jacoco(one(spark, xml)).collect()] == [("com/x/A.java", 5, 4)]
    assert reports.segment_count(reports.jacoco(one(spark, xml))).first().segments == 1


def written(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body, encoding="utf-8", newline="")
    return str(path)


def test_report_files_give_the_rows_of_their_texts(spark, tmp_path):
    """Split into many small parts, so that suites, packages and elements are cut anywhere."""
    cases = lambda k: "".join(
        f'<testcase name="t{i} &lt;x&gt;" classname="{"C" if i % 2 else ""}" file="f.py" time="0.0{i}" note="a > b"/>\n' if i % 3 else f"<testcase name='t{i}'>\n  <failure message='m{i} &amp; é'>body</failure>\n</testcase >" for i in range(k)
    )
    junit = "<?xml version='1.0'?>\n<testsuites name='all'>" + "".join(f'<testsuite name="s{k} &amp; co" tests="9">\n<properties/>{cases(k)}<system-out>x</system-out></testsuite>\n' for k in range(1, 40)) + "</testsuites>"
    cob = "<coverage><packages>" + "".join(f'<package name="p{k}"><classes>' + "".join(f'<class name="c" filename="p{k}/{c}.py"><methods/><lines>' + "".join(f'<line number="{n}" hits="{n * c}"/>' for n in range(1, 9)) + "</lines></class>" for c in range(k % 4)) + "</classes></package>" for k in range(40)) + "</packages></coverage>"
    jac = '<?xml version="1.0"?><!DOCTYPE report PUBLIC "a" "b"><report name="r">' + "".join(f'<package name="{"com/x" + str(k) if k % 5 else ""}"><class name="com/x/A"/>' + "".join(f'<sourcefile name="A{c}.java"><line nr="{c + 5}" mi="0" ci="{k}" mb="0" cb="1"/></sourcefile>' for c in range(k % 4)) + "</package>" for k in range(60)) + "</report>"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name, body, whole, files in (("j.xml", junit, reports.junit, reports.junit_files), ("c.xml", cob, reports.cobertura, reports.cobertura_files), ("k.xml", jac, reports.jacoco, reports.jacoco_files)):
            path = written(tmp_path, name, body)
            want = whole(one(spark, body)).drop("report_id")
            got = files(spark, path)
            assert spark.read.option("lineSep", "<x").text(path).rdd.getNumPartitions() > 5
            assert got.where("error IS NOT NULL").count() == 0
            assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_broken_element_is_an_error_and_the_others_stay(spark, tmp_path):
    good = '<testcase name="ok" classname="C"/>'
    path = written(tmp_path, "j.xml", f'<testsuite name="s">{good}<testcase name="bad"><failure></testcase>{good}<testcase name="cut" ')
    got = reports.junit_files(spark, path).collect()
    assert sorted((r.suite_name, r.name) for r in got if not r.error) == [("s", "ok"), ("s", "ok")]
    assert len([r for r in got if r.error]) == 2 and all(r.error.startswith("broken element: ") and r.name is None for r in got if r.error)
    path = written(tmp_path, "c.xml", '<classes><class filename="a.py"><lines><line number="3" hits="1"/></lines></class><class filename="b.py"><lines><line number="x" hits=1></lines></class></classes>')
    got = reports.cobertura_files(spark, path).collect()
    assert [(r.file_path, r.start_line) for r in got if not r.error] == [("a.py", 3)] and len([r for r in got if r.error]) == 1
    assert reports.junit_files(spark, written(tmp_path, "e.xml", "")).count() == 0 and reports.jacoco_files(spark, written(tmp_path, "n.xml", "<report/>")).count() == 0


def test_long_lcov_reports_are_scanned_by_ranges(spark):
    body = "\n".join(f"SF:f{i // 7}.rs" if i % 7 == 0 else "end_of_record" if i % 7 == 6 else f"DA:{i},{i % 3}" for i in range(7000))
    rows = spark.createDataFrame([(1, body), (2, "DA:1,1\n" + body), (None, body)], "report_id int, text string").repartition(3)
    got = reports.lcov(rows)
    assert got.groupBy("report_id").count().collect() and got.count() == 3 * 5000
    assert got.where("file_path <> concat('f', cast((start_line - start_line % 7) / 7 AS int), '.rs')").count() == 0


def test_empty_run_has_passed(spark):
    runs = one(spark, "")
    results = spark.createDataFrame([], "report_id int, status string")
    assert reports.status_counts(results, runs).first().status == "passed"


def test_playwright_suites_of_any_depth(spark):
    import json

    suite = {"title": "t20", "specs": [{"title": "deep", "tests": [{"projectName": "p", "status": "expected", "results": [{"status": "passed", "duration": 5}]}]}]}
    for level in range(19, -1, -1):
        suite = {"title": f"t{level}", "suites": [suite], "specs": [{"title": f"s{level}", "tests": [{"projectName": "", "status": "expected", "results": []}]}]}
    rows = reports.playwright_json(one(spark, json.dumps({"suites": [{**suite, "file": "a.ts"}]}))).collect()
    assert {r.name for r in rows} == {"deep", *(f"s{i}" for i in range(20))}
    deep = next(r for r in rows if r.name == "deep")
    assert deep.class_name == "::".join(f"t{i}" for i in range(21)) and deep.file_path == "a.ts" and deep.duration_ms == 5


def test_elements_of_files_are_parsed_once(spark, tmp_path):
    """A filter on the error is not pushed below the parse, and sound and broken elements come from one pass."""
    bodies = {
        "cobertura_files": '<coverage><packages><package><classes><class filename="a"><lines><line number="1" hits="2"/><line number="x" hits="3"/></lines></class><class filename="none"><lines/></class><class filename="b"><lines><line number="7"</lines></class></classes></package></packages></coverage>',
        "jacoco_files": '<report><package name="p"><sourcefile name="a"><line nr="1" ci="2" cb="0"/><line nr="x" ci="3"/></sourcefile><sourcefile name="none"/><sourcefile name="b"><line nr="7"</sourcefile></package></report>',
        "junit_files": '<testsuite name="s"><testcase name="a"/><testcase name="b"><failure</testcase></testsuite>',
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
        found = getattr(reports, name)(spark, str(tmp_path / name))
        plan = found.where("error IS NULL")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml(") == 1, name
        rows = found.collect()
        assert [r.error is None for r in rows].count(False) == 1
        if name != "junit_files":
            file, broken = {"cobertura_files": "a", "jacoco_files": "p/a"}[name], next(r for r in rows if r.error)
            assert {(r.file_path, r.start_line, r.end_line, r.hit_count) for r in rows if not r.error} == {(file, 1, 1, 2), (file, None, None, 3)}
            assert (broken.file_path, broken.start_line, broken.end_line, broken.hit_count) == (None, None, None, None) and broken.error.startswith("broken element: <")
