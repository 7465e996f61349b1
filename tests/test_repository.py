import json

import pytest

from lodestrata.repository import Repository, as_json

FILES = {
    "src/lib.rs": "mod trestle;\nfn total() -> i32 { load_beam(1) }\n",
    "src/trestle.rs": "fn load_beam(v: i32) -> i32 { v + 1 }\n#[test]\nfn load_beam_adds_mass() { assert_eq!(load_beam(1), 2); }\n",
    "web/app.ts": "class App { run() { go(1); } }\nfunction go(x) { return x; }\n",
    "tool.py": "def main():\n    pass\n",
    "docs/adr/1.md": "# one\n",
    "vendor/x.rs": "fn broken( {\n",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return Repository.scan(spark, str(root), "r")


def test_scan(repo):
    assert {r.fqn for r in repo.symbols.collect()} == {"trestle", "total", "load_beam", "load_beam_adds_mass", "App", "App::run", "go", "main"}
    assert repo.failed.count() == 0 and repo.commit == "working-tree"
    assert [r.kind for r in repo.architecture().collect()] == ["adr"]


def test_questions(repo):
    assert [r.fqn for r in repo.symbol("load_beam").collect()] == ["load_beam"]
    refs = {(r.source_fqn, r.target_fqn, r.direction) for r in repo.references("load_beam").collect()}
    assert refs == {("total", "load_beam", "incoming"), ("load_beam_adds_mass", "load_beam", "incoming")}
    report = repo.impact("load_beam").first()
    assert sorted(report.direct_callers) == ["load_beam_adds_mass", "total"] and report.affected_files == ["src/lib.rs", "src/trestle.rs"]
    assert {r.risk for r in repo.refactor_plan("load_beam").collect()} == {"medium"}
    assert repo.context("go").first().fqn == "go"
    tests, _ = repo.test_context("load_beam")
    assert [(r.fqn, r.confidence) for r in tests.collect()] == [("load_beam_adds_mass", "medium")]
    with pytest.raises(ValueError):
        repo.context(" ")


def test_graph_and_diff(repo):
    nodes, edges = repo.graph()
    kinds = {}
    for r in edges.collect():
        kinds[r.edge_type] = kinds.get(r.edge_type, 0) + 1
    assert kinds == {"contains": 8, "calls": 3, "imports": 1, "test_covers": 1}  # "App" is in "apply" too
    assert nodes.count() == 8 + 4
    diff = "diff --git a/src/lib.rs b/src/lib.rs\n--- a/src/lib.rs\n+++ b/src/lib.rs\n@@ -1,2 +1,3 @@\n mod trestle;\n+fn total() {}\ndiff --git a/tool.py b/tool.py\ndeleted file mode 100644\n"
    assert [(r.fqn, r.line) for r in repo.changed_symbols(diff).collect()] == [("total", 2)]
    after = {r.file_path: r.source for r in repo.overlay(diff).collect()}
    assert "tool.py" not in after and after["src/lib.rs"] == "head" and after["web/app.ts"] == "base"


def test_json_and_summary(repo):
    row = json.loads(as_json(repo.summary()).first().json)
    assert row["symbols"] == 8 and row["calls"] == 3 and row["nodes"] == 12
    assert repo.chunks("g").count() == 8


def test_a_broken_file_fails_the_scan_or_is_set_aside(spark, tmp_path):
    (tmp_path / "a.py").write_text("def (")
    (tmp_path / "b.py").write_text("def ok(): pass")
    with pytest.raises(ValueError, match="a.py"):
        Repository.scan(spark, str(tmp_path))
    kept = Repository.scan(spark, str(tmp_path), fail_fast=False)
    assert [r.fqn for r in kept.symbols.collect()] == ["ok"] and kept.failed.count() == 1
