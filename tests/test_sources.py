import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search
from lodestrata.sources import syntax, worktree
from lodestrata.streaming import worker


def test_manifest(spark, tmp_path):
    for name, body in [("src/a.rs", b"fn a() {}"), ("vendor/x.go", b"x"), ("bin.dat", b"a\x00b"), (".git/HEAD", b"ref: refs/heads/m\n"), (".git/refs/heads/m", b"abc\n"), ("target/t", b"x"), ("tests/t_test.py", b""), ("gen/g.ts", b"g")]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    got = {r.file_path: r for r in worktree.manifest(spark, str(tmp_path)).drop("content").collect()}
    assert sorted(got) == ["gen/g.ts", "src/a.rs", "tests/t_test.py"]
    assert got["src/a.rs"].language == "rust" and got["tests/t_test.py"].is_test and got["gen/g.ts"].is_generated
    assert got["tests/t_test.py"].content_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert worktree.revision(str(tmp_path)) == "abc" and worktree.revision(str(tmp_path), "v1") == "v1"


def test_a_tree_is_walked_by_tasks(spark, tmp_path, monkeypatch):
    """Any depth, empty files, links, NUL bytes, odd names; ignored folders are not even opened."""
    import hashlib
    import os

    monkeypatch.setattr(worktree, "FOLDERS_A_TASK", 2)
    monkeypatch.setattr(worktree, "AT_ONCE", 8)
    deep = "/".join(f"d{i}" for i in range(6))
    bodies = {f"{deep}/x.py": b"x" * 100, "a b/é.txt": "é".encode(), "empty": b"", "late.bin": b"a" * 50 + b"\x00", "vendored.txt": b"v", "targets/x": b"t", "sub/target/kept.rs": b"k", **{f"many/f{i}": str(i).encode() for i in range(300)}}
    for name, body in {**bodies, "target/x": b"", ".git/objects/a": b"", "a/node_modules/b/c.js": b"", "x/vendor/y": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "nothing").mkdir()
    os.symlink(tmp_path / "empty", tmp_path / "link")
    os.symlink(tmp_path / "many", tmp_path / "folder_link")
    os.mkfifo(tmp_path / "pipe")
    for root in (f"{tmp_path}/", f"file://{tmp_path}"):
        got = {r.file_path: (r.content_sha256, r.size_bytes) for r in worktree.manifest(spark, root, content=False).collect()}
        assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items() if b"\x00" not in b}
    assert {r.file_path: bytes(r.content) for r in worktree.manifest(spark, str(tmp_path)).where("file_path LIKE '%.txt'").collect()} == {"a b/é.txt": "é".encode(), "vendored.txt": b"v"}
    bare = tmp_path / "nothing"
    assert worktree.manifest(spark, str(bare)).count() == 0


def test_env():
    assert worktree.env_values("# c\n A = b=c \n\nX=\n") == {"A": "b=c", "X": ""}
    with pytest.raises(ValueError, match="line 2"):
        worktree.env_values("A=1\nbad")


RUST = """mod billing {
    pub struct Trestle { total: i32 }
    impl Trestle { pub fn total(&self) -> i32 { helper(1) } }
    enum Kind { A, B }
}
fn helper(v: i32) -> i32 { "not { a brace"; v }
#[test]
fn adds() { assert_eq!(billing::helper(2), 2); x.is_empty(); }
"""


def test_rust():
    found, error = syntax.symbols_of(RUST, "rust")
    assert error is None
    got = {(s.kind, s.fqn) for s in found}
    assert got == {("module", "billing"), ("class", "billing::Trestle"), ("method", "billing::Trestle::total"), ("enum", "billing::Kind"), ("function", "helper"), ("test_case", "adds")}
    assert [c[0] for c in syntax.calls_of(RUST, "rust")] == ["helper", "assert_eq", "helper"][:1] + ["helper"]


def test_other_languages():
    go = "package p\nfunc (s *Svc) Total() int { return 1 }\nfunc TestX(t *T) {}\nfunc plain() {}\n"
    assert [(s.kind, s.name) for s in syntax.symbols_of(go, "go")[0]] == [("method", "Svc.Total"), ("test_case", "TestX"), ("function", "plain")]
    web = "interface I { a: string }\nexport class A { run() { go(1); this.no(2); } }\nenum E { X }\nfunction testIt() { }\n"
    assert [(s.kind, s.fqn) for s in syntax.symbols_of(web, "typescript")[0]] == [("interface", "I"), ("class", "A"), ("method", "A::run"), ("enum", "E"), ("test_case", "testIt")]
    assert [c[0] for c in syntax.calls_of(web, "typescript")] == ["go"]
    python = "class A:\n    def é(self):\n        def inner(): pass\n@d\ndef test_x(): pass\n"
    assert [(s.kind, s.fqn) for s in syntax.symbols_of(python, "python")[0]] == [("class", "A"), ("method", "A::é"), ("function", "A::é::inner"), ("test_case", "test_x")]
    assert syntax.symbols_of("fn a() { (", "rust")[1] and syntax.symbols_of("def (", "python")[1]


def test_symbol_rows(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 'é'; \ndef f():\n    pass\n"), ("b.rs", "rust", "fn a( {"), ("c.py", "python", None)], "file_path string, language string, body string")
    rows = syntax.symbols(files)
    got = rows.where("error IS NULL").collect()
    assert [(r.name, r.start_line, r.start_col, r.end_line, r.end_col) for r in got] == [("f", 2, 0, 3, 8)]
    assert [r.file_path for r in syntax.failed(rows).collect()] == ["b.rs"]


def test_index_follows_the_outbox_stream(spark, tmp_path):
    schema = "entity_id string, operation string, payload string, created_at int, outbox_id string"
    source = str(tmp_path / "in")
    rows = [[("a", "upsert", "1", 1, "o1"), ("b", "upsert", "1", 1, "o2")], [("a", "upsert", "2", 2, "o3"), ("b", "delete", None, 2, "o4"), ("c", "upsert", "x", 2, "o5"), ("c", "upsert", "y", 3, "o6")]]
    index = worker.StoredTable(spark, str(tmp_path / "index"), "entity_id string, payload string")
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        worker.sync_stream(stream, index, str(tmp_path / "checkpoint")).awaitTermination()
    assert {(r.entity_id, r.payload) for r in index.at(1).collect()} == {("a", "2"), ("c", "y")}


def test_drift_and_rebuild(spark):
    outbox = spark.createDataFrame([("i", "a", "upsert", "queued", "1", 1, "o1"), ("i", "a", "upsert", "queued", "2", 2, "o2"), ("i", "b", "upsert", "cancelled", "1", 1, "o3")], "target_index string, entity_id string, operation string, state string, payload string, created_at int, outbox_id string")
    index = spark.createDataFrame([], "target_index string, entity_id string")
    r = search.drift(outbox, index, ["target_index"]).first()
    assert (r.expected, r.actual, r.has_drift) == (1, 0, True)
    assert [(x.entity_id, x.payload) for x in search.rebuild(outbox).collect()] == [("a", "2")]


def test_chunk_ids_differ_by_range(spark):
    fields = "versioned_symbol_id string, stable_symbol_id string, file_path string, language string, kind string, name string, fqn string, start_line int, start_col int, end_line int, end_col int"
    df = spark.createDataFrame([("v", "s", "a.ts", "typescript", "function", "f", "f", 1, 0, 2, 1), ("v", "s", "a.ts", "typescript", "function", "f", "f", 5, 0, 6, 1)], fields)
    one = search.chunks(df, F.lit("r"), F.lit("g1")).collect()
    two = search.chunks(df, F.lit("r"), F.lit("g2")).collect()
    assert one[0].chunk_id != one[1].chunk_id and one[0].text == "f function type_script a.ts"
    assert {r.payload_hash for r in one} == {r.payload_hash for r in two} and one[0].payload != two[0].payload
