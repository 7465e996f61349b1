import random

from lodestrata.operators import overlay
from lodestrata.sources import diffs


def lines_plain(diff):
    path = number = None
    out = []
    for line in diff.split("\n")[: None if not diff.endswith("\n") else -1]:
        line = line.removesuffix("\r")
        if line.startswith("+++ "):
            raw = line[4:]
            path = None if raw == "/dev/null" else raw[2:] if raw[:2] in ("a/", "b/") else raw
        elif line.startswith("@@"):
            plus = next((w[1:] for w in line[2:].split() if w.startswith("+")), "").split(",")[0]
            number = int(plus) if plus.isdigit() and plus.isascii() else None
        elif number is not None:
            if line.startswith("+"):
                if path is not None:
                    out.append((path, number))
                number += 1
            elif not line.startswith(("-", "\\")):
                number += 1
    return out


def test_changed_lines_match_a_plain_model(spark):
    rng = random.Random(2)
    pool = ["diff --git a/x b/y", "--- a/x", "+++ b/src/a.rs", "+++ /dev/null", "+++ plain", "@@ -1 +5,2 @@", "@@ -1,2 +7 @@ fn", "@@ bad @@", "@@ -1 +x @@", "+a", "+", "++ b", "-c", " d", "", "\\ No newline", "e\r"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "\n"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "diff_id int, text string")
    got = {}
    for r in diffs.changed_lines(df).orderBy("diff_id", "pos").collect():
        got.setdefault(r.diff_id, []).append((r.file_path, r.line))
    for i, t in enumerate(texts):
        assert got.get(i, []) == lines_plain(t), t


def test_diffs_as_files_are_split(spark, tmp_path):
    """One diff of many hunks, in parts of a few hundred bytes: path and counter cross all of them."""
    rng = random.Random(4)
    body = "".join(f"diff --git a/f{i}.rs b/f{i}.rs\n--- a/f{i}.rs\n+++ b/f{i}.rs\n" + "".join(f"@@ -1 +{10 * k} @@\n" + "".join(rng.choice(["+x\n", " y\r\n", "-z\n"]) for _ in range(rng.randrange(60))) for k in range(1, 6)) for i in range(20))
    (tmp_path / "one.diff").write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = diffs.file_lines(spark, str(tmp_path / "one.diff"))
        assert rows.rdd.getNumPartitions() > 5
        got = [(r.file_path, r.line) for r in diffs.changed_lines_of(rows).orderBy("pos").collect()]
        files = [(r.file_path, r.status) for r in diffs.changed_files_of(rows).orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == lines_plain(body) and files == [(f"f{i}.rs", "modified") for i in range(20)]


def test_changed_files(spark):
    diff = """diff --git a/src/a.rs b/src/a.rs
--- a/src/a.rs
+++ b/src/a.rs
@@ -1 +1 @@
-a
+b
diff --git a/new.rs b/new.rs
new file mode 100644
--- /dev/null
+++ b/new.rs
@@ -0,0 +1 @@
+x
diff --git a/old.rs b/old.rs
deleted file mode 100644
--- a/old.rs
+++ /dev/null
diff --git a/from.rs b/to.rs
rename from from.rs
rename to to.rs
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
"""
    got = diffs.changed_files(spark.createDataFrame([(1, diff)], "diff_id int, text string")).orderBy("ordinal").collect()
    assert [(r.file_path, r.previous_file_path, r.status) for r in got] == [
        ("src/a.rs", None, "modified"),
        ("new.rs", None, "added"),
        ("old.rs", None, "deleted"),
        ("to.rs", "from.rs", "renamed"),
        ("run.sh", None, "mode_only"),
    ]


def merge_plain(base, entries):
    files = {p: ("base", h) for p, h in base}
    for path, previous, status, h in entries:
        if status in ("added", "modified"):
            files[path] = ("head", h)
        elif status == "deleted":
            files.pop(path, None)
        elif status == "renamed":
            files.pop(previous, None)
            files[path] = ("head", h)
        else:
            had = files.pop(path, None)
            if had and had[0] == "base":
                files[path] = ("head", had[1])
    return {(p, h, s) for p, (s, h) in files.items()}


def test_overlay_matches_a_plain_model(spark):
    rng = random.Random(9)
    for _ in range(6):
        names = [f"f{i}" for i in range(8)]
        base = [(n, f"b{n}") for n in names[:5]]
        entries = [(rng.choice(names), rng.choice(names), rng.choice(["added", "modified", "deleted", "renamed", "mode_only"]), f"h{i}") for i in range(14)]
        b = spark.createDataFrame(base, "file_path string, content_sha256 string")
        o = spark.createDataFrame([(i, p, q if s == "renamed" else None, s, h) for i, (p, q, s, h) in enumerate(entries)], "ordinal int, file_path string, previous_file_path string, status string, content_sha256 string")
        got = {(r.file_path, r.content_sha256, r.source) for r in overlay.merge(b, o).collect()}
        assert got == merge_plain(base, entries)
