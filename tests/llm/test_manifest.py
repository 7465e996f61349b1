import hashlib
import zlib

import duckdb
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import manifest  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(digests):
    """The top node, and for each leaf its steps (before, after)."""
    steps, own, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for i, at in enumerate(own):
            run = at // 8 * 8
            steps[i].append(("".join(now[run:at]), "".join(now[at + 1 : run + 8])))
        now = [h(*now[i : i + 8]) for i in range(0, len(now), 8)]
        own = [at // 8 for at in own]
    return now[0], steps


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for x in langs:
        by_lang[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[x] = tree([leaf(r) for r in by_lang[x]])
    root, outer = tree([inner[x][0] for x in langs]) if langs else (None, [])
    out = []
    for i, x in enumerate(langs):
        for r, steps in zip(by_lang[x], inner[x][1], strict=True):
            steps = [*steps, *outer[i]]
            now = leaf(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in steps:
                now = h(before, now, after)
            out.append((r[0], leaf(r), inner[x][0], root, h(*[s for step in steps for s in step]), now, now == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest.audited(df).collect()), key=repr)


def many(n, langs):
    return [(i * 7 % 1009, f"Text {i} É", langs[i % len(langs)], "web" if i % 3 else None, i) for i in range(n)]


EDGES = [
    (None, None, None, None, None), (None, None, None, None, None), (1, "", "", "", 0), (2, None, "", "s", None), (3, "ABC É ẞ", "é", "S", 3), (3, "abc É ẞ", "é", "S", 3),
    (4, "x" * 300_000, "z", None, -5), (5, "A\x00B", "=", "a:b", 3), (-6, "Q", None, "-", 1), (7, "same", "en", "w", 4), (7, "same", "en", "w", 4),
]


@pytest.mark.parametrize(
    "rows",
    [many(1, ["en"]), many(9, ["en"]), many(8, ["en"]), many(65, ["en", None]), many(300, ["en", "en", "en", "de"]), many(90, [f"l{i}" for i in range(70)]), EDGES],
    ids=["one", "nine", "eight", "two", "hot", "langs", "edges"],
)
def test_small_blocks_are_the_plain_tree(spark, monkeypatch, rows):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS branch", "1 AS place", "2 AS leaf", "3 AS size")
    assert got(df.repartition(3)) == brute(rows)


def test_blocks_of_the_usual_size(spark):
    rows = [*many(5000, ["en", "en", "en", "en", "en", "de"]), *EDGES]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_alike_rows_are_spread(spark, monkeypatch):
    """Many rows alike in all fields have a place each, and the order they are read in makes no difference."""
    rows = [(7, "same", "en", "w", 4)] * 200 + many(30, ["en"])
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.repartition(7)) == got(df.coalesce(1)) == brute(rows)


def test_a_proof_holds_for_its_row_only(spark):
    rows = many(50, ["en", "de"])
    df = spark.createDataFrame(rows, SCHEMA)
    changed = manifest.leaf(text=manifest.F.concat("text", manifest.F.lit("!")))
    for shown, same in ((None, True), (changed, False)):
        made = manifest.manifest(df, shown).withColumn("now", manifest.fold(manifest.F.col("shown"), manifest.F.col("proof")))
        assert made.where("now = root").count() == (50 if same else 0)


@pytest.mark.parametrize("rows", [many(700, ["en", "de", None]), EDGES[1:]])
def test_sql_gives_the_plain_tree(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r for r in rows if r[0] is not None])
    cursor = con.execute(manifest.oracle_sql())
    names = [d[0] for d in cursor.description]
    assert sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in cursor.fetchall()), key=repr) == brute([r for r in rows if r[0] is not None])
