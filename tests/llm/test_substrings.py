import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import substrings  # noqa: E402


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def jaccard(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_line_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(7)
    lines = []
    for _ in range(12):
        base = words(rng, 60)
        for _ in range(8):
            w = list(base)
            for i in rng.sample(range(60), rng.randrange(3)):
                w[i] = f"n{rng.randrange(10**6)}"
            lines.append(" ".join(w))
    lines = sorted(set(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    units = substrings._units(df).where("kind = 0").withColumnRenamed("doc_id", "d0")
    number = {r.uid: r.d0 for r in units.collect()}
    groups = {}
    for r in substrings._line_components(units, df).collect():
        groups.setdefault(r.cluster, []).append(number[r.uid])
    got = {i: min(g) for g in groups.values() for i in g}
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if jaccard(lines[i], lines[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: got.get(i, i) for i in range(len(lines))} == {i: find(i) for i in range(len(lines))}


def test_pasted_passages_are_found(spark):
    rng = random.Random(3)
    docs, planted = [], []
    for k in range(40):
        passage = words(rng, rng.randrange(51, 120))
        own = [words(rng, 200) for _ in range(2)]
        for j in range(2):
            at = rng.randrange(200)
            docs.append((100 + 2 * k + j, " ".join(own[j][:at] + passage + own[j][at:])))
        planted.append((100 + 2 * k, 101 + 2 * k))
    docs += [(500 + i, " ".join(words(rng, 300)) + "\n" + "a common line of nine words stands right here") for i in range(60)]
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    removed = {r.doc_id for r in got if r.removed}
    kept = {r.doc_id for r in got if not r.removed}
    assert sum(b in removed and a in kept for a, b in planted) >= 39
    assert not any(r.doc_id >= 500 for r in got)
    text = dict(docs)
    for r in got:
        other = " ".join(text[r.doc_id].split()[r.start : r.start + r.n])
        assert any(other in t for d, t in docs if d != r.doc_id)


def test_edges(spark):
    rng = random.Random(5)
    line = " ".join(words(rng, 30))
    long = " ".join(words(rng, 40000))
    docs = [(1, line, "x"), (2, line.upper(), None), (2, line, None), (3, None, "y"), (4, "", None), (None, line, None), (5, long, None), (6, long, None), (7, "And " * 5000, None), (8, "a\nb\n\nc", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, removed string")
    got = substrings.repeated_passages(df).collect()
    assert {(r.doc_id, r.removed) for r in got} == {(1, False), (2, True), (5, False), (6, True)}
    assert [r.n for r in got if r.doc_id == 6] == [40000]
    assert substrings.repeated_passages(df.limit(0)).count() == 0


def test_measures_do_not_depend_on_the_batch():
    rng = random.Random(6)
    texts = [substrings.paragraphs("\n".join(" ".join(words(rng, rng.randrange(5, 60))) for _ in range(rng.randrange(1, 5)))) for _ in range(50)]
    whole, alone = substrings._measured(texts), [substrings._measured([t]) for t in texts]
    for c in ("start", "n", "uid"):
        one = sorted((at, kind, x) for at, kind, x in zip(whole["at"].tolist(), whole["kind"].tolist(), whole[c].tolist()))
        assert one == sorted((i, kind, x) for i, m in enumerate(alone) for kind, x in zip(m["kind"].tolist(), m[c].tolist()))
    assert (whole["keys"] == np.concatenate([m["keys"] for m in alone])).all()


def test_lines_are_joined_up_to_a_blank_one():
    line = " ".join(f"w{i}" for i in range(10))
    got = substrings.paragraphs(f"{line}\n{line}\n \n{line}\n\n{line} {line}\nx")[1]
    assert got == [(0, 20), (30, 20)]


def windows(text):
    """(words, first word) of every window of a text."""
    found = substrings.windows(substrings.Spans(substrings._hashes(text)), np.array([len(text)]))
    return {(tuple(text[a : a + substrings.GRAM]), int(a)) for a in found}


@pytest.mark.parametrize("vocabulary", [3, 40, 4000])
def test_every_passage_of_51_words_holds_a_window_and_a_span(vocabulary):
    """Also where words repeat so often that the same window recurs within a few words."""
    rng = random.Random(vocabulary)
    some = lambda n: [b"w%d" % rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(300):
        passage, heads = some(51), [some(rng.randrange(60)) for _ in range(2)]
        texts = [head + passage + some(rng.randrange(60)) for head in heads]
        one, two = ({(w, a - len(h)) for w, a in windows(t)} for t, h in zip(texts, heads))
        alike = [a for w, a in one & two if 0 <= a <= 51 - substrings.GRAM]
        assert alike
        for t, h in zip(texts, heads):
            hashes, size = substrings._hashes(t), np.array([len(t)])
            at = substrings.spans_around(hashes, size, np.array([a + len(h) for a in alike]))[1] - len(h)
            assert any(0 <= a <= 51 - substrings.CORE for a in at)


def test_passages_of_few_words_are_found(spark):
    rng = random.Random(13)
    docs = []
    for k in range(40):
        passage = [f"p{k}x{rng.randrange(4)}" for _ in range(51)]
        docs += [(2 * k + j, " ".join(words(rng, rng.randrange(20, 90)) + passage + words(rng, 50))) for j in range(2)]
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.removed} == set(range(1, 80, 2))
    assert {r.doc_id for r in got if not r.removed} == set(range(0, 80, 2))


def spans51(text, size=51):
    w = text.lower().split()
    return {tuple(w[i : i + size]): i for i in range(len(w) - size + 1)}


@pytest.mark.parametrize("size", [51, 70])
def test_passages_of_real_texts_pasted_into_others_are_all_found_and_nothing_else(spark, size):
    """Recall of documents and words, and precision, against every span of 51 words."""
    rng = random.Random(size)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = [t.lower().split() for t in texts if t and len(t.split()) > 250][:160]
    docs = {}
    for k, t in enumerate(texts):
        docs[k] = " ".join(t[:200])
    for k in range(80):  # a passage of one goes into another
        at, to = rng.randrange(200 - size), rng.randrange(1, 199)
        own = docs[80 + k].split()
        docs[80 + k] = " ".join(own[:to] + docs[k].split()[at : at + size] + own[to:])
    for k in range(60):  # many share a sentence of 20 words, which is no passage
        docs[1000 + k] = " ".join(words(rng, 60) + docs[0].split()[5:25] + words(rng, 60))
    got = substrings.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    held = {}
    for d, t in docs.items():
        for s in spans51(t):
            held.setdefault(s, set()).add(d)
    want = {d: {j for s, i in spans51(t).items() if len(held[s]) > 1 for j in range(i, i + 51)} for d, t in docs.items()}
    found = {d: set() for d in docs}
    for r in got:
        if r.n >= substrings.CORE:
            found[r.doc_id] |= set(range(r.start, r.start + r.n))
    whole = {d for d, t in docs.items() if any(len(held[s]) > 1 for s in spans51(t))}
    assert whole <= {d for d in found if found[d]} and len(whole) >= 160
    for d in {d for d in found if found[d]} - whole:  # what else is found has a near copy, or shares almost as much
        mine = spans51(docs[d], substrings.CORE)
        assert any(jaccard(docs[d].lower(), t.lower()) >= 0.8 or not mine.keys().isdisjoint(spans51(t, substrings.CORE)) for o, t in docs.items() if o != d), d
    assert all(len(found[d] & want[d]) >= 0.6 * len(want[d]) for d in docs)


def test_pieces_of_many_documents_make_no_passage(spark):
    """Fragments that touch, or overlap, but come from different documents: no 51 words are in any other one."""
    rng = random.Random(21)
    sources = [words(rng, 90) for _ in range(300)]
    touching = [w for s in sources[:150] for w in s[20:46]]
    longer = [w for s in sources[150:250] for w in s[10:60]]
    overlapping = [f"o{i}" for i in range(2000)]
    pieces = [words(rng, 30) + overlapping[a : a + 50] + words(rng, 30) for a in range(0, 1950, 20)]
    docs = [*sources, touching, longer, overlapping, *pieces]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = substrings.repeated_passages(df).collect()
    held = {}
    for i, d in enumerate(docs):
        for s in spans51(" ".join(d), substrings.CORE):
            held.setdefault(s, set()).add(i)
    for r in got:  # whatever is reported holds CORE words that another document holds
        mine = spans51(" ".join(docs[r.doc_id][r.start : r.start + r.n]), substrings.CORE)
        assert any(len(held[s]) > 1 for s in mine)
    assert not any(r.doc_id == 300 for r in got), "fragments of 26 words"


@pytest.mark.parametrize("size", [51, 80, 120, 200])
def test_copies_are_reported_almost_whole(spark, size):
    rng = random.Random(size)
    docs, spots = [], {}
    for k in range(60):
        passage = words(rng, size)
        for j in range(2):
            head = words(rng, rng.randrange(60, 120))
            spots[2 * k + j] = len(head)
            docs.append((2 * k + j, " ".join(head + passage + words(rng, 80))))
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(120)) and len(got) == 120
    for r in got:
        before, after = r.start - spots[r.doc_id], spots[r.doc_id] + size - r.start - r.n
        assert 0 <= before < substrings.STEP and 0 <= after < substrings.STEP


def test_words_of_many_texts_are_read_and_hashed_as_one_by_one():
    """Texts in a row, from any slice of a batch: words, their hashes (as by xxhash) and their lines."""
    rng = random.Random(5)
    some = ["a", "B", "é", "\u2003", "𝒳", "\x1c", "\xa0", "\x00", *" \n\t\r\x0b\x0c", " ", " ", "\n\n", *("Xy" * n + "z" * (n % 2) for n in range(20))]
    texts = [None, "", " ", "\n", *("".join(rng.choice(some) for _ in range(rng.choice([1, 5, 900]))) for _ in range(300)), "end", None]
    column = pa.array(texts)
    for a, b in ((0, len(texts)), (0, 0), (3, 200), (200, len(texts)), (4, 5)):
        got, at = substrings.Texts(column.slice(a, b - a)), 0
        lines = {tuple(x) for x in got.lines().tolist()}
        for i, t in enumerate(texts[a:b]):
            want = (t or "").encode().lower().split()
            assert got.sizes[i] == len(want) and got.words(at, len(want)) == want
            assert (got.hashes[at : at + len(want)] == substrings._hashes(want)).all()
            n = 0
            for line in (t or "").split("\n"):
                m = len(line.encode().split())
                assert ((i, at + n, m) in lines) or m < substrings.LEAST
                n += m
            at += len(want)
        assert at == len(got.hashes)
