import zlib

import numpy as np
import pytest

pytest.importorskip("lodestrata.llm")
from tokenizers import Tokenizer  # noqa: E402

from lodestrata.llm import packing  # noqa: E402


def check(rows, docs, capacity=2048):
    """Every id in one piece, sequences gapless and within capacity; the share of slots used."""
    whole = Tokenizer.from_file(packing.vocabulary_path())
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, made in ids.items():
        if len(made) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(made[0])
                at += r.length
                assert zlib.crc32(made[0][r.start : at].tobytes()) == r.ids_crc32
            assert at == len(made[0])
        else:
            assert sum(r.length for r in by_doc[d]) == sum(map(len, made))
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    padded = lambda n: n if n & (n - 1) == 0 else capacity
    used = [sum(r.length for r in s) for s in by_seq.values()]
    return sum(used) / sum(map(padded, used))


def test_cuts_are_whole():
    for n in [1, 2, 5, 1000, 1025, 2047, 2048, 2049, 5000]:
        assert sum(packing.cuts(n)) == n


def test_query_packs_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs.repartition(5)).collect()
    assert check(rows, [tuple(r) for r in docs.collect()]) > 0.98


@pytest.mark.parametrize("again", [30, 200_000])
def test_edges_and_many_workers(spark, monkeypatch, again):
    monkeypatch.setattr(packing, "AGAIN", again)
    docs = [(1, None), (2, ""), (3, "word " * 40000), (4, "same"), (4, "same"), (None, "x y"), (5, "<|endoftext|> é\x00  b"), *((10 + i, "tok " * (i * 37 % 900)) for i in range(120))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS sequence_id", "1 AS offset")
    rows = packing.pack(df.repartition(6)).collect()
    check(rows, docs)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "7" * 300_000, " " * 50_000, "x" + " " * 9_999 + "y", (" " * 10_000 + "x") * 20, "a" + "\t \n" * 40_000 + "<|endoftext|>b"])
def test_texts_of_any_length_and_kind(text):
    path = packing.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.encode(text, path).tolist() == [*want, 1]


def test_very_long_blank_texts_pack(spark):
    docs = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a" * 1_000_000), (4, "plain words")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check(rows, docs)
