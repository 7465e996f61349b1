"""Repeated passages: paragraph MinHash banding, exact verification, and removals by components.

Texts are lower-cased (A-Z) and split into words at ASCII white space. Two kinds of paragraph are compared
across the whole corpus, both by MinHash bands over shingles of ``SHINGLE`` words:

* lines of ``LEAST`` words or more, and the lines between two blank lines joined, where most of them are
  shorter. ``BANDS`` bands of ``ROWS`` rows find a pair of similarity 0.8 with probability 0.998. Pairs that
  share a band are verified on their shingle sets, exactly, and linked at a Jaccard similarity of ``SIMILAR``
  or more; links are joined into components.
* windows of ``GRAM`` words inside texts, for passages pasted into other text. A window stands where the hash
  of its words is the smallest of ``ROW`` windows in a row, the rightmost of equal ones, so that windows stand
  at the same words wherever a passage stands, and every passage of ``RUN`` words holds one whole. A window's
  one band mixes ``WINDOW_ROWS`` least hashes and a hash of all its words: only equal windows collide.

Windows that other documents hold too are verified as passages. From each window a bridge reaches to the end of
the first window after it that ends ``RUN`` words on or more: where another document holds the whole bridge, by
128 bits of its words, it is a repeated passage. Windows that touch but come from different documents make none.
Around windows whose bridge nobody shares, and the first windows of runs of bridges, spans of ``CORE`` words are
compared the same way, one at least of them inside any passage of ``RUN`` words that holds the window; so a passage
shorter than a bridge is found, and both ends of a longer one to within ``STEP`` words.

Equal paragraphs are merged by their hashes before anything is compared; they cost one row for each task and
value, however common they are. Texts are read again to verify, not moved: what is asked for goes to the
documents as a table of ``SIEVE`` bits (16 MB whatever the corpus), by which a few more paragraphs than asked
for are picked; the joins that follow drop these. Only the texts of lines that share a band with an unlike
line are shuffled, once each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import cut, ship, stored
from lodestrata.llm.components import connected_components
from lodestrata.llm.shingles import BASES, SHINGLE, Spans, _hashes, _mix, _slices, bands, linked

ship(__name__)

#: Words of a line, and of lines joined, from which on they are compared.
LEAST = 16
#: Words from which on a passage inside other text is reported; words of a window; windows that RUN words hold.
#: Of one passage, windows follow each other by at most GRAM words, and so touch.
RUN, GRAM = 51, 26
ROW = RUN - GRAM + 1
#: Around the windows of short runs, spans that begin every STEP words are compared, so many words shorter.
STEP = 5
CORE = RUN - STEP + 1
BANDS, ROWS, WINDOW_ROWS = 6, 2, 3
#: Paragraphs of one band value that one task compares; more are compared chunk against chunk.
CHUNK = 4096
PARAGRAPH, INSIDE = 0, 1
#: Bits of a sieve, a power of two.
SIEVE = 1 << 27
KEYS = [f"k{b}" for b in range(BANDS)]
#: Of a window: the hash of its bridge, and the bridge's words.
BRIDGE = ["far", "m"]
#: Of each byte: whether it stands between words, and its lower case. The numbers of XXH64.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``_hashes`` gives for the words at ``starts`` of some bytes: XXH64 (seed 7), for all words at once."""
    p1, p2, p3, p4, p5 = PRIMES
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each byte on
    out = sizes.astype(np.uint64) + (p5 + np.uint64(7))
    for k in range(3):
        some = np.flatnonzero(sizes >= 8 * k + 8)
        out[some] = _rotated(out[some] ^ _rotated(eight[starts[some] + 8 * k] * p2, 31) * p1, 27) * p1 + p4
    tail = sizes & 7
    for n in range(1, 8):
        some = np.flatnonzero(tail == n)
        h, rest = out[some], eight[starts[some] + (sizes[some] - n)]
        if n & 4:
            h = _rotated(h ^ (rest & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
            rest = rest >> np.uint64(32)
        for _ in range(n & 3):
            h = _rotated(h ^ (rest & np.uint64(0xFF)) * p5, 11) * p1
            rest = rest >> np.uint64(8)
        out[some] = h
    out = (out ^ (out >> np.uint64(33))) * p2
    out = (out ^ (out >> np.uint64(29))) * p3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), 7)
    return out


class Texts:
    """The lower-cased words of texts in a row: where each begins and ends in ``data``, and how many each text has."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, dtype=np.int64)
        self.data = LOWER[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
        self.texts = at - at[0]
        space = np.append(SPACE[self.data], True)
        edge = np.append(True, space[1:] != space[:-1])
        edge[self.texts] = True  # a text ends its last word
        edge = np.flatnonzero(edge)
        word = np.flatnonzero(~space[edge])
        self.starts, self.ends = edge[word], edge[word + 1]
        self.sizes = np.diff(np.searchsorted(self.starts, self.texts))
        self.hashes = word_hashes(self.data, self.starts, self.ends - self.starts)

    def lines(self) -> np.ndarray:
        """(text, first word of all, words) of each line, and of short lines joined, of ``LEAST`` words or more."""
        begins = np.sort(np.concatenate([self.texts[:-1], np.flatnonzero(self.data == 10) + 1]))
        first = np.searchsorted(self.starts, begins)
        n = np.diff(first, append=len(self.starts))
        full = np.flatnonzero(n)
        first, n = first[full], n[full]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[first]
        # Joined are lines that follow each other without a blank one, in one text.
        new = np.flatnonzero(np.append(True, (np.diff(full) > 1) | (np.diff(owner) > 0))[: len(full)])
        whole, short, many = (np.add.reduceat(x, new) if len(new) else n for x in (n, (n < LEAST).astype(np.int64), np.ones_like(n)))
        joined = np.flatnonzero((many > 1) & (2 * short > many) & (whole >= LEAST))
        alone = np.flatnonzero(n >= LEAST)
        return np.concatenate([np.stack([owner[alone], first[alone], n[alone]], axis=1), np.stack([owner[new[joined]], first[new[joined]], whole[joined]], axis=1)])

    def words(self, first: int, n: int) -> list[bytes]:
        """Words in a row, of one text."""
        return self.data[self.starts[first] : self.ends[first + n - 1]].tobytes().split() if n else []


def windows(spans: Spans, sizes: np.ndarray) -> np.ndarray:
    """Starts of the windows of texts in a row, of ``sizes`` words each; none reaches another text."""
    n = int(sizes.sum()) - RUN + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    # The least of ROW hashes in a row and its place, from those of 1, 2, 4, .. in a row.
    least, at = spans.every(GRAM), np.arange(n + ROW - 1, dtype=np.int32 if n < 1 << 30 else np.int64)
    wide = 1
    while wide < ROW:
        step = min(wide, ROW - wide)
        at = np.where(least[step:] <= least[:-step], at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        wide += step
    left = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n)  # words from each row to its text's end
    chosen = at[left >= RUN].astype(np.int64)
    return chosen[np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)]]  # they ascend


def _window_ids(spans: Spans, starts: np.ndarray) -> np.ndarray:
    """The band of each window: its least shingles, and all its words."""
    band = bands(spans.every(SHINGLE), starts, np.full(len(starts), GRAM - SHINGLE + 1, dtype=np.int64), 1, WINDOW_ROWS)[:, 0]
    return _mix(spans.of(starts, GRAM) ^ band.view(np.uint64)).view(np.int64)


def bridges(h: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, words) of the bridge of each window; no words where the text ends before it."""
    last = np.searchsorted(starts, starts + RUN - GRAM)
    there = np.append(owner, -1)[last] == owner
    m = np.where(there, np.append(starts, 0)[last] + GRAM - starts, 0)
    return Spans(h, BASES[1]).of(starts, m).view(np.int64), m


def paragraphs(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text, and (start, length) of each line, and of short lines joined, of ``LEAST`` words or more."""
    made = Texts(pa.array([text]))
    return made.words(0, len(made.starts)), [(s, n) for _, s, n in sorted(made.lines().tolist(), key=lambda x: (x[1] + x[2], x[2]))]


def _measures(h: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> dict[str, np.ndarray]:
    """Columns (at, kind, start, n, uid, keys, far, m) of the paragraphs of some texts; at is the text's place among them.

    ``h`` has the hashes of their words, ``sizes`` how many each has, ``lines`` is as ``Texts.lines`` gives it.
    """
    begins = np.cumsum(sizes) - sizes
    spans = Spans(h)
    first = windows(spans, sizes)
    owner = np.searchsorted(begins, first, side="right") - 1
    who, start = np.concatenate([lines[:, 0], owner]), np.concatenate([lines[:, 1], first])
    n = np.concatenate([lines[:, 2], np.full(len(first), GRAM, dtype=np.int64)])
    kind = np.repeat([PARAGRAPH, INSIDE], [len(lines), len(who) - len(lines)])
    grams = spans.every(SHINGLE)
    m, size = len(lines), n - SHINGLE + 1
    keys = bands(grams, start[:m], size[:m], BANDS, ROWS)
    uid = np.concatenate([spans.of(start[:m], n[:m]).view(np.int64), _window_ids(spans, start[m:])])
    far, words = bridges(h, first, owner)
    return {"at": who, "kind": kind, "start": start - begins[who], "n": n, "uid": uid, "keys": keys, "far": far, "m": words}


def _measured(texts: list[tuple]) -> dict[str, np.ndarray]:
    """``_measures`` of texts as ``paragraphs`` gives them."""
    sizes = np.array([len(words) for words, _ in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    lines = np.array([(d, begins[d] + s, n) for d, (_, found) in enumerate(texts) for s, n in found], dtype=np.int64).reshape(-1, 3)
    return _measures(_hashes([w for words, _ in texts for w in words]), sizes, lines)


def _parts(batches):
    """(doc_ids, texts) of batches (doc_id, text), of about a million bytes at a time."""
    for batch in batches:
        names, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for a, b in _slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            yield names[a:b], Texts(column.slice(a, b - a))


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, n, uid, k0, .., far, m): every paragraph of every document. start, n and m count words.

    uid is a hash of all words in their order; only lines have keys, one for each band, and only windows a bridge.
    """

    def rows(names: np.ndarray, texts: Texts) -> pa.RecordBatch:
        made = _measures(texts.hashes, texts.sizes, texts.lines())
        nothing, lines = pa.nulls(len(made["at"]) - len(made["keys"]), pa.int64()), pa.nulls(len(made["keys"]), pa.int64())
        none = made["m"] == 0
        columns = [
            pa.array(names[made["at"]]),
            pa.array(made["kind"].astype(np.int32)),
            pa.array(made["start"].astype(np.int32)),
            pa.array(made["n"].astype(np.int32)),
            pa.array(made["uid"]),
            *[pa.concat_arrays([pa.array(made["keys"][:, b]), nothing]) for b in range(BANDS)],
            pa.concat_arrays([lines, pa.array(made["far"], mask=none)]),
            pa.concat_arrays([lines, pa.array(made["m"], mask=none)]).cast(pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "start", "n", "uid", *KEYS, *BRIDGE])

    def of(batches):
        yield from (rows(*part) for part in _parts(batches))

    return _texts(docs).mapInArrow(of, "doc_id long, kind int, start int, n int, uid long, " + ", ".join(f"{k} long" for k in KEYS) + ", far long, m int")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _of_document(uid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """A hash of a paragraph and its document."""
    return _mix(uid.view(np.uint64) + _mix(doc_id.view(np.uint64))).view(np.int64)


def sieve(hashes: DataFrame, column: str):
    """A broadcast table of ``SIEVE`` bits, in which the bit of every hash is set. At most SIEVE / 64 numbers reach the driver."""
    spot = F.col(column).bitwiseAND(SIEVE - 1)
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")
    rows = hashes.select(F.shiftright(spot, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(SIEVE >> 6, dtype=np.int64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes & np.int64(SIEVE - 1)
    return (table[spot >> 6].view(np.uint64) >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _picked(docs: DataFrame, table) -> DataFrame:
    """(uid, text) of the lines whose hash with their document passes the sieve."""

    def rows(names: np.ndarray, texts: Texts) -> pa.RecordBatch:
        lines, spans = texts.lines(), Spans(texts.hashes)
        uid = spans.of(lines[:, 1], lines[:, 2]).view(np.int64)
        hits = np.flatnonzero(passes(table.value, _of_document(uid, names[lines[:, 0]])))
        bodies = [b" ".join(texts.words(s, n)).decode() for s, n in lines[hits, 1:].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(uid[hits]), pa.array(bodies, pa.string())], ["uid", "text"])

    def of(batches):
        yield from (rows(*part) for part in _parts(batches))

    return _texts(docs).mapInArrow(of, "uid long, text string")


def _line_components(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, cluster) of the lines that have a near-duplicate. ``lines`` has distinct rows (uid, d0, keys)."""
    keyed = lines.select("uid", F.explode(F.array(*KEYS)).alias("key"))

    def texts(asked: DataFrame) -> DataFrame:
        mixed = asked.mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array(_of_document(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["h"]) for b in batches), "h long"
        )
        # A document may hold a line twice.
        return _picked(docs, sieve(mixed, "h")).join(asked.select("uid"), "uid", "left_semi").dropDuplicates(["uid"])

    found = linked(keyed, lines.select("uid", F.col("d0").alias("rep")), texts, CHUNK)
    return connected_components(found).select(F.col("node").alias("uid"), F.col("component").alias("cluster"))


def spans_around(h: np.ndarray, sizes: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, two hashes of the words) of the spans of ``CORE`` words around windows of texts in a row.

    The windows begin at the spots. A passage of RUN words that holds the window holds one of its spans.
    """
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends - sizes, spots, side="right") - 1
    back = np.arange(0, ROW, STEP)
    at, who = (spots[:, None] - back).ravel(), np.repeat(owner, len(back))
    fits = (at >= (ends - sizes)[who]) & (at + CORE <= ends[who])
    at, first = np.unique(at[fits], return_index=True)
    who = who[fits][first]
    return who, at - (ends - sizes)[who], *(Spans(h, base).of(at, CORE).view(np.int64) for base in BASES)


def _spans_of(docs: DataFrame, table) -> DataFrame:
    """(doc_id, start, g1, g2): the spans around the windows that pass the sieve."""

    def rows(names: np.ndarray, texts: Texts) -> pa.RecordBatch:
        spans = Spans(texts.hashes)
        at = windows(spans, texts.sizes)
        who, start, one, two = spans_around(texts.hashes, texts.sizes, at[passes(table.value, _window_ids(spans, at))])
        return pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(start.astype(np.int32)), pa.array(one), pa.array(two)], ["doc_id", "start", "g1", "g2"])

    def of(batches):
        yield from (rows(*part) for part in _parts(batches))

    return _texts(docs).mapInArrow(of, "doc_id long, start int, g1 long, g2 long")


def _runs(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (start, n, ..) with run, a number for each longest row of words that they cover without a gap."""
    mine = Window.partitionBy(*keys).orderBy("start", "n", "cluster")
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n")).over(before), F.lit(True))
    return rows.withColumn("first", first).withColumn("run", F.sum(F.col("first").cast("int")).over(mine)).drop("first")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n, cluster_id, removed, units): passages that other documents repeat.

    A row is a longest run of words of a document that repeated lines and passages cover: its first word
    (from 0), its words, the smallest cluster in it, and how many lines, windows and spans it joins. The
    document of smallest id keeps a cluster; ``removed`` is true in the others. Null, empty and short texts
    give no row; rows without a doc_id are left out; rows that repeat a doc_id are one document. Texts may
    have any length, and hold any passage any number of times. No documents give no rows. Only doc_id and
    text are read, so other columns may have any name.
    """
    units = stored(_units(docs))
    lines = units.where(F.col("kind") == PARAGRAPH).groupBy("uid").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), *[F.min(k).alias(k) for k in KEYS])
    lines = stored(lines)
    near = _line_components(lines, docs)
    classed = lines.select("uid", "d0", "d1").join(near, "uid", "left").withColumn("cluster", F.coalesce("cluster", "uid"))
    across = classed.groupBy("cluster").agg(F.min("d0").alias("keeper"), F.max("d1").alias("last")).where("keeper <> last")
    same = classed.join(across, "cluster").select(F.lit(PARAGRAPH).alias("kind"), "uid", "cluster", "keeper")
    equal = units.where(F.col("kind") == INSIDE).groupBy("uid").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper <> last")
    chosen = cut(same.unionByName(equal.select(F.lit(INSIDE).alias("kind"), "uid", F.col("uid").alias("cluster"), "keeper")))
    held = units.drop(*KEYS).join(chosen, ["kind", "uid"])

    inside = stored(held.where(F.col("kind") == INSIDE).select("doc_id", "start", "uid", *BRIDGE))  # so that all windows are moved once
    apart = ["uid", "far"]  # 128 bits of a bridge's words
    crossed = inside.where("far IS NOT NULL").groupBy(*apart).agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper <> last").drop("last")
    inside = stored(inside.join(cut(crossed), apart, "left"))
    # Bridges that touch are one row before they meet lines and spans.
    run = ["doc_id", "removed", "run"]
    whole = inside.where("keeper IS NOT NULL").select("doc_id", (F.col("doc_id") != F.col("keeper")).alias("removed"), "start", F.col("m").alias("n"), F.col("far").alias("cluster"), "uid")
    long = cut(
        _runs(whole, *run[:2]).groupBy(*run).agg(
            F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"), F.min("cluster").alias("cluster"),
            F.count(F.lit(1)).alias("units"), F.min_by("uid", F.struct("start", "uid")).alias("first"),
        )
    )
    # Every document that holds a window without a shared bridge, or one that begins a run, compares the spans around it.
    asked = inside.where("keeper IS NULL").select("uid").unionByName(long.select(F.col("first").alias("uid")))
    spans = cut(_spans_of(docs, sieve(asked, "uid")))
    twice = cut(spans.groupBy("g1", "g2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper <> last").drop("last"))  # so that a span that very many hold can be split
    found = spans.join(twice, ["g1", "g2"]).select("doc_id", "start", F.lit(CORE).alias("n"), F.col("g1").alias("cluster"), "keeper").distinct()
    long = long.select("doc_id", "removed", "start", "n", "cluster", "units")
    rest = held.where(F.col("kind") == PARAGRAPH).select("doc_id", "start", "n", "cluster", "keeper").unionByName(found)
    rest = rest.select("doc_id", (F.col("doc_id") != F.col("keeper")).alias("removed"), "start", "n", "cluster", F.lit(1).cast("long").alias("units"))
    passages = _runs(long.unionByName(rest), "doc_id", "removed")
    return (
        passages.groupBy(*run)
        .agg(
            F.min("start").alias("start"),
            (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"),
            F.min("cluster").alias("cluster_id"),
            F.sum("units").alias("units"),
        )
        .select("doc_id", "start", "n", "cluster_id", "removed", "units")
    )
