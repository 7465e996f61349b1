import html
import re

import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import htmltext  # noqa: E402
from lodestrata.llm.queries import QUERIES  # noqa: E402

CASES = [
    ("", ""),
    ("plain &amp; simple &copy;&notanentity;", "plain & simple ©¬anentity;"),
    ("<p>a<p>b", "a\n\nb"),
    ("<p>a<br>b<br><br>c</p>d", "a\nb\n\nc\n\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "* a\n* b\n  * c\n* d\n\ne"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("<pre>x\n  y</pre>z", "x\n  y\n\nz"),
    ("<div hidden>no</div><p style='display: none'>no</p><span style='visibility:hidden'>no</span>yes", "yes"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><noscript>x</noscript>t<!-- c --> u", "t u"),
    ("<table><tr><th>aa<th>b<tr><td>c<td>dddd<tr><td colspan=2>wide cell text</table>", "aa  b\nc   dddd\nwide cell text"),
    ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x  y\n   z"),
    ("<b>one</b> <i>two</i>three", "one twothree"),
    ("<title>t</title><body>b", "b"),
    ("a<p", "a"),
    ("a<b", "a"),
    ("a < b and c > d", "a < b and c > d"),
    ("<p>x</div></span>y", "xy"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<p>one<h1>two</h1>three", "one\n\ntwo\n\nthree"),
    ("<img alt='pic'>x", "pic x"),
    ("<textarea> a <b> </textarea>", "a <b>"),
    ("<p>unclosed attribute <a href='x>y</a> z", "unclosed attribute y z"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_rendering(source, want):
    assert htmltext.render(source).strip() == want


def test_query_keeps_every_visible_word(spark):
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op10_html"](spark, path).collect()}
    assert got.keys() == pages.keys()
    for p, source in pages.items():
        plain = re.sub(r"(?s)<(script|style|title)\b.*?(</\1>|\Z)|<!--.*?-->|<[!/a-zA-Z][^>]*(>|\Z)", " ", source)
        assert html.unescape(plain).split() == [w for w in got[p].split() if w != "*"], p


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a", None), (1, "<p>a", "y"), (2, "<p>" + "word " * 50000, None)], "page_id long, html string, text string")
    got = htmltext.extract(df).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 1), (1, 0), (1, 1), (2, 249999)]
    assert htmltext.extract(df.limit(0)).count() == 0


STRAY = [
    ("<table><tr>Total<td>5</table>", "Total\n\n5"),
    ("<table><tbody><p>note</p><tr><td>1</table>", "note\n\n1"),
    ("<table>a<thead>b<tr>c<th>h</th>d</tr></thead><tfoot>e<tr><td>f</table>", "abcde\n\nh\nf"),
    ("<table><caption>cap</caption><tr><b>x</b><td>1<td>2</tr>y</table>", "xy\n\ncap\n1  2"),
    ("<table><colgroup><col>z</colgroup><tr hidden>y<td>no</tr><tr><i hidden>no</i><td>1</table>", "zy\n\n1"),
    ("<table hidden><tr>seen<td>no</table>", "seen"),
    ("<table><tr><b>x<td>1<td>2</table>", "x\n\n1  2"),
    ("<table><form><tr><td>1<td>2</form></table>z", "1  2\n\nz"),
    ("<table><tr>a<table><tr><td>1</table>b", "a\n\n1\n\nb"),
    ("<table><tr><td>a<table>b<tr><td>1</table>c</table>", "ab\n\n1\n\nc"),
]


@pytest.mark.parametrize("source,want", STRAY)
def test_stray_parts_of_tables_come_before_them(source, want):
    assert htmltext.render(source).strip() == want


@pytest.mark.parametrize("deep", [300, 20000])
def test_depth_changes_nothing(deep):
    a, b = "<div>" * deep, "</div>" * deep
    inside = "<ul><li>a<li>b</ul><noscript><b>no</b></noscript><div hidden><p>no</p></div><table><tr><td>1<td>2</table><p>c</p>"
    assert htmltext.render(a + inside + b + "z").strip() == "* a\n* b\n\n1  2\n\nc\n\nz"
    assert htmltext.render("<span>" * deep + "x<div>y</div>" + "</span>" * deep + "z").strip() == "x\ny\nz"
    assert htmltext.render("<table><tr><td>" * 300 + "x" + "</table>" * 300).strip() == "x"


VISIBILITY = [
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>and</b></p>no</div>", "yesand"),
    ("<div style='visibility:hidden'><div style='display:none'><b style='visibility:visible'>no</b></div>x</div>y", "y"),
    ("<p style='display:none;display:block'>last one counts</p>", "last one counts"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "* yes"),
    ("<table style='visibility:collapse'><tr><td>no<td style='visibility:visible'>1<tr style='visibility:visible'><td>2</table>", "1\n2"),
    ("<div hidden style='visibility:visible'>no</div>a<img alt=no style='visibility:hidden'>b", "ab"),
]


@pytest.mark.parametrize("source,want", VISIBILITY)
def test_visibility_is_inherited_and_can_be_undone(source, want):
    assert re.sub(r"  +", "", htmltext.render(source)).strip() == want


def test_random_broken_pages_show_just_the_visible_words():
    """Tags opened and closed at random, tables among them; hidden parts are closed properly, so their words are known."""
    import random

    tags = "div p b i span ul li ol table tr td th tbody thead caption blockquote h1 pre a dl dt dd".split()
    for seed in range(400):
        rng, parts, want, hidden, n = random.Random(seed), [], [], [], 0
        for _ in range(rng.randint(5, 120)):
            n += 1
            kind = rng.random()
            if kind < 0.45:
                parts.append(f" w{n} ")
                want.append(f"w{n}")
            elif kind < 0.75:
                parts.append(f"<{rng.choice(tags)}>")
            elif kind < 0.92:
                parts.append(f"</{rng.choice(tags)}>")
            else:
                inside = rng.choice(["<b>x{0}</b>", "x{0}", "<ul><li>x{0}</ul>", "<li>x{0}"]).format(n)
                if rng.random() < 0.3:
                    inside = f"<table><tr>x{n}<td>x{n}</table>"
                    parts.append(f"<template>{inside}</template>")
                else:
                    parts.append(rng.choice(["<section hidden>{}</section>", "<section style='display:none'>{}</section>", "<script>x{1}</script>", "<template>{}</template>"]).format(inside, n))
                hidden.append(f"x{n}")
        text = htmltext.render("".join(parts))
        assert sorted(re.findall(r"w\d+", text)) == sorted(want), seed
        assert not re.search(r"x\d", text), seed


def long_pages(n):
    """Pages of about ``n`` characters whose plain layout would grow with their square."""
    wide = "w" * (n // 10)
    return {
        "one wide cell, many rows": f"<table><tr><td>{wide}<td>x" + "<tr><td>a<td>b" * (n // 15) + "</table>",
        "many columns, rows with the last only": "<table><tr>" + "<td>c" * 900 + "<tr><td colspan=899><td>x" * (n // 25) + "</table>",
        "deep quotes": "<blockquote>q " * (n // 14),
        "deep lists": "<ul><li>i " * (n // 10),
        "deep ordered lists": "<ol start=100000000><li>i " * (n // 26),
        "nested tables": "<table><tr><td>a<td>" * (n // 21) + "end",
        "long spans": "<table>" + "<tr><td rowspan=65534>r<td>s" * (n // 600) + "<tr><td>t" * (n // 12),
        "lines in cells": "<table><tr><td>" + wide + "<td>" + "b<br>" * (n // 6) + "</table>",
    }


@pytest.mark.parametrize("name", list(long_pages(100)))
def test_a_long_page_takes_room_in_proportion(name):
    source = long_pages(300_000)[name]
    text = htmltext.render(source)
    assert len(text) < 10 * len(source)
    words = lambda s: sorted(re.findall("[a-z]+", s))
    assert words(text) == words(re.sub("<[^>]*>", " ", source))


def test_a_page_of_a_megabyte():
    source = "<table><tr><td>" + "w" * 500_000 + "<td>x" + "<tr><td>a<td>b" * 35_000 + "</table>"
    text = htmltext.render(source)
    assert len(text) < 10 * len(source) and text.split("\n")[-1] == "a  b"


def test_spans_over_many_rows():
    text = htmltext.render("<table><tr><td rowspan=3000>side<td>r0" + "".join(f"<tr><td>r{i}" for i in range(1, 2999)) + "<tr><td>r2999<tr><td>last</table>")
    lines = text.split("\n")
    assert lines[0] == "side  r0" and lines[2999] == "      r2999" and lines[3000] == "last"
