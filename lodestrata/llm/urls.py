"""URL filters: host and path rules, and boosted trees over lexical features for the rest.

Everything that touches the table is a SQL expression: parsing, rule matching, features, and the trees,
which are written out as one expression. The driver sees a bounded sample of labelled URLs' features.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.boosting import Trees
from lodestrata.llm.common import ascii_lower, hash_share

TRAIN_ROWS, FOLDS = 20_000, 4
#: Rows of the overall rate that a suffix's own rate is smoothed with.
SMOOTH = 10


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query, and words of host names that label a URL as unwanted.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
UNWANTED = ("adult", "ads", "bet", "bets", "casino", "malware", "phish", "pills", "porn", "spam", "warez", "xxx")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null where none does.

    A rule fits its host and every subdomain, where the path starts with the rule's; of rules of equal
    length the first by text wins.
    """
    out = F.lit(None).cast("struct<text: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"(?s)[^{pattern}]", "")).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.length(text).cast("double")
    part = lambda c: F.length(F.replace(text, c, F.lit(""))) / size  # noqa: E731  what is left without c
    return F.when(
        size > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(part(c) < 1, (1 - part(c)) * F.log2(1 - part(c))).otherwise(0.0))
    ).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features of a URL but for its suffix's statistics."""
    url = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "path_depth": _count(path, "/"),
        "host_depth": _count(host, "."),
        "host_hyphens": _count(host, "-"),
        "digit_ratio": _count(url, "0-9") / size,
        "path_digits": _count(path, "0-9"),
        "host_digits": _count(host, "0-9"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": F.when(F.length(query) > 0, 1 + _count(query, "&")).otherwise(0.0),
        "query_length": F.length(query).cast("double"),
        "has_fragment": url.contains("#").cast("double"),
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "is_secure": url.startswith("https").cast("double"),
        "first_part": F.length(F.regexp_extract(path, r"^/([^/]*)", 1)).cast("double"),
    }


class Model:
    """Trees, and the block rates of host suffixes, smoothed towards the overall rate."""

    def __init__(self, names: list[str], trees: Trees, rates: dict[str, float], rate: float):
        self.names, self.trees, self.rates, self.rate = names, trees, rates, rate

    def suffix_rate(self, host: Column) -> Column:
        out = F.lit(self.rate)
        if self.rates:
            pairs = [F.lit(x) for s in sorted(self.rates) for x in (s, self.rates[s])]
            out = F.coalesce(F.try_element_at(F.create_map(*pairs), suffix_of(host)), out)
        return out


def labelled(urls: DataFrame, unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(url, host, path, bad): URLs with a host, labelled by a list of unwanted host words.

    The rules of the query give no labels: they stand for themselves, and the trees judge what they leave.
    """
    parsed = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    word = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, unwanted)))
    return parsed.select("url", "host", "path", word.cast("int").alias("bad"))


def _rates(suffix: list[str], bad: np.ndarray, rate: float) -> dict[str, float]:
    """The share of bad rows of each suffix, smoothed towards the overall one."""
    held: dict[str, list[float]] = {}
    for s, y in zip(suffix, bad, strict=True):
        of = held.setdefault(s, [0.0, 0.0])
        of[0] += y
        of[1] += 1
    return {s: float((y + SMOOTH * rate) / (n + SMOOTH)) for s, (y, n) in held.items()}


def train(known: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Trees over the features of at most about ``train_rows`` different labelled URLs, taken by a hash of the URL.

    A URL counts once, however many rows hold it. The suffix rate of a training row comes from the other
    folds, so that it tells nothing of the row's own label; suffixes that none of the sample has get the
    overall rate. Without labels, or with labels of one kind, every URL has the same score.
    """
    count = known.agg(F.approx_count_distinct("url")).first()[0]
    spot = F.pmod(F.xxhash64("url"), F.lit(1_000_000))
    chosen = known.where(hash_share(F.col("url")) < min(1.0, train_rows / max(count, 1))).groupBy("url").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.max("bad").alias("bad"))
    made = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = chosen.select(*[c.alias(n) for n, c in made.items()], suffix_of(F.col("host")).alias("suffix"), "bad", (spot % FOLDS).alias("fold"), "url").orderBy("url").collect()
    names = list(made)
    y, fold, suffix = np.array([r["bad"] for r in rows], dtype=np.float64), np.array([r["fold"] for r in rows]), [r["suffix"] for r in rows]
    rate = float((y.sum() + 1) / (len(y) + 2))
    own = np.full(len(rows), rate)
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        others = _rates([suffix[i] for i in rest], y[rest], rate)
        for i in np.flatnonzero(fold == f):
            own[i] = others.get(suffix[i], rate)
    x = np.column_stack([*(np.array([r[n] for r in rows], dtype=np.float64) for n in names), own]) if rows else np.zeros((0, len(names) + 1))
    return Model([*names, "suffix_rate"], Trees(rounds=40, depth=3, rate=0.2).fit(x, y), _rates(suffix, y, rate), rate)


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row for each page; only page_id and url are read.

    The rule's verdict stands; else a URL is blocked where the trees give it more than even odds. A null
    URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees. URLs may
    have any length; rows that repeat or lack a page_id keep a row each; no pages give no rows.
    """
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    made = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_rate": model.suffix_rate(F.col("host"))}
    marked = parsed.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("r"), *[c.alias(n) for n, c in made.items()])
    scored = marked.select("page_id", "host", "path", "r", F.expr(model.trees.sql(model.names)).alias("margin"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.text").alias("rule"), verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("margin")))).alias("score"))
