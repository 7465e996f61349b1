import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ids, text


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_language(spark):
    paths = ["a.rs", "a.TS", "b.tsx", "c.mjs", "d.py", "e.go", "f.java", "g.php", ".rs", "x/.py", "noext", "a.b.cjs", "dir.rs/file"]
    want = ["rust", "unknown", "typescript", "javascript", "python", "go", "java", "php", "unknown", "unknown", "unknown", "javascript", "unknown"]
    assert run(spark, paths, text.language) == want


def test_path_flags(spark):
    assert run(spark, ["vendor", "a/vendor", "a/vendor/b", "VENDOR/x", "node_modules/a", "vendored/a"], text.is_vendor) == [True, False, True, True, True, False]
    assert run(spark, ["gen/a", "x/gen/a", "a.pb.go", "a.generated.ts", "regen/a", "Generated/x"], text.is_generated) == [True, True, True, True, False, True]
    assert run(spark, ["tests/a", "x/tests/a", "a_test.go", "a.spec.ts", "test/a", "mytests/a"], text.is_test) == [True, True, True, True, False, False]
    assert run(spark, [".git", ".git/x", "target/a", "targets", ".github/x", "src/target/a"], text.is_ignored) == [True, True, True, False, False, False]


def test_architecture(spark):
    paths = ["CODEOWNERS", "docs/CODEOWNERS", ".github/CODEOWNERS", "docs/adr/0001.md", "docs/x.md", "openapi.yaml", "a/openapi.yaml", "a/b.openapi.json", "schema.graphql", "x/y.GraphQL", "migrations/1.sql", "a/migrations/1.sql", "adr/x.txt"]
    want = ["codeowners", None, "codeowners", "adr", "documentation", "openapi", None, "openapi", "graphql", "graphql", "db_migration", None, None]
    assert run(spark, paths, text.architecture_kind) == want


def test_line_count(spark):
    assert run(spark, ["", "a", "a\n", "a\nb", "a\n\n", "a\r\nb\r\n"], text.line_count) == [1, 1, 1, 2, 2, 2]


def test_millis(spark):
    values = ["1.5", "0.0129", "2", "-0.5", "-1.5", "1e-3", "1,234.5", "", ".5", "3.", "99999999999999999999"]
    assert run(spark, values, text.seconds_to_millis) == [1500, 12, 2000, 500, -1500, None, None, None, None, 3000, None]


def test_case_and_space(spark):
    assert run(spark, ["ÉKAK"], text.ascii_lower) == ["ÉkaK"]
    assert run(spark, ["  a b \t\n", " "], text.trim) == ["a b", ""]
    assert run(spark, ["Get-User_ID é"], text.normalized) == ["getuserid"]
    assert run(spark, ["A b/é"], text.token_slug) == ["a-b--"]


def redact_plain(value):
    out, pending = [], 0
    for token, space in re.findall(r"(\S*)(\s|\Z)", value):
        shown = token
        if token:
            at = min((i for i in (token.find("="), token.find(":")) if i >= 0), default=0)
            key, rest = token[:at], token[at + 1 :]
            norm = re.sub("[^a-z0-9_-]", "", text.ascii_lower_text(key))
            secret = at > 0 and (norm == "authorization" or any(p in norm for p in text.SECRET_KEY_PARTS))
            low = text.ascii_lower_text(token.strip(text.PUNCTUATION))
            if pending:
                pending, shown = pending - 1, text.REDACTED
            elif secret and not rest:
                pending, shown = 2, token[: at + 1]
            elif secret:
                shown = token[: at + 1] + text.REDACTED
            elif low.startswith(text.SECRET_PREFIXES) or (low.startswith("sk-") and len(low.encode()) >= 12):
                shown = text.REDACTED
        out += [shown, space]
    return "".join(out)


def test_redaction_matches_a_plain_model(spark):
    rng = random.Random(0)
    parts = ["password", "api_key", "Token", "=", ":", " ", "\n", "ghp_x", "(sk-abcdefghijkl)", "sk-ab", "word", '"glpat-1",', "é", "x=1", "Authorization", "\t", "  "]
    parts += ["pass", ".", "word", "se", "-", "_", "cret", "PRIVATE", "_key", "\u00a0", "\u2003", "[redacted]", "auth", "$1", "\\"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(24))) for _ in range(3000)]
    assert run(spark, values, text.redact) == [redact_plain(v) for v in values]


def test_redaction_takes_time_in_proportion_to_the_text(spark):
    """Long texts of keys that wait, of one long token, and of keys with characters between their letters."""
    import time

    values = ["password= a token: b word " * 40_000, "p." * 400_000 + "=", "a" * 1_000_000 + "= x y", "secret: " * 100_000]
    began = time.time()
    got = run(spark, values, text.redact)
    assert time.time() - began < 30
    assert got == [redact_plain(v) for v in values]


def test_redaction_fixtures(spark):
    values = ["token=abc rest", "Authorization: Bearer abc kept", "plain text stays", 'token = "x" y']
    assert run(spark, values, text.redact) == ["token=[redacted] rest", "Authorization: [redacted] [redacted] kept", "plain text stays", 'token = "x" y']


def test_terms_and_required():
    assert text.query_terms(" Load_Beam load_beam É-b ") == ["load_beam", "load_beam", "b"]
    assert text.required(" a ", "q") == "a"
    with pytest.raises(ValueError):
        text.required("  ", "q")


def test_ids_count_bytes(spark):
    import hashlib

    def plain(prefix, parts, hashed):
        h = hashlib.sha256()
        for p in ([prefix] if hashed else []) + parts:
            h.update(f"{len(p.encode())}:{p};".encode())
        return f"{prefix}:{h.hexdigest()}"

    row = spark.range(1).select(ids.stable_symbol(F.lit("r"), F.lit("é/ß"), F.lit("a::b")).alias("a"), ids.symbol_node(F.lit("v")).alias("b")).first()
    assert row.a == plain("sym", ["r", "é/ß", "a::b"], True)
    assert row.b == plain("gn", ["symbol", "versioned", "symbol", "v"], False)
