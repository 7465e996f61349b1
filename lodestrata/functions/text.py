"""Path, identifier and text functions, as Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# File extensions, marks of generated, vendored and test paths, ignored folders.
EXTENSIONS = {
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "php": "php",
    "py": "python",
    "java": "java",
    "go": "go",
}
GENERATED_FOLDERS = ("generated/", "gen/", "assets/repo-explorer/")
GENERATED_PART, GENERATED_END = ".generated.", ".pb.go"
VENDOR_TREES = ("vendor", "node_modules", "third_party")
TEST_FOLDER, TEST_PARTS = "tests/", ("_test.", ".test.", ".spec.")
IGNORED_ROOTS = (".git", "target", ".omo/evidence", ".omo/ulw-loop")
INDEXABLE = ("rust", "typescript", "javascript", "python", "go")
TRUSTED_SOURCES = ("ci_artifact", "runtime_trace", "user_instruction", "system_instruction")
SECRET_KEY_PARTS = (
    "password",
    "passwd",
    "secret",
    "token",
    "apikey",
    "api_key",
    "accesskey",
    "access_key",
    "privatekey",
    "private_key",
)
SECRET_PREFIXES = ("ghp_", "github_pat_", "glpat-", "glpat_")
SHORT_SECRET_PREFIX, SHORT_SECRET_LENGTH = "sk-", 12
PUNCTUATION = "\"'`,.;)([]{}"
REDACTED = "[redacted]"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name, case kept; empty for none and for dotfiles."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def language(path: Column) -> Column:
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def json_language(language_column: Column) -> Column:
    """The spelling of outputs in JSON, which differs from the tables'."""
    return F.when(language_column == "typescript", "type_script").when(language_column == "javascript", "java_script").otherwise(language_column)


def is_generated(path: Column) -> Column:
    low = ascii_lower(path)
    tests = [t for d in GENERATED_FOLDERS for t in (low.contains("/" + d), low.startswith(d))]
    return any_of(*tests, low.contains(GENERATED_PART), low.endswith(GENERATED_END))


def is_vendor(path: Column) -> Column:
    """A vendor tree at the root, or below it when something follows; a nested last part alone is none."""
    low = ascii_lower(path)
    return any_of(*(t for d in VENDOR_TREES for t in (low == d, low.startswith(d + "/"), low.contains(f"/{d}/"))))


def is_test(path: Column) -> Column:
    low = ascii_lower(path)
    return any_of(low.startswith(TEST_FOLDER), low.contains("/" + TEST_FOLDER), *(low.contains(p) for p in TEST_PARTS))


def is_ignored(path: Column) -> Column:
    """Git's folder, build and tool artifacts, and vendor trees. Ignore files are not read."""
    return any_of(is_vendor(path), *(t for d in IGNORED_ROOTS for t in (path == d, path.startswith(d + "/"))))


def is_indexable(path: Column, language_column: Column) -> Column:
    return ~is_vendor(path) & ~is_generated(path) & language_column.isin(*INDEXABLE)


def architecture_kind(path: Column) -> Column:
    """The kind of an architecture document, by the first rule that fits; null for other files."""
    low = ascii_lower(path)
    ext = ascii_lower(extension(path))
    adr = (ext == "md") & any_of(low.startswith("docs/adr/"), low.startswith("doc/adr/"), low.startswith("adr/"), low.contains("/adr/"))
    api = [f"{stem}.{e}" for stem in ("openapi", "swagger") for e in ("yaml", "yml", "json")]
    return (
        F.when(low.isin("codeowners", ".github/codeowners"), "codeowners")
        .when(low.isin(*api), "openapi")
        .when(any_of(*(low.endswith(f".openapi.{e}") for e in ("yaml", "yml", "json"))), "openapi")
        .when(ext == "graphql", "graphql")
        .when(low.startswith("migrations/") & (ext == "sql"), "db_migration")
        .when(adr, "adr")
        .when(low.startswith("docs/") & (ext == "md"), "documentation")
    )


def line_count(body: Column) -> Column:
    """Lines of a text, a final line break not counted; at least one."""
    plain = F.regexp_replace(body, r"\r?\n\z", "")
    return F.greatest(F.when(body == "", 1).otherwise(F.size(F.split(plain, "\n", -1))), F.lit(1)).cast("int")


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "exact").when(confidence >= 0.80, "high").when(confidence >= 0.50, "medium").otherwise("low")


def trust_level(source_kind: Column) -> Column:
    return F.when(source_kind.isin(*TRUSTED_SOURCES), "trusted").otherwise("untrusted")


def normalized(text: Column) -> Column:
    """ASCII letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def normalized_contains(haystack: Column, needle: Column) -> Column:
    """Whether the normalised haystack holds the normalised needle; false for an empty one."""
    n = normalized(needle)
    return (n != "") & normalized(haystack).contains(n)


def token_slug(text: Column) -> Column:
    """Every character that is no ASCII letter or digit becomes a hyphen; lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", "-"))


def seconds_to_millis(text: Column) -> Column:
    """Decimal seconds to whole milliseconds, cut off; null for anything but digits around one point.

    The sign of a whole part of -0 is lost, so -0.5 gives 500.
    """
    whole = F.split_part(text, F.lit("."), F.lit(1))
    rest = F.when(F.instr(text, ".") > 0, F.substring(text, F.instr(text, ".") + 1, F.length(text))).otherwise("")
    digits = F.rpad(F.substring(rest, 1, 3), 3, "0")
    part = F.when(digits.rlike("^[0-9]{3}$"), digits.try_cast("long"))
    head = F.when(whole.rlike("^[+-]?[0-9]+$"), whole.try_cast("long"))
    return F.try_add(F.try_multiply(head, F.lit(1000)), F.when(head < 0, -part).otherwise(part))


def redact_config(key: Column, value: Column) -> Column:
    """A configuration value, hidden where its key names a secret."""
    up = F.translate(key, LOWER, UPPER)
    secret = any_of(up.contains("PASSWORD"), up.contains("SECRET"), up.contains("TOKEN"), up.endswith("_KEY"))
    return F.when(secret, REDACTED).otherwise(value)


def _key_is_secret(key: Column) -> Column:
    plain = F.regexp_replace(ascii_lower(key), "[^a-z0-9_-]", "")
    return (plain == "authorization") | any_of(*(plain.contains(p) for p in SECRET_KEY_PARTS))


def _has_secret_prefix(token: Column) -> Column:
    marks = "".join("\\" + c for c in PUNCTUATION)
    low = ascii_lower(F.regexp_replace(token, f"^[{marks}]+|[{marks}]+$", ""))
    return any_of(*(low.startswith(p) for p in SECRET_PREFIXES), low.startswith(SHORT_SECRET_PREFIX) & (F.octet_length(low) >= SHORT_SECRET_LENGTH))


_SIGN = "(?i)[=:]|" + "|".join((*SECRET_PREFIXES, SHORT_SECRET_PREFIX))


def _waiting_key() -> str:
    """An expression for a token that is a secret key with its sign and nothing after it; characters that a key's plain form leaves out may stand between any two."""
    other = r"[^A-Za-z0-9_\-=:\s]*+"
    letters = lambda word: other.join(f"[{c.upper()}{c}]" if c.isalpha() else f"\\{c}" if c == "-" else c for c in word)
    parts = "|".join(map(letters, SECRET_KEY_PARTS))
    # The end is looked for first, so that only tokens that wait are searched.
    return rf"(?<!\S)(?=[^=:\s]++[=:](?!\S))(?:{other}{letters('authorization')}{other}|[^=:\s]*?(?:{parts})[^=:\s]*+)[=:]"


def redact(text: Column) -> Column:
    """Secrets in running text, hidden token by token; white space stays as it was.

    ``key=value`` or ``key:value`` with a secret key loses its value, or the next two tokens where the
    value is empty; these two are no keys themselves. Tokens with a secret's prefix go whole.

    One pass of an expression goes from key to key and hides what follows those without a value, a second one
    works on each token alone, so the time is in proportion to the text.
    """
    key = _waiting_key()
    two = F.regexp_replace(text, rf"(?U)({key}\s++)\S++(\s++)\S++", "$1[redacted]$2[redacted]")
    hidden = F.when(text.rlike(rf"(?U)[=:](?!\S)"), F.regexp_replace(two, rf"(?U)({key}\s++)\S++(\s*+)\z", "$1[redacted]$2")).otherwise(text)
    pieces = F.regexp_extract_all(hidden, F.lit(r"(?U)(\S*)(\s|\z)"), F.lit(0))

    def alone(piece: Column) -> Column:
        token = F.regexp_replace(piece, r"(?U)\s$", "")
        space = F.substring(piece, F.length(token) + 1, F.lit(1))
        key = F.regexp_extract(token, "^([^=:]+)[=:]", 1)
        kept = F.when((key != "") & _key_is_secret(key), F.concat(key, F.substring(token, F.length(key) + 1, F.lit(1))))
        waits = F.length(token) == F.length(key) + 1
        shown = F.when(kept.isNotNull() & waits, kept).when(kept.isNotNull(), F.concat(kept, F.lit(REDACTED))).when(_has_secret_prefix(token), REDACTED).otherwise(token)
        return F.when(piece.rlike(_SIGN), F.concat(shown, space)).otherwise(piece)

    # Most texts hold no sign of a secret.
    return F.when(~text.rlike(_SIGN), text).otherwise(F.array_join(F.transform(pieces, alone), ""))


def as_json(rows, *keys: str):
    """Rows as JSON objects, nulls kept, next to the columns named."""
    return rows.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


# Characters that markup gives a meaning, in the order of their replacement.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_escape(text: Column) -> Column:
    for plain, entity in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def query_terms(query: str) -> list[str]:
    """Lower-cased runs of ASCII letters, digits and underscores; repeats stay."""
    import re

    return re.findall("[a-z0-9_]+", ascii_lower_text(query.strip()))


def ascii_lower_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def required(value: str, name: str) -> str:
    """A query parameter without outer white space; raises where nothing is left."""
    plain = value.strip() if value else ""
    if not plain:
        raise ValueError(f"{name} must not be empty")
    return plain
