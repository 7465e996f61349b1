"""Symbols and calls of source files.

Python is parsed by the standard library. Rust, Go, TypeScript and JavaScript are read by a scanner that
knows strings, comments and brackets, and the declarations below; it does not check the rest of the
grammar. Each file is one row of a Python worker; everything else of the library stays in expressions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL_FIELDS = "file_path string, language string, kind string, name string, fqn string, start_line int, start_col int, end_line int, end_col int, ordinal long, error string"
CALL_FIELDS = "file_path string, language string, target_name string, start_line int, start_col int, end_line int, end_col int, ordinal long, error string"
# Words that a bracket may follow without being a call.
NO_CALL = {
    "rust": set("if while for match loop return in let fn move as where impl unsafe else break".split()),
    "typescript": set("if while for switch return catch function typeof await void new in of delete throw super import yield case do else instanceof".split()),
}
MODIFIERS = {
    "rust": set("pub async unsafe const extern default".split()),
    "typescript": set("async static public private protected readonly override get set abstract".split()),
}


class Token(NamedTuple):
    kind: str  # word, text, note, or the mark itself
    text: str
    start: int
    end: int


class Symbol(NamedTuple):
    kind: str
    name: str
    fqn: str
    start: int
    end: int


_SCANNERS = {
    "rust": r'(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>b?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\(?:x..|u\{[^}]*\}|.)|[^\'\\])\')|(?P<life>\'[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<mark>::|->|=>|[^\s\w])',
    "go": r'(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<word>[A-Za-z_]\w*)|(?P<mark>[^\s\w])',
    "typescript": r'(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>=>|[^\s\w])',
}
_SCANNERS = {k: re.compile(v, re.S) for k, v in _SCANNERS.items()}
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _scan(source: str, language: str) -> tuple[list[Token], dict[int, int], str | None]:
    """Tokens without notes but attributes, the partner of every bracket, and an error for unpaired ones."""
    tokens = []
    for m in _SCANNERS[language].finditer(source):
        kind = m.lastgroup if m.lastgroup != "h" else "text"
        if m.group("note") is None:
            tokens.append(Token(m.group() if kind == "mark" else kind, m.group(), m.start(), m.end()))
    pairs, stack, error = {}, [], None
    for i, t in enumerate(tokens):
        if t.kind in OPENS:
            stack.append(i)
        elif t.kind in CLOSES:
            if not stack or OPENS[tokens[stack[-1]].kind] != t.kind:
                error = error or "unpaired bracket"
                continue
            pairs[stack.pop()] = i
    return tokens, pairs, error or ("unpaired bracket" if stack else None)


def _find(tokens: list[Token], at: int, stop: int, marks: set[str], pairs: dict[int, int]) -> int | None:
    """The first of these marks from ``at``, outside round and square brackets."""
    while at < stop:
        if tokens[at].kind in marks:
            return at
        at = pairs.get(at, at) + 1 if tokens[at].kind in "([" else at + 1
    return None


def _walk(source: str, tokens: list[Token], pairs: dict[int, int], language: str) -> Iterator[Symbol]:
    """Symbols in order of their start; every symbol, and every impl, holds those inside it."""
    stack: list[tuple[int, str, str]] = []  # last token inside, name, kind of container
    before: dict[int, str] = {}  # depth: text of the sibling before
    i = 0
    while i < len(tokens):
        while stack and i > stack[-1][0]:
            stack.pop()
        t = tokens[i]
        word = t.text if t.kind == "word" else ""
        depth = len(stack)
        last = tokens[i - 1].text if i else ""
        end, name, kind, container = None, None, None, None
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        named = nxt is not None and nxt.kind == "word"
        if language == "rust":
            if t.kind == "#" and nxt and nxt.kind == "[":
                close = pairs.get(i + 1, i + 1)
                before[depth] = source[t.start : tokens[close].end]
                i = close + 1
                continue
            if word in ("mod", "struct", "enum", "fn") and named:
                body = _find(tokens, i + 2, len(tokens), {"{", ";"}, pairs)
                if body is not None and not (word == "fn" and tokens[body].kind == ";"):
                    end = pairs.get(body, body) if tokens[body].kind == "{" else body
                    name = nxt.text
                    kind = {"mod": "module", "struct": "class", "enum": "enum"}.get(word) or ("method" if stack and stack[-1][2] == "impl" else "function")
            elif word == "impl" and last != ":" and last != "->" and last not in ("(", ",", "<", "&", "="):
                body = _find(tokens, i + 1, len(tokens), {"{", ";"}, pairs)
                if body is not None and tokens[body].kind == "{":
                    head = source[t.end : tokens[body].start]
                    head = re.sub(r"^\s*<[^{]*?>(?=\s+[A-Za-z_&(\[])", "", head) if head.lstrip().startswith("<") else head
                    head = re.split(r"\bwhere\b", head)[0]
                    target = re.split(r"\bfor\b", head)[-1].strip()
                    stack.append((pairs.get(body, len(tokens)), target, "impl"))
                    before.pop(len(stack), None)
                    i = body + 1
                    continue
        elif language == "go":
            if word == "func" and depth == 0 and nxt is not None:
                j, receiver = i + 1, ""
                if nxt.kind == "(":
                    close = pairs.get(i + 1, i + 1)
                    parts = source[nxt.end : tokens[close].start].split()
                    receiver = parts[-1].lstrip("*") + "." if parts else ""
                    j = close + 1
                if j < len(tokens) and tokens[j].kind == "word":
                    body = _find(tokens, j + 1, len(tokens), {"{"}, pairs)
                    if body is not None:
                        name, kind, end = receiver + tokens[j].text, "method" if receiver else "function", pairs.get(body, body)
        else:
            if word in ("class", "interface", "enum") and named and last not in (".", "abstract"):
                body = _find(tokens, i + 2, len(tokens), {"{"}, pairs)
                if body is not None:
                    name, kind, end = nxt.text, word, pairs.get(body, body)
            elif word == "function" and named and last != ".":
                body = _find(tokens, i + 2, len(tokens), {"{", ";"}, pairs)
                if body is not None and tokens[body].kind == "{":
                    name, kind, end = nxt.text, "function", pairs.get(body, body)
            elif t.kind == "word" and nxt and nxt.kind == "(" and stack and stack[-1][2] == "classbody" and last in ("{", "}", ";", *MODIFIERS["typescript"]):
                close = pairs.get(i + 1)
                body = _find(tokens, close + 1, len(tokens), {"{", ";"}, pairs) if close else None
                if body is not None and tokens[body].kind == "{":
                    name, kind, end = t.text, "method", pairs.get(body, body)
        if name is None:
            i += 1
            continue
        first = i
        if language in MODIFIERS and kind not in ("class", "interface", "enum", "module") or language == "rust":
            while first and (tokens[first - 1].text in MODIFIERS[language] or (tokens[first - 1].kind == ")" and first > 2 and tokens[first - 3].text == "(" and first > 3 and tokens[first - 4].text == "pub") or (tokens[first - 1].kind == "text" and first > 1 and tokens[first - 2].text == "extern")):
                first -= 3 if tokens[first - 1].kind == ")" else 1
        text = source[tokens[first].start : tokens[end].end]
        if kind in ("function", "method"):
            marked = language == "rust" and any(a in x for a in ("#[test]", "#[tokio::test]") for x in (text, before.get(depth, "")))
            plain = name.split(".")[-1] if language == "go" and kind == "function" else name
            if marked or plain.startswith({"rust": "test_", "go": "Test", "typescript": "test"}[language]):
                kind = "test_case"
        before[depth] = text
        yield Symbol(kind, name, "::".join([*(s[1] for s in stack), name]), tokens[first].start, tokens[end].end)
        container = "classbody" if kind == "class" and language == "typescript" else "class" if kind in ("class", "interface", "enum", "test_case") else "module"
        stack.append((end, name, container))
        before.pop(len(stack), None)
        i += 2


def _python_symbols(source: str) -> list[Symbol]:
    starts = [0]
    for line in source.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    out = []

    def walk(node: ast.AST, parents: list[str], inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "test_case" if child.name.startswith("test_") else "method" if inside_class else "function"
                at = (starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset)
                out.append(Symbol(kind, child.name, "::".join([*parents, child.name]), *at))
                walk(child, [*parents, child.name], is_class or kind == "test_case")
            else:
                walk(child, parents, inside_class)

    walk(ast.parse(source), [], False)
    return out


def symbols_of(source: str, language: str) -> tuple[list[Symbol], str | None]:
    """The symbols of a file and its error; a file with an error gives no symbols. Python offsets count bytes."""
    if language == "python":
        try:
            return _python_symbols(source), None
        except (SyntaxError, ValueError) as e:
            return [], f"syntax error: {e}"
    grammar = "typescript" if language in ("typescript", "javascript") else language
    if grammar not in _SCANNERS:
        return [], "unsupported language"
    tokens, pairs, error = _scan(source, grammar)
    return ([], error) if error else (list(_walk(source, tokens, pairs, grammar)), None)


def _target(raw: str) -> str | None:
    if "." in raw:
        return None
    return re.sub(r"[^A-Za-z0-9_]", "", raw.rsplit("::", 1)[-1]) or None


def calls_of(source: str, language: str) -> list[tuple[str, int, int]]:
    """(callee, start, end) of direct calls: Rust paths and macro contents, and plain names of TypeScript."""
    grammar = "typescript" if language in ("typescript", "javascript") else language
    if grammar not in ("rust", "typescript"):
        return []
    tokens, pairs, error = _scan(source, grammar)
    out, skip = [], -1
    for i, t in enumerate(tokens[:-1] if not error else []):
        if i <= skip or t.kind != "word":
            continue
        nxt, last = tokens[i + 1], tokens[i - 1].text if i else ""
        if grammar == "rust" and nxt.kind == "!" and i + 2 < len(tokens) and tokens[i + 2].kind in OPENS and t.text != "macro_rules":
            first = i
            while first > 1 and tokens[first - 1].text == "::":
                first -= 2
            skip = pairs[i + 2]
            start, end = tokens[first].start, tokens[skip].end
            raw = source[start:end]
            found = {_target(re.search(r"[A-Za-z0-9_:]*\Z", raw[: m.start()].rstrip()).group()) for m in re.finditer(r"\(", raw)}
            out += [(name, start, end) for name in sorted(n for n in found if n)]
        elif nxt.kind == "(" and t.text not in NO_CALL[grammar] and last not in (".", "fn", "function", "new"):
            if grammar == "rust":
                first = i
                while first > 1 and tokens[first - 1].text == "::":
                    first -= 2
                if first and tokens[first - 1].text in (".", "fn", "#", "["):
                    continue
                out.append((t.text, tokens[first].start, tokens[pairs[i + 1]].end))
            else:
                after = tokens[pairs[i + 1] + 1].kind if pairs[i + 1] + 1 < len(tokens) else ""
                if after != "{" and last not in MODIFIERS["typescript"] - {"async"}:
                    out.append((t.text, t.start, tokens[pairs[i + 1]].end))
    return out


def _places(source: str, in_bytes: bool):
    """From an offset to (line from 1, byte column from 0)."""
    data = source.encode()
    lines = [0]
    for m in re.finditer(rb"\n", data):
        lines.append(m.end())
    import bisect

    def place(offset: int) -> tuple[int, int]:
        at = offset if in_bytes else len(source[:offset].encode())
        row = bisect.bisect_right(lines, at) - 1
        return row + 1, at - lines[row]

    return place


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (file_path, language, body), and one row with an error for each file that fails.

    Callers choose: to fail on any error row, as the reference does, or to set such files aside.
    """

    def of(batches):
        for pdf in batches:
            rows = []
            for path, language, body in zip(pdf["file_path"], pdf["language"], pdf["body"], strict=True):
                body = body or ""
                found, error = symbols_of(body, language)
                place = _places(body, language == "python")
                if error:
                    rows.append((path, language, None, None, None, None, None, None, None, 0, error))
                for n, s in enumerate(found):
                    rows.append((path, language, s.kind, s.name, s.fqn, *place(s.start), *place(s.end), n, None))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SYMBOL_FIELDS.split(", ")]).astype(object)

    return files.select("file_path", "language", "body").mapInPandas(of, SYMBOL_FIELDS)


def calls(files: DataFrame) -> DataFrame:
    def of(batches):
        for pdf in batches:
            rows = []
            for path, language, body in zip(pdf["file_path"], pdf["language"], pdf["body"], strict=True):
                place = _places(body or "", False)
                for n, (name, start, end) in enumerate(calls_of(body or "", language)):
                    rows.append((path, language, name, *place(start), *place(end), n, None))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in CALL_FIELDS.split(", ")]).astype(object)

    return files.select("file_path", "language", "body").mapInPandas(of, CALL_FIELDS)


def failed(found: DataFrame) -> DataFrame:
    return found.where(F.col("error").isNotNull()).select("file_path", "language", "error")
