"""Facts from TypeScript files: imports, exports, functions, classes, calls by caller, HTTP requests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphlens.session import ship
from graphlens.sources.extract import of_kind

#: Methods of clients that send requests, and names of such clients.
_VERBS, _CLIENTS = frozenset("get post put delete patch head options request".split()), frozenset(("http", "httpClient", "axios"))
_WORDS = frozenset("if for while switch catch return function typeof new super import await throw delete in of do else case void yield with instanceof class extends const let var".split())
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`)|(?P<name>[A-Za-z_$][\w$]*|\#[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|[-+*/%&|^!=<>?:;,.()\[\]{}@~])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPENS = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line); what is no token is passed over. A slash after an operator begins a regular expression."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = None
        if text[at] == "/" and (not out or out[-1][1] in "=(,:;!&|?{}[+-*%<>~=>" or out[-1][1] in ("return", "typeof", "case")):
            m = _REGEX.match(text, at)
        kind = "regex" if m else None
        m = m or _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        kind = kind or m.lastgroup
        if kind != "skip":
            out.append((kind, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


def _matching(toks: list, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for k in range(at, len(toks)):
        if toks[k][0] == "op":
            if toks[k][1] in _OPENS:
                depth += 1
            elif toks[k][1] in ")]}":
                depth -= 1
                if depth == 0:
                    return k
    return len(toks)


def _body_after(toks: list, at: int) -> int | None:
    """Where the block of a function begins whose parameters begin at ``at``; null for a declaration without one."""
    k, angles = _matching(toks, at) + 1, 0
    while k < len(toks) and (toks[k][1] not in (";", "}", ",") or angles > 0):
        angles += (toks[k][1] == "<") - (toks[k][1] == ">")
        if toks[k][1] == "{" and angles <= 0:
            # An object type in the annotation of the result is followed by the block itself.
            after = _matching(toks, k) + 1
            if toks[k - 1][1] == ":" and after < len(toks) and toks[after][1] == "{":
                return after
            return k
        k = _matching(toks, k) + 1 if toks[k][1] in _OPENS else k + 1
    return None


def facts(text: str) -> list[tuple]:
    """(kind, name, line, detail, owner) of a file. ``owner``: the function or method around a call, else __module__; the class of a method."""
    toks = tokens(text)
    n, out = len(toks), []
    word = lambda k: toks[k][1] if 0 <= k < n else ""
    literal = lambda k: toks[k][1][1:-1] if 0 <= k < n and toks[k][0] == "string" else None
    scopes: list[tuple[int, str, str]] = []  # end, kind, name
    pending: dict[int, tuple[int, str, str]] = {}  # block begins → scope
    k = 0
    while k < n:
        while scopes and scopes[-1][0] <= k:
            scopes.pop()
        if k in pending:
            scopes.append(pending.pop(k))
        kind, value, line = toks[k]
        owner = next((s[2] for s in reversed(scopes) if s[1] == "function"), "__module__")
        in_class = scopes[-1][2] if scopes and scopes[-1][1] == "class" else None
        exported = any(word(j) == "export" for j in range(max(0, k - 3), k) if word(j) in ("export", "default", "async", "abstract", "declare") and all(word(i) in ("export", "default", "async", "abstract", "declare") for i in range(j, k)))
        after_dot = word(k - 1) in (".", "?.")
        if value == "import" and not after_dot and kind == "name":
            if word(k + 1) == "(":
                if (target := literal(k + 2)) is not None:
                    out.append(("import", target, line, None, "dynamic"))
            else:
                end, clause = k + 1, []
                while end < n and toks[end][0] != "string" and word(end) != ";" and end - k < 400:
                    clause.append(word(end))
                    end += 1
                if (target := literal(end)) is not None:
                    out += [("import", target, line, name, alias) for name, alias in _clause(clause)] or [("import", target, line, None, None)]
                    k = end
        elif value == "require" and word(k + 1) == "(" and literal(k + 2) is not None:
            out.append(("import", literal(k + 2), line, None, "require"))
        elif value == "export" and kind == "name" and word(k + 1) in ("{", "*"):
            end = _matching(toks, k + 1) if word(k + 1) == "{" else k + 1
            names = [a or b for b, a in _clause([word(j) for j in range(k + 1, end + 1)])]
            source = next((j for j in range(end + 1, min(n, end + 5)) if word(j) == "from"), None)
            if source and literal(source + 1) is not None:
                out.append(("import", literal(source + 1), line, ",".join(names) or "*", "re-export"))
            out += [("export", x, line, None, None) for x in names]
        elif value == "class" and kind == "name" and not after_dot and toks[k + 1 : k + 2] and toks[k + 1][0] == "name":
            start = next((j for j in range(k + 2, n) if word(j) == "{"), n)
            head = [word(j) for j in range(k + 2, start)]
            base = head[head.index("extends") + 1] if "extends" in head[:-1] else None
            out.append(("class", word(k + 1), line, base, "exported" if exported else None))
            if exported:
                out.append(("export", word(k + 1), line, "class", None))
            pending[start] = (_matching(toks, start), "class", word(k + 1))
        elif value == "function" and kind == "name":
            at = k + 2 if word(k + 1) == "*" else k + 1
            name = word(at) if toks[at : at + 1] and toks[at][0] == "name" else None
            start = next((j for j in range(at, min(n, at + 200)) if word(j) == "("), None)
            if name and start:
                out.append(("function", name, line, "async" if word(k - 1) == "async" else None, "exported" if exported else None))
                if exported:
                    out.append(("export", name, line, "function", None))
                if (body := _body_after(toks, start)) is not None:
                    pending[body] = (_matching(toks, body), "function", name)
        elif value in ("const", "let", "var") and kind == "name" and toks[k + 1 : k + 2] and toks[k + 1][0] == "name":
            name, j = word(k + 1), k + 2
            while j < n and word(j) not in ("=", ";", ",", "of", "in") and j - k < 200:
                j = _matching(toks, j) + 1 if word(j) in _OPENS else j + 1
            value_at = j + 2 if word(j + 1) == "async" else j + 1
            close = _matching(toks, value_at) if word(value_at) == "(" else value_at
            arrow = next((i for i in range(close + 1, min(n, close + 60)) if word(i) == "=>" or word(i) in (";", "{", ")")), None) if word(j) == "=" and (word(value_at) == "(" or word(value_at + 1) == "=>") else None
            if arrow is not None and word(arrow) == "=>":
                out.append(("function", name, line, "async" if word(j + 1) == "async" else None, "exported" if exported else None))
                if word(arrow + 1) == "{":
                    pending[arrow + 1] = (_matching(toks, arrow + 1), "function", name)
                else:
                    end = arrow + 1
                    while end < n and word(end) not in (";", "}", ")"):
                        end = _matching(toks, end) + 1 if word(end) in _OPENS else end + 1
                    pending[arrow + 1] = (end, "function", name)
            if exported:
                out.append(("export", name, line, "const", None))
        elif kind == "name" and in_class and word(k + 1) in ("(", "<") and value not in _WORDS and not after_dot and word(k - 1) not in ("=", "new", "@", "(", ","):
            start = k + 1 if word(k + 1) == "(" else next((j for j in range(k + 1, min(n, k + 60)) if word(j) == "("), None)
            body = _body_after(toks, start) if start else None
            if body is not None:
                out.append(("method", value, line, "async" if word(k - 1) == "async" else None, in_class))
                pending[body] = (_matching(toks, body), "function", f"{in_class}.{value}")
        elif kind == "name" and value == "new" and toks[k + 1 : k + 2] and toks[k + 1][0] == "name":
            out.append(("construct", word(k + 1), line, None, owner))
            k += 1
        elif kind == "name" and value not in _WORDS:
            at = k + 1
            if word(at) == "<":
                close = next((j for j in range(at, min(n, at + 40)) if word(j) == ">"), None)
                at = close + 1 if close and word(close + 1) == "(" else at
            if word(at) == "(":
                if after_dot and word(k - 2) in _CLIENTS and value in _VERBS:
                    out.append(("http", literal(at + 1) or "?", line, value.upper(), owner))
                out.append(("method_call" if after_dot else "call", value, line, word(k - 2) if after_dot else None, owner))
        k += 1
    return out


def _clause(words: list[str]) -> list[tuple[str, str | None]]:
    """(name, alias) of an import or export clause; default imports are named default, whole modules *."""
    out: list[tuple[str, str | None]] = []
    words = [w for w in words if w not in ("type", "from")]
    inside, k = False, 0
    while k < len(words):
        w = words[k]
        if w in "{}":
            inside = w == "{"
        elif w == "*" and words[k + 1 : k + 2] == ["as"]:
            out.append(("*", words[k + 2] if k + 2 < len(words) else None))
            k += 2
        elif w not in (",", "*"):
            alias = words[k + 2] if words[k + 1 : k + 2] == ["as"] and k + 2 < len(words) else None
            out.append((w, alias) if inside else ("default", w))
            k += 2 if alias else 0
        k += 1
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, *fact) for f, body in zip(pdf["file_id"], pdf["body"]) for fact in facts(body)]
        yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "line", "detail", "owner"])


def typescript_facts(files: DataFrame) -> DataFrame:
    """file_id, kind, name, line, detail, owner of TypeScript files.

    Kinds: import (name is the target, detail the imported name, owner its alias or how it is imported), export, function, class (detail its base),
    method (owner its class), call and method_call (detail the object; owner the caller), construct, http (name is the URL, detail the method). Text within strings, templates and comments is not
    looked at. Null bodies give no rows; broken text gives what can be read. Runs in the tasks that scan.
    """
    ship(files.sparkSession)
    rows = of_kind(files, "ts").select("file_id", "body")
    return rows.mapInPandas(_rows, "file_id long, kind string, name string, line int, detail string, owner string")
