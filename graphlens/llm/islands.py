"""Functions, methods and classes with their documentation: island grammars for Python and TypeScript.

Islands are documentation, decorators, modifiers, signatures and balanced bodies. Everything else
is water: its tokens are passed over, only brackets and indentation are followed.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from graphlens.llm import lexers


class Island(NamedTuple):
    """A documented definition; line counts from 1."""

    qualname: str
    name: str
    line: int
    doc: str


class _Lines:
    """Line numbers of positions asked for in rising order."""

    def __init__(self, text: str):
        self.ends = [m.end() for m in re.finditer(r"\r\n|\n|\r", text)]
        self.at = 0

    def of(self, pos: int) -> int:
        while self.at < len(self.ends) and self.ends[self.at] <= pos:
            self.at += 1
        return self.at + 1


def python_islands(text: str, tokens: list | None = None) -> list[Island]:
    """Documented definitions of a valid Python text. ``tokens``: gets the names of its tokens, for whoever checks the text."""
    places: list[tuple[int, int]] = []
    toks, _ = lexers.python(text, places)
    if tokens is not None:
        tokens += toks
    lines = _Lines(text)
    out: list[Island] = []
    scopes: list[tuple[int, str]] = []  # depth of the body, qualified name
    depth, i, n, fresh = 0, 0, len(toks), True
    toks += ["EOF"] * 3
    while i < n:
        name = toks[i]
        if name == "INDENT":
            depth += 1
        elif name == "DEDENT":
            depth -= 1
            while scopes and scopes[-1][0] > depth:
                scopes.pop()
        elif fresh and name in ("def", "class", "async"):
            j = i + (name == "async")
            if toks[j] in ("def", "class") and j + 1 < n:
                start, end = places[j + 1]
                ident = text[start:end]
                qual = f"{scopes[-1][1]}.{ident}" if scopes else ident
                k, nest = j + 2, 0
                while k < n and not (toks[k] == ":" and nest == 0):
                    nest += (toks[k] in "([{") - (toks[k] in ")]}") if len(toks[k]) == 1 else 0
                    k += 1
                body = k + 1
                if body < n and toks[body] == "NEWLINE":
                    scopes.append((depth + 1, qual))
                    body += 2
                line = lines.of(places[j][0])
                doc = _docstring(text, toks, places, body)
                if doc is not None:
                    out.append(Island(qual, ident, line, doc))
                i, fresh = k + 1, False
                continue
        fresh = name in ("NEWLINE", "INDENT", "DEDENT")
        i += 1
    return out


def _docstring(text: str, toks: list[str], places, at: int) -> str | None:
    parts = []
    while at < len(toks) and toks[at] == "STRING":
        parts.append(text[slice(*places[at])])
        at += 1
    if not parts or (at < len(toks) and toks[at] not in ("NEWLINE", ";")):
        return None
    try:
        value = [None if re.match(r"[rR]?[fFtTbB]", p) else ast.literal_eval(p) for p in parts]
    except (SyntaxError, ValueError):
        return None
    return "".join(value) if all(isinstance(v, str) for v in value) else None


_MODIFIERS = frozenset("export default async abstract declare public private protected static readonly override accessor".split())
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")
_TYPE_GOES_ON = frozenset(["|", "&", "=>", "?", ":", ".", "is", "keyof", "extends", "readonly", "unique", "infer", "asserts", "typeof", "new"])


class _TypeScript:
    def __init__(self, text: str):
        self.text = text
        self.toks = list(lexers.ts_scan(text, comments=True))
        self.n = len(self.toks)
        self.toks += [("EOF", len(text), len(text), True)] * 4  # so that looking ahead needs no checks
        self.names = [t[0] for t in self.toks]
        self.out: list[Island] = []

    def word(self, i: int) -> str:
        return self.text[self.toks[i][1] : self.toks[i][2]] if i < self.n else ""

    def past_comments(self, i: int) -> int:
        while i < self.n and self.names[i] in ("DOC", "COMMENT"):
            i += 1
        return i

    def balanced(self, i: int) -> int:
        """Past the bracket that opens at i."""
        nest = 0
        while i < self.n:
            name = self.names[i]
            nest += (name in _OPENS) - (name in _CLOSES)
            i += 1
            if nest == 0:
                break
        return i

    def angles(self, i: int) -> int:
        """Past the type parameters or arguments that open at i, if any do."""
        if i >= self.n or self.names[i] != "<":
            return i
        nest = 0
        while i < self.n:
            name = self.names[i]
            if name in _OPENS:
                i = self.balanced(i)
                continue
            nest += (name == "<") - (name == ">")
            i += 1
            if nest == 0:
                break
        return i

    def type(self, i: int) -> int:
        """Past the type that begins at i."""
        operand, group = True, False  # group: a parenthesis has just closed, so an arrow goes on with the type
        while i < self.n:
            name = self.names[i]
            if name == "=>" and not group:
                return i
            group = name == "("
            if name in ("DOC", "COMMENT"):
                i += 1
            elif name == "{":
                if not operand:
                    return i
                i, operand = self.balanced(i), False
            elif name in ("(", "["):
                i, operand = self.balanced(i), False
            elif name == "<":
                i, operand = self.angles(i), False
            elif name in _TYPE_GOES_ON:
                i, operand = i + 1, True
            elif name in (";", "=", ",", ")", "]", "}") or (not operand and self.toks[i][3]):
                return i
            else:
                i, operand = i + 1, False
        return i

    def signature(self, i: int) -> int:
        """Past type parameters, parameters and return type; i itself if no parameters follow."""
        start, i = i, self.past_comments(self.angles(i))
        if i >= self.n or self.names[i] != "(":
            return start
        i = self.past_comments(self.balanced(i))
        return self.past_comments(self.type(i + 1)) if i < self.n and self.names[i] == ":" else i

    def is_arrow(self, i: int) -> int:
        """Past the => of the arrow function that begins at i, or -1."""
        i = self.past_comments(i)
        if i < self.n and self.names[i] == "async":
            i = self.past_comments(i + 1)
        if i >= self.n:
            return -1
        if self.names[i] in ("(", "<"):
            j = self.signature(i)
        else:
            j = i + 1 if re.match(r"[\w$]", self.word(i)) else i
        return j + 1 if j > i and j < self.n and self.names[j] == "=>" else -1

    def run(self) -> list[Island]:
        lines = _Lines(self.text)
        names, toks, n = self.names, self.toks, self.n
        scopes: list[tuple[str, str]] = []  # kind, qualified name
        doc, i, starts = None, 0, True  # starts: a class member may begin here

        def record(at: int) -> str:
            ident = self.word(at)
            outer = scopes[-1][1] if scopes else ""
            qual = f"{outer}.{ident}" if outer else ident
            line = lines.of(toks[at][1])
            if doc is not None:
                self.out.append(Island(qual, ident, line, doc))
            return qual

        while i < n:
            name = names[i]
            member = bool(scopes) and scopes[-1][0] == "class"
            if name == "DOC":
                doc = self.text[toks[i][1] + 3 : toks[i][2] - 2]
                i += 1
            elif name == "COMMENT":
                doc, i = None, i + 1
            elif name == "@":
                i += 2
                while i < n and names[i] == ".":
                    i += 2
                i = self.angles(i)
                if i < n and names[i] == "(":
                    i = self.balanced(i)
                starts = True
            elif name == "}":
                if scopes:
                    scopes.pop()
                doc, starts, i = None, True, i + 1
            elif name in _MODIFIERS and not (member and i + 1 < n and names[i + 1] in ("(", "=", ":", ";", "?", "!", "<")):
                i += 1
            elif name == "function":
                j = i + 1 + (i + 1 < n and names[i + 1] == "*")
                if j < n and names[j] not in ("(", "<"):
                    qual, j = record(j), j + 1
                else:
                    qual = scopes[-1][1] if scopes else ""
                i, doc = self.signature(j), None
                if i < n and names[i] == "{":
                    scopes.append(("function", qual))
                    i += 1
            elif name == "class" and i + 1 < n:
                j, qual = i + 1, scopes[-1][1] if scopes else ""
                if names[j] not in ("{", "extends", "implements"):
                    qual, j = record(j), j + 1
                doc = None
                while j < n and names[j] != "{":
                    j = self.angles(j) if names[j] == "<" else self.balanced(j) if names[j] in _OPENS else j + 1
                scopes.append(("class", qual))
                i, starts = j + 1, True
            elif name in ("interface", "enum") and i + 2 < n and re.match(r"[\w$]", self.word(i + 1)) and names[i + 1] not in ("in", "of"):
                j = i + 1
                while j < n and names[j] not in ("{", ";"):
                    j = self.angles(j) if names[j] == "<" else j + 1
                i, doc = self.balanced(j) if j < n and names[j] == "{" else j, None
            elif name in ("namespace", "module") and names[i + 2] in ("{", ".") and (names[i + 1] == "STRING" or re.match(r"[\w$]", self.word(i + 1))):
                outer, j = scopes[-1][1] if scopes else "", i + 1
                while j < n and names[j] != "{":
                    j += 1
                own = self.text[toks[i + 1][1] : toks[j - 1][2]]
                scopes.append(("block", f"{outer}.{own}" if outer else own))
                i, doc = j + 1, None
            elif name == "const" and not member and i + 1 < n:
                j = i + 2
                if j < n and names[j] == ":":
                    j = self.type(j + 1)
                body = self.is_arrow(j + 1) if j < n and names[j] == "=" else -1
                if body >= 0 and re.match(r"[\w$]", self.word(i + 1)):
                    qual = record(i + 1)
                    i = self.past_comments(body)
                    if i < n and names[i] == "{":
                        scopes.append(("function", qual))
                        i += 1
                else:
                    i += 1
                doc = None
            elif member and starts:
                i, doc, starts = self._member(i, scopes, record)
            elif name in ("{", "TPL_HEAD"):
                scopes.append(("block", scopes[-1][1] if scopes else ""))
                doc, i = None, i + 1
            elif name == "TPL_TAIL":
                if scopes:
                    scopes.pop()
                doc, i = None, i + 1
            else:
                doc, i = None, i + 1
        return self.out

    def _member(self, i: int, scopes, record) -> tuple[int, None, bool]:
        """A member of a class from its name on; modifiers and decorators are behind."""
        names, n = self.names, self.n
        if names[i] == ";":
            return i + 1, None, True
        if names[i] == "*":
            i += 1
        if names[i] in ("get", "set") and i + 1 < n and names[i + 1] not in ("(", "<", "=", ":", ";", "?", "!", "}"):
            i += 1
        at, j = i, self.balanced(i) if names[i] == "[" else i + 1
        if names[i] == "{":  # a static block
            scopes.append(("block", scopes[-1][1]))
            return i + 1, None, True
        j += j < n and names[j] in ("?", "!")
        after = self.signature(j)
        if after > j:
            qual = record(at) if names[at] != "[" else scopes[-1][1]
            if after < n and names[after] == "{":
                scopes.append(("function", qual))
                after += 1
            return after, None, True
        while j < n and names[j] not in (";", "}") and not (self.toks[j][3] and names[j - 1] not in ("=", "=>", "?", ":", ".", "BINARY", "+", "-", "|", "&", ",")):
            j = self.balanced(j) if names[j] in _OPENS else j + 1
        return j, None, True


def typescript_islands(text: str) -> list[Island]:
    """Documented definitions of a valid TypeScript text."""
    out = _TypeScript(text).run()
    return [x._replace(doc="\n".join(re.sub(r"^\s*\* ?", "", line) for line in re.split(r"\r\n|\n|\r", x.doc))) for x in out]


ISLANDS = {"python": python_islands, "typescript": typescript_islands}

#: Words of which notes that documentation is still to come consist.
_NOTE_WORDS = frozenset(
    "a add an and any available be been below blank come comes coming comment comments describe described description detail details do doc docs docstring document documentation documented does empty explain explanation fill fixme follow follows for full function goes has here "
    "hold how in info insert is it its later me method missing more n na needed needs no none not nothing now null of on placeholder please provide provided purpose see some soon still stub summary tba tbc tbd text that the there thing this to todo undefined undocumented unknown update what wip will write xxx yet class".split()
)
_TODO = re.compile(r"(?:todo|fixme|xxx|tbd|wip|tba|hack)\b", re.I)
_DIRECTIVE = re.compile(
    r"@?(?:noqa|nosec|type:\s*ignore|pylint\b|pragma\b|flake8\b|mypy:|pyright:|ruff:|fmt:|isort:|yapf:|black:|bandit\b|coverage:|eslint\b|eslint-|tslint|jshint|jslint|istanbul\b|c8\s+ignore|v8\s+ignore|prettier-|ts-(?:ignore|nocheck|check|expect-error)|biome-|deno-|sonar|nolint|cspell|spell-?checker|webpack\w+:|vite-|global\s+\w+$|jsx\b)",
    re.I,
)
_GENERATED = re.compile(r"(?:this\s+\w+\s+(?:is|was|has been)\s+|code\s+|file\s+)?(?:auto[\s-]*generated\b|automatically\s+(?:generated|created)\b|machine[\s-]generated\b|generated\s+(?:code|file|stub|method|by|from|automatically|with|using)\b|do\s+not\s+(?:edit|modify)\b|@generated\b)", re.I)
_TAG = re.compile(r"\s*(?:@(?P<at>[A-Za-z][\w-]*)|:(?P<colon>[a-z]\w*)(?P<args>[^:\n]*):)(?P<rest>.*)", re.S)
_SECTION = re.compile(r"\s*(?:args?|arguments|parameters|params|returns?|yields?|raises|throws|attributes|notes?|examples?)\s*:?\s*$", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
#: Words that add nothing to a name.
_FILLERS = frozenset("a an the this that these those is are was to for of and it its which does do will simple simply just our some given function func method class constructor helper object async coroutine generator property getter setter procedure routine utility callable definition interface type".split())
_TYPE_TAGS = frozenset("rtype type typedef".split())
_NAMED_TAGS = frozenset("param parameter arg argument property prop template typeparam key keyword raises raise except exception throws throw var ivar cvar vartype".split())


def _stem(word: str) -> str:
    w = word.lower()
    for end, new in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", ""), ("ers", ""), ("er", ""), ("or", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not (end == "s" and w.endswith("ss")):
            w = w[: -len(end)] + new
            break
    w = w[:-1] if w.endswith("e") and len(w) > 3 else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _says_nothing(text: str, name_stems: frozenset[str]) -> bool:
    """Whether a paragraph or sentence without tags is trivial."""
    text = text.strip()
    if not re.search(r"\w", text):
        return True
    if _DIRECTIVE.match(text) or _GENERATED.match(text):
        return True
    words = [w for w in _WORD.findall(text)]
    low = [w.lower() for w in words]
    if all(w in _NOTE_WORDS for w in low):
        return True
    if m := _TODO.match(text):
        rest = [w.lower() for w in _WORD.findall(text[m.end() :])]
        if not rest or any(w in ("doc", "docs", "document", "documentation", "docstring", "describe", "description", "comment") for w in rest):
            return True
    return all(w in _FILLERS or _stem(w) in name_stems for w in low)


def is_trivial(doc: str, name: str) -> bool:
    """Whether documentation says nothing about what bears the name.

    That is: empty or punctuation; a placeholder, or a note that it is still to come; the words of the
    name; a directive, a notice of generated code, a bare tag; tags without any description. One
    paragraph, sentence or described tag that does say something is enough for it not to be.
    """
    stems = frozenset(_stem(w) for w in _WORD.findall(name))
    paragraphs: list[str] = []
    tags: list[str] = []
    target = paragraphs
    blank = True
    for line in doc.splitlines():
        if not line.strip():
            blank = True
            if target is paragraphs:
                continue
            target, blank = paragraphs, True
            continue
        if _TAG.match(line) and not _DIRECTIVE.match(line.strip()) and not _GENERATED.match(line.strip()):
            tags.append(line.strip())
            target, blank = tags, False
        elif target is tags:
            tags[-1] += " " + line.strip()
        elif blank or not paragraphs:
            paragraphs.append(line.strip())
            blank = False
        else:
            paragraphs[-1] += " " + line.strip()
    for p in paragraphs:
        if _SECTION.match(p):
            continue
        if not _says_nothing(p, stems) and not all(_says_nothing(s, stems) for s in re.split(r"(?<=[.!?;])\s+", p)):
            return False
    return not any(_described(t, stems) for t in tags)


def _described(tag: str, stems: frozenset[str]) -> bool:
    m = _TAG.match(tag)
    kind = (m["at"] or m["colon"]).lower()
    rest = m["rest"].strip()
    if kind in _TYPE_TAGS:
        return False
    if m["at"]:
        rest = re.sub(r"^\{[^}]*\}", "", rest).strip()
        if kind in _NAMED_TAGS:
            rest = re.sub(r"^(?:\[[^\]]*\]|[\w.$]+)", "", rest).strip()
    return bool(re.search(r"\w", rest)) and not _says_nothing(rest, frozenset())
