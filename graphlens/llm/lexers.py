"""Tokens of the supported languages for the grammars; text that has none gives an ERROR token."""

from __future__ import annotations

import re
import unicodedata

from graphlens.llm import grammars as g

ERROR = "ERROR"
Tokens = tuple[list[str], list[bool] | None]

_DQ = r'"[^"\\\n\r]*+(?:\\(?:\r\n|.)[^"\\\n\r]*+)*+"'
_SQ = _DQ.replace('"', "'")
_DQ3 = r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
_SQ3 = _DQ3.replace('"', "'")

_PY = re.compile(
    rf"""(?P<ws>[ \t\f]+|\\(?:\r\n|\n|\r))|(?P<comment>\#[^\r\n]*)|(?P<nl>\r\n|\n|\r)
    |(?P<fbegin>(?:[rR][fF]|[fF][rR]?)(?:\"{{3}}|'{{3}}|\"|'))
    |(?P<string>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:{_DQ3}|{_SQ3}|(?!"{{3}})(?:{_DQ})|(?!'{{3}})(?:{_SQ})))
    |(?P<number>(?>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
      |(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?:(?!\w)|(?=and|else|for|i[fns]|not|or)))
    |(?P<name>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*+)
    |(?P<aug>(?:\*\*|//|>>|<<|[-+*/%&|^@])=(?!=))|(?P<cmp>==|!=|<=|>=|<(?!<)|>(?!>))
    |(?P<lit>\.\.\.|->|:=|\*\*|[-+*/@~|=,:;.()\[\]{{}}](?<!//))|(?P<op><<|>>|[%&^])""",
    re.X | re.S,
)
_PY_FLOOR = re.compile(r"//(?!=)")
_PY_KEYS = frozenset(g.PYTHON_WORDS + g.PYTHON_SOFT)
#: A field's end or beginning, the string's end, an escape, or a line's end in the literal part of an f-string.
_PY_F = re.compile(r"""\{\{?|\}\}?|\"{3}|'{3}|\"|'|\\N\{[^}\n]*\}|\\(?:\r\n|[^{}])|\\(?=[{}])|\r\n|\n|\r""", re.S)
_PY_CONVERSION = re.compile(r"![ \t\f]*([A-Za-z_]\w*)[ \t\f]*(?=[:}])")
_PY_DEBUG = re.compile(r"=(?!=)\s*(?=[!:}])")
_PY_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{(?P<name>[^}]*)\}|(?P<bad>[xuUN])|.)", re.S)


def _py_escapes(body: str, named: bool) -> bool:
    """Whether all escapes of a string's text are complete; ``named``: \\u, \\U and \\N are escapes too."""
    for m in _PY_ESCAPE.finditer(body):
        if m["bad"] and (named or m["bad"] == "x"):
            return False
        if m["name"] is not None and named:
            try:
                unicodedata.lookup(m["name"])
            except KeyError:
                return False
    return True


def _py_literal(text: str, at: int, quote: str, raw: bool, spec: bool) -> tuple[str, int, int]:
    """The literal part of an f-string from ``at`` on: what ends it (FOPEN, FCLOSE, FEND, ERROR), where it ends, and where what follows begins."""
    start = at
    while m := _PY_F.search(text, at):
        found, at = m[0], m.end()
        if found in ("{{", "}}"):
            if not spec:
                continue
            found, at = found[0], at - 1
        if found[0] in "\r\n":
            if len(quote) == 3:
                continue
            return ERROR, at, at
        if found[0] == "\\":
            if raw and found[1:2] == "N":
                at = m.start() + 2
            continue
        if found[0] in "\"'":
            if found != quote and not (len(quote) == 1 and found[0] == quote):
                at = m.start() + (len(found) if found[0] != quote[0] else 1)
                continue
            kind, after = "FEND", m.start() + len(quote)
            if spec:
                kind = ERROR
        else:
            kind, after = ("FOPEN" if found == "{" else "FCLOSE"), at
            if kind == "FCLOSE" and not spec:
                kind = ERROR
        if not raw and "\\" in text[start : m.start()] and not _py_escapes(text[start : m.start()], True):
            kind = ERROR
        return kind, m.start(), after
    return ERROR, at, at


def python(text: str, places: list[tuple[int, int]] | None = None) -> Tokens:
    """``places``: gets where each token begins and ends.

    The fields of f-strings are tokens like all others, between FBEGIN and FEND; so strings in them may use any quote.
    """
    out: list[str] = []
    depth, indents, at, fresh_line, n = 0, [(0, 0)], 0, True, len(text)
    if "\0" in text:
        return [ERROR], None
    if text[:1] == "\ufeff":
        at = 1
    # Open f-strings: [quote, raw, in a format, depths at which fields were opened].
    open_f: list[list] = []
    while at < n:
        if open_f and open_f[-1][2]:
            f = open_f[-1]
            kind, _, after = _py_literal(text, at, f[0], f[1], f[2] == 2)
            if kind == ERROR:
                return [ERROR], None
            out.append(kind)
            if kind == "FOPEN":
                depth += 1
                f[3].append((depth, f[2]))
                f[2] = 0
            elif kind == "FEND":
                open_f.pop()
                depth -= 1
            else:
                depth, f[2] = f[3][-1][0] - 1, f[3][-1][1]
                f[3].pop()
            if places is not None:
                places.append((at, after))
            at = after
            continue
        if fresh_line and not depth:
            start = at
            while at < n and text[at] in " \t\f":
                at += 1
            if at < n and text[at] not in "#\r\n":
                lead = text[start:at].rpartition("\f")[2]
                col = (len(lead.expandtabs(8)), len(lead))
                if col > indents[-1]:
                    if col[1] <= indents[-1][1] or col[0] <= indents[-1][0]:
                        return [ERROR], None
                    indents.append(col)
                    out.append("INDENT")
                else:
                    while col[0] < indents[-1][0]:
                        indents.pop()
                        out.append("DEDENT")
                    if col != indents[-1]:
                        return [ERROR], None
            fresh_line = False
            if at >= n:
                break
        if open_f and open_f[-1][3] and open_f[-1][3][-1][0] == depth:
            # Directly in a field: what ends its expression.
            f, c = open_f[-1], text[at]
            m = (c == "=" and _PY_DEBUG.match(text, at)) or (c == "!" and text[at + 1 : at + 2] != "=" and _PY_CONVERSION.match(text, at)) or None
            if c == "!" and m and m[1] not in ("s", "r", "a"):
                return [ERROR], None
            if m or c in ":}":
                out.append("FDEBUG" if c == "=" else "FCONV" if c == "!" else "FSPEC" if c == ":" else "FCLOSE")
                end = m.end() if m else at + 1
                if c == ":":
                    f[2] = 2
                elif c == "}":
                    depth, f[2] = depth - 1, f[3].pop()[1]
                if places is not None:
                    places.append((at, end))
                at = end
                continue
        if text[at] == "/" and (m := _PY_FLOOR.match(text, at)):
            out.append("OP")
            kind, at = "floor", m.end()
        else:
            m = _PY.match(text, at)
            if not m:
                return [ERROR], None
            kind, at = m.lastgroup, m.end()
        if kind == "ws":
            if m[0][0] == "\\" and at >= n:
                return [ERROR], None
        elif kind == "nl":
            if not depth:
                if out and out[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    out.append("NEWLINE")
                fresh_line = True
        elif kind == "name":
            if not m[0].isascii() and not unicodedata.normalize("NFKC", m[0]).isidentifier():
                return [ERROR], None
            out.append(m[0] if m[0] in _PY_KEYS else "NAME")
        elif kind == "lit":
            if m[0] in "([{":
                depth += 1
            elif m[0] in ")]}":
                depth -= 1
                if depth < 0:
                    return [ERROR], None
            out.append(m[0])
        elif kind == "fbegin":
            quote = m[0].lstrip("rRfF")
            open_f.append([quote, len(m[0]) - len(quote) > 1, 1, []])
            depth += 1
            out.append("FBEGIN")
        elif kind == "string":
            s = m[0]
            prefix = s[: min(s.index(q) for q in "\"'" if q in s)].lower()
            if "b" in prefix and not s.isascii() or "\\" in s and "r" not in prefix and not _py_escapes(s, "b" not in prefix):
                return [ERROR], None
            out.append("BYTES" if "b" in prefix else "STRING")
        elif kind not in ("comment", "floor"):
            out.append(kind.upper())
        if places is not None:
            places += [m.span()] * (len(out) - len(places))
    if open_f:
        return [ERROR], None
    if out and out[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
        out.append("NEWLINE")
    out += ["DEDENT"] * (len(indents) - 1)
    if places is not None:
        places += [(n, n)] * (len(out) - len(places))
    return out, None


_JSON = re.compile(
    r"""[ \t\n\r]+|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<lit>true\b|false\b|null\b|[\[\]{},:])""",
    re.A,
)


def json(text: str) -> Tokens:
    return _flat(_JSON, text), None


def _flat(pattern: re.Pattern, text: str, start: int = 0) -> list[str]:
    out, at, n = [], start, len(text)
    while at < n:
        m = pattern.match(text, at)
        if not m or m.end() == at:
            return [ERROR]
        at = m.end()
        if kind := m.lastgroup:
            out.append(m[0] if kind == "lit" else kind.upper())
    return out


_CSS_ESC = r"\\(?:[0-9a-fA-F]{1,6}\s?|[^\n\r])"
_CSS_ID = rf"(?:-?(?:[A-Za-z_\u0080-\U0010ffff]|{_CSS_ESC}))(?:[\w\-\u0080-\U0010ffff]|{_CSS_ESC})*+"
_CSS = re.compile(
    rf"""\s+|/\*.*?\*/|(?P<string>{_DQ}|{_SQ})|(?P<url>(?i:url)\(\s*(?:[^"'()\\\s]|{_CSS_ESC})*\s*\))
    |(?P<function>{_CSS_ID}\()|(?P<custom>--[\w\-\u0080-\U0010ffff]+)|(?P<lit><!--|-->)
    |(?P<percent>[-+]?(?:\d+\.?\d*|\.\d+)%)|(?P<number>[-+]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?(?:{_CSS_ID})?)
    |(?P<ident>{_CSS_ID})|(?P<at_import>@(?:import|charset|namespace)\b)|(?P<at>@{_CSS_ID})|(?P<hash>\#[\w\-\u0080-\U0010ffff]+)|(?P<class>\.{_CSS_ID})
    |(?P<match>[~|^$*]?=)|(?P<combinator>>|\+|~|\|\|)|(?P<lit2>[{{}}()\[\],;:*!/&|<-])""",
    re.X | re.S,
)


def css(text: str) -> Tokens:
    out, at, n = [], 0, len(text)
    if text[:1] == "\ufeff":
        at = 1
    while at < n:
        m = _CSS.match(text, at)
        if not m or m.end() == at:
            return [ERROR], None
        at, kind = m.end(), m.lastgroup
        if kind:
            out.append(m[0] if kind in ("lit", "lit2") else kind.upper())
    return out, None


_TS = re.compile(
    rf"""(?P<ws>[ \t\f\v\u00a0\ufeff]+|//[^\r\n]*)|(?P<nl>[\r\n\u2028\u2029]+|/\*.*?\*/)|(?P<string>{_DQ}|{_SQ})
    |(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))
    |(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<private>\#[^\W\d][\w$]*)
    |(?P<lit>=>|\.\.\.|\?\.(?!\d))|(?P<assign>(?:\*\*|<<|&&|\|\||\?\?|[-+*%&|^])=(?!=)|/=)
    |(?P<binary>===|!==|==|!=|<=|\*\*|&&|\|\||\?\?|<<|[%^])|(?P<inc>\+\+|--)|(?P<unary>~)|(?P<lit2>[-+*/<>=&|!?:;,.()\[\]{{}}@])""",
    re.X | re.S,
)
_TS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*")
_TS_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+(`|\$\{)", re.S)
_TS_KEYS = frozenset(g.TS_RESERVED + g.TS_SOFT)
#: Tokens after which a slash divides; after any other it begins a regular expression.
_TS_VALUES = frozenset(["NAME", "NUMBER", "STRING", "TEMPLATE", "TPL_TAIL", "REGEX", "PRIVATE", "INC", ")", "]", "}", "this", "super", "null", "true", "false", *g.TS_SOFT])


def ts_scan(text: str, comments: bool = False):
    """(name, start, end, on a new line) of each token; comments as DOC and COMMENT, if asked for."""
    at, n, line, depth, templates = 0, len(text), True, 0, []
    last = ""
    if text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
    while at < n:
        c, start = text[at], at
        if c == "`" or (c == "}" and templates and templates[-1] == depth):
            m = _TS_TEMPLATE.match(text, at + 1)
            if not m:
                yield ERROR, start, n, line
                return
            closes = m[1] == "`"
            if c == "`":
                name = "TEMPLATE" if closes else "TPL_HEAD"
                if not closes:
                    templates.append(depth)
            else:
                name = "TPL_TAIL" if closes else "TPL_MID"
                if closes:
                    templates.pop()
            at = m.end()
        elif c == "/" and text[at + 1 : at + 2] not in ("/", "*") and last not in _TS_VALUES and (m := _TS_REGEX.match(text, at)):
            name, at = "REGEX", m.end()
        else:
            m = _TS.match(text, at)
            if not m:
                yield ERROR, start, n, line
                return
            kind, at = m.lastgroup, m.end()
            if kind in ("ws", "nl"):
                if comments and c == "/":
                    yield "DOC" if m[0].startswith("/**") and len(m[0]) > 4 else "COMMENT", start, at, line
                if kind == "nl":
                    line = line or "\n" in m[0] or "\r" in m[0]
                continue
            if kind == "name":
                name = m[0] if m[0] in _TS_KEYS else "NAME"
            elif kind in ("lit", "lit2"):
                name = m[0]
                depth += (name == "{") - (name == "}")
            else:
                name = kind.upper()
        last = name
        yield name, start, at, line
        line = False
    if templates:
        yield ERROR, n, n, line


def typescript(text: str) -> Tokens:
    out: list[str] = []
    fresh: list[bool] = []
    for name, _, _, line in ts_scan(text):
        if name == ERROR:
            return [ERROR], None
        out.append(name)
        fresh.append(line or name == "}")
    return out, fresh


_CS = re.compile(
    rf"""(?P<ws>\s+|//[^\r\n]*|/\*.*?\*/)|(?P<string>(?:{_DQ})(?:u8)?)|(?P<char>'(?:[^'\\\r\n]|\\[^\r\n]{{1,9}}?)')
    |(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?i:ul|lu|[ulfdm])?(?!\w))
    |(?P<name>@?[^\W\d]\w*)|(?P<lit>=>|->|::|\?\.(?!\d)|\.\.)|(?P<assign>(?:<<|\?\?|[-+*/%&|^])=(?!=))
    |(?P<binary>==|!=|<=|&&|\|\||\?\?|<<|%)|(?P<inc>\+\+|--)|(?P<lit2>[-+*/<>=&|!?:;,.()\[\]{{}}~^])""",
    re.X | re.S,
)
_CS_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?:if|elif|else|endif|define|undef|region|endregion|pragma|nullable|line|warning|error)\b[^\r\n]*", re.M)
_CS_KEYS = frozenset(g.CS_WORDS + g.CS_SOFT)
_CS_BUILTIN = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
_CS_STRING = re.compile(r'(\$*@?|@\$+)(")')


def _cs_string(text: str, at: int) -> int:
    """End of a verbatim, interpolated or raw string that begins at ``at``; -1 if it has none."""
    m = _CS_STRING.match(text, at)
    dollars, verbatim, at = m[1].count("$"), "@" in m[1], m.end() - 1
    quotes = len(text) - at - len(text[at:].lstrip('"')) if text.startswith('"""', at) and not verbatim else 1
    if quotes >= 3:
        end = text.find('"' * quotes, at + quotes)
        while 0 <= end and text[end + quotes : end + quotes + 1] == '"':
            end += 1
        return end + quotes if end >= 0 else -1
    at += 1
    n = len(text)
    while at < n:
        c = text[at]
        if c == '"':
            if not (verbatim and text[at + 1 : at + 2] == '"'):
                return at + 1
            at += 2
        elif c == "\\" and not verbatim:
            at += 2
        elif c in "\r\n" and not verbatim:
            return -1
        elif c == "{" and dollars:
            if text[at + 1 : at + 2] == "{":
                at += 2
                continue
            depth, at = 1, at + 1
            while at < n and depth:
                if text[at] in "\"$@" and _CS_STRING.match(text, at):
                    at = _cs_string(text, at)
                    if at < 0:
                        return -1
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
            if depth:
                return -1
        else:
            at += 1
    return -1


def csharp(text: str) -> Tokens:
    if "#" in text:
        text = _CS_DIRECTIVE.sub("", text)
    out, at, n = [], 1 if text[:1] == "\ufeff" else 0, len(text)
    while at < n:
        if text[at] in '$@"' and (m := _CS_STRING.match(text, at)) and (m[1] or text.startswith('"""', at)):
            at = _cs_string(text, at)
            if at < 0:
                return [ERROR], None
            out.append("STRING")
            continue
        m = _CS.match(text, at)
        if not m:
            return [ERROR], None
        kind, at = m.lastgroup, m.end()
        if kind == "ws":
            continue
        if kind == "name":
            out.append("BUILTIN" if m[0] in _CS_BUILTIN else m[0] if m[0] in _CS_KEYS else "NAME")
        else:
            out.append(m[0] if kind in ("lit", "lit2") else kind.upper())
    return out, None


_BREAKS = "\r\n\x85\u2028\u2029"
_Y_END = frozenset("\0 \t" + _BREAKS)
_Y_PLAIN = re.compile(r"[^\0 \t\r\n\x85\u2028\u2029:]+")
_Y_PLAIN_FLOW = re.compile(r"[^\0 \t\r\n\x85\u2028\u2029:,?\[\]{}]+")
_Y_BAD = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff\ufeff]")
_Y_ESCAPE = re.compile(r'\\(?:[0abtnvfre "/\\N_LP\t]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\r?\n|\r)')
_Y_ANCHOR = re.compile(r"[^\s,\[\]{}]+")
_Y_TAG = re.compile(r"!(?:<[^>\s]+>|[\w\-]*![^\s,\[\]{}]*|[^\s,\[\]{}!]*)")
_Y_HEADER = re.compile(r"[|>](?:[+-]?([1-9])?|([1-9])[+-]?)(?:[ \t]+#[^\r\n]*|[ \t]*)(?=[\r\n\0])")
_Y_MARK = re.compile(r"(?:---|\.\.\.)(?=[\0 \t\r\n])")


class _Bad(Exception):
    pass


class _Yaml:
    """Scanner of YAML: indentation and implicit keys become tokens, by the rules for simple keys.

    A scalar or flow collection may turn out to be a key only where its colon is met, on the same
    line and within 1024 characters; KEY then goes before the token at which it began.
    """

    def __init__(self, text: str):
        self.s, self.p, self.line, self.start = text + "\0", 0, 0, 0
        self.out: list[str] = []
        self.indent, self.indents, self.flow, self.open_key = -1, [], 0, True
        self.keys: dict[int, tuple[int, bool, int, int, int]] = {}  # level: token, required, line, place, column

    def column(self) -> int:
        return self.p - self.start

    def newline(self) -> None:
        self.p += 2 if self.s.startswith("\r\n", self.p) else 1
        self.line += 1
        self.start = self.p

    def may_be_key(self) -> None:
        required = not self.flow and self.indent == self.column()
        if self.open_key:
            self.no_key()
            self.keys[self.flow] = (len(self.out), required, self.line, self.p, self.column())

    def no_key(self) -> None:
        key = self.keys.pop(self.flow, None)
        if key and key[1]:
            raise _Bad

    def unwind(self, column: int) -> None:
        if not self.flow:
            while self.indent > column:
                self.indent = self.indents.pop()
                self.out.append("END")

    def deeper(self, column: int) -> bool:
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            return True
        return False

    def skip(self) -> None:
        s = self.s
        while True:
            while s[self.p] == " " or (s[self.p] == "\ufeff" and self.p == 0) or (s[self.p] == "\t" and self.flow):
                self.p += 1
            if s[self.p] == "\t":
                q = self.p
                while s[q] in " \t":
                    q += 1
                if s[q] in "#\r\n" or (s[q] == "\0" and q == len(s) - 1):
                    self.p = q
            if s[self.p] == "#":
                while s[self.p] not in "\0" + _BREAKS:
                    self.p += 1
            if s[self.p] in _BREAKS:
                self.newline()
                if not self.flow:
                    self.open_key = True
            else:
                return

    def run(self) -> list[str]:
        s, end = self.s, len(self.s) - 1
        while True:
            self.skip()
            for level, key in list(self.keys.items()):
                if key[2] != self.line or self.p - key[3] > 1024:
                    if key[1]:
                        raise _Bad
                    del self.keys[level]
            self.unwind(self.column())
            if self.p >= end:
                self.flow and self._fail()
                self.no_key()
                self.unwind(-1)
                return self.out
            c, after = s[self.p], s[self.p + 1]
            if self.column() == 0 and c == "%":
                self.unwind(-1)
                self.no_key()
                self.open_key = False
                while s[self.p] not in "\0" + _BREAKS:
                    self.p += 1
                self.out.append("DIRECTIVE")
            elif self.column() == 0 and c in "-." and _Y_MARK.match(s, self.p):
                self.unwind(-1)
                self.no_key()
                self.open_key = False
                self.out.append(s[self.p : self.p + 3])
                self.p += 3
            elif c in "[{":
                self.may_be_key()
                self.flow += 1
                self.open_key = True
                self._one(c)
            elif c in "]}":
                self.no_key()
                self.flow -= 1
                if self.flow < 0:
                    raise _Bad
                self.open_key = False
                self._one(c)
            elif c == ",":
                if not self.flow:
                    raise _Bad
                self.open_key = True
                self.no_key()
                self._one(c)
            elif c == "-" and after in _Y_END:
                if self.flow or not self.open_key:
                    raise _Bad
                if self.deeper(self.column()):
                    self.out.append("BLOCK_SEQ")
                self.open_key = True
                self.no_key()
                self._one(c)
            elif c == "?" and (self.flow or after in _Y_END):
                if not self.flow:
                    if not self.open_key:
                        raise _Bad
                    if self.deeper(self.column()):
                        self.out.append("BLOCK_MAP")
                self.open_key = not self.flow
                self.no_key()
                self._one("KEY")
            elif c == ":" and (self.flow or after in _Y_END):
                self._value()
            elif c in "*&":
                self.may_be_key()
                self.open_key = False
                m = _Y_ANCHOR.match(s[:end], self.p + 1) or self._fail()
                self.p = m.end()
                self.out.append("ALIAS" if c == "*" else "ANCHOR")
            elif c == "!":
                self.may_be_key()
                self.open_key = False
                self.p = _Y_TAG.match(s[:end], self.p).end()
                if s[self.p] not in _Y_END and not (self.flow and s[self.p] in ",]}"):
                    raise _Bad
                self.out.append("TAG")
            elif c in "|>" and not self.flow:
                self._block_scalar()
            elif c in "'\"":
                self.may_be_key()
                self.open_key = False
                self._quoted(c)
            elif (c not in _Y_END and c not in "-?:,[]{}#&*!|>'\"%@`") or (after not in _Y_END and (c == "-" or (not self.flow and c in "?:"))):
                self.may_be_key()
                self.open_key = False
                self._plain()
            else:
                raise _Bad

    def _fail(self):
        raise _Bad

    def _one(self, name: str) -> None:
        self.out.append(name)
        self.p += 1

    def _value(self) -> None:
        key = self.keys.pop(self.flow, None)
        if key:
            token, _, _, _, column = key
            self.out.insert(token, "KEY")
            if not self.flow and self.deeper(column):
                self.out.insert(token, "BLOCK_MAP")
            self.open_key = False
        else:
            if not self.flow:
                if not self.open_key:
                    raise _Bad
                if self.deeper(self.column()):
                    self.out.append("BLOCK_MAP")
            self.open_key = not self.flow
            self.no_key()
        self._one("VALUE")

    def _block_scalar(self) -> None:
        s = self.s
        self.open_key = True
        self.no_key()
        m = _Y_HEADER.match(s, self.p) or self._fail()
        self.p = m.end()
        given = m[1] or m[2]
        least = max(self.indent + 1, 1)
        width = least + int(given) - 1 if given else None
        self.out.append("SCALAR")
        while s[self.p] in _BREAKS:
            self.newline()
            q = self.p
            while s[q] == " " and (width is None or q - self.start < width):
                q += 1
            if s[q] in _BREAKS:
                self.p = q
                continue
            if width is None:
                width = max(least, q - self.start)
            if q - self.start < width or s[q] == "\0":
                self.p = q
                return
            while s[q] not in "\0" + _BREAKS:
                q += 1
            self.p = q

    def _quoted(self, quote: str) -> None:
        s = self.s
        self.p += 1
        while True:
            c = s[self.p]
            if c == "\0":
                raise _Bad
            if c == quote:
                if quote == "'" and s[self.p + 1] == "'":
                    self.p += 2
                    continue
                self.p += 1
                self.out.append("SCALAR")
                return
            if c == "\\" and quote == '"':
                m = _Y_ESCAPE.match(s, self.p) or self._fail()
                if m[0][-1] in "\r\n":
                    self.p = m.end() - (2 if m[0].endswith("\r\n") else 1)
                    self.newline()
                else:
                    self.p = m.end()
            elif c in _BREAKS:
                self.newline()
                if _Y_MARK.match(s, self.p):
                    raise _Bad
            else:
                self.p += 1

    def _plain(self) -> None:
        s, run = self.s, _Y_PLAIN_FLOW if self.flow else _Y_PLAIN
        least = self.indent + 1
        while True:
            begun = self.p
            while True:
                if m := run.match(s, self.p):
                    self.p = m.end()
                if s[self.p] == ":" and s[self.p + 1] not in _Y_END and not (self.flow and s[self.p + 1] in ",[]{}"):
                    self.p += 1
                else:
                    break
            if self.p == begun:
                break
            self.open_key = False
            spaced = self.p
            while s[self.p] in " \t":
                self.p += 1
            if s[self.p] in _BREAKS:
                self.open_key = True
                while s[self.p] in _BREAKS or s[self.p] in " \t":
                    if s[self.p] in _BREAKS:
                        self.newline()
                        if _Y_MARK.match(s, self.p):
                            self.out.append("SCALAR")
                            return
                    else:
                        self.p += 1
            if self.p == spaced or s[self.p] == "#" or (not self.flow and self.column() < least):
                break
        self.out.append("SCALAR")


def yaml(text: str) -> Tokens:
    if _Y_BAD.search(text):
        return [ERROR], None
    try:
        return _Yaml(text).run(), None
    except _Bad:
        return [ERROR], None


LEXERS = {"python": python, "json": json, "css": css, "yaml": yaml, "typescript": typescript, "csharp": csharp}
