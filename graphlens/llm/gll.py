"""Generalised LL recognition with a graph-structured stack, for grammars with regular right sides.

A grammar is text: ``rule: alternatives ;`` with 'literals', TOKEN classes, rules, grouping, ``?``,
``*``, ``+`` and ``&NL`` (a zero-width test which the lexer answers for each token). Each rule becomes
a small automaton. A descriptor is a state, a stack node and a position; a stack node is a rule
with the position where it was called, its edges say where to go on. Where one token of lookahead leaves
one way, the current descriptor just goes on; other ways are queued. So a deterministic text costs what
a table-driven LL parser costs, an ambiguous one at most the cube of its length.

Several dialects are several start rules: all begin as descriptors on one stack graph, share the
nodes of whatever rules they have in common, and end apart at their own roots.
"""

from __future__ import annotations

import re

EOF = "EOF"
_MATCH, _CALL, _BRANCH, _RETURN, _TEST = range(5)
_TOKEN = re.compile(r"\s*(?:#[^\n]*|(?P<lit>'[^']+')|(?P<test>&NL)|(?P<name>\w+)|(?P<op>[|()?*+:;]))")


def _read(text: str) -> dict[str, tuple]:
    """Rules as trees: ('seq', ..), ('alt', ..), ('opt', x), ('rep', x), ('t', name), ('r', name), ('test',)."""
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar at {text[at:at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            toks.append((m.lastgroup, m[m.lastgroup]))
    pos = 0

    def alternatives():
        nonlocal pos
        out = [sequence()]
        while toks[pos] == ("op", "|"):
            pos += 1
            out.append(sequence())
        return out[0] if len(out) == 1 else ("alt", *out)

    def sequence():
        nonlocal pos
        out = []
        while toks[pos][1] not in ("|", ")", ";") or toks[pos][0] != "op":
            kind, value = toks[pos]
            pos += 1
            if kind == "lit":
                item = ("t", value[1:-1])
            elif kind == "test":
                item = ("test",)
            elif kind == "name":
                item = ("t", value) if value.isupper() else ("r", value)
            else:
                item = alternatives()
                pos += 1
            while toks[pos] in (("op", "?"), ("op", "*"), ("op", "+")):
                op = toks[pos][1]
                pos += 1
                item = {"?": ("opt", item), "*": ("rep", item), "+": ("seq", item, ("rep", item))}[op]
            out.append(item)
        return ("seq", *out)

    rules = {}
    while pos < len(toks):
        name = toks[pos][1]
        pos += 2
        rules[name] = alternatives()
        pos += 1
    return rules


class Grammar:
    """A compiled grammar; ``starts`` are the start rules of its dialects, by dialect."""

    def __init__(self, text: str, starts: dict[str, str]):
        self.starts = starts
        rules = _read(text)
        self.terminals: dict[str, int] = {EOF: 0}
        self.rules = {name: k for k, name in enumerate(rules)}
        self.kind: list[int] = []
        self.arg: list = []
        self.next: list[int] = []
        self.entry = [0] * len(rules)
        for name, tree in rules.items():
            end = self._state(_RETURN, self.rules[name], -1)
            self.entry[self.rules[name]] = self._compile(tree, end)
        self._predict()

    def _state(self, kind: int, arg, nxt: int) -> int:
        self.kind.append(kind)
        self.arg.append(arg)
        self.next.append(nxt)
        return len(self.kind) - 1

    def _compile(self, tree: tuple, after: int) -> int:
        op = tree[0]
        if op == "seq":
            for item in reversed(tree[1:]):
                after = self._compile(item, after)
            return after
        if op == "alt":
            return self._state(_BRANCH, [self._compile(x, after) for x in tree[1:]], -1)
        if op == "opt":
            return self._state(_BRANCH, [self._compile(tree[1], after), after], -1)
        if op == "rep":
            loop = self._state(_BRANCH, [], -1)
            self.arg[loop] = [self._compile(tree[1], loop), after]
            return loop
        if op == "t":
            return self._state(_MATCH, self.terminals.setdefault(tree[1], len(self.terminals)), after)
        if op == "r":
            return self._state(_CALL, self.rules[tree[1]], after)
        return self._state(_TEST, None, after)

    def _predict(self) -> None:
        """Lookahead of every state: FIRST of what follows in the rule, and FOLLOW if that may be empty."""
        n = len(self.kind)
        first: list[set[int]] = [set() for _ in range(n)]
        empty = [False] * n
        changed = True
        while changed:
            changed = False
            for s in range(n):
                kind, arg, nxt = self.kind[s], self.arg[s], self.next[s]
                if kind == _MATCH:
                    add, e = {arg}, False
                elif kind == _RETURN:
                    add, e = set(), True
                elif kind == _TEST:
                    add, e = first[nxt], empty[nxt]
                elif kind == _CALL:
                    inner = self.entry[arg]
                    add, e = (first[inner] | first[nxt], empty[nxt]) if empty[inner] else (first[inner], False)
                else:
                    add, e = set().union(*(first[x] for x in arg)), any(empty[x] for x in arg)
                if not add <= first[s] or e != empty[s]:
                    first[s] |= add
                    empty[s] = empty[s] or e
                    changed = True
        owner = self._owners()
        follow: list[set[int]] = [set() for _ in self.rules]
        for rule in self.starts.values():
            follow[self.rules[rule]].add(0)
        changed = True
        while changed:
            changed = False
            for s in range(n):
                if self.kind[s] == _CALL:
                    nxt, callee = self.next[s], self.arg[s]
                    add = first[nxt] | (follow[owner[s]] if empty[nxt] else set())
                    if not add <= follow[callee]:
                        follow[callee] |= add
                        changed = True
        self.ways: list[dict[int, tuple[int, ...]] | None] = [None] * n
        for s in range(n):
            if self.kind[s] == _BRANCH:
                table: dict[int, list[int]] = {}
                for x in dict.fromkeys(self.arg[s]):
                    for t in first[x] | (follow[owner[s]] if empty[x] else set()):
                        table.setdefault(t, []).append(x)
                self.ways[s] = {t: tuple(xs) for t, xs in table.items()}

    def _owners(self) -> list[int]:
        owner = [-1] * len(self.kind)
        for rule, entry in enumerate(self.entry):
            todo = [entry]
            while todo:
                s = todo.pop()
                if owner[s] < 0:
                    owner[s] = rule
                    todo += self.arg[s] if self.kind[s] == _BRANCH else [self.next[s]] if self.next[s] >= 0 else []
        return owner

    def accepted(self, names: list[str], fresh: list[bool] | None = None) -> set[str]:
        """The dialects that accept the tokens (without EOF); ``fresh``: what &NL answers for each."""
        ids = self.terminals
        toks = [ids.get(x, -1) for x in names]
        if -1 in toks:
            return set()
        toks.append(0)
        kind, arg, nxt, ways, entry = self.kind, self.arg, self.next, self.ways, self.entry
        end = len(toks) - 1
        # A stack node is [edges, positions at which its rule ended, number].
        made = 0
        names_of = list(self.starts)
        found: set[str] = set()
        nodes: dict[tuple[int, int], list] = {}
        seen: set[tuple[int, int, int]] = set()
        todo = []
        for k, rule in enumerate(self.starts.values()):
            made += 1
            node = nodes.setdefault((self.rules[rule], 0), [[], set(), made])
            node[0].append((-1 - k, None))
            if len(node[0]) == 1:
                todo.append((entry[self.rules[rule]], node, 0))
        while todo:
            s, u, i = todo.pop()
            while True:
                k = kind[s]
                if k == _MATCH:
                    if toks[i] != arg[s]:
                        break
                    i += 1
                    s = nxt[s]
                elif k == _BRANCH:
                    way = ways[s].get(toks[i])
                    if way is None:
                        break
                    for other in way[1:]:
                        key = (other, u[2], i)
                        if key not in seen:
                            seen.add(key)
                            todo.append((other, u, i))
                    s = way[0]
                elif k == _CALL:
                    key = (arg[s], i)
                    node = nodes.get(key)
                    if node is None:
                        if not todo and len(nodes) > 4096:
                            # One descriptor is left: nothing can call a rule at a place behind it.
                            nodes = {q: x for q, x in nodes.items() if q[1] == i}
                            seen = {q for q in seen if q[2] == i}
                        made += 1
                        nodes[key] = u = [[(nxt[s], u)], set(), made]
                        s = entry[arg[s]]
                    else:
                        edge = (nxt[s], u)
                        if not any(a == edge[0] and b is u for a, b in node[0]):
                            node[0].append(edge)
                            for j in node[1]:
                                todo.append((nxt[s], u, j))
                        break
                elif k == _RETURN:
                    if i in u[1]:
                        break
                    u[1].add(i)
                    edges = u[0]
                    for back, parent in edges[1:]:
                        if back < 0:
                            if i == end:
                                found.add(names_of[-1 - back])
                        elif (key := (back, parent[2], i)) not in seen:
                            seen.add(key)
                            todo.append((back, parent, i))
                    back, parent = edges[0]
                    if back < 0:
                        if i == end:
                            found.add(names_of[-1 - back])
                        break
                    key = (back, parent[2], i)
                    if todo or len(edges) > 1 or key in seen:
                        if key in seen:
                            break
                        seen.add(key)
                    s, u = back, parent
                else:
                    if not (toks[i] == 0 or fresh[i]):
                        break
                    s = nxt[s]
        return found
