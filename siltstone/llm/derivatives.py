"""Parsing with derivatives over token classes, memoised.

A language is an expression of tokens, sequences, choices, repetitions and
named rules. The derivative of a language by a token is what may follow that
token. Expressions are interned and each remembers its derivatives, so a
context met before costs one dictionary access per token. An empty derivative
marks the token that can't stand where it is; an end in an expression that
doesn't hold the empty word means that the text stops too early.
"""

from __future__ import annotations

import re

#: Interned expressions a grammar keeps before it forgets those made while parsing.
NODES_KEPT = 250_000


class Node:
    __slots__ = ("kind", "a", "b", "null", "d", "n")

    def __init__(self, kind: str, a, b, null: bool, n: int):
        self.kind, self.a, self.b, self.null, self.n = kind, a, b, null, n
        self.d: dict[str, Node] = {}


class Grammar:
    """Rules in a small notation: ``name = expr ;`` per rule.

    Lower-case words are rules, anything else is a token class (quoted where it
    has signs of the notation). ``|`` separates choices, ``*`` ``+`` ``?``
    follow a unit, parentheses group. Rules must not be left-recursive.
    """

    def __init__(self, text: str, start: str):
        self.rules: dict[str, Node] = {}
        self.start_name = start
        self.source = text
        self._reset()

    def _reset(self) -> None:
        self.made: dict[tuple, Node] = {}
        self.empty = Node("empty", None, None, False, 0)
        self.eps = Node("eps", None, None, True, 1)
        self.refs: dict[str, Node] = {}
        self.rules = {}
        for name, body in re.findall(r"(\w+)\s*=\s*((?:'[^']*'|[^;'])*);", self.source):
            self.rules[name] = self._parse(re.findall(r"'[^']*'|[\w$]+|[|*+?()]", body))
        changed = True
        while changed:  # which rules hold the empty word
            changed = False
            for name, body in self.rules.items():
                ref = self._ref(name)
                if not ref.null and self._nullable(body):
                    ref.null = changed = True
        for node in list(self.made.values()):
            node.null = self._nullable(node)
        self.start = self._ref(self.start_name)

    def _nullable(self, x: Node) -> bool:
        if x.kind == "seq":
            return self._nullable(x.a) and self._nullable(x.b)
        if x.kind == "alt":
            return any(self._nullable(y) for y in x.a)
        return x.null

    def _parse(self, words: list[str]) -> Node:
        at = 0

        def choice() -> Node:
            nonlocal at
            options = [chain()]
            while at < len(words) and words[at] == "|":
                at += 1
                options.append(chain())
            return self.alt(options)

        def chain() -> Node:
            units = []
            while at < len(words) and words[at] not in ("|", ")"):
                units.append(unit())
            out = self.eps
            for u in reversed(units):
                out = self.seq(u, out)
            return out

        def unit() -> Node:
            nonlocal at
            word = words[at]
            at += 1
            if word == "(":
                x = choice()
                at += 1
            elif word[0] == "'":
                x = self.tok(word[1:-1])
            elif word[0].islower():
                x = self._ref(word)
            else:
                x = self.tok(word)
            while at < len(words) and words[at] in ("*", "+", "?"):
                sign = words[at]
                at += 1
                x = self.alt([x, self.eps]) if sign == "?" else self.seq(x, self.star(x)) if sign == "+" else self.star(x)
            return x

        return choice()

    def _intern(self, key: tuple, kind: str, a, b, null: bool) -> Node:
        node = self.made.get(key)
        if node is None:
            node = self.made[key] = Node(kind, a, b, null, len(self.made) + 2)
        return node

    def tok(self, c: str) -> Node:
        return self._intern(("t", c), "tok", c, None, False)

    def _ref(self, name: str) -> Node:
        return self._intern(("r", name), "ref", name, None, False)

    def star(self, x: Node) -> Node:
        return self._intern(("*", x.n), "star", x, None, True)

    def seq(self, x: Node, y: Node) -> Node:
        if x is self.empty or y is self.empty:
            return self.empty
        if x is self.eps:
            return y
        if y is self.eps:
            return x
        if x.kind == "seq":  # to the right, so that the head is always at hand
            return self.seq(x.a, self.seq(x.b, y))
        return self._intern(("s", x.n, y.n), "seq", x, y, x.null and y.null)

    def alt(self, options: list[Node]) -> Node:
        flat: dict[int, Node] = {}
        for x in options:
            for y in x.a if x.kind == "alt" else (x,):
                if y is not self.empty:
                    flat[y.n] = y
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        parts = tuple(flat[n] for n in sorted(flat))
        return self._intern(("a", *sorted(flat)), "alt", parts, None, any(p.null for p in parts))

    def derive(self, x: Node, c: str) -> Node:
        got = x.d.get(c)
        if got is not None:
            return got
        kind = x.kind
        if kind == "seq":
            out = self.seq(self.derive(x.a, c), x.b)
            if x.a.null:
                out = self.alt([out, self.derive(x.b, c)])
        elif kind == "alt":
            out = self.alt([self.derive(y, c) for y in x.a])
        elif kind == "tok":
            out = self.eps if x.a == c else self.empty
        elif kind == "star":
            out = self.seq(self.derive(x.a, c), x)
        elif kind == "ref":
            out = self.derive(self.rules[x.a], c)
        else:
            out = self.empty
        x.d[c] = out
        return out

    def check(self, classes: list[str]) -> int | None:
        """None where valid; else the index of the failing token, ``len(classes)`` for an early end."""
        if len(self.made) > NODES_KEPT:
            self._reset()
        at, empty = self.start, self.empty
        for i, c in enumerate(classes):
            nxt = at.d.get(c)
            if nxt is None:
                nxt = self.derive(at, c)
            if nxt is empty:
                return i
            at = nxt
        return None if at.null else len(classes)
