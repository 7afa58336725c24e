"""Parsing with memoised derivatives.

A state is what may still follow: a set of stacks of grammar nodes. The derivative of a state by a token
kind is again a state; states and stacks are interned and every derivative is kept with the state it was
taken of, so a known (state, token) pair costs one dictionary lookup. Grammars have no left recursion,
which makes the derivative of a node a finite set of node sequences.

An empty derivative marks the token at which no continuation is left. A state at the end of the input
from which the end can't be derived (it isn't nullable) tells that the text was cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

END = "END"  # kind for the end of input, where statement ends may be left out
MOST_STATES = 400_000  # memo entries after which it is emptied between texts; results don't depend on it


class Node:
    __slots__ = ("kind", "a", "b")

    def __init__(self, kind: str, a=None, b=None):
        self.kind, self.a, self.b = kind, a, b


class Cell:
    """A stack: a node and what follows it."""

    __slots__ = ("head", "tail", "memo")

    def __init__(self, head: Node | None, tail: "Cell | None"):
        self.head, self.tail, self.memo = head, tail, {}


_LEX = re.compile(r"\s*(?:'([^']+)'|([A-Z]+)|([a-z_0-9]+)|(~'[^']+')|([|()?*+]))")


class Grammar:
    """Rules in EBNF: ``name: alternatives``, one rule a paragraph.

    'x' and UPPER are token kinds, lower names are rules, ~'x' forbids the next part to begin with x,
    ANY is any token, SC the end of a statement: a semicolon, or nothing before a closing brace, at the
    end, or before a token on a new line."""

    def __init__(self, text: str, start: str):
        self.rules: dict[str, Node] = {}
        for rule in re.split(r"\n(?=[a-z_0-9]+:)", text.strip()):
            name, body = rule.split(":", 1)
            self.rules[name.strip()] = self._parse(_LEX.findall(body))
        self.start = start
        self._null: dict[int, bool] = {}
        self._derived: dict[tuple[int, str], frozenset] = {}
        self.reset()

    def reset(self) -> None:
        self.cells: dict[tuple[int, int], Cell] = {}
        self.bottom = Cell(None, None)
        self.states: dict = {}
        self.entries = 0

    def first(self, rule: str | None = None) -> frozenset:
        return frozenset([self.push((Node("ref", rule or self.start),), self.bottom)])

    # -- reading of the notation
    def _parse(self, lexemes: list) -> Node:
        at = 0

        def alternatives() -> Node:
            nonlocal at
            options = [sequence()]
            while at < len(lexemes) and lexemes[at][4] == "|":
                at += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else Node("alt", options)

        def sequence() -> Node:
            nonlocal at
            parts, guards = [], []
            while at < len(lexemes) and lexemes[at][4] not in ("|", ")"):
                literal, upper, lower, guard, op = lexemes[at]
                at += 1
                if guard:
                    guards.append(guard[2:-1])
                    continue
                if op == "(":
                    node = alternatives()
                    at += 1
                elif literal:
                    node = Node("tok", literal)
                elif upper:
                    node = Node("sc") if upper == "SC" else Node("any") if upper == "ANY" else Node("tok", upper)
                else:
                    node = Node("ref", lower)
                while at < len(lexemes) and lexemes[at][4] in ("?", "*", "+"):
                    op = lexemes[at][4]
                    at += 1
                    star = Node("star", node)
                    node = Node("opt", node) if op == "?" else star if op == "*" else Node("seq", [node, star])
                if guards:
                    node, guards = Node("guard", frozenset(guards), node), []
                parts.append(node)
            return parts[0] if len(parts) == 1 else Node("seq", parts)

        return alternatives()

    # -- derivatives
    def nullable(self, node: Node) -> bool:
        """Can the node be empty, whatever follows?"""
        got = self._null.get(id(node))
        if got is None:
            self._null[id(node)] = False
            k = node.kind
            got = k in ("star", "opt") or (k == "seq" and all(map(self.nullable, node.a))) or (k == "alt" and any(map(self.nullable, node.a))) or (k == "ref" and self.nullable(self.rules[node.a])) or (k == "guard" and self.nullable(node.b))
            self._null[id(node)] = got
        return got

    def empty_before(self, node: Node, kind: str, new_line: bool) -> bool:
        """Can the node be empty before this token?"""
        if self.nullable(node):
            return True
        k = node.kind
        if k == "sc":
            return new_line or kind in ("}", END)
        if k == "seq":
            return all(self.empty_before(x, kind, new_line) for x in node.a)
        if k == "alt":
            return any(self.empty_before(x, kind, new_line) for x in node.a)
        if k == "ref":
            return node.a in self._may_end and self.empty_before(self.rules[node.a], kind, new_line)
        return False

    @property
    def _may_end(self) -> frozenset:
        """Rules that are empty but for statement ends."""
        got = self.__dict__.get("_ends")
        if got is None:
            got = frozenset()
            while True:
                def can(n: Node) -> bool:
                    return n.kind in ("sc", "star", "opt") or (n.kind == "seq" and all(map(can, n.a))) or (n.kind == "alt" and any(map(can, n.a))) or (n.kind == "ref" and n.a in got)

                new = frozenset(r for r, n in self.rules.items() if can(n))
                if new == got:
                    break
                got = new
            self.__dict__["_ends"] = got
        return got

    def derive(self, node: Node, kind: str, new_line: bool) -> frozenset:
        """Sequences of nodes that may follow the token within the node."""
        key = (id(node), kind, new_line)
        got = self._derived.get(key)
        if got is None:
            self._derived[key] = got = frozenset(self._derive(node, kind, new_line))
        return got

    def _derive(self, node: Node, kind: str, new_line: bool):
        k = node.kind
        if k == "tok":
            return [()] if node.a == kind else []
        if k == "any":
            return [()] if kind not in ("BAD", END) else []
        if k == "sc":
            return [()] if kind == ";" else []
        if k == "ref":
            return self.derive(self.rules[node.a], kind, new_line)
        if k == "guard":
            return [] if kind in node.a else self.derive(node.b, kind, new_line)
        if k == "opt":
            return self.derive(node.a, kind, new_line)
        if k == "star":
            return [(*s, node) for s in self.derive(node.a, kind, new_line)]
        if k == "alt":
            return [s for x in node.a for s in self.derive(x, kind, new_line)]
        out = []
        for i, x in enumerate(node.a):
            rest = tuple(node.a[i + 1 :])
            out += [(*s, *rest) for s in self.derive(x, kind, new_line)]
            if not self.empty_before(x, kind, new_line):
                break
        return out

    def push(self, nodes: tuple, tail: Cell) -> Cell:
        for n in reversed(nodes):
            key = (id(n), id(tail))
            cell = self.cells.get(key)
            if cell is None:
                self.cells[key] = cell = Cell(n, tail)
            tail = cell
        return tail

    def after(self, cell: Cell, kind: str, new_line: bool) -> frozenset:
        """Stacks that may follow the token."""
        key = (kind, new_line)
        got = cell.memo.get(key)
        if got is None:
            out: set = set()
            if cell.head is not None:
                out.update(self.push(s, cell.tail) for s in self.derive(cell.head, kind, new_line))
                if self.empty_before(cell.head, kind, new_line):
                    out |= self.after(cell.tail, kind, new_line)
            cell.memo[key] = got = frozenset(out)
            self.entries += 1
        return got

    def step(self, stacks: frozenset, kind: str, new_line: bool = False) -> frozenset:
        if len(stacks) == 1:
            (cell,) = stacks
            return self.after(cell, kind, new_line)
        return frozenset(x for c in stacks for x in self.after(c, kind, new_line))

    def can_end(self, stacks: frozenset) -> bool:
        return any(self._ends_here(c) for c in stacks)

    def _ends_here(self, cell: Cell) -> bool:
        while cell.head is not None:
            if not self.empty_before(cell.head, END, True):
                return False
            cell = cell.tail
        return True


class State(dict):
    """The state after some tokens; ``state[kind]`` is the state after one more."""

    __slots__ = ("g", "stacks", "extra")
    lead = ""  # put before the text

    def __init__(self, g: Grammar, stacks: frozenset, extra: tuple):
        self.g, self.stacks, self.extra = g, stacks, extra
        self["SKIP"] = self

    @classmethod
    def of(cls, g: Grammar, stacks: frozenset, extra: tuple) -> "State":
        key = (cls, stacks, extra)
        got = g.states.get(key)
        if got is None:
            g.states[key] = got = cls(g, stacks, extra)
            g.entries += 1
        return got

    def __missing__(self, kind) -> "State":
        self[kind] = got = self.next(kind)
        return got

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other

    def dead(self) -> bool:
        return not self.stacks

    def next(self, kind) -> "State":
        raise NotImplementedError

    def complete(self) -> bool:
        return self.g.can_end(self.stacks)


class FreeState(State):
    """Statements may end at line ends (JavaScript, TypeScript) or line ends mean nothing (Java).
    extra = (was there a line end before the next token,)"""

    @classmethod
    def start(cls, g: Grammar, rule: str | None = None) -> State:
        return cls.of(g, g.first(rule), (False,))

    def next(self, kind):
        if kind == "NL":
            return self.of(self.g, self.stacks, (True,))
        return self.of(self.g, self.g.step(self.stacks, kind, self.extra[0]), (False,))


class LineState(State):
    """A line end is a semicolon after certain tokens (Go). extra = (would it be one now,)"""

    AFTER = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])  # fixed values of the language

    @classmethod
    def start(cls, g: Grammar, rule: str | None = None) -> State:
        return cls.of(g, g.first(rule), (False,))

    def next(self, kind):
        if kind == "NL":
            return self.of(self.g, self.g.step(self.stacks, ";"), (False,)) if self.extra[0] else self
        return self.of(self.g, self.g.step(self.stacks, kind), (kind in self.AFTER,))

    def complete(self) -> bool:
        return self.g.can_end(self.stacks) or (self.extra[0] and self.g.can_end(self.g.step(self.stacks, ";")))


class IndentState(State):
    """Blocks by indentation (Python). Line ends are numbers: the width of the next line's indentation.
    extra = (indentations, open brackets, width at hand or None, is a line open)"""

    __slots__ = ()
    lead = "\n"  # so that the first line's indentation is seen

    @classmethod
    def start(cls, g: Grammar, rule: str | None = None) -> State:
        return cls.of(g, g.first(rule), ((0,), 0, 0, False))

    def next(self, kind):
        indents, depth, width, line = self.extra
        if type(kind) is int:
            return self if depth else self.of(self.g, self.stacks, (indents, 0, kind, line))
        stacks = self.stacks
        if width is not None:
            if line:
                stacks = self.g.step(stacks, "NEWLINE")
            if width > indents[-1]:
                stacks, indents = self.g.step(stacks, "INDENT"), (*indents, width)
            while width < indents[-1]:
                stacks, indents = self.g.step(stacks, "DEDENT"), indents[:-1]
            if width != indents[-1]:
                stacks = frozenset()
        stacks = self.g.step(stacks, kind)
        depth = depth + 1 if kind in ("(", "[", "{") else max(0, depth - 1) if kind in (")", "]", "}") else depth
        return self.of(self.g, stacks, (indents, depth, None, True))

    def complete(self) -> bool:
        indents, depth, _, line = self.extra
        stacks = self.g.step(self.stacks, "NEWLINE") if line else self.stacks
        for _ in indents[1:]:
            stacks = self.g.step(stacks, "DEDENT")
        return self.g.can_end(stacks)


class Kinds(dict):
    """Token text -> kind, by a function; forgets when large."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str):
        if len(self) > 400_000:
            self.clear()
        self[token] = kind = self.classify(token)
        return kind


class Language:
    def __init__(self, grammar: Grammar, state: type[State], pattern: re.Pattern, classify):
        self.grammar, self.state, self.pattern, self.kinds = grammar, state, pattern, Kinds(classify)

    def tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        return ((m.start(), m.group()) for m in self.pattern.finditer(text))

    def check(self, text: str, rule: str | None = None) -> tuple[bool, int | None, bool]:
        """(valid, line of the failing token, was the text cut off)"""
        if self.grammar.entries > MOST_STATES:
            self.grammar.reset()
        lead = self.state.lead
        text = lead + text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        kind = self.kinds
        s = first = self.state.start(self.grammar, rule)
        for t in self.tokens(text):
            s = s[kind[t]]
        if not s.dead():
            return (True, None, False) if s.complete() else (False, text.count("\n") + 1 - len(lead), True)
        s = first
        for at, t in self.places(text):
            s = s[kind[t]]
            if s.dead():
                return False, text.count("\n", 0, at + (t[:1] == "\n")) + 1 - len(lead), False
        return False, None, False
