"""Byte regexes to deterministic automata: parsing, subset construction, minimisation, transition arrays.

The syntax is the small one that rules need: literals, escapes (``\\xHH``, ``\\n``, ``\\t``, ``\\.``), classes with ranges and ``^``, ``.``, groups,
``|``, and the quantifiers ``* + ? {m} {m,} {m,n}``. Matching is leftmost-longest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Parser:
    """Recursive descent to trees: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, low, high or None)."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        tree = self.choice()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        self.i += 1
        return c

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.single()
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                body = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(body) + 1
                low, _, high = body.partition(",")
                bounds = (int(low), int(high) if high else None if "," in body else int(low))
            else:
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            part = ("rep", part, *bounds)
        return part

    def single(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.choice()
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", ALL - {10})
        return ("set", self.folded({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            found |= set(range(low, high + 1))
        out = self.folded(found)
        return ALL - out if negated else out

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)


def _reversed(tree):
    if tree[0] == "cat":
        return ("cat", [_reversed(t) for t in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [_reversed(t) for t in tree[1]])
    if tree[0] == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.silent.append([])
        self.step.append(None)
        return len(self.silent) - 1

    def add(self, tree, at: int) -> int:
        """Thompson's construction from state at; the state after the tree."""
        if tree[0] == "set":
            end = self.state()
            here = self.state()
            self.silent[at].append(here)
            self.step[here] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if tree[0] == "alt":
            ends = [self.add(part, at) for part in tree[1]]
            out = self.state()
            for e in ends:
                self.silent[e].append(out)
            return out
        _, part, low, high = tree
        for _ in range(low):
            at = self.add(part, at)
        if high is None:
            loop = self.state()
            self.silent[at].append(loop)
            self.silent[self.add(part, loop)].append(loop)
            return loop
        out = self.state()
        self.silent[at].append(out)
        for _ in range(high - low):
            at = self.add(part, at)
            self.silent[at].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.silent[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.step[s] or s in self.ends)

    ends: dict[int, int] = {}


@dataclass(frozen=True)
class Automaton:
    """moves[state, class] is the next state; classes maps bytes; accepts is a bit mask of patterns; state 0 is the start."""

    moves: np.ndarray
    classes: bytes
    accepts: list[int]

    def table(self) -> tuple[list[int], int, list[int]]:
        """A flat table for scanning: states are row offsets, ordered so that those from the returned limit on accept."""
        quiet = [s for s in range(len(self.accepts)) if not self.accepts[s]]
        loud = [s for s in range(len(self.accepts)) if self.accepts[s]]
        quiet.sort(key=lambda s: s != 0)
        order = quiet + loud if self.accepts[0] == 0 else [0, *quiet, *(s for s in loud if s)]
        width = self.moves.shape[1]
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order)) * width
        flat = at[self.moves[order]].ravel().tolist()
        return flat, len(quiet) * width, [self.accepts[s] for s in order]


def compile_patterns(patterns: list[tuple[str, bool]], search: bool = False, backwards: bool = False) -> Automaton:
    """One minimal automaton for all (pattern, fold case); ``search`` lets a match begin anywhere; ``backwards`` reverses the patterns."""
    nfa = _Nfa()
    start = nfa.state()
    nfa.ends = {}
    for bit, (pattern, fold) in enumerate(patterns):
        tree = _Parser(pattern, fold).parse()
        here = nfa.state()
        nfa.silent[start].append(here)
        nfa.ends[nfa.add(_reversed(tree) if backwards else tree, here)] = 1 << bit
    sets = sorted({s[0] for s in nfa.step if s}, key=lambda x: (len(x), sorted(x)))
    signatures: dict[tuple, int] = {}
    classes = bytearray(256)
    samples = []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in signatures:
            signatures[key] = len(samples)
            samples.append(b)
        classes[b] = signatures[key]
    first = nfa.closure([start])
    index, todo, rows = {first: 0}, [first], []
    for current in todo:
        row = []
        for b in samples:
            target = {t for s in current if nfa.step[s] and b in nfa.step[s][0] for t in (nfa.step[s][1],)}
            following = nfa.closure(target) | first if search else nfa.closure(target)
            if following not in index:
                index[following] = len(todo)
                todo.append(following)
            row.append(index[following])
        rows.append(row)
    accepts = [sum({nfa.ends[s] for s in states if s in nfa.ends}) for states in todo]
    return _minimal(np.array(rows, np.int64), bytes(classes), accepts)


def _minimal(moves: np.ndarray, classes: bytes, accepts: list[int]) -> Automaton:
    """Moore's partition refinement: states stay together while their accepts and all their moves agree."""
    part = np.unique(np.array(accepts), return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.unique(part, return_index=True)[1]
    order = [order[part[0]], *(s for p, s in enumerate(order) if p != part[0])]
    name = np.empty(len(order), np.int64)
    for k, s in enumerate(order):
        name[part[s]] = k
    return Automaton(name[part[moves[order]]], classes, [accepts[s] for s in order])
