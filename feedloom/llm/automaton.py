"""Regular expressions over bytes to one minimal automaton, by subset construction and minimisation.

Syntax: literals, escapes (``\\xHH``, ``\\.``), classes ``[...]`` with ranges and ``^``, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``. The result is a transition array
``[state][byte class]`` and for each state the set of rules that end there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Reader:
    """Recursive descent over one pattern; nodes are tuples."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = ""
                while (x := self.take()) != "}":
                    body += x
                a, comma, b = body.partition(",")
                low, high = int(a), int(b) if b else (None if comma else int(a))
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.either()
            if self.take() != ")":
                raise ValueError(f"no closing bracket in {self.text}")
            return node
        if c == "[":
            return ("set", self.charset())
        if c == ".":
            return ("set", ALL - {10})
        byte = self.escaped() if c == "\\" else c.encode("latin-1")[0]
        return ("set", self.cased({byte}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def charset(self) -> frozenset:
        negative = self.peek() == "^" and bool(self.take())
        out: set[int] = set()
        while self.peek() != "]":
            a = self.escaped() if (c := self.take()) == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                b = self.escaped() if (c := self.take()) == "\\" else ord(c)
                out.update(range(a, b + 1))
            else:
                out.add(a)
        self.take()
        return ALL - self.cased(out) if negative else self.cased(out)

    def cased(self, out: set) -> frozenset:
        if self.fold:
            letters = {b for b in out if chr(b).isascii() and chr(b).isalpha()}
            out = out | {b ^ 32 for b in letters}
        return frozenset(out)


class _Nfa:
    def __init__(self):
        self.empty: list[set[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append(set())
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """States for ``node`` after ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "seq":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for option in node[1]:
                begin = self.state()
                self.empty[start].add(begin)
                self.empty[self.add(option, begin)].add(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].add(loop)
            self.empty[self.add(inner, loop)].add(loop)
            return loop
        ends = [start]
        for _ in range(high - low):
            ends.append(self.add(inner, ends[-1]))
        end = self.state()
        for e in ends:
            self.empty[e].add(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """``step[state, byte]`` (state 0 starts), ``rules[state]`` the rule numbers that end there, ``dead`` or -1."""

    step: np.ndarray
    rules: list[frozenset]
    dead: int

    def rows(self) -> list:
        """Linked rows for a byte loop: row[byte] is the next row, row[256] its rules or None."""
        out: list[list] = [[None] * 257 for _ in self.rules]
        for s, row in enumerate(self.step.tolist()):
            out[s][:256] = [out[t] for t in row]
            out[s][256] = tuple(sorted(self.rules[s])) or None
        return out


def parse(pattern: str, fold: bool = False) -> tuple:
    """The tree of a pattern; ``fold`` makes its letters match in either case."""
    reader = _Reader(pattern, fold)
    tree = reader.either()
    if reader.at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} after {reader.at}")
    return tree


def reverse(tree: tuple) -> tuple:
    """The tree that matches the reversed strings."""
    if tree[0] == "seq":
        return ("seq", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [reverse(x) for x in tree[1]])
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


def compile_trees(trees: list[tuple], floating: bool = True, most: int = 20_000) -> Automaton:
    """One automaton for several trees, numbered in order.

    ``floating`` lets a match begin anywhere, else it begins at the first byte. More than ``most``
    states is an error.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for number, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].add(begin)
        ends[nfa.add(tree, begin)] = number
    classes = _byte_classes(nfa)
    samples = [int(np.flatnonzero(classes == k)[0]) for k in range(classes.max() + 1)]
    start = nfa.closure([root])
    numbers, todo, table = {start: 0}, [start], []
    while todo:
        subset = todo.pop(0)
        row = []
        for byte in samples:
            reached = {t for s in subset for on, t in nfa.moves[s] if byte in on}
            target = nfa.closure(reached | ({root} if floating else set()))
            if target not in numbers:
                if len(numbers) == most:
                    raise ValueError(f"the rules need more than {most} states")
                numbers[target] = len(numbers)
                todo.append(target)
            row.append(numbers[target])
        table.append(row)
    rules = [frozenset(ends[s] for s in subset if s in ends) for subset in numbers]
    step, rules = _minimal(np.array(table), rules)
    dead = next((s for s in range(len(rules)) if not rules[s] and (step[s] == s).all()), -1)
    return Automaton(step[:, classes], rules, dead)


def _byte_classes(nfa: _Nfa) -> np.ndarray:
    """Bytes that no rule tells apart share a class."""
    sets = list({on for moves in nfa.moves for on, _ in moves})
    marks: dict[tuple, int] = {}
    return np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)])


def _minimal(table: np.ndarray, rules: list[frozenset]) -> tuple[np.ndarray, list[frozenset]]:
    """States split by their rules and then by the groups they lead to, until nothing splits."""
    marks: dict = {}
    group = np.array([marks.setdefault(r, len(marks)) for r in rules])
    while True:
        signature = np.column_stack([group, group[table]])
        _, new = np.unique(signature, axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == group.max():
            break
        group = new
    firsts = np.array([int(np.flatnonzero(new == k)[0]) for k in range(new.max() + 1)])
    order = np.argsort(firsts)  # the start state, first of all, gets number 0
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    kept = firsts[order]
    return place[new[table[kept]]], [rules[k] for k in kept]
