"""Regular expressions over bytes as one deterministic automaton.

parse() reads a subset of regex syntax (literals, classes, groups, alternation, ? * + {m} {m,} {m,n},
escapes) into a tree; compile_rules() joins the trees of all rules into one nondeterministic automaton,
makes it deterministic by subset construction over byte classes, minimises it by partition refinement,
and lays the result out as transition arrays. A state's value is its row's offset in the array, so a
step is one addition and one look-up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Tree = tuple


def _letters_either_case(found: set[int]) -> set[int]:
    return found | {b ^ 32 for b in found if 65 <= b <= 90 or 97 <= b <= 122}


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def choice(self) -> Tree:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def sequence(self) -> Tree:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("then", *parts)

    def repeated(self) -> Tree:
        item = self.atom()
        while (c := self.peek()) in ("?", "*", "+", "{") and c:
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c) or self.bounds()
            item = ("times", item, low, high)
        return item

    def bounds(self) -> tuple[int, int | None]:
        inside, _, rest = self.p[self.i :].partition("}")
        self.i = len(self.p) - len(rest)
        low, comma, high = inside.partition(",")
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self) -> Tree:
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            inner = self.choice()
            if self.peek() != ")":
                raise ValueError(f"open group in {self.p!r}")
            self.take()
            return inner
        if c == "[":
            return ("bytes", frozenset(self.char_class()))
        if c == ".":
            return ("bytes", frozenset(range(256)) - {10})
        found = {self.escaped() if c == "\\" else ord(c)}
        return ("bytes", frozenset(_letters_either_case(found) if self.fold else found))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c) or ord(c)

    def char_class(self) -> set[int]:
        negative = self.peek() == "^"
        if negative:
            self.take()
        found: set[int] = set()
        while self.peek() != "]" or not found and self.p[self.i - 1] == "[":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            found |= set(range(low, high + 1))
        self.take()
        if self.fold:
            found = _letters_either_case(found)
        return set(range(256)) - found if negative else found


def parse(pattern: str, ignore_case: bool = False) -> Tree:
    """The tree of an ASCII pattern; letters outside classes and in them fold if ignore_case."""
    reader = _Parser(pattern, ignore_case)
    tree = reader.choice()
    if reader.i < len(pattern):
        raise ValueError(f"cannot read {pattern!r} at {reader.i}")
    return tree


def reverse(tree: Tree) -> Tree:
    """The tree whose texts are those of tree read backwards."""
    if tree[0] == "bytes":
        return tree
    if tree[0] == "times":
        return ("times", reverse(tree[1]), *tree[2:])
    parts = [reverse(x) for x in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "then" else parts))


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def build(self, tree: Tree, start: int) -> int:
        """Add the states of tree behind start; return where its texts end."""
        kind = tree[0]
        if kind == "bytes":
            mid, end = self.state(), self.state()
            self.free[start].append(mid)
            self.steps[mid] = (tree[1], end)
            return end
        if kind == "then":
            for part in tree[1:]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1:]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(part, first)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.build(inner, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """table[state + classes[byte]] is the next state, a multiple of width; states from accepting on accept.

    marks[state // width] has bit k set if rule k accepts there. State dead, if any, has no way on.
    """

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    marks: list[int]
    dead: int


def compile_rules(trees: list[Tree], anchored: bool) -> Automaton:
    """One minimal automaton for all trees; unless anchored, a text may begin anywhere."""
    nfa = _Nfa()
    first = nfa.state()
    ends = {nfa.build(tree, first): k for k, tree in enumerate(trees)}

    sets = {s[0] for s in nfa.steps if s}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    numbers: dict[tuple, int] = {}
    classes = bytes(numbers.setdefault(x, len(numbers)) for x in signature)
    sample = {c: b for b, c in reversed(list(enumerate(classes)))}
    width = len(numbers)

    def closure(states: set[int]) -> frozenset[int]:
        stack, seen = list(states), set(states)
        while stack:
            for x in nfa.free[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(x for x in seen if nfa.steps[x] or x in ends)

    closed = {s: closure({s}) for s in range(len(nfa.free))}
    always = closed[first] if not anchored else frozenset()
    root = closed[first]
    index, rows, todo = {root: 0}, [], [root]
    for found in todo:
        row = []
        for c in range(width):
            moved = set(always)
            for x in found:
                step = nfa.steps[x]
                if step and sample[c] in step[0]:
                    moved |= closed[step[1]]
            key = frozenset(moved)
            if key not in index:
                index[key] = len(index)
                todo.append(key)
            row.append(index[key])
        rows.append(row)
    marks = np.array([sum({1 << ends[x] for x in s if x in ends}) for s in todo], dtype=np.int64)

    # Partition refinement: states stay together while their marks and their successors' blocks agree.
    step_to = np.array(rows, dtype=np.int64)
    block = np.unique(marks, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[step_to]]), axis=0, return_inverse=True)[1].reshape(-1)
        done = finer.max() == block.max()
        block = finer
        if done:
            break
    n = int(block.max()) + 1
    member = np.zeros(n, dtype=np.int64)
    member[block] = np.arange(len(block))
    order = sorted(range(n), key=lambda k: (marks[member[k]] != 0, k))
    place = {k: i for i, k in enumerate(order)}
    table = [place[int(block[t])] * width for k in order for t in step_to[member[k]]]
    kept_marks = [int(marks[member[k]]) for k in order]
    accepting = next((i for i, m in enumerate(kept_marks) if m), n) * width
    dead = next((i * width for i in range(n) if not kept_marks[i] and all(t == i * width for t in table[i * width : (i + 1) * width])), -1)
    return Automaton(classes, width, table, place[int(block[0])] * width, accepting, kept_marks, dead)
