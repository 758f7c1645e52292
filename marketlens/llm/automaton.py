"""Regular expressions as one minimal deterministic automaton over bytes.

Rules are written in the common notation (literals, ``\\x``-escapes, classes,
groups, ``|``, ``? * + {m,n}``).  ``compile_rules`` builds one nondeterministic
automaton of all rules that may start at any byte, determines it by subset
construction over classes of bytes that no rule tells apart, and merges equal
states; the result is a few arrays.  A state's ``accept`` bits say which rules
have a match that ends there.
"""

from __future__ import annotations

import numpy as np

ALL = frozenset(range(256))


class _Parser:
    """Recursive descent from a rule to automaton fragments (start, end)."""

    def __init__(self, text: str, fold: bool, moves: list, jumps: list):
        self.text, self.at, self.fold, self.moves, self.jumps = text, 0, fold, moves, jumps

    def state(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            s, e = self.sequence()
            self.jumps[start].append(s)
            self.jumps[e].append(end)
            if self.peek() != "|":
                return start, end
            self.take()

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            least, most = 1, 1
            s, e = self.atom()
            after = self.at
            if self.peek() in ("?", "*", "+", "{"):
                least, most = self.count()
            rest = self.at
            for i in range(max(least, most or 0, 1)):
                if i:  # each further copy is parsed anew
                    self.at = begin
                    s, e = self.atom()
                    assert self.at == after
                self.jumps[end].append(s)
                if i >= least:
                    self.jumps[s].append(e)
                end = e
            if most is None:
                self.jumps[e].append(s)
                if least == 0:
                    self.jumps[s].append(e)
            self.at = rest
        return start, end

    def count(self) -> tuple[int, int | None]:
        kind = self.take()
        if kind != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[kind]
        body = ""
        while (c := self.take()) != "}":
            body += c
        low, comma, high = body.partition(",")
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            found = self.choice()
            if self.take() != ")":
                raise ValueError(self.text)
            # a loop must not lead back into a shared start
            s, e = self.state(), self.state()
            self.jumps[s].append(found[0])
            self.jumps[found[1]].append(e)
            return s, e
        if c == "[":
            chosen = self.chosen()
        elif c == "\\":
            chosen = {self.escape()}
        elif c == ".":
            chosen = ALL - {10}
        else:
            chosen = {ord(c)}
        if self.fold:
            chosen = {x for b in chosen for x in (b, *([b ^ 32] if chr(b).isalpha() and b < 128 else []))}
        s, e = self.state(), self.state()
        self.moves[s].append((frozenset(chosen), e))
        return s, e

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def chosen(self) -> frozenset:
        out, negate = set(), self.peek() == "^"
        self.at += negate
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
            out |= set(range(low, high + 1))
        return frozenset(ALL - out if negate else out)


class Automaton:
    """``step[state, byte_class[byte]]`` is the next state, 0 the first one."""

    def __init__(self, step: np.ndarray, byte_class: np.ndarray, accept: np.ndarray):
        self.step, self.byte_class, self.accept = step, byte_class, accept
        #: Bytes after which any state is the first one again: no match spans them.
        self.resets = (step == 0).all(axis=0)[byte_class]
        self.flat = np.ascontiguousarray(step).ravel()
        self.width = step.shape[1]

    def scan(self, data: np.ndarray, few: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass over the bytes: (start, end, rules) of the stretches between
        resets in which some rule has a match.

        All stretches are walked side by side, one byte each at a time, and the
        last few long ones byte by byte."""
        resets = self.resets[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[1], resets.view(np.int8), [1]])))
        start, end = edge[0::2], edge[1::2]
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        size = end - start
        classes = self.byte_class[data]
        state = np.zeros(len(start), np.int32)
        rules = np.zeros(len(start), np.uint32)
        # how many stretches are longer than i
        longer = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1 if len(size) else 0), side="right")
        at = 0
        while at < len(longer) - 1 and longer[at] >= few:
            n = longer[at]
            state[:n] = self.flat[state[:n] * self.width + classes[start[:n] + at]]
            rules[:n] |= self.accept[state[:n]]
            at += 1
        if at < len(longer):
            table, accept = self.step.tolist(), self.accept.tolist()
            for i in range(int(longer[at])):
                s, got = int(state[i]), int(rules[i])
                for c in classes[start[i] + at:end[i]].tolist():
                    s = table[s][c]
                    got |= accept[s]
                rules[i] = got
        hit = np.flatnonzero(rules)
        hit = hit[np.argsort(start[hit])]
        return start[hit], end[hit], rules[hit]


def compile_rules(rules: list[tuple[str, bool]], most_states: int = 60_000) -> Automaton:
    """The minimal automaton of (rule, whether letters match in either case)."""
    moves: list[list] = [[]]
    jumps: list[list] = [[]]
    ends = {}
    for i, (text, fold) in enumerate(rules):
        parser = _Parser(text, fold, moves, jumps)
        s, e = parser.choice()
        if parser.at != len(text):
            raise ValueError(text)
        jumps[0].append(s)
        ends[e] = i

    # bytes that every move treats alike
    sets = sorted({m for out in moves for m, _ in out}, key=sorted)
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(b in m for m in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(kinds))]

    def closure(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in jumps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        # only states that move or end a rule tell subsets apart
        return frozenset(s for s in seen if moves[s] or s in ends)

    always = closure([0])
    onward = [[[t for m, t in out if b in m] for b in sample] for out in moves]
    subsets, table, todo = {always: 0}, [], [always]
    closed: dict[frozenset, frozenset] = {}
    while todo:
        now = todo.pop(0)
        row = []
        for c in range(len(sample)):
            # the state before the first byte stays possible: a match may start anywhere
            to = frozenset(t for s in now for t in onward[s][c])
            if to not in closed:
                closed[to] = closure(to) | always
            nxt = closed[to]
            if nxt not in subsets:
                if len(subsets) >= most_states:
                    raise ValueError("the rules need too many states; shorten their counts")
                subsets[nxt] = len(subsets)
                todo.append(nxt)
            row.append(subsets[nxt])
        table.append(row)
    step = np.array(table, np.int32)
    accept = np.array([sum(1 << ends[s] for s in sub if s in ends) for sub in subsets], np.uint32)

    # merge states: refine by acceptance, then by where each class leads
    _, group = np.unique(accept, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_index=True, return_inverse=True)
        if len(first) == group.max() + 1:
            break
        group = finer.ravel()
    # the state of the start is number 0
    rename = np.argsort(np.argsort(np.where(np.arange(len(first)) == group[0], -1, np.arange(len(first)))))
    keep = np.empty(len(first), np.int64)
    keep[rename[group]] = np.arange(len(group))
    return Automaton(rename[group][step][keep].astype(np.int32), byte_class, accept[keep])
