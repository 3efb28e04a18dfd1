"""Regular rules compiled to one deterministic automaton over bytes.

A rule is a pattern in Python syntax, restricted to what a finite automaton can say:
literals, classes, groups, alternation and greedy repeats.  Subset construction and
minimisation turn rules into flat transition arrays over classes of bytes.

``Scanner`` runs the automaton of all rules (unanchored) once over the bytes of a
text.  Where it accepts, some rule's match may end; the rule's own reversed automaton
finds the leftmost start that is not inside the rule's previous match, and its forward
automaton the longest end.  The matches are thus leftmost, longest and, for each rule,
do not overlap.  For rules in which the first match to end is the first to start,
which all rules here satisfy, this is what a backtracking search finds.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections import deque
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``min_length``: of the match's group ``group`` (0: all of it); shorter matches are
    dropped after the search, and the search goes on behind them."""
    name: str
    pattern: str
    min_length: int = 0
    group: int = 0
    ignore_case: bool = False


class _Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int, fold: bool, backwards: bool) -> int:
        """Append the parsed pattern behind ``start``; the state it ends in."""
        for op, arg in (reversed(list(tree)) if backwards else tree):
            start = self._one(op, arg, start, fold, backwards)
        return start

    def _one(self, op, arg, start, fold, backwards) -> int:
        if op in (sre.LITERAL, sre.IN, sre.NOT_LITERAL, sre.ANY):
            end = self.state()
            self.edges[start].append((_bytes(op, arg, fold), end))
            return end
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, fold, backwards)
        if op is sre.BRANCH:
            end = self.state()
            for tree in arg[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(tree, own, fold, backwards)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                start = self.add(tree, start, fold, backwards)
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(tree, loop, fold, backwards)].append(loop)
                return loop
            end = self.state()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(tree, start, fold, backwards)
                self.empty[start].append(end)
            return end
        raise ValueError(f"a finite automaton cannot express {op}")

    def closure(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)


def _bytes(op, arg, fold: bool) -> frozenset:
    if op is sre.ANY:
        return frozenset(range(256)) - {10}
    if op in (sre.LITERAL, sre.NOT_LITERAL):
        found, negate = {arg}, op is sre.NOT_LITERAL
    else:
        found, negate = set(), False
        for kind, x in arg:
            if kind is sre.NEGATE:
                negate = True
            elif kind is sre.LITERAL:
                found.add(x)
            elif kind is sre.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"unknown class member {kind}")
    if max(found, default=0) > 127:
        raise ValueError("rules are over ASCII characters")
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
    return frozenset(range(256)) - found if negate else frozenset(found)


@dataclass
class Dfa:
    """``table[state * classes + cls[byte]]`` is the next state; state 0 is dead unless it
    is the start; ``accepts[state]`` are the numbers of the rules that end there."""
    cls: bytes
    classes: int
    table: list[int]
    start: int
    accepts: list[tuple[int, ...]]


def compile_dfa(rules: list[tuple[int, str, bool]], search: bool = False, backwards: bool = False) -> Dfa:
    """Automaton of (number, pattern, ignore case); ``search``: a match may begin anywhere."""
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for number, pattern, fold in rules:
        own = nfa.state()
        nfa.empty[root].append(own)
        ends[nfa.add(parser.parse(pattern), own, fold, backwards)] = number
    # classes: bytes that no edge tells apart
    sets = {s for es in nfa.edges for s, _ in es}
    kinds: dict[tuple, int] = {}
    cls = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [cls.index(k) for k in range(len(kinds))]
    # subset construction, sets of states as bits of a number
    closed = [sum(1 << x for x in nfa.closure([i])) for i in range(len(nfa.edges))]
    again = closed[root] if search else 0
    step = [[0] * len(sample) for _ in nfa.edges]
    for x, es in enumerate(nfa.edges):
        for c, b in enumerate(sample):
            for s, t in es:
                if b in s:
                    step[x][c] |= closed[t]
    first = closed[root]
    number_of, todo, moves = {first: 0}, deque([first]), []
    while todo:
        here = todo.popleft()
        to, x = [again] * len(sample), 0
        while here >> x:
            if here >> x & 1 and nfa.edges[x]:
                to = [a | b for a, b in zip(to, step[x])]
            x += 1
        for there in to:
            if there not in number_of:
                number_of[there] = len(number_of)
                todo.append(there)
        moves.append([number_of[there] for there in to])
    accepts = [tuple(sorted(n for x, n in ends.items() if s >> x & 1)) for s in number_of]
    # minimisation: refine the partition by accepted rules until transitions agree
    block = [0] * len(moves)
    seen: dict = {}
    block = [seen.setdefault(a, len(seen)) for a in accepts]
    while True:
        seen = {}
        new = [seen.setdefault((block[i], *(block[t] for t in moves[i])), len(seen)) for i in range(len(moves))]
        if len(seen) == len(set(block)):
            break
        block = new
    n = len(set(block))
    table, accept = [0] * (n * len(kinds)), [()] * n
    for i, b in enumerate(block):
        accept[b] = accepts[i]
        for c, t in enumerate(moves[i]):
            table[b * len(kinds) + c] = block[t]
    return Dfa(cls, len(kinds), table, block[0], accept)


class Scanner:
    """All matches of some rules in a text, in one pass over its bytes."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.all = compile_dfa([(i, r.pattern, r.ignore_case) for i, r in enumerate(rules)], search=True)
        self.forward = [compile_dfa([(0, r.pattern, r.ignore_case)]) for r in rules]
        self.reverse = [compile_dfa([(0, r.pattern, r.ignore_case)], backwards=True) for r in rules]
        # the hot loop: states are table offsets, accepting ones stand last
        d = self.all
        order = sorted(range(len(d.accepts)), key=lambda s: bool(d.accepts[s]))
        place = {s: i * d.classes for i, s in enumerate(order)}
        self.table = [place[t] for s in order for t in d.table[s * d.classes:(s + 1) * d.classes]]
        self.first_accept = sum(not a for a in d.accepts) * d.classes
        self.ends = {place[s]: a for s, a in enumerate(d.accepts) if a}
        self.begin = place[d.start]

    @staticmethod
    def _longest(d: Dfa, data, positions) -> int | None:
        """How many steps along ``positions`` the longest accepted prefix takes."""
        state, best, dead = d.start, None, _dead(d)
        for i, p in enumerate(positions, 1):
            state = d.table[state * d.classes + d.cls[data[p]]]
            if state == dead:
                break
            if d.accepts[state]:
                best = i
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, in the order in which matches are found."""
        out, free = [], [0] * len(self.rules)
        table, limit, ends = self.table, self.first_accept, self.ends
        state = self.begin
        for at, c in enumerate(data.translate(self.all.cls)):
            state = table[state + c]
            if state >= limit:
                for r in ends[state]:
                    if at >= free[r]:
                        back = self._longest(self.reverse[r], data, range(at, free[r] - 1, -1))
                        if back is not None:
                            start = at + 1 - back
                            end = start + self._longest(self.forward[r], data, range(start, len(data)))
                            free[r] = end
                            out.append((r, start, end))
        return out


def _dead(d: Dfa) -> int:
    """The state that leads only to itself and accepts nothing (-1: none)."""
    if not hasattr(d, "dead"):
        d.dead = next((s for s, a in enumerate(d.accepts) if not a and all(
            t == s for t in d.table[s * d.classes:(s + 1) * d.classes])), -1)
    return d.dead
