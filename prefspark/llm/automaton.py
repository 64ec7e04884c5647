"""Regular expressions to minimised deterministic automata over bytes.

Supported syntax: literals, ``\\xNN`` and escaped characters, ``[...]`` classes with ranges and
negation, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``; ASCII only.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class _Nfa:
    """Thompson construction; states are integers, edges carry frozensets of bytes."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.edges.append([])
        return len(self.eps) - 1

    def add(self, tree, reverse: bool) -> tuple[int, int]:
        kind = tree[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.edges[a].append((tree[1], b))
            return a, b
        if kind == "cat":
            first = last = self.state()
            for part in (reversed(tree[1]) if reverse else tree[1]):
                a, b = self.add(part, reverse)
                self.eps[last].append(a)
                last = b
            return first, last
        if kind == "alt":
            a, b = self.state(), self.state()
            for part in tree[1]:
                x, y = self.add(part, reverse)
                self.eps[a].append(x)
                self.eps[y].append(b)
            return a, b
        _, part, low, high = tree  # repetition
        first = last = self.state()
        for _ in range(low):
            a, b = self.add(part, reverse)
            self.eps[last].append(a)
            last = b
        if high is None:
            loop = self.state()
            a, b = self.add(part, reverse)
            self.eps[last].append(loop)
            self.eps[loop].append(a)
            self.eps[b].append(loop)
            return first, loop
        end = self.state()
        self.eps[last].append(end)
        for _ in range(high - low):
            a, b = self.add(part, reverse)
            self.eps[last].append(a)
            last = b
            self.eps[last].append(end)
        return first, end


def _parse(pattern: str):
    pos = 0

    def peek() -> str:
        return pattern[pos] if pos < len(pattern) else ""

    def char() -> int:
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "\\":
            c = pattern[pos]
            pos += 1
            if c == "x":
                c, pos = chr(int(pattern[pos:pos + 2], 16)), pos + 2
        return ord(c)

    def atom():
        nonlocal pos
        if peek() == "(":
            pos += 1
            tree = alternation()
            pos += 1
            return tree
        if peek() == "[":
            pos += 1
            negated = peek() == "^"
            pos += negated
            members: set[int] = set()
            while peek() != "]":
                low = char()
                if peek() == "-" and pattern[pos + 1] != "]":
                    pos += 1
                    members.update(range(low, char() + 1))
                else:
                    members.add(low)
            pos += 1
            return "set", frozenset(set(range(256)) - members if negated else members)
        return "set", frozenset([char()])

    def repetition():
        nonlocal pos
        tree = atom()
        while peek() and peek() in "?*+{":
            c = pattern[pos]
            pos += 1
            if c == "{":
                end = pattern.index("}", pos)
                low, _, high = pattern[pos:end].partition(",")
                high = low if "," not in pattern[pos:end] else high
                tree, pos = ("rep", tree, int(low), int(high) if high else None), end + 1
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def alternation():
        nonlocal pos
        options = [[]]
        while peek() and peek() != ")":
            if peek() == "|":
                pos += 1
                options.append([])
            else:
                options[-1].append(repetition())
        return "alt", [("cat", o) for o in options]

    return alternation()


class Dfa:
    """Minimised automaton: ``trans[state, byte]`` and ``accept[state]``, a bit mask of rules.
    State 0 is the start. Accepting states have the highest numbers."""

    def __init__(self, patterns: list[str], reverse: bool = False, unanchored: bool = False):
        nfa, start, final = _Nfa(), None, {}
        start = nfa.state()
        for rule, pattern in enumerate(patterns):
            a, b = nfa.add(_parse(pattern), reverse)
            nfa.eps[start].append(a)
            final[b] = 1 << rule
        trans, accept = self._subsets(nfa, start, final, unanchored)
        self.trans, self.accept = self._minimised(trans, accept)
        self.first_accepting = int((self.accept == 0).sum())

    @staticmethod
    def _subsets(nfa: _Nfa, start: int, final: dict[int, int], unanchored: bool):
        def closure(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        # bytes that no edge tells apart share one column of the construction
        sets = {s for edges in nfa.edges for s, _ in edges}
        groups = defaultdict(list)
        for b in range(256):
            groups[tuple(b in s for s in sets)].append(b)
        classes = list(groups.values())
        first = closure([start])
        index, rows, todo = {first: 0}, [], [first]
        while todo:
            current = todo.pop(0)
            row = np.zeros(256, np.int32)
            for members in classes:
                b = members[0]
                target = {t for s in current for chars, t in nfa.edges[s] if b in chars}
                nxt = closure(target | ({start} if unanchored else set()))
                if nxt not in index:
                    index[nxt] = len(index)
                    todo.append(nxt)
                row[members] = index[nxt]
            rows.append(row)
        masks = [sum(bit for s, bit in final.items() if s in subset) for subset in index]
        return np.array(rows), np.array(masks, np.int64)

    @staticmethod
    def _minimised(trans: np.ndarray, accept: np.ndarray):
        """Moore's partition refinement; classes are then numbered start first, accepting last."""
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            key = np.column_stack([block, block[trans]])
            refined = np.unique(key, axis=0, return_inverse=True)[1].ravel()
            if refined.max() == block.max():
                break
            block = refined
        member = np.zeros(block.max() + 1, np.int64)
        member[block] = np.arange(len(block))
        order = sorted(range(len(member)), key=lambda k: (accept[member[k]] != 0, k != block[0]))
        number = np.zeros(len(order), np.int32)
        number[order] = np.arange(len(order))
        return number[block[trans[member[order]]]], accept[member[order]]


class Scanner:
    """All rules in one byte pass.

    One pass from the last byte to the first drives the minimised automaton of all reversed
    rules; where it accepts, a match of some rule starts. From each start that does not lie in an
    earlier match of its rule, that rule's own automaton reads forward to the longest end. This
    gives leftmost-longest non-overlapping matches per rule.
    """

    def __init__(self, patterns: list[str]):
        starts = Dfa(patterns, reverse=True, unanchored=True)
        # states multiplied by 256, so that one addition finds the next cell
        self.step = (starts.trans.astype(np.int64) * 256).ravel().tolist()
        self.accepting = starts.first_accepting * 256
        self.masks = starts.accept.tolist()
        self.rules = []
        for pattern in patterns:
            dfa = Dfa([pattern])
            dead = {s for s in range(len(dfa.accept))
                    if not dfa.accept[s] and (dfa.trans[s] == s).all()}
            self.rules.append((dfa.trans.tolist(), dfa.first_accepting, dead))

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        step, accepting, state, hits = self.step, self.accepting, 0, []
        position = len(data)
        for byte in data[::-1]:
            state = step[state + byte]
            position -= 1
            if state >= accepting:
                hits.append((position, self.masks[state >> 8]))
        hits.reverse()
        return hits

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in byte offsets, by rule and start."""
        found, hits = [], self.starts(data)
        for rule, (trans, accepting, dead) in enumerate(self.rules):
            end = 0
            for start, mask in hits:
                if start < end or not mask >> rule & 1:
                    continue
                state, at = 0, start
                while at < len(data):
                    state = trans[state][data[at]]
                    if state in dead:
                        break
                    at += 1
                    if state >= accepting:
                        end = at
                found.append((rule, start, end))
        return found
