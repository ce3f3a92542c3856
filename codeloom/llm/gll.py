"""A generalised LL parser with a graph-structured stack and least-cost recovery.

Descriptors (grammar slot, stack node, position) are processed in order of the cost
spent so far, so the first derivation that spans the input is a cheapest one. Calls of
one nonterminal at one position share a stack node; its results are kept and replayed
for later callers, which gives all derivations of ambiguous and left-recursive grammars
in polynomial time. One token of lookahead keeps slots that cannot go on from being
scheduled. What the marked terminals matched is carried as a rope and flattened once, so a list
of n items costs n steps where each item has a bounded number of ends.

Symbols of a rule:

* a key of the grammar: a nonterminal;
* ``x`` or ``xname``: the token ``x``; with a name the derivation carries (name, position);
* ``[xyz]`` or ``[xyz]name``: any one of these tokens;
* ``?n``, ``?n:xyz``: any one token, or one of these, skipped at cost n;
* ``!n:xyz``: nothing, at cost n, where one of these tokens or the end follows: a missing token is put in.
"""

from __future__ import annotations

import heapq

Grammar = dict[str, list[tuple[str, ...]]]


class Parser:
    """A grammar prepared for parsing."""

    def __init__(self, grammar: Grammar, start: str):
        self.start = start
        names = list(grammar)
        self._id = {n: i for i, n in enumerate(names)}
        first: dict[str, set] = {n: set() for n in names}
        empty = {n: False for n in names}
        changed = True
        while changed:
            changed = False
            for n in names:
                for rule in grammar[n]:
                    got, void = self._first(rule, grammar, first, empty)
                    if not got <= first[n] or (void and not empty[n]):
                        first[n] |= got
                        empty[n] = empty[n] or void
                        changed = True
        # slots are numbered; each has what it does next and which tokens may follow at once
        self.rules: dict[str, list[int]] = {}
        self.step: list[tuple] = []
        for n in names:
            self.rules[n] = []
            for rule in grammar[n]:
                self.rules[n].append(len(self.step))
                for dot in range(len(rule) + 1):
                    got, void = self._first(rule[dot:], grammar, first, empty)
                    allowed = None if void or None in got else frozenset(got)
                    self.step.append((self._action(rule[dot], grammar) if dot < len(rule) else ("end",), allowed))

    @staticmethod
    def _set(x: str) -> tuple[str, str]:
        if x[0] == "[" and "]" in x[1:]:
            at = x.index("]", 2)
            return x[1:at], x[at + 1 :]
        return x[0], x[1:]

    def _first(self, symbols, grammar, first, empty) -> tuple[set, bool]:
        out: set = set()
        for x in symbols:
            if x in grammar:
                out |= first[x]
                if not empty[x]:
                    return out, False
            elif x[0] == "!" and len(x) > 1:
                out |= set(x.split(":", 1)[1]) | {None}
                return out, False
            elif x[0] == "?":
                return out | (set(x.split(":", 1)[1]) if ":" in x else {None}), False
            else:
                return out | set(self._set(x)[0]), False
        return out, True

    def _action(self, x: str, grammar: Grammar) -> tuple:
        if x in grammar:
            return ("call", x)
        if x[0] == "?":
            cost, _, some = x[1:].partition(":")
            return ("skip", int(cost or 1), frozenset(some))
        if x[0] == "!" and len(x) > 1:
            cost, ahead = x[1:].split(":", 1)
            return ("put", int(cost), frozenset(ahead))
        tokens, name = self._set(x)
        return ("take", frozenset(tokens), name)

    def parse(self, tokens: str) -> tuple[int, tuple] | None:
        """(cost, marks) of a cheapest derivation of ``tokens`` (one character a token); None if there is none."""
        n, order = len(tokens), 0
        step, rules = self.step, self.rules
        heap: list = []
        seen: set = set()
        stack: dict[tuple, list] = {}  # stack node -> edges (slot, caller, value, cost)
        popped: dict[tuple, dict[int, tuple]] = {}  # stack node -> end -> (value, cost)
        entry: dict[tuple, int] = {}
        push, pop = heapq.heappush, heapq.heappop
        root = (self.start, 0)
        stack[root], popped[root], entry[root] = [], {}, 0
        for slot in rules[self.start]:
            allowed = step[slot][1]
            if allowed is None or (n and tokens[0] in allowed):
                order += 1
                push(heap, (0, 0, order, slot, root, 0, None))
        while heap:
            cost, _, _, slot, node, at, value = pop(heap)
            key = (slot, node, at)
            if key in seen:
                continue
            seen.add(key)
            action = step[slot][0]
            kind = action[0]
            todo = ()
            if kind == "take":
                if at < n and tokens[at] in action[1]:
                    todo = ((cost, slot + 1, node, at + 1, (value, (action[2], at)) if action[2] else value),)
            elif kind == "end":
                ends = popped[node]
                if at in ends:
                    continue
                spent = cost - entry[node]
                ends[at] = (value, spent)
                if node == root and at == n:
                    return cost, _flat(value)
                todo = [(paid + spent, ret, caller, at, (before, value) if value is not None else before) for ret, caller, before, paid in stack[node]]
            elif kind == "call":
                callee = (action[1], at)
                edge = (slot + 1, node, value, cost)
                if callee in stack:
                    stack[callee].append(edge)
                    todo = [(cost + c, slot + 1, node, end, (value, v) if v is not None else value) for end, (v, c) in popped[callee].items()]
                else:
                    stack[callee], popped[callee], entry[callee] = [edge], {}, cost
                    todo = [(cost, s, callee, at, None) for s in rules[action[1]]]
            elif kind == "skip":
                if at < n and (not action[2] or tokens[at] in action[2]):
                    todo = ((cost + action[1], slot + 1, node, at + 1, value),)
            elif at >= n or tokens[at] in action[2]:
                todo = ((cost + action[1], slot + 1, node, at, value),)
            for c, s, nd, a, v in todo:
                allowed = step[s][1]
                if (allowed is None or (a < n and tokens[a] in allowed)) and (s, nd, a) not in seen:
                    order += 1
                    push(heap, (c, -a, order, s, nd, a, v))
        return None


def _flat(rope) -> tuple:
    """The marks of a rope from left to right."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if x is None:
            continue
        if isinstance(x[0], str):
            out.append(x)
        else:
            todo += [x[1], x[0]]
    return tuple(out)


def parse(grammar: Grammar, start: str, tokens: str) -> tuple[int, tuple] | None:
    """``Parser(grammar, start).parse(tokens)``."""
    return Parser(grammar, start).parse(tokens)
