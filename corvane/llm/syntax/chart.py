"""An error-correcting chart over bracketed spans.

A language is a set of rules with regular right-hand sides over one-character symbols: a symbol stands for a token, or for
a bracketed span by the roles it can play (block, arguments, object, ...). The chart is filled from the innermost spans
outwards; the cell of a span holds the roles it derives and their least repair cost. The right-hand sides are regular, so
the cost of a span is a shortest path through position x state: match 0, and 1 for a token dropped, added or replaced.
Cells are looked up by their symbols: equal spans of any file are derived once.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

try:
    from re import _constants as sre, _parser as parser
except ImportError:  # older layouts
    import sre_constants as sre
    import sre_parse as parser

SPAN = 0xE000  # private characters from here on stand for spans: SPAN + role bits


def span(bits: int) -> str:
    return chr(SPAN + bits)


def having(bit: int, bits: int) -> str:
    """A character class of all spans that can play a role."""
    return "[" + "".join(re.escape(span(m)) for m in range(1 << bits) if m >> bit & 1) + "]"


def fill(pattern: str, parts: dict[str, str]) -> str:
    """Replace «NAME» by the named parts, themselves filled."""
    for _ in range(40):
        filled = re.sub(r"«(\w+)»", lambda m: "(?:" + parts[m[1]] + ")", pattern)
        if filled == pattern:
            return re.sub(r"\s+", "", filled)
        pattern = filled
    raise ValueError("parts are nested in a circle")


class Rule:
    """A regular right-hand side: recognised at once, repaired at least cost."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.whole = re.compile(pattern)
        self.known: dict[str, bool] = {}
        self.graph: list[list[tuple]] | None = None

    def fits(self, symbols: str) -> bool:
        known = self.known.get(symbols)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[symbols] = self.whole.fullmatch(symbols) is not None
        return known

    def nfa(self) -> tuple[list[list[tuple]], int]:
        """States with (None, to) and (set of characters, to) steps; start is 0."""
        if self.graph is None:
            steps: list[list[tuple]] = [[]]

            def new() -> int:
                steps.append([])
                return len(steps) - 1

            def build(tree, at: int) -> int:
                for op, arg in tree:
                    if op in (sre.LITERAL, sre.NOT_LITERAL):
                        to = new()
                        steps[at].append((frozenset([chr(arg)]), to))
                        at = to
                    elif op is sre.IN:
                        chars = set()
                        for kind, value in arg:
                            if kind is sre.LITERAL:
                                chars.add(chr(value))
                            elif kind is sre.RANGE:
                                chars.update(map(chr, range(value[0], value[1] + 1)))
                        to = new()
                        steps[at].append((frozenset(chars), to))
                        at = to
                    elif op is sre.BRANCH:
                        end = new()
                        for branch in arg[1]:
                            steps[build(branch, at)].append((None, end))
                        at = end
                    elif op is sre.SUBPATTERN:
                        at = build(arg[-1], at)
                    elif op is sre.ATOMIC_GROUP:
                        at = build(arg, at)
                    elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                        low, high, inner = arg
                        for _ in range(low):
                            at = build(inner, at)
                        if high is sre.MAXREPEAT:
                            loop = new()
                            steps[at].append((None, loop))
                            steps[build(inner, loop)].append((None, loop))
                            end = new()
                            steps[loop].append((None, end))
                            at = end
                        else:
                            end = new()
                            for _ in range(high - low):
                                steps[at].append((None, end))
                                at = build(inner, at)
                            steps[at].append((None, end))
                            at = end
                return at

            last = build(parser.parse(self.pattern), 0)
            self.graph, self.last = steps, last
        return self.graph, self.last

    def cost(self, symbols: str, most: int = 8) -> tuple[int, int]:
        """(least number of edits, position of the first of them); most if it takes that many or more."""
        if self.fits(symbols):
            return 0, -1
        steps, last = self.nfa()
        n = len(symbols)
        queue, done = [(0, 0, 0, -1)], {}
        while queue:
            cost, back, state, first = heapq.heappop(queue)
            at = -back
            if (at, state) in done:
                continue
            done[at, state] = cost
            if at == n and state == last:
                return cost, first
            if cost >= most or len(done) > 60_000:
                return most, max(first, 0)
            here = first if first >= 0 else at
            if at < n:
                heapq.heappush(queue, (cost + 1, back - 1, state, here))
            for chars, to in steps[state]:
                if chars is None:
                    heapq.heappush(queue, (cost, back, to, first))
                else:
                    heapq.heappush(queue, (cost + 1, back, to, here))
                    if at < n:
                        same = symbols[at] in chars
                        heapq.heappush(queue, (cost + (not same), back - 1, to, first if same else here))
        return most, 0


class Choice:
    """Alternatives, each a head and, after what the head matches, the rest by another rule."""

    def __init__(self, *options: tuple[str, "Rule | Choice | None"]):
        self.options = [(Rule(head), tail) for head, tail in options]
        self.known: dict[str, bool] = {}

    def fits(self, symbols: str) -> bool:
        known = self.known.get(symbols)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[symbols] = any(self.option(head, tail, symbols) for head, tail in self.options)
        return known

    @staticmethod
    def option(head: Rule, tail, symbols: str) -> bool:
        if tail is None:
            return head.whole.fullmatch(symbols) is not None
        m = head.whole.match(symbols)
        return m is not None and tail.fits(symbols[m.end() :])

    def cost(self, symbols: str, most: int = 8) -> tuple[int, int]:
        best = (most, 0)
        for head, tail in self.options:
            m = head.whole.match(symbols) if tail is not None else None
            if m is not None:
                cost, first = tail.cost(symbols[m.end() :], most)
                best = min(best, (cost, first + m.end() if first >= 0 else first))
            elif tail is None:
                best = min(best, head.cost(symbols, most))
        return best


@lru_cache(maxsize=64)
def lexer(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.VERBOSE | re.DOTALL)
