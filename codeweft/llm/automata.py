"""Grammar rules to automata, and error-correcting charts over them.

Brackets nest, what stands between them hardly does: after its inner brackets have become cells, the content of a
bracket is a short string over tokens and finished cells. The chart is filled from the innermost bracket out. A cell
holds the set of rules that derive its content without edits, found by one pass over a deterministic automaton of
chart items (place in a rule, rules to return to) that is built as contents need it. Where the set is empty,
:meth:`Dfa.repair` searches the items for the least number of inserted and deleted tokens.

Notation: words are tokens or rules; ``[ x ]`` optional; ``{ x }`` any number; ``( x / y )`` one of; ``P:args`` a round
bracket whose content is by rule args, ``S:`` square, ``B:`` curly or indented, ``P:*`` any content.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

#: Cells: a base for each kind of bracket; below it one bit for each rule.
CELL = {"P": 0xE000, "S": 0xE400, "B": 0xE800}
BITS = 10
#: Chart items that one repair looks at before it gives the window up as deleted, and tokens that must follow a repair.
MOST_ITEMS, AHEAD = 300, 10


def cell(kind: str, bits: int) -> str:
    return chr(CELL[kind] + bits)


def is_cell(c: str) -> bool:
    return 0xE000 <= ord(c) < 0xEC00


class Rules:
    """The rules of one language. ``contents`` names those of each bracket kind, ``symbol`` gives a token's character."""

    def __init__(self, text: str, contents: dict[str, list[str]], symbol: Callable[[str], str], sets: dict[str, str]):
        self.text = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, _, body = line.partition(" = ")
                self.text[name.strip()] = body.split()
        self.contents, self.symbol = contents, symbol
        self.sets = {k: frozenset(symbol(t) for t in v.split()) for k, v in sets.items()}
        self.step: list[list[tuple[object, int]]] = []  # by token or cell
        self.free: list[list[int]] = []
        self.call: list[list[tuple[str, int]]] = []  # rule, place to return to
        self.rule = {name: None for name in self.text}
        for name, words in self.text.items():
            frag, at = self._any(words, 0)
            assert at == len(words), (name, words[at:])
            self.rule[name] = frag
        self.ends = {b for _, b in self.rule.values()}
        self.stacks: list[tuple[int, int]] = [(-1, -1)]  # (place to return to, stack below)
        self.stack_of: dict[tuple[int, int], int] = {}
        self.near: dict[int, tuple] = {}
        self.closed: dict[tuple[int, int], tuple] = {}
        self.moved: dict[tuple[int, str], tuple[int, ...]] = {}
        self.going: dict[tuple[int, int, str], bool] = {}
        self.kinds = {kind: Dfa(self, names) for kind, names in contents.items()}

    def _state(self) -> int:
        self.step.append([])
        self.free.append([])
        self.call.append([])
        return len(self.step) - 1

    def _any(self, w: list[str], at: int) -> tuple[tuple[int, int], int]:
        a, b = self._state(), self._state()
        while True:
            (x, y), at = self._row(w, at)
            self.free[a].append(x)
            self.free[y].append(b)
            if at >= len(w) or w[at] != "/":
                return (a, b), at
            at += 1

    def _row(self, w: list[str], at: int) -> tuple[tuple[int, int], int]:
        first = last = self._state()
        while at < len(w) and w[at] not in ("/", ")", "]", "}"):
            t = w[at]
            if t in ("(", "[", "{"):
                (x, y), at = self._any(w, at + 1)
                self.free[last].append(x)
                last = self._state()
                self.free[y].append(last)
                if t != "(":
                    self.free[x].append(y)
                if t == "{":
                    self.free[y].append(x)
            else:
                before, last = last, self._state()
                if t in self.text and t[0].isupper():  # rules in lower case are contents
                    self.call[before].append((t, last))
                else:
                    self.step[before].append((self._label(t), last))
            at += 1
        return (first, last), at

    def _label(self, t: str) -> object:
        if t in self.sets:
            return self.sets[t]
        if len(t) > 2 and t[1] == ":" and t[0] in "PSB":
            everything = t[2:] == "*"
            return CELL[t[0]], (1 << BITS) - 1 if everything else 1 << self.contents[t[0]].index(t[2:]), everything
        return frozenset(self.symbol(t))

    def push(self, back: int, below: int) -> int:
        key = (back, below)
        k = self.stack_of.get(key)
        if k is None:
            k = self.stack_of[key] = len(self.stacks)
            self.stacks.append(key)
        return k

    def closure(self, item: tuple[int, int]) -> tuple[frozenset[tuple[int, int]], frozenset[int]]:
        """What an item reaches without a token: items with a step, and the ends of rules with nothing to return to.

        A set's closure is the union of its items', so each item's is worked out once.
        """
        known = self.closed.get(item)
        if known is None:
            steps, ends, seen, todo = set(), set(), {item}, [item]
            while todo:
                s, stack = todo.pop()
                near, calls, last = self._near(s)
                for x in near:
                    steps.add((x, stack))
                more = [(to, self.push(back, stack)) for to, back in calls]
                if last and stack:
                    more.append(self.stacks[stack])
                ends.update(last if not stack else ())
                for x in more:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            known = self.closed[item] = frozenset(steps), frozenset(ends)
        return known

    def _near(self, s: int) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...], tuple[int, ...]]:
        """Places with a step, calls (begin of the rule, place to return to) and ends of rules that ``s`` reaches freely."""
        known = self.near.get(s)
        if known is None:
            seen, todo = {s}, [s]
            for x in todo:
                for y in self.free[x]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            calls = {(self.rule[r][0], back) for x in todo for r, back in self.call[x]}
            known = self.near[s] = tuple(x for x in todo if self.step[x]), tuple(sorted(calls)), tuple(x for x in todo if x in self.ends)
        return known

    def goes_on(self, s: int, stack: int, c: str) -> bool:
        """Whether an item or one that it reaches without a token takes ``c``."""
        key = (s, stack, c)
        known = self.going.get(key)
        if known is None:
            known = self.going[key] = any(self.moves(x, c) for x, _ in self.closure((s, stack))[0])
        return known

    def moves(self, s: int, c: str) -> tuple[int, ...]:
        """Where the token or cell ``c`` leads from a place."""
        known = self.moved.get((s, c))
        if known is None:
            known = self.moved[s, c] = tuple(b for label, b in self.step[s] if self.fits(label, c))
        return known

    @staticmethod
    def fits(label, c: str) -> bool:
        if isinstance(label, frozenset):
            return c in label
        code = ord(c) - label[0]
        return 0 <= code < 1 << BITS and (label[2] or bool(code & label[1]))

    @staticmethod
    def sample(label) -> str:
        return min(label) if isinstance(label, frozenset) else chr(label[0] + label[1])


class Dfa:
    """The automaton of one bracket kind's rules, determinized as inputs need it."""

    def __init__(self, rules: Rules, names: list[str]):
        assert len(names) <= BITS
        self.rules, self.names = rules, names
        self.items: list[tuple] = []  # those with a step
        self.known: dict[tuple, int] = {}
        self.table: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.inserts: list[list[str] | None] = []
        self.bridge: dict[tuple[int, str | int], list[str]] = {}
        self.start = self._add({(rules.rule[n][0], 0) for n in names})

    def _add(self, items) -> int:
        r = self.rules
        parts = [r.closure(x) for x in items]
        ends = frozenset().union(*(p[1] for p in parts))
        bits = sum(1 << k for k, n in enumerate(self.names) if r.rule[n][1] in ends)
        key = (frozenset().union(*(p[0] for p in parts)), bits)
        k = self.known.get(key)
        if k is None:
            k = self.known[key] = len(self.items)
            self.items.append(tuple(key[0]))
            self.table.append({})
            self.accept.append(bits)
            self.inserts.append(None)
        return k

    def next(self, k: int, c: str) -> int:
        """-1 where no rule goes on."""
        to = self.table[k].get(c)
        if to is None:
            moves = self.rules.moves
            got = {(b, stack) for s, stack in self.items[k] for b in moves(s, c)}
            to = self.table[k][c] = self._add(got) if got else -1
        return to

    def run(self, text: str) -> tuple[int, int]:
        """(bits of the rules that derive ``text``, place of the first token that no rule goes on with or -1)."""
        k, table = self.start, self.table
        for at, c in enumerate(text):
            n = table[k].get(c)
            if n is None:
                n = self.next(k, c)
            if n < 0:
                return 0, at
            k = n
        return self.accept[k], -1

    def _inserts(self, k: int) -> list[str]:
        known = self.inserts[k]
        if known is None:
            r = self.rules
            known = self.inserts[k] = sorted({r.sample(label) for s, _ in self.items[k] for label, _ in r.step[s]})
        return known

    def _bridges(self, k: int, c: str, bits: int) -> list[str]:
        """The tokens that, inserted, let ``c`` follow, or a rule of ``bits`` end if ``c`` is ''."""
        key = (k, c or bits)
        known = self.bridge.get(key)
        if known is None:
            r, found = self.rules, set()
            ends = {r.rule[n][1] for i, n in enumerate(self.names) if bits >> i & 1}
            for s, stack in self.items[k]:
                for label, b in r.step[s]:
                    if r.goes_on(b, stack, c) if c else r.closure((b, stack))[1] & ends:
                        found.add(r.sample(label))
            known = self.bridge[key] = sorted(found)
        return known

    def repair(self, text: str, bits: int, most: int = 4) -> list[tuple[str, int]]:
        """Edits (kind, place) that let a rule of ``bits`` derive ``text``; none exactly if one does as it is.

        Around each failure the chart items from the last statement's end on are searched by number of edits, least
        first, until a way has read AHEAD tokens beyond the failure or ended well. Where ``most`` edits don't do, the
        tokens up to there are deleted.
        """
        sync = self.rules.sets["SYNC"]
        edits: list[tuple[str, int]] = []
        at, k, n = 0, self.start, len(text)
        back = (0, k)
        while True:
            while at < n and (to := self.next(k, text[at])) >= 0:
                k, at = to, at + 1
                if text[at - 1] in sync or is_cell(text[at - 1]) and text[at - 1] >= chr(CELL["B"]):
                    back = (at, k)
            if at >= n and self.accept[k] & bits:
                return edits
            found = self._search(text, back, at, bits, most)
            if found is None:
                end = min(n, at + 1)
                while end < n and text[end - 1] not in sync:
                    end += 1
                edits += [("delete", x) for x in range(back[0], end)] or [("insert", n)]
                at, k = end, back[1]
                if at >= n:
                    return edits
            else:
                way, at, k = found
                edits += way
            back = (at, k)

    def _search(self, text: str, back: tuple[int, int], fail: int, bits: int, most: int):
        """Least edits first: tokens are deleted, or one or two inserted such that the next one, or the end, can follow."""
        n, goal = len(text), min(len(text), fail + AHEAD)
        queue = [(0, -back[0], back[1], (), 0)]
        seen: set[tuple[int, int]] = set()
        while queue:
            cost, minus, k, way, pair = heapq.heappop(queue)
            at = -minus
            here = text[at] if at < n else ""
            if pair:
                firsts = self._inserts(k)
            else:
                if (at, k) in seen:
                    continue
                seen.add((at, k))
                if at >= goal and (at < n or self.accept[k] & bits):
                    return way, at, k
                if len(seen) > MOST_ITEMS:
                    return None
                if here and (to := self.next(k, here)) >= 0:
                    heapq.heappush(queue, (cost, -at - 1, to, way, 0))
                if here and cost < most:
                    heapq.heappush(queue, (cost + 1, -at - 1, k, (*way, ("delete", at)), 0))
                if cost + 2 <= most:
                    heapq.heappush(queue, (cost + 2, -at, k, way, 1))
                if cost >= most:
                    continue
                firsts = (None,)
            for first in firsts:
                k1 = k if first is None else self.next(k, first)
                done = way if first is None else (*way, ("insert", at))
                for c in self._bridges(k1, here, bits):
                    to = self.next(k1, c)
                    if here:
                        to = self.next(to, here)
                    heapq.heappush(queue, (cost + (first is None), -at - bool(here), to, (*done, ("insert", at)), 0))
        return None
