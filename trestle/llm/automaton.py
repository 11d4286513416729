"""Regular expressions over bytes, compiled to minimal deterministic automata.

The dialect: literals, ``\\`` escapes, ``.``, classes, groups, ``|`` and the
greedy repetitions ``? * + {m} {m,} {m,n}``. No anchors, look-around or back
references.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))
_ESCAPES = {"n": {10}, "t": {9}, "r": {13}, "f": {12}, "d": set(range(48, 58)), "s": {9, 10, 12, 13, 32}, "w": {95, *range(48, 58), *range(65, 91), *range(97, 123)}}


class _Parser:
    def __init__(self, pattern: str):
        if not pattern.isascii():
            raise ValueError("patterns are ASCII")
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} of {self.p!r}")
        return node

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("cat", items)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (None, None))
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                self.i = end + 1
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            node = ("rep", node, low, high)
        return node

    def escape(self) -> set[int]:
        c = self.take()
        if c.isalnum() and c not in _ESCAPES:
            raise ValueError(f"escape \\{c} isn't supported")
        return _ESCAPES.get(c, {ord(c)})

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            if not self.peek():
                raise ValueError("group isn't closed")
            self.take()
            return node
        if c == "[":
            return ("set", self.bracket())
        if c == "\\":
            return ("set", frozenset(self.escape()))
        if c in "^$?*+{":
            raise ValueError(f"{c!r} isn't supported here")
        return ("set", ALL - {10} if c == "." else frozenset({ord(c)}))

    def bracket(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            one = self.escape() if (c := self.take()) == "\\" else {ord(c)}
            if self.peek() == "-" and self.p[self.i + 1] != "]" and len(one) == 1:
                self.take()
                top = self.escape() if (c := self.take()) == "\\" else {ord(c)}
                one = set(range(min(one), max(top) + 1))
            found |= one
        self.take()
        return ALL - found if negated else frozenset(found)


def parse(pattern: str):
    """Syntax tree of a pattern."""
    return _Parser(pattern).parse()


def reverse(node):
    """The tree that matches the same strings backwards."""
    if node[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self):
        self.step: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append(None)
        self.free.append([])
        return len(self.step) - 1

    def build(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.free[start].append(mid)
            self.step[mid] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.build(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(x, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """Transition arrays: ``table[state * 256 + byte]`` is the next state times 256.

    States from ``first_accept`` on accept; ``accepts[state]`` has a bit for each
    pattern that ends there; ``dead`` is the state without a way out, or -1.
    """

    table: np.ndarray
    accepts: np.ndarray
    start: int
    first_accept: int
    dead: int


def compile_patterns(patterns: list[str], anchored: bool = False, backwards: bool = False, guards: list[str] | None = None, most_states: int = 20_000) -> Automaton:
    """One automaton for all patterns: subset construction, then minimisation.

    Without ``anchored`` a match may begin at any byte, or, where ``guards`` has a
    class for the pattern, only at the start or after a byte outside that class.
    ``backwards`` reads the bytes from last to first. A pattern that matches the
    empty string is refused, and so are patterns that need over ``most_states``.
    """
    nfa = _Nfa()
    starts, always, finals = [], [], {}
    for k, pattern in enumerate(patterns):
        tree = reverse(parse(pattern)) if backwards else parse(pattern)
        starts.append(nfa.state())
        finals[nfa.build(tree, starts[-1])] = k
        always.append(starts[-1])
        if guards and guards[k]:
            always[-1] = nfa.state()
            nfa.step[always[-1]] = (ALL - parse(guards[k])[1][0][1], starts[-1])
    first = nfa.closure(starts + always)
    restart = set() if anchored else set(nfa.closure(always))
    if first & finals.keys():
        raise ValueError("a pattern matches the empty string")
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)], dtype=np.uint8)
    _, samples, byte_class = np.unique(member, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    ids, order, rows = {first: 0}, [first], []
    closures: dict[int, frozenset[int]] = {}
    for current in order:
        moves = [nfa.step[s] for s in current if nfa.step[s]]
        row = []
        for sample in samples.tolist():
            target: set[int] = set(restart)
            for allowed, to in moves:
                if sample in allowed:
                    if to not in closures:
                        closures[to] = nfa.closure([to])
                    target |= closures[to]
            key = frozenset(target)
            if key not in ids:
                ids[key] = len(order)
                order.append(key)
            row.append(ids[key])
        rows.append(row)
        if len(order) > most_states:
            raise ValueError(f"the patterns need more than {most_states} states")
    step = np.array(rows, dtype=np.int64)
    masks = np.array([sum(1 << finals[s] for s in states & finals.keys()) for states in order], dtype=np.int64)
    # Moore's refinement: split blocks until their successors agree.
    block = np.unique(masks, return_inverse=True)[1].reshape(-1)
    while True:
        split = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if split.max() == block.max():
            break
        block = split
    representative = np.unique(block, return_index=True)[1]
    step, masks, start = block[step[representative]], masks[representative], block[0]
    by_accept = np.argsort(masks != 0, kind="stable")
    rank = np.empty_like(by_accept)
    rank[by_accept] = np.arange(len(by_accept))
    step, masks = rank[step[by_accept]], masks[by_accept]
    first_accept = int((masks == 0).sum())
    dead = [s for s in range(first_accept) if (step[s] == s).all()]
    full = (step[:, byte_class] * 256).astype(np.int32)
    return Automaton(full.reshape(-1), masks, int(rank[start]), first_accept, dead[0] if anchored and dead else -1)


SEGMENT, WARM_UP = 4096, 128


def _run(a: Automaton, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, record: np.ndarray):
    """Drive all lanes at once. Returns final states, entry states (at ``record``) and hits (lane, end position, accept mask)."""
    order = np.argsort(begin - end, kind="stable")
    pos, until, st, rec = begin[order], end[order], state[order].astype(np.int32) * 256, record[order]
    length = until - pos
    entry = st.copy()
    hits_lane, hits_pos, hits_mask = [], [], []
    bar = a.first_accept * 256
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), side="left") if steps else []
    warm = int((rec - pos).max()) if len(rec) else 0
    for t in range(steps):
        n = alive[t]
        if t <= warm:
            due = rec[:n] == pos[:n]
            np.copyto(entry[:n], st[:n], where=due)
        cur = st[:n]
        cur += buf.take(pos[:n])
        a.table.take(cur, out=cur, mode="clip")
        pos[:n] += 1
        if cur.max() >= bar:
            at = np.flatnonzero(cur >= bar)
            hits_lane.append(order[at])
            hits_pos.append(pos[at])
            hits_mask.append(a.accepts[cur[at] >> 8])
    late = rec >= until
    entry[late] = st[late]
    final, first = np.empty_like(st), np.empty_like(st)
    final[order], first[order] = st >> 8, entry >> 8
    if hits_lane:
        return final, first, np.concatenate(hits_lane), np.concatenate(hits_pos), np.concatenate(hits_mask)
    none = np.zeros(0, np.int64)
    return final, first, none, none, none


def scan(a: Automaton, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bit mask of the patterns that occur in each text ``buf[starts[i]:ends[i]]``.

    A text is cut into segments that run side by side. A segment starts a little
    early to reach its true state; wherever that state differs from the one in
    which the segment before it ended, it is run again from there, so that the
    result is that of a single pass over the whole text.
    """
    found = np.zeros(len(starts), np.int64)
    lengths = ends - starts
    pieces = -(-lengths // SEGMENT)
    if not pieces.sum():
        return found
    doc = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    own = starts[doc] + nth * SEGMENT
    until = np.minimum(own + SEGMENT, ends[doc])
    begin = np.maximum(own - WARM_UP, starts[doc])
    state = np.full(len(doc), a.start)
    final, entry, lane, pos, mask = _run(a, buf, begin, until, state, own)
    settled = entry.copy()
    hits = [(lane, pos, mask)]
    while True:
        true = np.where(nth > 0, np.roll(final, 1), a.start)
        wrong = np.flatnonzero(settled != true)
        if not len(wrong):
            break
        settled[wrong] = true[wrong]
        again, _, lane, pos, mask = _run(a, buf, own[wrong], until[wrong], true[wrong], own[wrong])
        final[wrong] = again
        stale = np.zeros(len(doc), bool)
        stale[wrong] = True
        hits = [(x[~stale[x]], y[~stale[x]], z[~stale[x]]) for x, y, z in hits]
        hits.append((wrong[lane], pos, mask))
    for lane, pos, mask in hits:
        inside = pos > own[lane]
        np.bitwise_or.at(found, doc[lane[inside]], mask[inside])
    return found


class SpanFinder:
    """Leftmost-longest, non-overlapping spans of one pattern in a text.

    With a guard, the byte before a span is outside the guard's class and no part
    of the span before it.
    """

    def __init__(self, pattern: str, guard: str = ""):
        self.guard = parse(guard)[1][0][1] if guard else frozenset()
        back = compile_patterns([pattern], backwards=True)
        ahead = compile_patterns([pattern], anchored=True)
        self.back = (back.table.tolist(), back.start * 256, back.first_accept * 256)
        self.ahead = (ahead.table.tolist(), ahead.start * 256, ahead.first_accept * 256, ahead.dead * 256)

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        table, state, bar = self.back
        begins = []
        for i in range(len(text) - 1, -1, -1):
            state = table[state + text[i]]
            if state >= bar:
                begins.append(i)
        out, free = [], 0
        table, start, bar, dead = self.ahead
        for s in reversed(begins):
            if s < free or s and self.guard and (text[s - 1] in self.guard or s == free):
                continue
            state, e = start, -1
            for i in range(s, len(text)):
                state = table[state + text[i]]
                if state >= bar:
                    e = i + 1
                elif state == dead:
                    break
            if e > 0:
                out.append((s, e))
                free = e
        return out
