"""Secret scans with one combined deterministic automaton.

The beginnings of all rules' matches, expressions of fixed length, become one
NFA over bytes; subset construction and minimisation make it deterministic, and
the result is a transition array over byte classes.  One pass over the bytes,
many stretches in step, gives every place where a match of any rule can begin.
From these places a second automaton of all rules, anchored, reads the ends;
it stops where an earlier walk has shown that nothing more is accepted, so the
work stays in proportion to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches


@dataclass(frozen=True)
class Rule:
    """full: the expression to match, leftmost and longest.  starts: expressions of fixed length, one of which begins every match.

    least: bytes that a match must have after `lead` (an expression for its start) is taken off; shorter ones are dropped.
    """

    kind: str
    full: str
    starts: tuple[str, ...]
    least: int = 0
    lead: str = ""


_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = rf"""(?i:{"|".join(_KEYS)})["']?\x20*[:=]\x20*["']?"""

#: The three base rules, in the order in which ties of spans are listed, then formats that issuers publish.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", tuple(f"(?i:{k})" for k in _KEYS), 6, _ASSIGN),
    Rule("access", "AKIA[A-Z0-9]{16,}", ("AKIA[A-Z0-9]",)),
    Rule("hex", "[0-9a-f]{24,}", ("[0-9a-f]{12}",)),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}", ("gh[opsur]_[A-Za-z0-9]",)),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", ("xox[abprs]-[A-Za-z0-9-]",)),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}", ("AIza[A-Za-z0-9_-]",)),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", ("[rs]k_live_[A-Za-z0-9]",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", ("eyJ[A-Za-z0-9_-]",)),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", ("-----BEGIN [A-Z]",)),
)
BASE = ("assign", "access", "hex")


# --- expression to NFA ------------------------------------------------------------------------


class _Nfa:
    """edges[s]: (set of bytes or None for an empty move, target)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """(start, end) of the pattern: literals, escapes, [classes], groups, (?i:groups), | ? * + {n} {n,} {n,m}."""
        tree, at = self._choice(pattern, 0, False)
        if at != len(pattern):
            raise ValueError(f"unread: {pattern[at:]!r}")
        return self._build(tree)

    def length(self, pattern: str) -> int:
        """The bytes of every match of a pattern of fixed length."""

        def size(tree) -> int:
            if tree[0] == "set":
                return 1
            if tree[0] == "seq":
                return sum(map(size, tree[1]))
            if tree[0] == "or" and len(found := {size(x) for x in tree[1]}) == 1:
                return found.pop()
            if tree[0] == "rep" and tree[2] == tree[3]:
                return tree[2] * size(tree[1])
            raise ValueError(f"not of fixed length: {pattern!r}")

        return size(self._choice(pattern, 0, False)[0])

    def _choice(self, p: str, at: int, fold: bool):
        options = []
        while True:
            items = []
            while at < len(p) and p[at] not in "|)":
                item, at = self._repeat(p, at, fold)
                items.append(item)
            options.append(("seq", items))
            if at < len(p) and p[at] == "|":
                at += 1
                continue
            return ("or", options), at

    def _repeat(self, p: str, at: int, fold: bool):
        item, at = self._atom(p, at, fold)
        while at < len(p) and p[at] in "?*+{":
            if p[at] == "{":
                end = p.index("}", at)
                low, comma, high = p[at + 1 : end].partition(",")
                item, at = ("rep", item, int(low), int(high) if high else (None if comma else int(low))), end + 1
            else:
                item, at = ("rep", item, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[p[at]]), at + 1
        return item, at

    def _atom(self, p: str, at: int, fold: bool):
        if p[at] == "(":
            inner = fold
            at += 1
            if p.startswith("?i:", at):
                inner, at = True, at + 3
            tree, at = self._choice(p, at, inner)
            return tree, at + 1
        if p[at] == "[":
            chosen: set[int] = set()
            at += 1
            while p[at] != "]":
                low, at = self._byte(p, at)
                if p[at] == "-" and p[at + 1] != "]":
                    high, at = self._byte(p, at + 1)
                    chosen |= set(range(low, high + 1))
                else:
                    chosen.add(low)
            return ("set", frozenset(chosen)), at + 1
        b, at = self._byte(p, at)
        both = {ord(chr(b).lower()), ord(chr(b).upper())} if fold and chr(b).isalpha() else {b}
        return ("set", frozenset(both)), at

    @staticmethod
    def _byte(p: str, at: int) -> tuple[int, int]:
        if p[at] != "\\":
            return ord(p[at]), at + 1
        if p[at + 1] == "x":
            return int(p[at + 2 : at + 4], 16), at + 4
        return ord(p[at + 1]), at + 2

    def _build(self, tree) -> tuple[int, int]:
        start, end = self.state(), self.state()
        if tree[0] == "set":
            self.edges[start].append((tree[1], end))
        elif tree[0] == "seq":
            at = start
            for item in tree[1]:
                a, b = self._build(item)
                self.edges[at].append((None, a))
                at = b
            self.edges[at].append((None, end))
        elif tree[0] == "or":
            for item in tree[1]:
                a, b = self._build(item)
                self.edges[start].append((None, a))
                self.edges[b].append((None, end))
        else:
            _, item, low, high = tree
            at = start
            for _ in range(low):
                a, b = self._build(item)
                self.edges[at].append((None, a))
                at = b
            if high is None:
                a, b = self._build(item)
                self.edges[at].append((None, a))
                self.edges[b].append((None, a))
                self.edges[b].append((None, end))
                self.edges[at].append((None, end))
            else:
                for _ in range(high - low):
                    a, b = self._build(item)
                    self.edges[at].append((None, a))
                    self.edges[at].append((None, end))
                    at = b
                self.edges[at].append((None, end))
        return start, end


# --- NFA to minimal DFA -----------------------------------------------------------------------


@dataclass
class Dfa:
    """table[state, class of byte] is the next state; state 0 is the start; sets[accepts[state]] are the patterns it accepts, sets[0] none."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    sets: list[tuple[int, ...]]

    @property
    def dead(self) -> int | None:
        own = np.arange(len(self.table))
        stuck = np.flatnonzero((self.table == own[:, None]).all(axis=1) & (self.accepts == 0))
        return int(stuck[0]) if len(stuck) else None


def compile_patterns(patterns: list[str], anywhere: bool) -> Dfa:
    """One DFA for all patterns; anywhere: a match may start at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for k, p in enumerate(patterns):
        a, b = nfa.add(p)
        nfa.edges[root].append((None, a))
        finals[b] = k
    if anywhere:
        nfa.edges[root].append((frozenset(range(256)), root))
    sets = {s for e in nfa.edges for s, _ in e if s is not None}
    marks: dict[tuple, int] = {}
    classes = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], dtype=np.uint8)
    sample = [int(np.argmax(classes == c)) for c in range(len(marks))]

    def closure(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s, t in nfa.edges[todo.pop()]:
                if s is None and t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(x for x in out if x in finals or any(s is not None for s, _ in nfa.edges[x]))

    first = closure({root})
    number, order, rows = {first: 0}, [first], []
    while len(rows) < len(order):
        now, row = order[len(rows)], []
        for b in sample:
            nxt = closure({t for x in now for s, t in nfa.edges[x] if s is not None and b in s})
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    table = np.array(rows, dtype=np.int32)
    sets: dict[tuple[int, ...], int] = {(): 0}
    accepts = np.array([sets.setdefault(tuple(sorted(finals[x] for x in s if x in finals)), len(sets)) for s in order], dtype=np.int32)
    return _minimal(classes, table, accepts, list(sets))


def _minimal(classes: np.ndarray, table: np.ndarray, accepts: np.ndarray, sets: list[tuple[int, ...]]) -> Dfa:
    """Blocks of states are split by accepted patterns, then by the blocks their moves lead to, until none splits."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    seen: dict[int, int] = {int(block[0]): 0}  # the start keeps number 0
    for b in block.tolist():
        seen.setdefault(b, len(seen))
    name = np.array([seen[b] for b in range(len(seen))])
    at = np.zeros(len(seen), dtype=np.int64)
    at[name[block[::-1]]] = np.arange(len(block))[::-1]
    return Dfa(classes, name[block[table[at]]].astype(np.int32), accepts[at], sets)


# --- scanning ---------------------------------------------------------------------------------

#: Lanes that a batch is cut into, and the bytes of one.
LANES, SHORTEST, LONGEST = 1024, 256, 8192
#: Walks that end so many bytes after their last match are remembered.
TAIL = 8


class Scanner:
    """The automaton of all beginnings, and the anchored one of all rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        starts = [(k, p) for k, r in enumerate(rules) for p in r.starts]
        self.of = np.array([k for k, _ in starts])
        self.size = np.array([_Nfa().length(p) for _, p in starts])
        self.first = compile_patterns([p for _, p in starts], anywhere=True)
        k = self.first.table.shape[1]
        self.flat = (self.first.table * k).ravel().astype(np.int32)
        self.hit = np.repeat(self.first.accepts, k).astype(np.int32)
        whole = compile_patterns([r.full for r in rules], anywhere=False)
        self.whole = whole.classes.tobytes(), whole.table.tolist(), [whole.sets[x] for x in whole.accepts.tolist()], whole.dead
        leads = [compile_patterns([r.lead], anywhere=False) if r.lead else None for r in rules]
        self.leads = [d and (d.classes.tobytes(), d.table.tolist(), (d.accepts != 0).tolist(), d.dead) for d in leads]

    def beginnings(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and rule of all that can begin a match, in order; texts are data[offsets[i]:offsets[i + 1]].

        A state depends on as many bytes as the longest beginning has, so each
        lane reads that many before its own.
        """
        low, high = int(offsets[0]), int(offsets[-1])
        n, back = high - low, int(self.size.max())
        lane = min(max(n // LANES, SHORTEST), LONGEST)
        lanes = -(-n // lane)
        kinds = np.zeros(back + lanes * lane, dtype=np.uint8)
        kinds[back : back + n] = self.first.classes[data[low:high]]
        kinds = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(kinds, back + lane)[::lane].T) if n else np.zeros((0, 0), dtype=np.uint8)
        state, found = np.zeros(lanes, dtype=np.int32), []
        for t in range(len(kinds)):
            state = self.flat.take(state + kinds[t])
            if t >= back:
                sets = self.hit.take(state)
                at = np.flatnonzero(sets)
                if len(at):
                    found.append((at * lane + (t - back + 1), sets[at]))
        ends = np.concatenate([np.zeros(0, dtype=np.int64), *(x for x, _ in found)])
        sets = np.concatenate([np.zeros(0, dtype=np.int64), *(x for _, x in found)])
        rows = [np.zeros((2, 0), dtype=np.int64)]
        for k in np.unique(sets):
            own = ends[sets == k]
            rows += [np.stack([own - self.size[p], np.full(len(own), self.of[p])]) for p in self.first.sets[k]]
        at, rule = np.concatenate(rows, axis=1)
        size = np.concatenate([np.zeros(0, dtype=np.int64), *(np.full((sets == k).sum(), self.size[p]) for k in np.unique(sets) for p in self.first.sets[k])])
        text = np.searchsorted(offsets - low, at, side="right") - 1
        inside = (at >= 0) & (at + size <= n) & (at + size <= (offsets - low)[np.minimum(text + 1, len(offsets) - 1)])
        text, at, rule = text[inside], at[inside], rule[inside]
        order = np.lexsort((rule, at))
        text, at, rule = text[order], at[order], rule[order]
        return text, at - (offsets - low)[text], rule

    def spans(self, text: bytes, begins: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in bytes, by start, then rule; begins: places and rules in order."""
        classes, table, accepts, dead = self.whole
        out, done = [], [0] * len(self.rules)
        trail: np.ndarray | None = None  # states from which nothing more is accepted, by place
        k = 0
        while k < len(begins):
            at, wanted = begins[k][0], set()
            while k < len(begins) and begins[k][0] == at:
                if at >= done[begins[k][1]]:
                    wanted.add(begins[k][1])
                k += 1
            if not wanted:
                continue
            state, ends, last, states = 0, {}, at, []
            for i in range(at, len(text)):
                state = table[state][classes[text[i]]]
                if state == dead or (trail is not None and trail[i] == state):
                    break
                states.append(state)
                if accepts[state]:
                    last = i + 1
                    for rule in accepts[state]:
                        ends[rule] = last
            if at + len(states) - last > TAIL:
                if trail is None:
                    trail = np.full(len(text), -1, dtype=np.int32)
                trail[last : at + len(states)] = states[last - at :]
            for rule in sorted(wanted & ends.keys()):
                done[rule] = end = ends[rule]
                begin = self._lead(rule, text, at, end) if self.leads[rule] else at
                if end - begin >= self.rules[rule].least:
                    out.append((at, rule, end))
        return out

    def _lead(self, rule: int, text: bytes, at: int, most: int) -> int:
        """The end of the longest lead of the match."""
        classes, table, accepts, dead = self.leads[rule]
        state, end = 0, at
        for i in range(at, most):
            state = table[state][classes[text[i]]]
            if state == dead:
                break
            if accepts[state]:
                end = i + 1
        return end


def _scan_batches(scanner: Scanner) -> Callable:
    rules = scanner.rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            n = len(texts)
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if n and texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
            found: list[list[dict]] = [[] for _ in range(n)]
            text, places, which = scanner.beginnings(data, offsets)
            cuts = np.flatnonzero(np.diff(text, prepend=-1, append=n)).tolist() if len(text) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                i = int(text[a])
                own, at, chars = data[offsets[i] : offsets[i + 1]].tobytes(), 0, 0
                for s, k, e in scanner.spans(own, list(zip(places[a:z].tolist(), which[a:z].tolist(), strict=True))):
                    chars += len(own[at:s].decode("utf-8", "replace"))
                    at = s
                    found[i].append({"kind": rules[k].kind, "start": chars, "end": chars + len(own[s:e].decode("utf-8", "replace"))})
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col and spans (kind, start, end in code points, end exclusive; by start, then rule) per input row.

    Null and empty texts have no spans; null and repeated ids stay rows of their
    own; other input columns are ignored; an empty table gives none; texts are
    read whole, in time that grows with their length.  There may be any number
    of rules.  The automata are compiled once, on the driver, and their arrays
    sent along.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .mapInArrow(releasing(_scan_batches(Scanner(rules))), f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
        .select(F.col("id").alias(id_col), "spans")
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    """As the query forms it: the SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
