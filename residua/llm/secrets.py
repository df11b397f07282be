"""Secret scan: one deterministic automaton for all rules, one pass over the bytes.

Every rule is a regular expression over bytes. The rules' position automata are
joined behind one restart loop, determinised by subset construction, minimised by
partition refinement and laid out as one flat transition array. A scan reads each
byte once; where a rule stops accepting, a match of that rule ends, and the rule's
reversed automaton, run back from there to the end of the rule's previous match at
most, gives its leftmost start.

Ends found so are those of leftmost, longest, non-overlapping matches if a rule, once it
has stopped accepting, never accepts the same match again, and if no match of it can end
within the part of another one that comes before that one accepts. Both are checked on
each rule's own automaton when it is compiled; other rules are refused (ValueError).

A private key is found as a whole, header to footer, so that redaction leaves nothing of
it; one whose footer is missing is found up to where its letters end.

Null and empty texts hold no secrets. Rows with equal ids are scanned one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _parser as sre  # the standard library's regex syntax tree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from residua.llm.common import released


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length of the group named v, or of the match where there is none.
    least: int = 0


_VALUE = r"[A-Za-z0-9+/_.=-]"
RULES = (
    Rule("assign", rf"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(?P<v>{_VALUE}+)", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    # Beyond the base: well-known shapes. Each further rule that ends in a repeated class about doubles the states.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("pem_begin", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
)
BASE_KINDS = ("assign", "access", "hex")


class _Nfa:
    """Thompson automaton over bytes; state 0 is the start."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append(None)
        return len(self.empty) - 1

    def build(self, tree, at: int, fold: bool, back: bool) -> int:
        """Add what tree matches, from state at; the state where it ends. back: mirrored."""
        for op, arg in reversed(list(tree)) if back else tree:
            name = str(op)
            if name == "LITERAL":
                codes = {arg}
            elif name == "NOT_LITERAL":
                codes = {arg}
            elif name == "IN":
                codes = set()
                for kind, x in arg:
                    codes |= {"LITERAL": lambda x: {x}, "RANGE": lambda x: set(range(x[0], x[1] + 1)), "NEGATE": lambda x: set()}[str(kind)](x)
            if name in ("LITERAL", "NOT_LITERAL", "IN"):
                if fold:
                    codes |= {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper) if c < 128}
                if name == "NOT_LITERAL" or name == "IN" and str(arg[0][0]) == "NEGATE":
                    codes = set(range(256)) - codes
                to = self.state()
                self.edges[at] = (frozenset(codes), to)
                at = to
            elif name == "SUBPATTERN":
                at = self.build(arg[3], at, fold or bool(arg[1] & re.IGNORECASE), back)
            elif name == "BRANCH":
                end = self.state()
                for option in arg[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.build(option, begin, fold, back)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                least, most, inner = arg
                for _ in range(least):
                    at = self.build(inner, self._fresh(at), fold, back)
                if most is sre.MAXREPEAT:
                    loop = self._fresh(at)
                    end = self.build(inner, loop_in := self._fresh(loop), fold, back)
                    assert loop_in != end
                    self.empty[end].append(loop)
                    at = self._fresh(loop)
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(out)
                        at = self.build(inner, self._fresh(at), fold, back)
                    self.empty[at].append(out)
                    at = out
            else:
                raise ValueError(f"rules can't use {name}")
        return at

    def _fresh(self, at: int) -> int:
        new = self.state()
        self.empty[at].append(new)
        return new

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """next[state * 256 + byte] is the next state times 256; states from `accepting` on accept."""

    next: list[int]
    mask: list[int]
    accepting: int


def _determinise(nfa: _Nfa, start: frozenset[int], ends: dict[int, int], restart: bool) -> tuple[list[list[int]], list[int]]:
    """Subset construction; rows of next states (-1: none) and the mask of accepted rules."""
    number, todo, rows, masks = {start: 0}, [start], [], []
    for subset in todo:
        masks.append(sum({ends[x] for x in subset if x in ends}))
        by_byte: dict[int, set[int]] = {}
        for x in subset:
            if nfa.edges[x]:
                for b in nfa.edges[x][0]:
                    by_byte.setdefault(b, set()).add(nfa.edges[x][1])
        row, memo = [-1] * 256, {}
        for b in range(256):
            to = frozenset(by_byte.get(b, ()))
            if not to and not restart:
                continue
            if to not in memo:
                memo[to] = nfa.closure(to) | (start if restart else frozenset())
            if memo[to] not in number:
                number[memo[to]] = len(todo)
                todo.append(memo[to])
            row[b] = number[memo[to]]
        rows.append(row)
    return rows, masks


def _minimise(rows: list[list[int]], masks: list[int]) -> Dfa:
    """Refine the partition by accepted rules until successors agree; state 0 stays first."""
    block = [sorted(set(masks)).index(m) for m in masks]
    while True:
        keys = [(block[s], *(block[x] if x >= 0 else -1 for x in rows[s])) for s in range(len(rows))]
        names: dict[tuple, int] = {}
        new = [names.setdefault(k, len(names)) for k in keys]
        if len(names) == len(set(block)):
            break
        block = new
    first = {b: s for s, b in reversed(list(enumerate(new)))}
    order = sorted(first, key=lambda b: (masks[first[b]] > 0, b != new[0], b))
    place = {b: i for i, b in enumerate(order)}
    flat = [place[new[x]] * 256 if x >= 0 else -1 for b in order for x in rows[first[b]]]
    mask = [masks[first[b]] for b in order]
    return Dfa(flat, mask, next((i for i, m in enumerate(mask) if m), len(mask)) * 256)


def _tree(rule: Rule):
    return sre.parse(rule.pattern)


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa]]:
    """The automaton of all rules together, and each rule's automaton from its end backwards."""
    nfa, starts, ends = _Nfa(), [], {}
    for k, rule in enumerate(rules):
        starts.append(nfa.state())
        ends[nfa.build(_tree(rule), starts[-1], False, False)] = 1 << k
    joined = _minimise(*_determinise(nfa, nfa.closure(starts), ends, True))
    for rule in rules:
        _check(rule)
    return joined, [_alone(rule, True) for rule in rules]


def _alone(rule: Rule, back: bool) -> Dfa:
    """A rule's own automaton, without a restart; back: from its end."""
    nfa = _Nfa()
    start = nfa.state()
    end = nfa.build(_tree(rule), start, False, back)
    return _minimise(*_determinise(nfa, nfa.closure([start]), {end: 1}, False))


def _check(rule: Rule) -> None:
    """Refuse a rule whose leftmost, longest matches the scan would miss (see the module's docstring)."""
    d = _alone(rule, False)
    states = range(len(d.mask))
    rows = [[x >> 8 if x >= 0 else -1 for x in d.next[s * 256 : s * 256 + 256]] for s in states]
    # Bytes that all states treat alike count once.
    columns = list(dict.fromkeys(zip(*rows)))
    useful = {s for s in states if d.mask[s]}
    while more := {s for s in states if s not in useful and useful & set(rows[s])}:
        useful |= more
    if d.mask[0]:
        raise ValueError(f"rule {rule.kind} matches nothing at all")
    if any(d.mask[s] and x >= 0 and not d.mask[x] and x in useful for s in states for x in rows[s]):
        raise ValueError(f"rule {rule.kind} stops and starts accepting within a match")
    # Of two matches, b begun inside a: does b accept while a has yet to?
    todo = [(c[0], 0) for c in columns if c[0] in useful]
    seen = set(todo)
    for a, b in todo:
        if d.mask[a]:
            continue
        for c in columns:
            if (x := c[a]) not in useful:
                continue
            for pair in {(x, c[b]), (x, 0)}:
                if pair[1] >= 0 and pair not in seen:
                    if d.mask[pair[1]] and not d.mask[x]:
                        raise ValueError(f"rule {rule.kind} can match before another of its matches is complete")
                    seen.add(pair)
                    todo.append(pair)


def scanner(rules: tuple[Rule, ...] = RULES, compiled: tuple[Dfa, list[Dfa]] | None = None) -> Callable[[bytes], list[tuple[int, int, int]]]:
    """A function from bytes to (start, rule index, end), sorted. compiled: what compile_rules gave on the driver."""
    dfa, back = compiled or compile_rules(rules)
    step, mask, accepting = dfa.next, dfa.mask, dfa.accepting
    forms = [re.compile(r.pattern.encode()) for r in rules]

    def start_of(data: bytes, end: int, least: int, rule: int) -> int:
        d, s, found = back[rule], 0, -1
        for i in range(end - 1, least - 1, -1):
            s = d.next[s + data[i]]
            if s < 0:
                break
            if d.mask[s >> 8]:
                found = i
        return found

    def scan(data: bytes) -> list[tuple[int, int, int]]:
        ends, live, s = [], 0, 0
        for i, b in enumerate(data):
            s = step[s + b]
            if s >= accepting or live:
                now = mask[s >> 8]
                if gone := live & ~now:
                    ends.append((i, gone))
                live = now
        if live:
            ends.append((len(data), live))
        out, last = [], [0] * len(rules)
        for end, gone in ends:
            for k, rule in enumerate(rules):
                if gone >> k & 1 and (begin := start_of(data, end, last[k], k)) >= 0:
                    last[k] = end
                    if rule.least:
                        m = forms[k].fullmatch(data, begin, end)
                        size = len(m["v"]) if "v" in forms[k].groupindex else end - begin
                        if size < rule.least:
                            continue
                    out.append((begin, k, end))
        return sorted(out)

    return scan


def spans_in(text: str | None, scan, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the rules' order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scan(data)
    if len(data) == len(text or ""):
        return [(rules[k].kind, a, b) for a, k, b in found]
    at = lambda i: len(data[:i].decode("utf-8", "surrogatepass"))
    return [(rules[k].kind, at(a), at(b)) for a, k, b in found]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `secrets`, an array of (kind, begin, end) in code points, for every row of docs."""

    given = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, given.value)
        for batch in batches:
            found = [[{"kind": k, "begin": a, "end": b} for k, a, b in spans_in(t.as_py(), scan, rules)] for t in batch.column("text")]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, secrets array<struct<kind: string, begin: long, end: long>>")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark (overlapping ones by a single mark); n_chars follows.

    A null text stays null. All columns stay as they are otherwise.
    """

    given = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, given.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text and (found := spans_in(text, scan, rules)):
                    parts, at = [], 0
                    for _, a, b in found:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join([*parts, text[at:]])
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(released(run), StructType([StructField(f.name, f.dataType, True) for f in docs.schema]))


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns: counts of the base kinds, the hash of base spans, all spans."""
    found = scan_secrets(docs, rules)
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    text = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(of(*BASE_KINDS)), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
