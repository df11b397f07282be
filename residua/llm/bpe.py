"""Byte-pair encoding by per-prefix dynamic programming, decoding, and token counts.

Both operators take the path of a public tokenizer file (tokenizers' JSON form) and
never copy it. Null texts count as empty; repeated rows are handled one by one.

Encoding. For every prefix of a word exactly one vocabulary entry can be the last
token of that prefix's encoding. A suffix automaton over the vocabulary yields, at each
position, the entries that are suffixes of the prefix, longest first; an entry is the
last token if it goes with the last token of the prefix before it, that is if no merge
across the border of the two would come before the merges that build them. Back-pointers
from the end of the word then give the exact ids, with no merge loop.

Counting. A vocabulary entry that encodes alone as itself is proved such once, when
the tables are built; a pre-token equal to one counts 1. The others are merged.

What a worker remembers of words it has seen is bounded (Memo), texts are taken in steps
of about a megabyte, and a longer text goes through one pre-token at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from residua.llm.common import released, steps

#: Distinct pre-tokens in each of the two halves of a worker's memory (about 200 bytes each), and pairs of tokens (about 100).
MEMO, PAIRS = 300_000, 250_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64
#: Texts of more characters are cut into pre-tokens one at a time.
LONG_TEXT = 1 << 20
#: Stands for the end-of-word mark in an entry (the byte alphabet below has no such character).
_END = "\ue000"
#: The same as a symbol of the automaton, next to the 256 bytes.
_END_SYMBOL = 256
_INF = 1 << 60


class Memo(dict):
    """Remembers make(key). When `room` keys are in, they become the older half; keys of the older half that are used again stay."""

    def __init__(self, make: Callable, room: int = 0):
        super().__init__()
        self.make, self.room, self.older = make, room or MEMO, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > MEMO_CHARS:
                return value
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The printable character of each byte: visible Latin-1 stands for itself, the rest follow U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


_BYTES = byte_alphabet()


class Vocabulary:
    """Entries, merge ranks and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {self._own(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = (self._own(x) for x in (m.split(" ") if isinstance(m, str) else m))
            whole = a + b
            if a in self.ids and b in self.ids and whole in self.ids:
                self.rank.setdefault((self.ids[a], self.ids[b]), (k, self.ids[whole]))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: What every special string begins with: a text without it holds none.
        self.mark = os.path.commonprefix(list(self.special))

    def _own(self, t: str) -> str:
        return t[: -len(self.end)] + _END if self.end and t.endswith(self.end) else t

    def symbols(self, word: str) -> list[int]:
        """Ids of the single symbols of a pre-token; the last carries the end-of-word mark if there is one."""
        chars = [_BYTES[b] for b in word.encode("utf-8", "surrogatepass")]
        if self.end:
            chars[-1] += _END
        return [self.ids[c] for c in chars]

    def merged(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost among equals, until no pair merges."""
        n, rank = len(symbols), self.rank
        if n <= 48:
            return self._merged_short(list(symbols))
        ids, nxt, prev = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, whole, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = whole, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for left in (prev[i], i):
                if left >= 0 and nxt[left] >= 0 and (p := (ids[left], ids[nxt[left]])) in rank:
                    heapq.heappush(heap, (*rank[p], left, *p))
        return [x for x in ids if x >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        """The same for a word of a few symbols, where looking at all ranks is cheaper than a heap."""
        get, none = self.rank.get, (_INF, -1)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least[0] == _INF:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [least[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids


class SuffixAutomaton:
    """All substrings of many strings, and which of the strings are suffixes of what has been read.

    A state stands for the substrings that end at the same places of the strings; `length`
    is its longest one's, and its link leads to the longest suffix that ends at more places.
    Reading keeps the longest suffix of what has been read that is a substring of a string:
    a state and how many symbols of it are read. A string is the longest substring of its
    state, as nothing stands before its own beginning, so the strings that are suffixes are
    those of the states along the links, and the state's own one if all of it is read.
    """

    def __init__(self, entries: Iterable[tuple[list[int], int]]):
        """entries: symbols (0 to 511) and the number that stands for them."""
        out: list[dict[int, int]] = [{}]
        length, link, own = [0], [-1], [-1]

        def copied(p: int, c: int, q: int) -> int:
            """q's part of the strings that end with p and then c, as a state of its own."""
            new = len(out)
            out.append(dict(out[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            own.append(-1)
            while p >= 0 and out[p].get(c) == q:
                out[p][c] = new
                p = link[p]
            link[q] = new
            return new

        for symbols, name in entries:
            last = 0
            for c in symbols:
                q = out[last].get(c)
                if q is not None:  # known from an earlier string
                    last = q if length[q] == length[last] + 1 else copied(last, c, q)
                    continue
                new = len(out)
                out.append({})
                length.append(length[last] + 1)
                link.append(0)
                own.append(-1)
                p = last
                while p >= 0 and c not in out[p]:
                    out[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = out[p][c]
                    link[new] = q if length[q] == length[p] + 1 else copied(p, c, q)
                last = new
            own[last] = name
        link[0] = 0
        found: list[tuple[tuple[int, int], ...]] = [()] * len(out)
        for k in sorted(range(1, len(out)), key=length.__getitem__):
            found[k] = ((own[k], length[k]), *found[link[k]]) if own[k] >= 0 else found[link[k]]
        #: Steps by state and symbol; lengths, links and the strings at and above each state, longest first.
        self.step = {k << 9 | c: to for k, steps_ in enumerate(out) for c, to in steps_.items()}
        self.length, self.link, self.found = length, link, found

    def after(self, state: int, read: int, symbol: int) -> tuple[int, int]:
        """The state and how much of it is read, one symbol later."""
        get = self.step.get
        while (to := get(state << 9 | symbol)) is None and state:
            state = self.link[state]
            read = self.length[state]
        return (0, 0) if to is None else (to, read + 1)

    def suffixes(self, state: int, read: int) -> tuple[tuple[int, int], ...]:
        """Strings (number, length) that are suffixes of what has been read, longest first."""
        return self.found[state if read == self.length[state] else self.link[state]]


class PrefixEncoder:
    """Exact encoding of one pre-token at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        #: How each entry is built: (rank, left part, right part); single symbols have none.
        self.built: dict[int, tuple[int, int, int]] = {}
        for (a, b), (k, whole) in v.rank.items():
            if whole not in self.built or k < self.built[whole][0]:
                self.built[whole] = (k, a, b)
        self.good: dict[int, bool] = {}
        single = {i for t, i in v.ids.items() if len(t.rstrip(_END)) <= 1}
        code = {c: b for b, c in enumerate(_BYTES)} | {_END: _END_SYMBOL}
        self.automaton = SuffixAutomaton(([code[c] for c in text], i) for text, i in v.ids.items() if i in single or i in self.built and self._alone(i))
        self.pairs = Memo(lambda key: self._first_across(key >> 20, key & 0xFFFFF) is None, PAIRS)

    def _alone(self, i: int) -> bool:
        """Does the entry's text encode as the entry? Its two parts must, and must not be split by an earlier merge."""
        if i not in self.built:
            return True
        if i not in self.good:
            rank, a, b = self.built[i]
            self.good[i] = self._alone(a) and self._alone(b) and self._first_across(a, b) == (rank, i)
        return self.good[i]

    def _spine(self, i: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's right (0) or left (1) border over time: (id, rank of the merge that ends it)."""
        out, until, built = [], _INF, self.built
        while True:
            out.append((i, until))
            if i not in built:
                return out[::-1]
            until, a, b = built[i]
            i = a if side else b

    def _first_across(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge across the border of tokens a and b, if one comes before both are whole; else what merges them."""
        left, right, rank = self._spine(a, 0), self._spine(b, 1), self.v.rank
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = rank.get((x, y))
            if across and across[0] < x_until and across[0] <= y_until:
                return across
            if x_until == y_until == _INF:
                return None
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        automaton, pairs, state, read = self.automaton, self.pairs, 0, 0
        get, link, length, found = automaton.step.get, automaton.link, automaton.length, automaton.found
        marked = bool(self.v.end)
        for at, symbol in enumerate(data, 1):
            while (to := get(state << 9 | symbol)) is None and state:
                state = link[state]
                read = length[state]
            state, read = (0, 0) if to is None else (to, read + 1)
            if marked and at == n:
                # The end-of-word mark is part of the last symbol: it ends the same prefix, and adds nothing to it.
                entries, mark = automaton.suffixes(*automaton.after(state, read, _END_SYMBOL)), 1
            else:
                entries, mark = found[state if read == length[state] else link[state]], 0
            for token, size in entries:
                begin = at + mark - size
                if begin == 0 or last[begin] >= 0 and pairs[last[begin] << 20 | token]:
                    last[at], back[at] = token, begin
                    break
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: The pre-token patterns of the two public tokenizers.
BYTE_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORD_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def normalised(text: str) -> str:
    """NFC and lower case, character by character."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pretokens(find: regex.Pattern, text: str) -> Iterable[str]:
    return find.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in find.finditer(text))


class WordCodec:
    """Encodes and decodes texts for a lower-casing tokenizer with word ends."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.encoder = PrefixEncoder(self.v)
        self.find = regex.compile(WORD_PRETOKENS)
        self.known = Memo(self._word)

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encoder.encode(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.v.shown[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and their decoding (entries joined by spaces)."""
        parts = self.v.splitter.split(text) if self.v.splitter and self.v.mark in text else [text]
        ids, shown, known = [], [], self.known
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(struct.pack("<I", self.v.special[part]))
                shown.append(part)
            elif both := [known[w] for w in pretokens(self.find, normalised(part))]:
                ids.append(b"".join([x[0] for x in both]))
                shown.append(" ".join([x[1] for x in both]))
        return b"".join(ids), " ".join(shown)


@lru_cache(maxsize=1)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_words(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch, _, _ in steps(batches):
            ids, decoded = zip(*[codec.encode(t.as_py() or "") for t in batch.column("text")])
            ends = np.cumsum([0, *(len(b) // 4 for b in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: n_tokens and the hashes of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = word_codec(path), hashlib.sha256
        for batch, _, _ in steps(batches):
            rows = []
            for t in batch.column("text"):
                ids, decoded = codec.encode(t.as_py() or "")
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class TokenCounter:
    """Tokens of each pre-token: 1 for proved vocabulary strings, merges for the rest."""

    def __init__(self, path: str):
        self.v = v = vocabulary(path)
        code = {c: b for b, c in enumerate(_BYTES)}
        self.find = regex.compile(BYTE_PRETOKENS)
        whole = set()
        for entry, i in v.ids.items():
            raw = bytes(code[c] for c in entry)
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.find.fullmatch(text) and v.merged(v.symbols(text)) == [i]:
                whole.add(text)
        #: Strings that are proved to encode alone as one token.
        self.whole = frozenset(whole)
        self.known = Memo(lambda word: 1 if word in self.whole else len(v.merged(v.symbols(word))))

    def count(self, text: str) -> int:
        parts = self.v.splitter.split(text) if self.v.splitter and self.v.mark in text else [text]
        return len(parts) // 2 + sum(sum(map(self.known.__getitem__, pretokens(self.find, p))) for p in parts[::2])


@lru_cache(maxsize=1)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; special strings count as one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch, _, _ in steps(batches):
            size, n = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                size.append(len(text.encode("utf-8", "surrogatepass")))
                n.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
