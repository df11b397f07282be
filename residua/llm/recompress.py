"""Removal of repeated word sequences by recompression.

A word goes if a window of 20 words that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one. Windows are judged on the input.

Recompression. Words are named by hashes. A first round names runs of equal words; each
further round deals all names into left and right ones (by a hash bit, new each round)
and names every pair of a left and a following right one. Names are functions of what
they stand for, so all tasks give equal names without an exchange, and equal texts get
equal names except near their ends. How near is known exactly: every symbol carries the
stretch of words that its name and its borders depend on. A window that holds the whole
stretch holds that symbol, wherever it occurs.

Each window thus has a symbol of the highest level that it is sure to hold (of several
the one whose stretch has the least hash). Windows with the same symbol are neighbours
and travel together. One exchange finds the stretches that occur more than once; a
window whose stretch is unique can't repeat. A second one brings the remaining windows
of equal stretches together, ordered by document and place: the first of each word
sequence stays, the others go. Sequences are compared by a 64-bit hash of their words
within one stretch; the words themselves are not compared.

A stretch is streamed in order, never gathered; copies within one step of a task (about a
megabyte of texts) are settled there and only their first goes on. A stretch of very many
groups is dealt by document to SALTS tasks; each settles its own, and the first of each
sequence in each, at most SALTS, are compared once more by sequence.

Null texts have no words. Rows with equal doc_id and text are one document: they don't
repeat each other, and get the same result. Rows without a doc_id come before all
others; among different texts of one id the text's hash decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import SPACE_WORDS, WordHash, documents_in, mix, released, stage_table, steps, word_spans
from residua.llm.suffixes import CONTEXTS, once_per_document, pointer, repeated_beginnings, same_document

WINDOW = 20
#: Groups of windows from which on a stretch is dealt to several tasks, and to how many.
HOT, SALTS = 1000, 64
#: Rounds of pair naming; after four a symbol stands for three words on average and depends on ten.
ROUNDS = 4

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Symbols:
    """One level: names, and the stretch of words [left, right) that each depends on. Name 0 separates documents."""

    def __init__(self, name: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.name, self.left, self.right = name, left, right

    def runs(self) -> Symbols:
        """Runs of equal names become one symbol; to know a run's ends one must see its neighbours."""
        name = self.name
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (name[1:] == 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(name)) - 1
        size = (last - first + 1).astype(np.uint64)
        whole = np.where(size > 1, mix(name[first] * _A + size * _B), name[first])
        left = self.left[np.maximum(first - 1, 0)]
        right = self.right[np.minimum(last + 1, len(name) - 1)]
        return Symbols(whole, left, right)

    def pairs(self, number: int) -> Symbols:
        """A left name followed by a right name becomes one symbol."""
        name = self.name
        real = name != 0
        bit = (mix(name + _C * np.uint64(number + 1)) >> np.uint64(63)).astype(bool)
        is_left, is_right = real & ~bit, real & bit
        merges = np.zeros(len(name), bool)
        merges[:-1] = is_left[:-1] & is_right[1:]
        taken = np.zeros(len(name), bool)
        taken[1:] = merges[:-1]
        keep = np.flatnonzero(~taken)
        after = np.minimum(keep + 1, len(name) - 1)
        before = np.maximum(keep - 1, 0)
        whole = np.where(merges[keep], mix(name[keep] * _A + mix(name[after] + _B) + _C), name[keep])
        # A left one is what it is for what follows it, a right one for what comes before it.
        left = np.where(is_right[keep], self.left[before], self.left[keep])
        right = np.where(is_left[keep], self.right[after], self.right[keep])
        return Symbols(whole, left, right)


def levels(words: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """All levels over word hashes with a 0 before, between and after documents."""
    at = np.arange(len(words))
    out = [Symbols(words, at, at + 1)]
    out.append(out[0].runs())
    for k in range(rounds):
        out.append(out[-1].pairs(k))
    return out


def least_in(key: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Index of the least key (leftmost among equals) of each range of at least one."""
    best = np.arange(len(key))
    tables, width = [best], 1
    while 2 * width <= int(count.max()):
        a = tables[-1]
        b = a[np.minimum(np.arange(len(a)) + width, len(a) - 1)]
        tables.append(np.where(key[a] <= key[b], a, b))
        width *= 2
    depth = np.frexp(count.astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for d in range(len(tables)):
        own = depth == d
        if own.any():
            a, b = tables[d][first[own]], tables[d][first[own] + count[own] - (1 << d)]
            out[own] = np.where(key[a] <= key[b], a, b)
    return out


class Windows:
    """Neighbouring windows that share their symbol: document, first and last begin (in words of the document), stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: WordHash, rounds: int = ROUNDS):
        starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
        h = hasher.spans(data, starts, ends)
        self.starts, self.ends, self.first = starts, ends, first
        docs, n = len(offsets) - 1, len(h)
        # Slot of each word in a row of words with a separator before, between and after documents.
        slot = np.arange(n) + np.repeat(np.arange(docs), np.diff(first)) + 1
        words = np.zeros(n + docs + 1, np.uint64)
        words[slot] = np.where(h == 0, _A, h)
        hasher._powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * hasher.up[: len(words)], out=sums[1:])
        hashed = lambda a, b: mix((sums[b] - sums[a]) * hasher.down[a] + (b - a).astype(np.uint64))
        room = np.maximum(np.diff(first) - WINDOW + 1, 0)
        doc = np.repeat(np.arange(docs), room)
        begin = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
        p = first[doc] + begin + doc + 1
        stretch = np.zeros(len(p), np.uint64)
        where = np.zeros(len(p), np.int64)  # the symbol's own place, to tell neighbours with equal stretches apart
        open_ = np.arange(len(p))
        for level in reversed(levels(words, rounds)):
            if not len(open_):
                break
            at = np.searchsorted(level.left, p[open_])
            count = np.searchsorted(level.right, p[open_] + WINDOW, "right") - at
            has = count > 0
            if has.any():
                key = hashed(level.left, level.right)
                best = least_in(key, at[has], count[has])
                stretch[open_[has]] = key[best]
                where[open_[has]] = level.left[best] * 64 + (level.right[best] - level.left[best])
            open_ = open_[~has]
        self.hashes = hashed(p, p + WINDOW) if len(p) else np.zeros(0, np.uint64)
        new = np.ones(len(p), bool)
        new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
        self.at = np.flatnonzero(new)
        self.count = np.diff(np.append(self.at, len(p)))
        self.doc, self.begin, self.stretch = doc[self.at], begin[self.at], stretch[self.at]


def stretches(docs: DataFrame) -> DataFrame:
    """(context, at, many): the stretch of each group of windows, once per document, and a hash that points to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch, data, offsets in steps(batches):
            w = Windows(data, offsets, hasher)
            yield once_per_document(batch, w.doc, w.stretch)

    return docs.select("text", pointer().alias("at")).mapInArrow(released(run), CONTEXTS)


_PLACE = "doc_id long, doc_key long, begin long"


def window_groups(docs: DataFrame) -> DataFrame:
    """Rows of `candidate` windows: context, doc_id, doc_key, begin, hashes (of the windows, in order), and local.

    docs: doc_id, doc_key, text, contexts. A group that repeats an earlier one of the same batch goes as a
    whole and needs no comparison: its row has local set and no hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch, data, offsets in steps(batches):
            w = Windows(data, offsets, hasher)
            wanted = batch.column("contexts")
            stretch = w.stretch.view(np.int64)
            keep = np.zeros(len(stretch), bool)
            bounds = np.searchsorted(w.doc, np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                a, b = bounds[d], bounds[d + 1]
                if b > a:
                    keep[a:b] = np.isin(stretch[a:b], wanted[d].values.to_numpy(zero_copy_only=False))
            k = np.flatnonzero(keep)
            ids = batch.column("doc_id").to_pylist()
            keys = batch.column("doc_key").to_pylist()
            order = sorted(k.tolist(), key=lambda i: (ids[w.doc[i]] is not None, ids[w.doc[i]] or 0, keys[w.doc[i]], w.begin[i]))
            seen: set = set()
            local, hashes = [], []
            for i in order:
                own = w.hashes[w.at[i] : w.at[i] + w.count[i]].view(np.int64)
                name = (int(stretch[i]), own.tobytes())
                local.append(name in seen)
                seen.add(name)
                hashes.append(own)
            at = np.array(order, np.int64)
            doc = pa.array(w.doc[at])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([0 if x else len(h) for x, h in zip(local, hashes)])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *[h for x, h in zip(local, hashes) if not x]])))
            yield pa.RecordBatch.from_arrays([pa.array(stretch[at]), batch.column("doc_id").take(doc), batch.column("doc_key").take(doc), pa.array(w.begin[at]), pa.array(w.count[at]), lists, pa.array(local, pa.bool_())], ["context", "doc_id", "doc_key", "begin", "count", "hashes", "local"])

    return docs.mapInArrow(released(run), f"context long, {_PLACE}, count long, hashes array<long>, local boolean")


def later_windows(groups: DataFrame) -> DataFrame:
    """(doc_id, doc_key, begin, count): runs of windows whose word sequence starts earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seen = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            stretch, salt = batch.column("context").to_numpy().view(np.uint64), batch.column("salt").to_numpy().astype(np.uint64)
            c = mix(stretch + mix(salt * _B + _C)).view(np.int64)  # a stretch's part in one task
            lists = batch.column("hashes")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            size = np.diff(lists.offsets.to_numpy())
            h = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(c)), size)
            # Names of (context, sequence): equal ones in one context are found by order of first sight.
            name = mix(h.view(np.uint64) ^ mix(c[row].view(np.uint64) + _A)).view(np.int64)
            _, first = np.unique(name, return_index=True)
            later = np.ones(len(name), bool)
            later[first] = False
            if context is not None and c[0] == context:
                own = np.flatnonzero(c[row] == context)
                later[own] |= np.isin(name[own], seen)
            tail = name[c[row] == c[-1]]
            seen = np.unique(np.concatenate([seen, tail]) if context is not None and c[-1] == context else tail)
            context = c[-1]
            place = np.arange(len(name)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(later)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(at)))
            # First of their part, but not yet of their stretch.
            open_ = np.flatnonzero(~later & (salt[row] > 0))
            r = np.concatenate([row[at[start]], row[open_]])
            begin = batch.column("begin").to_numpy()[r] + place[np.concatenate([at[start], open_])]
            given = np.concatenate([np.zeros(len(start), bool), np.ones(len(open_), bool)])
            sequence = np.concatenate([np.zeros(len(start), np.int64), h[open_]])
            take = pa.array(r)
            columns = [batch.column("doc_id").take(take), batch.column("doc_key").take(take), pa.array(begin), pa.array(np.concatenate([count, np.ones(len(open_), np.int64)])), batch.column("context").take(take), pa.array(sequence), pa.array(given)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_key", "begin", "count", "context", "sequence", "open"])

    whole = groups.where("not local")
    hot = stage_table(whole.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("context", F.lit(True).alias("hot")), "hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "doc_key"), F.lit(SALTS)) + 1).otherwise(0).cast("long")
    rows = whole.join(hot, "context", "left").select("context", salt.alias("salt"), "doc_id", "doc_key", "begin", "hashes")
    dealt = rows.repartition("context", "salt").sortWithinPartitions("context", "salt", "doc_id", "doc_key", "begin")
    found = stage_table(dealt.mapInArrow(released(run), _PLACE + ", count long, context long, sequence long, open boolean"), "later")
    # One first per part at most; the earliest of them stays.
    firsts = found.where("open").groupBy("context", "sequence").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc_key", "begin"))).alias("f"))
    others = firsts.select(F.explode(F.slice("f", 2, SALTS)).alias("x")).select("x.doc_id", "x.doc_key", "x.begin", F.lit(1).cast("long").alias("count"))
    settled = found.where("not open").select("doc_id", "doc_key", "begin", "count")
    return settled.unionByName(others).unionByName(groups.where("local").select("doc_id", "doc_key", "begin", "count"))


def kept_words(raw: bytes, starts: list[int], ends: list[int], spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """n_words, n_removed and what is left, joined by single spaces. spans: first window's begin and number of windows."""
    n, parts, at, removed = len(starts), [], 0, 0
    for begin, count in sorted(spans):
        end = begin + count + WINDOW - 1
        if end <= at:
            continue
        begin = max(begin, at)
        parts += [raw[starts[i] : ends[i]] for i in range(at, begin)]
        removed += end - begin
        at = end
    parts += [raw[starts[i] : ends[i]] for i in range(at, n)]
    return n, removed, b" ".join(parts)


_OUT = "doc_id long, doc_key long, n_words long, n_removed long, kept_sha256 string"


def _rows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, spans: list) -> pa.RecordBatch:
    """The result's columns, with what each document's spans cover gone."""
    starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
    raw, out = data.tobytes(), []
    for d, s in enumerate(spans):
        a, b = first[d], first[d + 1]
        n, removed, left = kept_words(raw, starts[a:b].tolist(), ends[a:b].tolist(), [(x["begin"], x["count"]) for x in s or []])
        out.append((n, removed, hashlib.sha256(left).hexdigest()))
    n, removed, sha = zip(*out)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "doc_key", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, doc_key, n_words, n_removed, kept_sha256."""
    d = documents_in(docs)
    wanted = repeated_beginnings(stretches(d)).groupBy("at").agg(F.collect_set("context").alias("contexts"))
    both = d.withColumn("at", pointer()).join(wanted, "at", "left").select("doc_id", "doc_key", "text", "contexts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without repeated stretches are done; the others keep their text."""
        for batch, data, offsets in steps(batches):
            done = _rows(batch, data, offsets, [None] * batch.num_rows)
            text = pa.array([t if o else None for o, t in zip(batch.column("contexts").is_valid().to_pylist(), batch.column("text").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*done.columns, text, batch.column("contexts")], [*done.schema.names, "text", "contexts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            yield _rows(batch, data, offsets, batch.column("spans").to_pylist())

    rows = stage_table(both.mapInArrow(released(finish), _OUT + ", text string, contexts array<long>"), "windows")
    rest = rows.where("contexts is not null").select("doc_id", "doc_key", "text", "contexts")
    groups = stage_table(window_groups(rest.dropDuplicates(["doc_id", "doc_key"])), "groups")
    spans = later_windows(groups).groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("begin", "count")).alias("spans"))
    late = rest.join(spans, same_document(rest, spans), "left").select(rest["doc_id"], rest["doc_key"], "text", "spans").mapInArrow(released(cut), _OUT)
    return rows.where("contexts is null").select(*late.columns).unionByName(late)


def dedup_digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).drop("doc_key")
