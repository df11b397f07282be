"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Words are runs of a-z (A-Z lower-cased), digits and non-ASCII characters. An item's
windows are its runs of 13 words (a shorter item is one window). A document word inside
any occurrence of a window is hit.

A window's words are ordered by how often the corpus holds them, rarest first (counted
over all documents, map-side first). Its rarest word is the necessary prefix: a document
without it can't hold the window, so only occurrences of prefix words are looked at, and of
these only such as have the window's next word (or the one before) beside them, so that a
word that is the rarest of very many windows doesn't meet all of them each time. The word's place in the window gives the positional bound (so many words must stand before
it) and the window's length the length bound (so many must follow). What passes is
verified, first by a hash over the item-sized run of words and then byte by byte.

The benchmark stays a table: its windows, their words' counts and each window's rarest word
are found by exchanges. The join itself broadcasts windows, by number and not by trust: at
most MAX_INDEX_WORDS words of them at a time, cut by the windows' hashes. A larger
benchmark is taken in as many slices as that needs, one pass over the documents each, and
the hits of all slices are joined per document. Which items a window belongs to is joined
last, to the hits only.

Null texts have no words and no windows. Rows with equal doc_id and text are one
document and get the same result; item ids that repeat count once. Null item ids are
left out of items_sha256 but their windows still hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import ALNUM_WORDS, LOWER, WordHash, byte_column, doc_key, documents_in, free_name, mix, released, run_hash, stage_table, steps, word_spans

WINDOW = 13
#: Words of item windows that one broadcast may hold (about 100 bytes each).
MAX_INDEX_WORDS = 4_000_000
HIT_SHARE = 20
#: Windows that are tried at once in a step's texts, about.
STEP_PAIRS = 1 << 20


def _hashed(data: np.ndarray, offsets: np.ndarray, hasher: WordHash):
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, ALNUM_WORDS)
    return low, starts, ends, first, hasher.spans(low, starts, ends)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, window, size) of every window of every item: the id as text, the words joined by spaces, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            low = LOWER[data]
            starts, ends, first = word_spans(low, offsets, ALNUM_WORDS)
            raw, rows = low.tobytes(), []
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                words = [raw[i:j] for i, j in zip(starts[a:b], ends[a:b])]
                if words:
                    size = min(window, len(words))
                    rows += [(k, b" ".join(words[i : i + size]), size) for i in range(len(words) - size + 1)]
            item, text, size = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(item, pa.int64())), pa.array([t.decode("utf-8", "surrogatepass") for t in text], pa.string()), pa.array(size, pa.int32())], ["item", "window", "size"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(released(run), "item string, window string, size int")


def word_counts(docs: DataFrame, words: DataFrame, most: int = MAX_INDEX_WORDS) -> DataFrame:
    """(word, hash, n): how often the corpus holds each of the given words. words: word.

    Up to `most` words are told to the tasks, which then count these only; beyond that, all
    words of the corpus are counted and joined.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in batches:
            data, offsets = byte_column(batch.column("word"))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(hasher.spans(data, offsets[:-1], offsets[1:]).view(np.int64))], ["word", "hash"])

    named = stage_table(words.select("word").distinct().mapInArrow(released(hashed), "word string, hash long"), "vocabulary")
    few = named.count() <= most
    known = np.unique(np.array([r.hash for r in named.select("hash").toLocalIterator()], np.int64).view(np.uint64)) if few else None
    given = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHash(), given.value
        if known is None:
            for _, data, offsets in steps(batches):
                h, n = np.unique(_hashed(data, offsets, hasher)[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])
            return
        total, probe = np.zeros(len(known), np.int64), Probe(known)
        for _, data, offsets in steps(batches):
            _, index = probe.hits(_hashed(data, offsets, hasher)[-1])
            total += np.bincount(index, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["hash", "n"])

    counts = docs.select("text").mapInArrow(released(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return named.join(counts, "hash", "left").select("word", "hash", F.coalesce("n", F.lit(0)).alias("n"))


def with_prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows (window, size) with `place`, where the rarest word stands (ties: the word itself, then the first), and its `hash`."""
    words = windows.select("window", "size", F.posexplode(F.split("window", " ")).alias("place", "word")).join(counts, "word")
    return words.groupBy("window", "size").agg(F.min(F.struct("n", "word", "place", "hash")).alias("r")).select("window", "size", "r.place", "r.hash")


class Probe:
    """Which of many hashes are in a sorted array: a bit table first, then a search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = max(12, int(np.ceil(np.log2(len(known) + 1))) + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[known >> np.uint64(64 - self.bits)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h, and for each its place in the sorted array."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        place = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        same = self.known[place] == h[at]
        return at[same], place[same]


def _pair_key(word: np.ndarray, other: np.ndarray | int, side: int) -> np.ndarray:
    """Key of a prefix word with the word after (0) or before it (1), or alone (2)."""
    return mix(word * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(np.asarray(other, np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(side))


class WindowIndex:
    """Item windows by their prefix: the rarest word with the word after it in the window (before it, if it is the last).

    This is the broadcast side of the join. With two words, a prefix word that stands in
    very many windows meets only those that go on alike.
    """

    def __init__(self, rows: list):
        """rows: window, size, place, hash."""
        self.text = [r.window.encode("utf-8", "surrogatepass") for r in rows]
        self.size = np.array([r["size"] for r in rows], np.int64)
        self.place = np.array([r.place for r in rows], np.int64)
        rare = np.array([r.hash for r in rows], np.int64).view(np.uint64)
        hasher = WordHash()
        self.hash, keys = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for k, (t, n, place) in enumerate(zip(self.text, self.size.tolist(), self.place.tolist())):
            words = hasher.spans(*_joined(t.split(b" ")))
            self.hash[k] = run_hash(words, n)[0]
            side = 2 if n == 1 else 0 if place + 1 < n else 1
            other = 0 if n == 1 else words[place + 1 if side == 0 else place - 1]
            keys[k] = _pair_key(words[place : place + 1], other, side)[0]
        self.prefixes = np.unique(rare)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[self.order], return_index=True, return_counts=True)

    def met(self, h: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that stand in the documents, and the words where they do. at: words that are prefix words; first: first word of each document."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.searchsorted(first, at, "right") - 1
        after, before = at[at + 1 < first[doc + 1]], at[at > first[doc]]
        word = np.concatenate([after, before, at])
        key = np.concatenate([_pair_key(h[after], h[after + 1], 0), _pair_key(h[before], h[before - 1], 1), _pair_key(h[at], 0, 2)])
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[place] == key
        return place[same], word[same]


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends


def find_windows(docs: DataFrame, index: WindowIndex) -> DataFrame:
    """doc_id, doc_key, n_words and hits (begin word, size, window) of every row, for the index's windows."""
    given = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, hasher = given.value, WordHash()
        probe, sizes = Probe(ix.prefixes), np.unique(ix.size)
        for batch, data, offsets in steps(batches):
            low, starts, ends, first, h = _hashed(data, offsets, hasher)
            place, at = ix.met(h, probe.hits(h)[0], first)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            raw = low.tobytes() if len(at) else b""
            # Every window of a key, with its begin in the document if there is room for it; a bounded number at once.
            upto = np.cumsum(ix.count[place])
            cuts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]) + STEP_PAIRS, STEP_PAIRS), "right")) if len(at) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                times = ix.count[place[a:b]]
                window = ix.order[_spread(ix.first[place[a:b]], times)]
                word = np.repeat(at[a:b], times)
                doc = np.searchsorted(first, word, "right") - 1
                begin = word - ix.place[window]
                fits = (begin >= first[doc]) & (begin + ix.size[window] <= first[doc + 1])
                window, doc, begin = window[fits], doc[fits], begin[fits]
                found = np.zeros(len(window), bool)
                for n in sizes:
                    own = ix.size[window] == n
                    if own.any():
                        found[own] = _run_hash_at(h, begin[own], int(n)) == ix.hash[window[own]]
                for w, d, at_word in zip(window[found].tolist(), doc[found].tolist(), begin[found].tolist()):
                    n = int(ix.size[w])
                    if b" ".join(raw[starts[i] : ends[i]] for i in range(at_word, at_word + n)) == ix.text[w]:
                        hits[d].append({"begin": at_word - int(first[d]), "size": n, "window": ix.text[w].decode("utf-8", "surrogatepass")})
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("size", pa.int64()), ("window", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(np.diff(first)), pa.array(hits, kind)], ["doc_id", "doc_key", "n_words", "hits"])

    return documents_in(docs).mapInArrow(released(run), "doc_id long, doc_key long, n_words long, hits array<struct<begin: long, size: long, window: string>>")


def _spread(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    total = int(times.sum())
    return np.repeat(first - (np.cumsum(times) - times), times) + np.arange(total)


def _run_hash_at(h: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    out, weight = np.zeros(len(begin), np.uint64), 0x9E3779B97F4A7C15
    for k in range(length):
        out += h[begin + k] * np.uint64(weight)
        weight = weight * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """A row per row of docs: doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    each = stage_table(item_windows(benchmark, window), "items")
    windows = each.select("window", "size").distinct()
    counts = word_counts(docs, windows.select(F.explode(F.split("window", " ")).alias("word")), max_index_words)
    index = stage_table(with_prefixes(windows, counts), "index")
    slices = max(1, -(-(index.agg(F.sum("size").alias("n")).first().n or 0) // max_index_words))
    rows, hits = None, None
    for k in range(slices):
        part = index.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == k).collect()  # about max_index_words words
        found = stage_table(find_windows(docs, WindowIndex(part)), "hits")
        rows = rows if k else found.select("doc_id", "doc_key", "n_words")
        own = found.where(F.size("hits") > 0).select("doc_id", "doc_key", F.explode("hits").alias("h")).select("doc_id", "doc_key", "h.*")
        hits = hits.unionByName(own) if k else own
    # Rows of one document give the same hits.
    hits = hits.distinct()
    spans = F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["begin"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    covered = hits.groupBy("doc_id", "doc_key").agg(spans.alias("s")).select("doc_id", "doc_key", F.aggregate("s", zero, step)["n"].alias("n_hit"))
    items = hits.select("doc_id", "doc_key", "window").distinct().join(each.select("item", "window").where("item is not null").distinct(), "window")
    named = items.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.doc_key").eqNullSafe(F.col(f"{b}.doc_key"))
    out = rows.alias("r").join(covered.alias("c"), same("r", "c"), "left").join(named.alias("i"), same("r", "i"), "left")
    n_hit, items = F.coalesce("c.n_hit", F.lit(0)).cast("long"), F.coalesce("i.items", F.array().cast("array<string>"))
    return out.select(
        "r.doc_id", "r.doc_key", "r.n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("r.n_words"))).alias("contaminated"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("doc_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id", "doc_key").distinct().alias("k")
    key = free_name(docs, "doc_key")
    d = docs.withColumn(key, doc_key()).alias("d")
    return d.join(bad, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col(f"d.{key}").eqNullSafe(F.col("k.doc_key")), "left_anti").drop(key)
