"""Repeated byte strings by a distributed merge sort of suffixes that never compares a known prefix again.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.

Which suffixes are sorted. Every string of 400 bytes picks the place with the least
16-byte hash in its middle 200; the strings of a document that pick the same place are
neighbours and form one suffix: from 100 bytes before the place to the end of the last
of the strings, with what stands left of it kept beside it. Equal strings pick equal
places, so they meet at suffixes with equal beginnings. Suffixes whose first 201 bytes
occur once in the corpus, by a 64-bit hash, can't repeat and are left out (one exchange
of hashes and ids).

How they are sorted. Only suffixes with equal beginnings must meet, so there is no order
over all suffixes: each task cuts its suffixes into buckets by the hash of their
beginning, sorts each bucket, joins equal suffixes into one entry and front-codes the
run: for each entry the number of bytes it shares with the entry before, and the rest.
Per bucket the runs of all tasks are merged by a loser tree whose nodes know how much
each run's head shares with the last suffix put out: the head that shares more comes
first unseen, and only ties are compared, from the shared length on. The merge yields
the common prefix of neighbours; with the bytes left of the beginning it gives, for
every entry, the strings that another entry holds too. Entries go back to the places
that hold them by (run, entry), so a text copied a thousand times is one entry per task
in the merge, and its copies stay where they are.

A beginning that very many documents hold, each with other bytes around it, would bring all
of them into one bucket. Of the 199 bytes that a string has beyond its beginning, some
stand left and the others right; by how many stand left the strings of such a suffix fall
into SHARES classes, and a class is sure of most of them. Each suffix then goes to one
bucket per class, chosen by these bytes too, so only suffixes that share most of a whole
string meet, and every repeated string is found in its class.

Null texts are empty. Matches don't cross documents. Rows with equal doc_id and text are
one document: they don't repeat each other, and get the same result.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import WordHash, byte_column, documents_in, mix, released, stage_table, steps

LENGTH = 400
#: Bytes before and after the picked place that all its strings hold, places to pick from, bytes hashed at a place.
BEFORE, AFTER, PLACES, GRAM = 100, 101, 200, 16
#: Bytes of suffixes that a bucket is meant to hold.
BUCKET_BYTES = 4 << 20
#: Documents from which on a beginning is split by the bytes around it, and into how many classes.
HOT, SHARES = 1000, 4
#: Groups of up to so many entries are compared pair by pair, larger ones length by length.
FEW = 24

_CODE = WordHash(seed=11)


def picked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each suffix: document index, first and last string's begin, place, and hash of the suffix's beginning."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64)
    _CODE._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE.code[data] * _CODE.up[:n], out=sums[1:])
    # The hash in the high half, the place in the low half: the least is the leftmost place of the least hash.
    gram = (sums[GRAM:] - sums[:-GRAM]) * _CODE.down[: n - GRAM + 1]
    low = np.uint64((1 << 32) - 1)
    at = np.arange(len(gram), dtype=np.uint64)
    size = -(-len(gram) // PLACES) * PLACES
    keyed = np.full(size + PLACES, np.uint64(0xFFFFFFFFFFFFFFFF))
    keyed[: len(gram)] = (mix(gram) & ~low) | (at & low)
    rows = keyed.reshape(-1, PLACES)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    # Strings that lie within one document.
    last = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    begin = np.concatenate([np.arange(a, b) for a, b in zip(offsets[:-1], last) if b > a] or [none])
    if not len(begin):
        return none, none, none, none, none.view(np.uint64)
    p = begin + BEFORE
    place = (np.minimum(back[p], ahead[p + PLACES - 1]) & low).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(begin)) - 1
    lo, hi, place = begin[first], begin[ends], place[first]
    context = mix((sums[place + AFTER] - sums[place - BEFORE]) * _CODE.down[place - BEFORE])
    return np.searchsorted(offsets, lo, "right") - 1, lo, hi, place, context


def beginnings(docs: DataFrame) -> DataFrame:
    """(context, at, many) of every suffix, once per document, with whether the document holds it more than once.

    at is a hash of the document's id and text (equal ones only let more pass).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            doc, _, _, _, context = picked(data, offsets)
            yield once_per_document(batch, doc, context)

    return docs.select("text", pointer().alias("at")).mapInArrow(released(run), CONTEXTS)


CONTEXTS = "context long, at long, many boolean"


def once_per_document(batch: pa.RecordBatch, doc: np.ndarray, context: np.ndarray) -> pa.RecordBatch:
    """CONTEXTS rows: a document's equal contexts are summed up before any exchange."""
    order = np.lexsort((context, doc))
    c, d = context[order], doc[order]
    new = np.ones(len(c) + 1, bool)
    new[1:-1] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new[:-1])
    many = ~new[first + 1]
    return pa.RecordBatch.from_arrays([pa.array(c[first].view(np.int64)), batch.column("at").take(pa.array(d[first])), pa.array(many)], ["context", "at", "many"])


def pointer():
    return F.xxhash64("doc_id", "text")


def repeated_beginnings(found: DataFrame) -> DataFrame:
    """The rows of found whose context another row has too, or their document more than once.

    One exchange, streamed in sorted order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        last = None  # the context last seen, if it is known to repeat
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            c = rows.column("context").to_numpy()
            same = np.zeros(len(c) + 1, bool)
            same[1:-1] = c[1:] == c[:-1]
            same[0] = last is not None and c[0] == last
            keep = same[:-1] | same[1:] | rows.column("many").to_numpy()
            # The last row waits for the next batch, unless it is known to repeat.
            held = None if keep[-1] else rows.slice(len(c) - 1, 1).to_batches()[0]
            last = c[-1] if keep[-1] else None
            yield from rows.filter(pa.array(keep)).to_batches()

    return found.repartition("context").sortWithinPartitions("context").mapInArrow(released(run), found.schema)


def shared_length(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, given that the first `at` bytes are equal."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def front_coded(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (suffix, left bytes reversed, copies) with shared prefixes left out."""
    shared, tails, before = [], [], b""
    for suffix, _, _ in entries:
        k = shared_length(before, suffix)
        shared.append(k)
        tails.append(suffix[k:])
        before = suffix
    return pickle.dumps((shared, tails, [x for _, x, _ in entries], [n for _, _, n in entries]), protocol=5)


class Run:
    """The head of a front-coded run: its suffix, and how much it shares with the last one put out."""

    __slots__ = ("at", "left", "copies", "shared", "tails", "text", "same")

    def __init__(self, blob: bytes):
        self.shared, self.tails, self.left, self.copies = pickle.loads(blob)
        self.at, self.text, self.same = 0, self.tails[0], 0

    def step(self) -> bool:
        """On to the next entry; False at the end. After a step `same` is what it shares with the one before it."""
        self.at += 1
        if self.at == len(self.tails):
            self.text = None
            return False
        self.same = self.shared[self.at]
        self.text = self.text[: self.same] + self.tails[self.at]
        return True


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, entry, suffix, length shared with the suffix before) in order, by a loser tree.

    Each node keeps the loser of its match. All heads know what they share with the last
    winner, so of two heads the one that shares more is smaller, unseen; of two that share
    equally much the bytes from there on decide, and the loser then shares with the new
    winner what that comparison found.
    """
    k = len(runs)
    losers = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two heads."""
        a, b = runs[x], runs[y]
        if a.text is None or b.text is None:
            return (y, x) if a.text is None else (x, y)
        if a.same != b.same:
            return (x, y) if a.same > b.same else (y, x)
        same = shared_length(a.text, b.text, a.same)
        if same == len(a.text) and (same < len(b.text) or x < y) or same < len(a.text) and same < len(b.text) and a.text[same] < b.text[same]:
            b.same = same
            return x, y
        a.same = same
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while runs[winner].text is not None:
        r = runs[winner]
        yield winner, r.at, r.text, r.same
        r.step()
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2


def repeated_strings(group: list[tuple[bytes, bytes, int]], shared: list[int]) -> list[list[tuple[int, int]]]:
    """For entries with equal beginnings, in order: the numbers of left bytes (from, to) whose strings repeat.

    shared[i] is the prefix that entries i - 1 and i share. A string with x left bytes
    needs x equal bytes on the left and LENGTH - x equal bytes from the beginning on.
    """
    m = len(group)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for i, (suffix, left, copies) in enumerate(group):
        if copies > 1:
            out[i].append((LENGTH - len(suffix), len(left)))
    if m <= FEW:
        for i in range(m):
            right = len(group[i][0])
            for j in range(i + 1, m):
                right = min(right, shared[j])
                x = shared_length(group[i][1], group[j][1])
                if LENGTH - right <= x:
                    out[i].append((LENGTH - right, x))
                    out[j].append((LENGTH - right, x))
        return out
    order = sorted(range(m), key=lambda i: group[i][1])
    lefts = np.array([0] + [shared_length(group[a][1], group[b][1]) for a, b in zip(order, order[1:])])
    rights, place = np.array(shared), np.array(order)
    sizes = np.array([len(s) for s, _, _ in group])
    deep = np.array([len(x) for _, x, _ in group])
    for x in range(max(0, LENGTH - int(sizes.max())), int(deep.max()) + 1):
        right = np.cumsum(rights < LENGTH - x)
        left = np.empty(m, np.int64)
        left[place] = np.cumsum(lefts < x)
        has = (sizes >= LENGTH - x) & (deep >= x)
        both = np.where(has, right * (m + 1) + left, -1)
        _, back, times = np.unique(both, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(has & (times[back] > 1)).tolist():
            if out[i] and out[i][-1][1] == x - 1:
                out[i][-1] = (out[i][-1][0], x)
            else:
                out[i].append((x, x))
    return out


def shared_buckets(context: int, suffix: bytes, left: bytes, buckets: int) -> set[int]:
    """Buckets of a suffix whose beginning is hot: one for each class of its strings.

    Strings of class j have lo to hi left bytes, so equal ones have lo equal bytes on the
    left, and LENGTH - hi from the beginning on.
    """
    out, room = set(), LENGTH - BEFORE - AFTER
    for j in range(SHARES):
        lo, hi = room * j // SHARES, room * (j + 1) // SHARES
        if len(left) >= lo and len(suffix) >= LENGTH - hi:
            key = zlib.crc32(suffix[: LENGTH - hi], zlib.crc32(left[:lo]))
            out.add((context + (key * SHARES + j) * 0x9E3779B1) % buckets)
    return out


def sorted_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Front-coded runs (blob) per task and bucket, and the places (doc_id, doc_key, begin, left) of each entry.

    docs: doc_id, doc_key, text, `contexts`, the repeated beginnings, and `hot`, those that very many documents hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, room = TaskContext.get().partitionId(), 0, 16 << 20
        names = ["bucket", "run", "entry", "blob", "doc_id", "doc_key", "begin"]

        def out(held: dict) -> Iterator[pa.RecordBatch]:
            nonlocal part
            for bucket, places in held.items():
                name = f"{task}-{part}"
                part += 1
                keys = sorted(places)
                blob = front_coded([(s, x, len(places[s, x])) for s, x in keys])
                yield rows([(bucket, name, -1, blob, None, None, None)])
                yield rows([(bucket, name, i, None, *p) for i, k in enumerate(keys) for p in places[k]])

        def rows(x: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x), kinds)], names)

        held: dict[int, dict] = {}
        size = 0
        for batch in batches:
            ids, keys, texts, wanted, many = (batch.column(c) for c in ("doc_id", "doc_key", "text", "contexts", "hot"))
            for i in range(batch.num_rows):
                data, offsets = byte_column(texts.slice(i, 1))
                raw = data.tobytes()
                _, lo, hi, place, context = picked(data, offsets)
                keep = np.isin(context.view(np.int64), wanted[i].values.to_numpy(zero_copy_only=False))
                doc, key, hot = ids[i].as_py(), keys[i].as_py(), {h & 0xFFFFFFFFFFFFFFFF for h in many[i].as_py() or ()}
                for a, b, p, c in zip(lo[keep].tolist(), hi[keep].tolist(), place[keep].tolist(), context[keep].tolist()):
                    begin = p - BEFORE
                    entry = (raw[begin : b + LENGTH], raw[a:begin][::-1])
                    for bucket in shared_buckets(c, *entry, buckets) if c in hot else (c % buckets,):
                        size += LENGTH if (places := held.setdefault(bucket, {}).setdefault(entry, [])) == [] else 40
                        places.append((doc, key, begin))
            if size > 8 * room:
                yield from out(held)
                held, size = {}, 0
        yield from out(held)

    return docs.mapInArrow(released(run), "bucket long, run string, entry long, blob binary, doc_id long, doc_key long, begin long")


def repeated_entries(runs: DataFrame) -> DataFrame:
    """(run, entry, least, most): the entry's strings with so many left bytes repeat."""

    def merge(group: pa.Table) -> pa.Table:
        names = group["run"].to_pylist()
        heads = [Run(b) for b in group["blob"].to_pylist()]
        found: list[tuple[str, int, int, int]] = []
        held: list[tuple[int, int]] = []
        entries: list[tuple[bytes, bytes, int]] = []
        shared: list[int] = []

        def close() -> None:
            if len(entries) > 1 or entries and entries[0][2] > 1:
                for (r, e), spans in zip(held, repeated_strings(entries, shared)):
                    found.extend((names[r], e, a, b) for a, b in joined(spans))
            held.clear(), entries.clear(), shared.clear()

        for r, e, suffix, same in merge_runs(heads):
            if same < BEFORE + AFTER:
                close()
            held.append((r, e))
            entries.append((suffix, heads[r].left[e], heads[r].copies[e]))
            shared.append(same)
        close()
        columns = list(zip(*found)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("run", "entry", "least", "most"), columns, kinds)})

    return runs.where("entry < 0").select("bucket", "run", "blob").groupBy("bucket").applyInArrow(merge, "run string, entry long, least long, most long")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of whole-number intervals, ends included."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the hash of what is left. spans: begin and end, end exclusive."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    sha, at = hashlib.sha256(), 0
    for a, b in runs:
        sha.update(raw[at:a])
        at = b
    sha.update(raw[at:])
    return len(raw), sum(b - a for a, b in runs), len(runs), sha.hexdigest()


_DIGEST = "doc_id long, doc_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(ids, keys, rows: list[tuple]) -> pa.RecordBatch:
    n, removed, spans, sha = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([ids, keys, *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())], ["doc_id", "doc_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def same_document(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["doc_key"] == b["doc_key"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, doc_key, n_bytes, n_removed, n_spans, kept_sha256."""
    d = documents_in(docs)
    again = stage_table(repeated_beginnings(beginnings(d)), "beginnings")
    hot = stage_table(again.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("context", F.col("context").alias("hot")), "hot")
    wanted = again.join(hot, "context", "left").groupBy("at").agg(F.collect_set("context").alias("contexts"), F.collect_set("hot").alias("hot"))
    both = d.withColumn("at", pointer()).join(wanted, "at", "left").select("doc_id", "doc_key", "text", "contexts", "hot")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without repeated beginnings are done; the others keep their text."""
        for batch in batches:
            open_ = batch.column("contexts").is_valid().to_pylist()
            rows = [(None,) * 4 if o else digest((t.as_py() or "").encode("utf-8", "surrogatepass"), []) for o, t in zip(open_, batch.column("text"))]
            done = _digests(batch.column("doc_id"), batch.column("doc_key"), rows)
            text = pa.array([t.as_py() if o else None for o, t in zip(open_, batch.column("text"))], pa.string())
            yield pa.RecordBatch.from_arrays([*done.columns, text, batch.column("contexts"), batch.column("hot")], [*done.schema.names, "text", "contexts", "hot"])

    rows = stage_table(both.mapInArrow(released(finish), _DIGEST + ", text string, contexts array<long>, hot array<long>"), "suffixes")
    rest = rows.where("contexts is not null").select("doc_id", "doc_key", "text", "contexts", "hot")
    total = rest.agg(F.sum(F.size("contexts")).alias("n")).first().n or 0
    runs = stage_table(sorted_runs(rest.dropDuplicates(["doc_id", "doc_key"]), max(1, total * 300 // BUCKET_BYTES)), "runs")
    places = runs.where("entry >= 0").select("run", "entry", "doc_id", "doc_key", "begin")
    spans = places.join(repeated_entries(runs), ["run", "entry"])
    # Strings with `most` to `least` left bytes start at begin - most to begin - least.
    spans = spans.select("doc_id", "doc_key", F.struct((F.col("begin") - F.col("most")).alias("a"), (F.col("begin") - F.col("least") + LENGTH).alias("b")).alias("s"))
    spans = spans.groupBy("doc_id", "doc_key").agg(F.collect_list("s").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(t.as_py().encode("utf-8", "surrogatepass"), [(x["a"], x["b"]) for x in s.as_py() or []]) for t, s in zip(batch.column("text"), batch.column("spans"))]
            yield _digests(batch.column("doc_id"), batch.column("doc_key"), found)

    late = rest.join(spans, same_document(rest, spans), "left").select(rest["doc_id"], rest["doc_key"], "text", "spans").mapInArrow(released(cut), _DIGEST)
    return rows.where("contexts is null").select(*late.columns).unionByName(late)


def repeat_digest(docs: DataFrame) -> DataFrame:
    return repeated_bytes(docs).drop("doc_key")
