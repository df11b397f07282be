"""Exact n-gram Jaccard join with PartEnum signatures, and the groups that its links form.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; words are runs of
anything but ASCII white space), as 64-bit hashes. Sets that reach a Jaccard similarity
of 0.8 differ in few shingles, so:

* sets are dealt into size bands; a set signs for every band that a partner at least
  as large can be in, so that two similar sets share the band of the larger one;
* within a band the shingle domain is cut into `parts`, each into two cells. Of two
  sets that differ in at most k shingles, some part holds at most one difference, and
  then one of its two cells is the same in both: the two one-cell subsets of each part
  are the signatures. Empty cells sign nothing; a set with too few parts whose cells are
  both filled (it could agree with a partner on empty cells only) is irregular and signs
  its empty cells too, for other irregular sets. If only one of the two sets is
  irregular, the other one's filled cells are enough. Nothing similar is lost.

Equal sets are one class throughout. Per signature, the class that shares most leads the
others; the best candidates of each class are verified on the texts, and classes so
joined form first components. What is left are signatures shared by different components. Their members are compared with parity
sketches, which bound the number of differing shingles from below. Signatures of a few
members give candidate pairs at once. In larger ones first only those
members are marked that have a candidate at all, by ever wider sketches; these then meet with their
texts, and the verified links that join components are put out. Signatures of over BLOCK members,
which a frequent passage makes, are parted before: their members go by their rarest shingles,
as many as two similar sets need to share one, so unrelated members do not meet and
rows grow with the members. Only sets of which four fifths are shingles that over BLOCK others have
still meet in a group of more members; these are compared block by block. No link
between components is missed.

Links are verified on the words themselves: words of both texts are numbered, and
shingles are compared as exact numbers. Equal sets are told by a 64-bit hash.

A null or wordless text has an empty set and is linked with nothing; so are rows without
a doc_id. Fewer than five words make one shingle. Rows with equal doc_id and text are
one document; each of them gets the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.common import LOWER, SPACE_WORDS, WordHash, doc_key, documents_in, free_name, mix, released, run_hash, stage_table, steps, word_spans

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
#: Upper over lower end of a size band.
BAND = 1.6
#: Candidates verified per class before components are formed.
BEST = 2
#: Signatures of up to so many members are paired directly.
FEW = 6
#: Members of a signature that are compared in one block.
BLOCK = 1500
#: Shingles of the members that meet in one block with their texts.
BLOCK_SHINGLES = 1_000_000
#: Bits of a parity sketch: the power of two at or above the number of shingles, within these ends.
SKETCH_LEAST, SKETCH_MOST = 64, 4096
#: Times as many where texts are at hand: the bound is then close to the difference itself.
WIDER = 8
#: A table of keys is broadcast up to so many rows (16 bytes each); beyond, it is joined by exchange.
BROADCAST_KEYS = 500_000


def shingle_hashes(words: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles, from its word hashes."""
    return np.unique(run_hash(words, min(length, len(words)))) if len(words) else np.zeros(0, np.uint64)


def sets_in(data: np.ndarray, offsets: np.ndarray, hasher: WordHash, length: int = SHINGLE) -> Iterator[np.ndarray]:
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, SPACE_WORDS)
    h = hasher.spans(low, starts, ends)
    if len(h) >= length:
        runs = run_hash(h, length)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(runs[a : b - length + 1]) if b - a >= length else shingle_hashes(h[a:b], length)


def set_id(s: np.ndarray) -> int:
    """Equal sets have equal ids; with the size it names the class."""
    return int(mix(np.array([mix(s + np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64))[0].astype(np.int64)) if len(s) else 0


def band_ends() -> list[int]:
    ends = [4]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND)))
    return ends


_ENDS = band_ends()


def most_differences(size: int, largest: int, similarity: Fraction = SIMILARITY) -> int:
    """Most shingles in which a set and a partner of at most `largest` shingles can differ."""
    num, den = similarity.numerator, similarity.denominator
    return min(2 * largest * (den - num) // (den + num), size * (den - num) // num)


def signatures(s: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """All signatures of a set of sorted hashes. Sets of which no other set can be a partner have none."""
    size, out = len(s), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0xD6E8FEB86659FD93)))])
    own = int(np.searchsorted(_ENDS, size))
    for band in range(own, len(_ENDS)):
        if band > own and (_ENDS[band - 1] + 1) * similarity.numerator > size * similarity.denominator:
            break
        largest = _ENDS[band]
        k = most_differences(largest, largest, similarity)
        need = most_differences(size, largest, similarity)
        if need == 0:
            continue
        parts = k // 2 + 1 + (k >= 6) + k // 25
        # Hash ranges are the cells, so each cell is a run of the sorted set.
        width = np.uint64((1 << 64) // (2 * parts) + 1)
        at = np.searchsorted(s, np.arange(1, 2 * parts, dtype=np.uint64) * width)
        at = np.concatenate([[0], at, [size]])
        cells = sums[at[1:]] - sums[at[:-1]]
        filled = np.diff(at) > 0
        names = np.arange(2 * parts, dtype=np.uint64) + np.uint64((band + 1) << 40)
        good = int((filled[0::2] & filled[1::2]).sum())
        out.append(mix(mix(names[filled]) + cells[filled]))
        if good <= need // 2:
            out.append(mix(mix(names[~filled]) + np.uint64(0xE7037ED1A0B428DB)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray, times: int = 1) -> bytes:
    """Parity of the number of hashes in each of many cells; two sets differ at least where bits do."""
    bits = SKETCH_LEAST
    while bits < len(s) and bits < SKETCH_MOST:
        bits *= 2
    bits *= times
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(a: np.ndarray, words: int) -> np.ndarray:
    """Sketches with fewer bits: cells that agree in their low bits are joined."""
    while a.shape[-1] > words:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, n_shingles, sid and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch, data, offsets in steps(batches):
            n, sid, bits = [], [], []
            for s in sets_in(data, offsets, hasher):
                n.append(len(s))
                sid.append(set_id(s))
                bits.append(sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "doc_key", "n_shingles", "sid", "sketch"])

    return documents_in(docs).mapInArrow(released(run), "doc_id long, doc_key long, n_shingles long, sid long, sketch binary")


def signed(docs: DataFrame) -> DataFrame:
    """(sig, sid) of every set; sets that a task has signed before are left out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHash(), set()
        for _, data, offsets in steps(batches):
            sigs, sids = [], []
            for s in sets_in(data, offsets, hasher):
                sid = set_id(s)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    sigs.append(signatures(s))
                    sids.append(np.full(len(sigs[-1]), sid))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(sids))], ["sig", "sid"])

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(released(run), "sig long, sid long")


def shared_signatures(sigs: DataFrame) -> DataFrame:
    """(sig, sid, members) of signatures with several classes. One exchange, sorted runs, streamed.

    members is the number of a signature's classes within one Arrow batch: enough to weigh
    leaders, and nothing but the last class is held from one batch to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # a class that waits for a second one; the last class of a signature known to be shared
        for batch in batches:
            sig, sid = batch.column("sig").to_numpy(), batch.column("sid").to_numpy()
            if not len(sig):
                continue
            before = held or last
            if held:
                sig, sid = np.append(held[0], sig), np.append(held[1], sid)
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
            new[0] = held is not None or before != (sig[0], sid[0])
            sig, sid = sig[new], sid[new]
            if not len(sig):
                continue
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            members = np.diff(np.append(np.flatnonzero(first), len(sig)))
            known = np.zeros(len(members), bool)
            known[0] = last is not None and held is None and sig[0] == last[0]
            shared = known | (members > 1)
            rows, count = np.repeat(shared, members), np.repeat(np.maximum(members, 2), members)
            end = (sig[-1], sid[-1])
            held, last = (None, end) if shared[-1] else (end, None)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (sig, sid, count)], ["sig", "sid", "members"])

    return sigs.repartition("sig").sortWithinPartitions("sig", "sid").mapInArrow(released(run), "sig long, sid long, members long")


def small(table: DataFrame) -> DataFrame:
    """table, marked for a broadcast if it has at most BROADCAST_KEYS rows (of two numbers each)."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def hub_pairs(shared: DataFrame, best: int = BEST) -> DataFrame:
    """Candidate pairs (a, b): per signature its heaviest class with the others, at most `best` per class.

    A class is the heavier the more signatures it shares with the more others, so the text
    that many are near copies of leads them. Signatures of up to FEW members need no
    leader: their members are all compared later.
    """
    shared = shared.where(F.col("members") > FEW).select("sig", "sid", "members")
    weights = stage_table(shared.groupBy("sid").agg(F.sum("members").alias("weight")), "weights")
    rows = shared.select("sig", "sid").join(small(weights), "sid")
    # A table of its own, so that the join below can split a signature with very many members.
    lead = stage_table(rows.groupBy("sig").agg(F.max(F.struct("weight", "sid")).alias("r")).select("sig", F.col("r.sid").alias("a")), "lead")
    pairs = shared.select("sig", "sid").join(lead, "sig").where("a <> sid").select("a", F.col("sid").alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that may be similar by size and sketch. classes: sid, n_shingles, sketch."""
    num, den = similarity.numerator, similarity.denominator
    side = lambda x: classes.select(F.col("sid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = (n * den >= num * m) & (m * den >= num * n)
            for k in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u8") for c in ("s_a", "s_b"))
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())
                # difference <= (1 - t) / (1 + t) * total, in whole numbers
                ok[k] = differ * (den + num) <= (den - num) * int(n[k] + m[k])
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(released(run), "a long, b long")


def words_in(text: str) -> list[bytes]:
    """The same words as SPACE_WORDS: split() cuts bytes at the six ASCII white-space characters, lower() folds A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def similar(a: list[bytes], b: list[bytes], similarity: Fraction = SIMILARITY, length: int = SHINGLE) -> bool:
    """Do the shingle sets of two texts' words reach the similarity? Compared exactly."""
    if min(len(a), len(b)) < length:
        x, y = ({tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} for w in (a, b))
        common, total = len(x & y), len(x) + len(y)
    else:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in (*a, *b)], np.int64)
        at = np.concatenate([np.arange(len(a) - length + 1), np.arange(len(a), len(ids) - length + 1)])
        code = ids[at]
        for k in range(1, length):
            code = code * len(number) + ids[at + k]
            if len(number) ** (k + 2) >= 1 << 63:
                code = np.unique(code, return_inverse=True)[1]  # ranks stand for the shingles so far, and keep the numbers small
        x, y = np.unique(code[: len(a) - length + 1]), np.unique(code[len(a) - length + 1 :])
        common, total = len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)
    return similarity.denominator * common >= similarity.numerator * (total - common)


def verified(pairs: DataFrame, texts: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, by their texts. texts: (sid, text), a row per class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = texts.join(small(wanted), "sid", "left_semi")
    t = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    u = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(t, "a").join(u, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text_a"), batch.column("text_b"))
            ok = pa.array([similar(words_in(x.as_py()), words_in(y.as_py()), similarity) for x, y in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return both.mapInArrow(released(run), "a long, b long")


def components(links: DataFrame, node: str = "sid") -> DataFrame:
    """(node, comp) for every end of a link (a, b): comp is the smallest node of its component.

    Smallest labels are passed along links and then looked up through their own label, so
    the rounds grow with the logarithm of a component's width; each round is a written table.
    """
    ends = stage_table(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = stage_table(ends.groupBy(F.col("a").alias(node)).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        other = labels.select(F.col(node).alias("b"), F.col("comp").alias("near"))
        near = ends.join(other, "b").groupBy(F.col("a").alias(node)).agg(F.min("near").alias("near"))
        lower = labels.join(near, node).select(node, F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col(node).alias("comp"), F.col("comp").alias("far"))
        after = stage_table(lower.join(jump, "comp").select(node, "was", F.least("comp", "far").alias("comp")), "labels")
        labels = after.select(node, "comp")
        if after.where("comp != was").isEmpty():
            return labels


def close_pairs(rows: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """Pairs (a, b) within signatures of at most FEW members that differ in component and may be similar by size and sketch.

    rows: sig, sid, comp, n_shingles, sketch. One exchange by signature; runs are compared
    with themselves, moved by one, two, ... places.
    """
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(t: pa.Table) -> pa.RecordBatch:
            sig, sid, comp, n = (t.column(c).to_numpy() for c in ("sig", "sid", "comp", "n_shingles"))
            column = t.column("sketch").combine_chunks().cast(pa.large_binary())
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            _, ends, data = column.buffers()
            begin = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // 8
            flat = np.frombuffer(data, "<u8", int(begin[-1])) if data and begin[-1] else np.zeros(0, np.uint64)
            begin, size = begin[:-1], np.diff(begin)

            def folded(rows: np.ndarray, words: int) -> np.ndarray:
                """Similar sizes have sketches of equal or next size; the larger is folded once."""
                at = begin[rows][:, None] + np.arange(words)
                out, big = flat[at], size[rows] > words
                out[big] ^= flat[at[big] + words]
                return out

            out = []
            for d in range(1, FEW):
                i = np.flatnonzero((sig[d:] == sig[:-d]) & (comp[d:] != comp[:-d]) & (n[d:] * den >= num * n[:-d]) & (n[:-d] * den >= num * n[d:])) if len(sig) > d else np.zeros(0, np.int64)
                low = np.minimum(size[i], size[i + d])
                for words in np.unique(low).tolist():
                    x = i[low == words]
                    # difference <= (1 - t) / (1 + t) * total, in whole numbers
                    x = x[np.bitwise_count(folded(x, words) ^ folded(x + d, words)).sum(axis=1, dtype=np.int64) * (den + num) <= (den - num) * (n[x] + n[x + d])]
                    out.append(np.stack([np.minimum(sid[x], sid[x + d]), np.maximum(sid[x], sid[x + d])], axis=1))
            out.append(np.zeros((0, 2), np.int64))
            both = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch]).combine_chunks()
            sig = t.column("sig").to_numpy()
            cut = int(np.searchsorted(sig, sig[-1]))
            held = t.slice(cut)
            yield found(t.slice(0, cut).combine_chunks())
        if held is not None:
            yield found(held.combine_chunks())

    return rows.repartition("sig").sortWithinPartitions("sig", "sid").mapInArrow(released(run), "a long, b long")


def mixed_signatures(rows: DataFrame) -> DataFrame:
    """(sig, members) of the signatures that different components share. rows: sig, sid, comp."""
    found = rows.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members"))
    return stage_table(found.where("x < y").select("sig", "members"), "mixed")


def by_rare_shingles(sids: DataFrame, texts: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(sig, sid): each of the classes under its rarest shingles, so many that two similar sets share one.

    Of n shingles a similar set has at least n * similarity, so one that both have is among the
    n - ceil(n * similarity) + 1 rarest of either, in one order for all: by the number of these
    classes, then by hash. A shingle of one class only comes first and needs no row.
    """
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch, data, offsets in steps(batches):
            sets = list(sets_in(data, offsets, hasher))
            sizes = np.array([len(s) for s in sets], np.int64)
            sid = np.repeat(batch.column("sid").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(sid), pa.array(np.repeat(sizes, sizes))], ["sig", "sid", "size"])

    shingles = texts.join(sids.select("sid"), "sid", "left_semi").mapInArrow(released(run), "sig long, sid long, size long")
    # A table of its own, so that the join below can split a shingle that very many classes have.
    common = stage_table(shingles.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "common")
    own = Window.partitionBy("sid")
    ranked = shingles.join(common, "sig").withColumns({"rank": F.row_number().over(own.orderBy("n", "sig")), "several": F.count("*").over(own)})
    prefix = F.expr(f"size - (size * {num} + {den - 1}) div {den} + 1")
    return ranked.where(F.col("rank") <= prefix - (F.col("size") - F.col("several"))).select("sig", "sid")


def parted(rows: DataFrame, texts: DataFrame, similarity: Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """rows (sig, sid, comp), and (sig, members) of those signatures that different components share.

    Members of signatures of over BLOCK members go by their rare shingles instead: unrelated
    sets that only have frequent passages in common part here, and a class has a bounded number
    of rows, however many signatures it shares with however many others.
    """
    mixed = mixed_signatures(rows)
    large = mixed.where(F.col("members") > BLOCK)
    if large.isEmpty():
        return rows, mixed
    sids = stage_table(rows.join(large, "sig").select("sid", "comp").distinct(), "large")
    rare = stage_table(by_rare_shingles(sids, texts, similarity).join(sids, "sid").select("sig", "sid", "comp"), "rare")
    return rows.select("sig", "sid", "comp").unionByName(rare), mixed.where(F.col("members") <= BLOCK).unionByName(mixed_signatures(rare))


def across_components(shared: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, tested: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """Verified links (a, b) that join the components which still share a signature. classes: sid, n_shingles, sketch."""
    rows = shared.select("sig", "sid").join(small(labels), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    rows, mixed = parted(rows, texts, similarity)
    few = rows.join(mixed.where(F.col("members") <= FEW).select("sig"), "sig").join(classes, "sid")
    many = rows.join(mixed.where(F.col("members") > FEW), "sig").join(classes, "sid")
    pairs = stage_table(close_pairs(few, similarity).distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    return verified(pairs, texts, similarity).unionByName(links_in_blocks(many, texts, similarity))


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows with sig, i, j and own: a signature's members are dealt into blocks, of which every two (i <= j) meet once."""
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def near_members(group: pa.Table, similarity: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """Of two blocks that meet: each member, with the later ones that may be similar by size and sketch and are in other components."""
    num, den = similarity.numerator, similarity.denominator
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    own, sid, comp, n = (group[c].to_numpy() for c in ("own", "sid", "comp", "n_shingles"))
    bits = [np.frombuffer(x.as_py(), "<u8") for x in group["sketch"]]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    words = np.array([len(b) for b in bits])
    for w in np.unique(words[left]).tolist():
        mine = left[words[left] == w]
        for v in np.unique(words[right]).tolist():
            # Similar sizes have sketches of equal or next size.
            if v > 2 * w or w > 2 * v:
                continue
            theirs = right[words[right] == v]
            x, y = (_folded(np.stack([bits[k] for k in part]), min(v, w)) for part in (mine, theirs))
            for r, row in zip(mine.tolist(), x):
                near = (comp[theirs] != comp[r]) & (n[theirs] * den >= num * n[r]) & (n[r] * den >= num * n[theirs])
                if i == j:
                    near &= sid[theirs] > sid[r]
                at = np.flatnonzero(near)
                if len(at):
                    # difference <= (1 - t) / (1 + t) * total, in whole numbers
                    at = at[np.bitwise_count(row ^ y[at]).sum(axis=1, dtype=np.int64) * (den + num) <= (den - num) * (n[theirs[at]] + n[r])]
                if len(at):
                    yield r, theirs[at]


def marked_members(rows: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows (sig, sid, comp, n_shingles) that have a candidate within their signature, by the sketches of rows."""

    def mark(group: pa.Table) -> pa.Table:
        seen = np.zeros(group.num_rows, bool)
        for r, others in near_members(group, similarity):
            seen[r] = True
            seen[others] = True
        return group.select(["sig", "sid", "comp", "n_shingles"]).filter(pa.array(seen))

    rows = rows.select("sig", "sid", "comp", "n_shingles", "sketch", "members")
    met = in_blocks(rows, F.ceil(F.col("members") / BLOCK).cast("int")).select("sig", "i", "j", "own", "sid", "comp", "n_shingles", "sketch")
    return met.groupBy("sig", "i", "j").applyInArrow(mark, "sig long, sid long, comp long, n_shingles long").distinct()


def wide_sketches(texts: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, sketch) of the given classes, wider than those of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch, data, offsets in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([sketch(s, WIDER) for s in sets_in(data, offsets, hasher)], pa.binary())], ["sid", "sketch"])

    return texts.join(sids, "sid", "left_semi").mapInArrow(released(run), "sid long, sketch binary")


def links_in_blocks(rows: DataFrame, texts: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The same for signatures of many members.

    Members with candidates are marked, twice: by the sketches that all classes have, and
    then by wider ones of those that are left. The few that remain are compared by words.
    """
    sized = lambda m: m.join(stage_table(m.groupBy("sig").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")), "sizes"), "sig")
    first = stage_table(marked_members(rows, similarity), "marked")
    wide = stage_table(wide_sketches(texts, first.select("sid").distinct()), "wide")
    marked = stage_table(marked_members(sized(first).join(wide, "sid"), similarity), "marked")

    def link(group: pa.Table) -> pa.Table:
        sid, comp = group["sid"].to_numpy(), group["comp"].to_pylist()
        texts, words = group["text"], {}
        root = {c: c for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def of(r: int) -> list[bytes]:
            if r not in words:
                words[r] = words_in(texts[r].as_py())
            return words[r]

        out = []
        for r, others in near_members(group, similarity):
            for o in others.tolist():
                if (x := top(comp[r])) != (y := top(comp[o])) and similar(of(r), of(o), similarity):
                    root[x] = y
                    out.append((min(sid[r], sid[o]), max(sid[r], sid[o])))
            words.pop(r, None)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    met = in_blocks(sized(marked), blocks).join(wide, "sid").join(texts, "sid")
    met = met.select("sig", "i", "j", "own", "sid", "comp", "n_shingles", "sketch", "text")
    return met.groupBy("sig", "i", "j").applyInArrow(link, "a long, b long")


def jaccard_members(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """A row per row of docs: doc_id, doc_key, n_shingles, and comp, the component's own key (null: stands alone)."""
    rows = stage_table(classes_of(docs), "sets")
    shared = stage_table(shared_signatures(signed(docs)), "shared")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "doc_key", "n_shingles", "sketch")).alias("r")).select("sid", "r.*")
    wanted = stage_table(shared.select("sid").distinct().join(classes, "sid"), "classes")
    keys = wanted.select("sid", F.col("doc_id").alias("k_id"), F.col("doc_key").alias("k_key"))
    d = documents_in(docs)
    found = d.join(keys, (d.doc_id == keys.k_id) & (d.doc_key == keys.k_key)).dropDuplicates(["k_id", "k_key"])
    texts = stage_table(found.select("sid", "text"), "texts")
    sketches = wanted.select("sid", "n_shingles", "sketch")
    tested = stage_table(hub_pairs(shared), "tested")
    links = stage_table(verified(stage_table(likely(tested, sketches, similarity), "likely"), texts, similarity), "links")
    labels = components(links)
    rest = across_components(shared, labels, sketches, texts, tested, similarity)
    labels = joined(labels, stage_table(rest, "links"))
    return with_components(rows, labels)


def jaccard_groups(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """A row per row of docs: doc_id, doc_key, n_shingles, component_id."""
    return with_component_ids(jaccard_members(docs, similarity))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: only the components that these join are looked at again."""
    if links.isEmpty():
        return labels
    end = lambda x: labels.select(F.col("sid").alias(x), F.col("comp").alias(f"c_{x}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    edges = ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = components(edges, "node").withColumnRenamed("comp", "top")
    known = labels.select("sid", "comp").union(links.select(F.explode(F.array("a", "b")).alias("sid")).join(labels, "sid", "left_anti").distinct().select("sid", F.col("sid").alias("comp")))
    out = known.join(over, F.col("comp") == F.col("node"), "left").select("sid", F.coalesce("top", "comp").alias("comp"))
    return stage_table(out, "labels")


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's component; empty sets and rows without an id stand alone."""
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    named = rows.select("doc_id", "doc_key", "n_shingles", F.when(linked, F.col("sid")).alias("sid")).join(labels, "sid", "left")
    return named.select("doc_id", "doc_key", "n_shingles", F.coalesce("comp", "sid").alias("comp"))


def with_component_ids(named: DataFrame) -> DataFrame:
    """The smallest doc_id of each row's component; rows without one have their own."""
    # A table of its own, so that the join can split a component that holds a large share of the rows.
    least = stage_table(named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least, "comp", "left").select("doc_id", "doc_key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs).drop("doc_key")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (of equal rows, any one)."""
    rows = jaccard_members(docs).where("doc_id is not null")
    # Different texts under one id: the one with the smallest key, if they are of one group. Rows without an id all stay.
    least = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "doc_key")).alias("r")).select("r.*")
    kept = least.union(rows.where("comp is null").select("doc_id", "doc_key").distinct()).alias("k")
    key = free_name(docs, "doc_key")
    d = docs.withColumn(key, doc_key()).alias("d")
    named = d.where("doc_id is not null").join(kept, (F.col("d.doc_id") == F.col("k.doc_id")) & F.col(f"d.{key}").eqNullSafe(F.col("k.doc_key")), "left_semi")
    single = named.dropDuplicates(["doc_id", key])
    return single.unionByName(d.where("doc_id is null")).drop(key)
