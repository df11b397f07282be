"""Hard negatives, the mix of sources and the conversation trie against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from residua.llm import conversations, mixing, negatives
from tests.llm import brute


def hard_negatives(rows):
    """rows: id, label, vector."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        kept[(i, int(label), tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    kept = list(kept)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in kept:
        if a[0] % 100:
            continue
        first = lambda xs: sorted(((dot(a[2], x[2]), x) for x in xs if x is not a), key=lambda s: (-s[0], s[1][0]))
        others = first([x for x in kept if x[1] != a[1]])
        for score, p in first([x for x in kept if x[1] == a[1]])[:5]:
            fit = [(s, x) for s, x in others if 30 * score <= 100 * s <= 90 * score][:10]
            out += [(a[0], p[0], k + 1, x[0], score, s) for k, (s, x) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=600, dim=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, 0.15) for x in r.choice(centres)]
        rows.append((i, r.randrange(4), v))
    hot = rows[3][2]
    rows += [(n + i, i % 3, hot) for i in range(200)]  # a vector that very many rows have
    rows += [(5000, None, hot), (5001, 1, None), (5002, 1, hot[:-1] + [None]), (5003, 1, hot[:-1] + [float("nan")]), (5004, 1, hot[:-1] + [float("inf")]), (None, 1, hot)]
    rows += [(5100, 2, hot[:3]), (5200, 2, []), (5300, 9, [0.0] * dim), (-100, 1, hot), (-7, 3, hot)]
    rows += rows[:40]  # repeated rows
    r.shuffle(rows)
    return rows


EMBEDDINGS = "vec_id long, label int, embedding array<float>, key string, anchor int"


def embeddings(spark, rows, parts=3):
    return spark.createDataFrame([(i, label, v, "k", 1) for i, label, v in rows], EMBEDDINGS).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    """Over cells of a few anchors and rows."""
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 4)
    monkeypatch.setattr(negatives, "CELL_ROWS", 300)
    rows = vectors(seed)
    got = sorted(tuple(r) for r in negatives.negatives_digest(embeddings(spark, rows)).collect())
    assert got == hard_negatives(rows)
    assert len(got) > 100


def test_hard_negatives_of_odd_tables(spark):
    run = lambda rows: negatives.negatives_digest(embeddings(spark, rows, 1)).collect()
    assert run([]) == []
    assert run([(0, 0, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]  # the anchor's label is moved on to 1
    assert run([(0, 1, [1.0])]) == [] and run([(0, 1, [1.0]), (5, 2, [-1.0]), (3, 4, [1.0])]) == []  # a positive of negative score has no range


def side(rng, n, dim, about):
    q = rng.integers(-120, 120, (n, dim))
    m, d = negatives.summaries(q)
    blob = lambda x, t: pa.array([r.astype(t).tobytes() for r in x], pa.binary())
    number = lambda x: pa.array(x, pa.int64())
    batch = pa.RecordBatch.from_pydict({"id": number(rng.permutation(n)), "label": number(rng.integers(0, 3, n)), "key": number(np.arange(n)), "q": blob(q, np.int16), "means": blob(m, np.float32), "deviations": blob(d, np.float32)})
    return q, negatives.Side(batch, about)


@pytest.mark.parametrize("dim", [1, 5, 64])
def test_bounds_hold_scores(dim):
    rng = np.random.default_rng(dim)
    about = {"dim": dim, "kind": np.int16, "exact": True}
    (p, a), (q, x) = side(rng, 40, dim, about), side(rng, 70, dim, about)
    true = p @ q.T
    for level in range(len(negatives.LEVELS)):
        centre, half = negatives.bounds(a, x, level, slice(0, 40), slice(None), False)
        assert ((centre - half <= true) & (true <= centre + half)).all()
        i, j = np.indices(true.shape).reshape(2, -1)
        one, wide = negatives.bounds(a, x, level, i, j, True)
        assert np.allclose(one, centre.ravel(), rtol=1e-3, atol=1) and np.allclose(wide, half.ravel(), rtol=1e-3, atol=1)


def test_finer_segments_leave_less_in_question():
    rng = np.random.default_rng(5)
    about = {"dim": 64, "kind": np.int16, "exact": True}
    (_, a), (_, x) = side(rng, 200, 64, about), side(rng, 2000, 64, about)
    best, stats = negatives.Best(200, 5), {}
    for _ in range(2):
        negatives.positives_of(a, x, best, stats)
    assert stats[1] >= stats[4] >= stats[16] > 0


TURNS = "conv_id long, turn long, role string, text string, depth int, conv_id_2 long"


def trie(rows):
    """rows: conv_id, turn, role, text."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, r, x))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(convs.get(int(c - math.fmod(c, 20)), [])[:h] + convs[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[c] for c in children[n]) or 1
        saved[n] = sum(saved[c] for c in children[n]) + ((len(members[n]) - 1) * len(brute.SPACE.findall(n[-1][1])) if n else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], brute.sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items())


def talks(seed, n=160):
    r = random.Random(seed)
    rows = []
    for c in range(-25, n):
        if r.random() < 0.1:
            continue
        length = r.choice([1, 2, 3, 5, 8, 9, 12, 41, 50])
        rows += [(c, t if r.random() > 0.02 else None, r.choice(["user", "bot", None]) if t % 7 == 0 else "user", f"w{r.randrange(2)} x" if t < 4 else f"t{t // 3} y z") for t in range(length)]
    rows += [(1000 + i, t, "user", f"all the same {t}") for i in range(120) for t in range(45)]  # a conversation that very many have, into the third band
    rows += [(2000 + i, t, "user", f"all the same {t}" if t < 43 else f"{i} at the end") for i in range(60) for t in range(45)]
    rows += [(3000, 0, None, None), (3001, None, None, ""), (3020, 0, "", "a"), (3020, 0, "", "a"), (3020, 0, "x", "b"), (3020, None, "x", "é"), (3020, None, "x", "z"), (3020, None, "a", "zz"), (None, 1, "user", "no id"), (3100, 1, "u", "long " * 60_000)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], TURNS).repartition(parts)


def of_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie(spark):
    rows = talks(1)
    rows = [x for x in rows if x[0] != -1]  # -1 stands for the root's missing parent here
    assert of_trie(conversations.trie_digest(frame(spark, rows))) == trie(rows)


def test_trie_of_hot_prefixes_and_narrow_runs(spark, monkeypatch):
    """Prefixes of over 20 conversations are peeled by exchange in deep bands too; ids are joined in runs of 7."""
    monkeypatch.setattr(conversations, "HOT", 20)
    monkeypatch.setattr(conversations, "RUN", 7)
    monkeypatch.setattr(conversations, "BANDS", (2, 5))
    rows = [x for x in talks(2, 60) if x[0] != -1 and (x[1] or 0) < 24]
    assert of_trie(conversations.trie_digest(frame(spark, rows))) == trie(rows)


def test_trie_of_odd_tables(spark):
    assert of_trie(conversations.trie_digest(frame(spark, []))) == []
    rows = [(1, 0, "user", "a")]  # takes its first turn from conversation 0, which is not there
    assert zlib.crc32(b"1") % 4 >= 1
    assert of_trie(conversations.trie_digest(frame(spark, rows))) == trie(rows) == [(1, 0, -1, 1, 0, 1, 0, brute.sha("1"))]


def test_trie_of_conversations_as_they_are(spark):
    rows = [(c, t, "u", f"{t} {c % 3 if t > 1 else ''}") for c in range(9) for t in range(4)]
    nodes = conversations.prefix_nodes(conversations.as_written(conversations.hashed_turns(frame(spark, rows))))
    assert sorted((r.depth, r.n_convs) for r in nodes.collect()) == [(0, 9), (1, 9), (2, 9)] + [(3, 3)] * 3 + [(4, 3)] * 3


DOCS = "doc_id long, text string, lang string, source string, n_chars long, at int, size string, taken int"


def sources(seed, n=900):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["b"] * 6 + ["a", "c", "é", "Z", "tiny" if i % 60 == 0 else "a", None])
        words = r.choice([0, 3, 40, 200]) if source != "tiny" else 5
        rows.append((i, " \n".join(f"{i}.{k}" for k in range(words)) if words else r.choice([None, "", " \t"]), source))
    rows += [(7, "the same row twice", "a")] * 30 + [(None, "no id here", None)] * 3 + [(9001, " ".join(f"long{k}" for k in range(30_000)), "c")]
    r.shuffle(rows)
    return rows


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "3", 4) for i, t, s in rows], DOCS).repartition(parts)


def level(sizes, weights):
    """Targets by bisection on the common level."""
    low, high, total = 0.0, 3.0 * sum(sizes) + 1, sum(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(3 * s, high * w) for s, w in zip(sizes, weights)]


def test_targets():
    r = random.Random(3)
    for n in [1, 2, 3, 7, 50]:
        sizes = [r.choice([0, 1, 10, 1000, 50_000]) for _ in range(n)]
        weights = [(5, 2, 1)[i % 3] for i in range(n)]
        got = mixing.targets(sizes)
        assert got == pytest.approx(level(sizes, weights), rel=1e-9, abs=1e-6)
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(got, sizes))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_mix(spark):
    rows = sources(1)
    docs = documents(spark, rows)
    got = mixing.mix_digest(docs).collect()
    size = lambda t: len(brute.SPACE.findall(t or ""))
    by_source = Counter()
    for _, t, s in rows:
        by_source[s] += size(t)
    order = sorted(s for s in by_source if s is not None) + [None]
    target = dict(zip(order, mixing.targets([by_source[s] for s in order])))
    source_of = {(i, size(t)): s for i, t, s in rows}
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        s = source_of[(r.doc_id, r["size"])]
        assert (r.source_size, r.target) == (by_source[s], pytest.approx(target[s])) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in order)
    again = mixing.mix_digest(docs.repartition(7)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_mixed_blocks_are_the_documents_words(spark):
    rows = sources(2, 200)
    docs = documents(spark, rows)
    blocks = mixing.mixed_blocks(docs, block_words=16, shard_slots=100).collect()
    digest = mixing.mix_digest(docs, block_words=16, shard_slots=100).collect()
    assert all(len(r.text.split()) <= 16 for r in blocks)
    words = Counter(w.partition(".")[0] for r in blocks for w in r.text.split() if "." in w)
    want = Counter({str(r.doc_id): r.taken for r in digest if r.taken and r["size"] in (3, 40, 200) and r.doc_id is not None and r.doc_id < 200})
    assert {k: v for k, v in words.items()} == {k: v for k, v in want.items()}
    assert sum(len(r.text.split()) for r in blocks) == sum(r.taken for r in digest)
    texts = defaultdict(set)
    for r in blocks:
        texts[(r.source, r.block)].add(r.text)
    assert all(len(x) == 1 for x in texts.values())
    shards = Counter(r.shard for r in blocks)
    assert sorted(shards) == list(range(len(shards))) and set(list(shards.values())[:-1]) | {100} >= {100} and all(n <= 100 for n in shards.values())
    assert sorted((r.shard, r.slot) for r in blocks) == [(s, k) for s in sorted(shards) for k in range(shards[s])]


def test_mix_of_odd_tables(spark):
    assert mixing.mix_digest(documents(spark, [], 1)).collect() == []
    got = mixing.mix_digest(documents(spark, [(1, None, "a"), (2, "", None)], 1)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert [tuple(r) for r in mixing.mix_digest(documents(spark, [(1, "one two", None)], 1)).collect()] == [(1, 2, 2, 2.0, 2)]


def test_shards_use_up_the_slots_as_drawn():
    p = mixing.plan({"a": 200_000, "b": 30_000, "c": 64 * 900, None: 5}, shard_slots=100)
    counts, before = zip(*(mixing.shard_counts(p, s) for s in range(p.shards)))
    assert (np.sum(counts, axis=0) == p.slots).all() and (np.cumsum(counts, axis=0)[:-1] == before[1:]).all()
    assert all(c.sum() == 100 for c in counts[:-1])
    share = p.slots / p.slots.sum()
    spread = np.var([c[0] for c in counts])
    assert 0.5 < spread / (100 * share[0] * (1 - share[0])) < 2  # as a multinomial draw's
    whole = [mixing.shard_slots(p, s) for s in range(p.shards)]
    source, block = (np.concatenate(x) for x in zip(*whole))
    for i in range(len(p.slots)):
        times = np.bincount(block[source == i], minlength=p.blocks[i])
        assert len(times) == p.blocks[i] and times.max() - times.min() <= 1 and times.max() <= 3


def test_very_large_draws_split_in_proportion():
    quotas = np.array([3 * 10**9, 10**9 + 1, 0, 7], np.int64)
    out = mixing.draw(quotas, 2 * 10**9, (1, 2, 3))
    assert out.sum() == 2 * 10**9 and (out <= quotas).all() and abs(out[0] - 1.5e9) < 10


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations(n):
    with np.errstate(over="ignore"):
        one, two = (mixing.permuted(np.arange(n), n, np.full(n, k, np.uint64)) for k in (1, 2))
    assert sorted(one) == sorted(two) == list(range(n))
    assert n < 64 or (one != two).mean() > 0.9
