"""The operators that compare documents, against brute force."""

import random

import pytest

from residua.llm import decontaminate, jaccard, recompress, suffixes
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def corpus(seed, n=140, letters="abcdefgh", words=60):
    """Random texts with exact and near copies, shared passages, runs, periods, nulls and very short ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(words)] + ["é", "ß日", "X"]
    say = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, texts = say(90), []
    for i in range(n):
        kind = r.random()
        w = say(r.choice([3, 8, 30, 100, 200, 400]))
        if kind < 0.2 and texts:
            w = list(r.choice(texts))
        elif kind < 0.45 and texts:
            w = list(r.choice(texts))
            for _ in range(r.randint(1, max(1, len(w) // 25))):
                if w:
                    at = r.randrange(len(w))
                    w[at : at + r.randint(0, 1)] = say(r.randint(0, 2))
        elif kind < 0.65:
            at, a = r.randrange(len(w)), r.randrange(60)
            w[at:at] = passage[a : a + r.randint(20, 90)]
        elif kind < 0.72:
            w[2:2] = [r.choice(vocabulary)] * r.randint(2, 130)
        elif kind < 0.78:
            w[2:2] = say(3) * r.randint(5, 80)
        texts.append(w)
    rows = [(i * 3 % (3 * n) + 1, r.choice([" ", " ", "\n"]).join(w)) for i, w in enumerate(texts)]
    return [*rows, (100_000, None), (100_001, ""), (100_002, " \n\t "), (100_003, "one"), (100_004, "One\x0b"), (100_005, "x" * 30_000)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def got(df):
    rows = df.collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    docs = corpus(seed)
    assert got(recompress.dedup_digest(frame(spark, docs))) == brute.substring_dedup(docs)


@pytest.mark.parametrize("seed", [1, 5])
def test_substring_dedup_of_hot_stretches(spark, monkeypatch, seed):
    """All stretches are dealt to several tasks, over batches of a few rows; some rows have no id."""
    monkeypatch.setattr(recompress, "HOT", 0)
    monkeypatch.setattr(recompress, "SALTS", 3)
    docs = corpus(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    docs += [(200_000 + i, f"{i} {i} {passage} {i}") for i in range(80)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got(recompress.dedup_digest(frame(spark, docs))) == brute.substring_dedup(docs)
        nulls = spark.createDataFrame([(None, passage), (3, passage), (1, passage)], SCHEMA)
        assert sorted((r.doc_id or 0, r.n_removed) for r in recompress.dedup_digest(nulls).collect()) == [(0, 0), (1, 70), (3, 70)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, seed):
    docs = corpus(seed)
    assert got(suffixes.repeat_digest(frame(spark, docs))) == brute.suffix_dedup(docs)


@pytest.mark.parametrize("seed", [1, 4])
def test_suffix_dedup_of_hot_beginnings(spark, monkeypatch, seed):
    """All beginnings are split by the bytes around them, and into many buckets."""
    monkeypatch.setattr(suffixes, "HOT", 1)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    docs = corpus(seed)
    r = random.Random(seed)
    passage = "".join(r.choice("abcdef ") for _ in range(460))
    docs += [(200_000 + i, f"{'yz'[i % 2] * r.randint(0, 9)}{r.random()}{passage[r.randint(0, 60) : 460 - r.randint(0, 60)]}{r.random()}") for i in range(60)]
    assert got(suffixes.repeat_digest(frame(spark, docs))) == brute.suffix_dedup(docs)


def test_suffix_groups_of_many_entries():
    r = random.Random(5)
    middle = bytes(r.randrange(256) for _ in range(201))
    entries = set()
    for _ in range(60):
        left, right = r.randint(0, 199), r.randint(0, 199)
        base = [b"\x00" * 199, b"\x01" * 199]
        side = lambda n: bytes(r.choice(base)[i] for i in range(n)) if r.random() < 0.2 else r.choice(base)[:n]
        entries.add((middle + side(right), side(left)))
    group = [(s, x, 1) for s, x in sorted(entries)]
    shared = [0] + [suffixes.shared_length(a[0], b[0]) for a, b in zip(group, group[1:])]
    many = [suffixes.joined(x) for x in suffixes.repeated_strings(group, shared)]
    few, suffixes.FEW = suffixes.FEW, 10_000
    try:
        assert [suffixes.joined(x) for x in suffixes.repeated_strings(group, shared)] == many
    finally:
        suffixes.FEW = few


def test_merge_is_sorted_and_knows_shared_prefixes():
    r = random.Random(9)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 60))}) for _ in range(7)]
    heads = [suffixes.Run(suffixes.front_coded([(s, b"", 1) for s in run])) for run in runs]
    out, shared = [], []
    for run, entry, text, same in suffixes.merge_runs(heads):
        assert runs[run][entry] == text
        out.append(text)
        shared.append(same)
    assert out == sorted(x for run in runs for x in run)
    assert shared[1:] == [suffixes.shared_length(a, b) for a, b in zip(out, out[1:])]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_jaccard(spark, seed):
    docs = corpus(seed, n=200)
    assert got(jaccard.jaccard_digest(frame(spark, docs))) == brute.jaccard(docs)


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_in_blocks(spark, monkeypatch, seed):
    """All signatures are compared in blocks, and every two blocks meet."""
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 900)
    # No leaders: what links there are must come from the blocks.
    monkeypatch.setattr(jaccard, "hub_pairs", lambda shared, best=2: shared.sparkSession.createDataFrame([], "a long, b long"))
    docs = corpus(seed, n=200)
    assert got(jaccard.jaccard_digest(frame(spark, docs))) == brute.jaccard(docs)


def test_jaccard_of_a_passage_that_very_many_share(spark):
    """Over 1,500 different texts hold one passage (similarity under 0.8), and 400 are near copies of one text, but not of each other."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *(f"x{i}y{k}" for k in range(16))])) for i in range(1600)]
    base = [f"b{i}" for i in range(100)]
    rows.append((1900, " ".join(base)))
    for i in range(2000, 2400):
        w = list(base)
        for at in r.sample(range(100), 2):
            w[at] = f"e{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    out = got(jaccard.jaccard_digest(frame(spark, rows)))
    assert {c for d, (_, c) in out.items() if d >= 1900} == {1900}
    assert all(out[d] == (52, d) for d in range(1600))


@pytest.mark.parametrize("seed", [7, 8])
def test_jaccard_by_rare_shingles(spark, monkeypatch, seed):
    """All signatures count as large, so members meet under rare shingles only."""
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    monkeypatch.setattr(jaccard, "hub_pairs", lambda shared, best=2: shared.sparkSession.createDataFrame([], "a long, b long"))
    docs = corpus(seed, n=200)
    assert got(jaccard.jaccard_digest(frame(spark, docs))) == brute.jaccard(docs)


def test_rows_grow_with_the_members_of_a_signature(spark, monkeypatch):
    """Unrelated members of large signatures part before they meet, and near copies among them are found."""
    rare, met = [], []
    by_rare_shingles, in_blocks = jaccard.by_rare_shingles, jaccard.in_blocks
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "by_rare_shingles", lambda *x: rare.append(by_rare_shingles(*x)) or rare[-1])
    monkeypatch.setattr(jaccard, "in_blocks", lambda *x: met.append(in_blocks(*x)) or met[-1])
    passage, r = [f"p{i}" for i in range(40)], random.Random(3)
    counts = []
    for n in (300, 600):
        rows = [(i, " ".join([*passage, *(f"x{i}y{k}" for k in range(16))])) for i in range(n)]
        copies = r.sample(range(n), n // 20)
        rows += [(10_000 + i, rows[i][1] + " end") for i in copies]
        out = got(jaccard.jaccard_digest(frame(spark, rows)))
        assert all(c == (d - 10_000 if d >= 10_000 else d) for d, (_, c) in out.items())
        assert rare
        counts.append((sum(x.count() for x in rare), sum(x.count() for x in met)))
        rare.clear(), met.clear()
    (few, few_met), (many, many_met) = counts
    # Only the near copies have rows: at most 12 of a prefix each.
    assert few <= 12 * 2 * 15 and many <= 12 * 2 * 30 and many_met <= 3 * few_met + 100


def test_similar_compares_words():
    many = [b"%d" % i for i in range(60_000)]
    assert jaccard.similar(many, many[100:]) and not jaccard.similar(many, many[20_000:])
    r = random.Random(2)
    for _ in range(300):
        a = [r.choice([b"a", b"b"]) for _ in range(r.randint(1, 30))]
        b = list(a)
        b[r.randrange(len(b)) :] = [r.choice([b"a", b"b"]) for _ in range(r.randint(0, 6))]
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b or [b"a"]))
        assert jaccard.similar(a, b or [b"a"]) == (5 * len(x & y) >= 4 * len(x | y))


def test_one_of_each_group_with_repeated_ids(spark):
    say = lambda x: " ".join(f"{x}{i}" for i in range(40))
    near = lambda x: say(x) + " and more"
    rows = [(1, say("a")), (1, say("b")), (1, near("b")), (1, say("c")), (1, say("c")), (2, near("a")), (2, say("c")), (2, say("d")), (3, near("d")), (3, say("e")), (4, ""), (4, " "), (4, ""), (None, say("a")), (None, say("a"))]
    out = sorted(((d or 0, t) for d, t in map(tuple, jaccard.one_of_each_group(frame(spark, rows)).collect())))
    # Which of the two near copies under id 1 stays is up to their keys.
    twins = [x for x in out if x in ((1, say("b")), (1, near("b")))]
    assert len(twins) == 1
    assert out == sorted([(1, say("a")), *twins, (1, say("c")), (2, say("d")), (3, say("e")), (4, ""), (4, " "), (0, say("a")), (0, say("a"))])


def test_jaccard_signatures_meet():
    """Any two sets at or above the threshold share a signature, small and large ones alike."""
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(1500):
        size = int(r.integers(4, 40)) if r.random() < 0.7 else int(r.integers(40, 900))
        a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        lost = int(r.integers(0, max(1, len(a) // 5) + 1))
        more = int(r.integers(0, max(1, len(a) // 8) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[lost:], r.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size


@pytest.mark.parametrize("slices", [4_000_000, 300])
def test_decontamination(spark, slices):
    docs = corpus(4)
    r = random.Random(4)
    texts = [t for _, t in docs if t and len(t) > 200]
    items = [(i, " ".join(r.choice(texts).split()[5 : r.randint(8, 40)])) for i in range(25)]
    items += [(90, None), (91, ""), (92, "x"), (93, items[0][1]), (94, items[1][1].upper() + "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(frame(spark, docs), bench, max_index_words=slices).drop("doc_key")) == brute.contamination(docs, items)


def test_decontamination_of_common_prefix_words(spark, monkeypatch):
    """Very many windows with one rarest word, at every place of a window; few are tried at once."""
    monkeypatch.setattr(decontaminate, "STEP_PAIRS", 5)
    r = random.Random(8)
    items = [(k, " ".join([*(r.choice("ab") for _ in range(p)), "rare", *(r.choice("ab") for _ in range(12 - p))])) for k, p in enumerate([*range(13)] * 6)] + [(900, "rare"), (901, "rare a"), (902, "b rare")]
    docs = [(d, " ".join(r.choice(["a", "b", "rare"] if d % 2 else ["a", "b"]) for _ in range(60)) + " " + r.choice(items)[1]) for d in range(60)]
    items_table = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination_digest(frame(spark, docs), items_table)) == brute.contamination(docs, items)


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    twice = frame(spark, [(1, " ".join(f"w{i}" for i in range(200)))] * 2 + [(None, "a b c d e f"), (None, None)])
    for run in (recompress.dedup_digest, suffixes.repeat_digest, jaccard.jaccard_digest, lambda d: decontaminate.contamination_digest(d, bench)):
        assert run(none).count() == 0
        rows = run(twice).collect()
        assert len(rows) == 4
        same = [r for r in rows if r.doc_id == 1]
        assert same[0] == same[1]
        if "n_removed" in same[0]:
            assert same[0].n_removed == 0
