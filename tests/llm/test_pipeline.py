"""The pipeline against a plain version of its five stages."""

from collections import Counter, defaultdict

import pytest

from residua.llm import quality_rules, secrets
from residua.llm.queries import tokenizer_file
from tests.llm import brute


def kept_by_rules(docs):
    """docs: (doc_id, text, source). Ids that the quality rules keep."""
    lines, hosts = defaultdict(set), defaultdict(set)
    normal = lambda x: " ".join(w.lower() for w in brute.SPACE.findall(x))
    for _, text, host in docs:
        hosts[host].add(text)
        for x in (text or "").split("\n"):
            if normal(x):
                lines[host, normal(x)].add(text)
    out = set()
    for doc, text, host in docs:
        n, *_, failed = brute.quality(text)
        words = [(normal(x), len(brute.SPACE.findall(x))) for x in (text or "").split("\n")]
        gone = sum(k for x, k in words if x and len(lines[host, x]) > quality_rules.LINE_DOCS and len(lines[host, x]) > quality_rules.LINE_SHARE * len(hosts[host]))
        if not failed and gone <= quality_rules.DEPLETED_SHARE * n:
            out.add(doc)
    return out


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "secret_scans", "bpe_codec"]
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in table("documents").collect()]
    kept = kept_by_rules(docs)
    docs = [(d, t) for d, t, _ in docs if d in kept]
    groups = brute.jaccard(docs)
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    bad = brute.contamination(docs, [(r.item_id, r.text) for r in table("benchmark").collect()])
    docs = [(d, t) for d, t in docs if not bad[d][4]]
    library, scan = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), secrets.scanner()
    want = {}
    for d, t in docs:
        parts, at = [], 0
        for _, a, b in secrets.spans_in(t, scan):
            if a >= at:
                parts += [t[at:a], "[SECRET]"]
            at = max(at, b)
        want[d] = library.encode("".join([*parts, t[at:]]), add_special_tokens=False).ids
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(want.keys())
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
