"""The queries that SQL can express, against DuckDB; columns of all queries."""

import pytest

from residua.llm import queries
from tests import oracle

COLUMNS = {
    1: "doc_id held_out score predicted", 2: "doc_id n_words n_removed kept_sha256", 3: "doc_id n_assign n_access n_hex base_sha256 spans",
    4: "doc_id n_words n_base first_word last_word base_labels labels score", 5: "doc_id n_tokens ids_sha256 decoded_sha256", 6: "doc_id n_shingles component_id",
    7: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 8: "doc_id n_bytes n_tokens over_limit",
    9: "doc_id n_words n_hit n_items items_sha256 contaminated", 10: "doc_id n_bytes n_removed n_spans kept_sha256",
    11: "anchor_id positive_id rank negative_id positive_score negative_score", 12: "doc_id size source_size target taken",
    13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    columns, rows = oracle.of_frame(queries.QUERIES[name](spark, sf_dir))
    want_columns, want = oracle.of_sql(oracle.connect(sf_dir), queries.SQL[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert all(oracle.close(x, y) for a, b in zip(rows, want) for x, y in zip(a, b)), next((a, b) for a, b in zip(rows, want) if not all(map(oracle.close, a, b)))


def test_one_query_for_each_operator(spark, sf_dir):
    found = {int(n[2:].split("_")[0]): q for n, q in queries.QUERIES.items()}
    assert sorted(found) == sorted(COLUMNS)
    for n, q in found.items():
        if n in (1, 3, 5, 8, 12):
            assert set(COLUMNS[n].split()) <= set(q(spark, sf_dir).columns)
