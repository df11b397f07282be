"""SQL (DuckDB's dialect) that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from residua.llm import licenses, quality_rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(text: str, form: str, table: str = "documents", key: str = "doc_id") -> str:
    """w: key, word and its place i from 1."""
    return f"l AS (SELECT {key}, regexp_extract_all({text}, {form}) AS ws FROM {table}), w AS (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l)"


_RAW = "coalesce(text, '')"

OP2 = f"""WITH {_words(_RAW, _SPACE)},
g AS (SELECT *, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, word, i, n = 20 AND row_number() OVER (PARTITION BY gram ORDER BY n < 20, doc_id, i) > 1 AS later FROM g),
k AS (SELECT doc_id, word, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)"""

_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)

OP4 = f"""WITH {_words(_LOWER, _ALNUM)},
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g3,
  string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g4 FROM w),
ph(label, phrase) AS (VALUES {_VALUES(licenses.PHRASES)}),
f AS (SELECT doc_id, i - 1 AS pos, label FROM g JOIN ph ON phrase = g3 OR phrase = g4),
p AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY doc_id),
te(label, text) AS (VALUES {_VALUES(licenses.TEMPLATES)}),
tl AS (SELECT label, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM te), tw AS (SELECT DISTINCT label, unnest(ws) AS word FROM tl),
tn AS (SELECT label, len(ws) AS length, len(list_distinct(ws)) AS size FROM tl),
ok AS (SELECT doc_id, label FROM (SELECT DISTINCT doc_id, label, word FROM w JOIN tw USING (word)) JOIN tn USING (label) GROUP BY doc_id, label HAVING count(*) >= {licenses.THRESHOLD} * any_value(size) - 1e-9),
tp AS (SELECT doc_id, label, i, word FROM w JOIN tw USING (word) SEMI JOIN ok USING (doc_id, label)),
c AS (SELECT a.doc_id, a.label, a.i, count(DISTINCT b.word) / any_value(size) AS share FROM tp a JOIN tn USING (label) JOIN tp b ON b.doc_id = a.doc_id AND b.label = a.label AND b.i >= a.i AND b.i < a.i + length
  GROUP BY a.doc_id, a.label, a.i HAVING count(DISTINCT b.word) >= {licenses.THRESHOLD} * any_value(size) - 1e-9),
m AS (SELECT doc_id, max(share) AS share FROM c GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM f UNION SELECT doc_id, label FROM c) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS DOUBLE) AS score FROM l LEFT JOIN p USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP6 = f"""WITH RECURSIVE {_words(_LOWER, _SPACE)},
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE n = 5 OR (total < 5 AND i = 1)), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM z UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root < u.b),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP7 = f"""WITH {_words(_RAW, _SPACE)},
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
d AS (SELECT doc_id, i, n = 8 AND count(*) OVER (PARTITION BY doc_id, gram, n) > 1 AS twice FROM g),
v AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM d),
rp AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, unnest(string_split({_RAW}, chr(10))) AS line FROM documents),
nl AS (SELECT doc_id, source, text, line, regexp_extract_all(line, {_SPACE}) AS ws FROM ln),
x AS (SELECT doc_id, source, text, line, lower(array_to_string(ws, ' ')) AS norm, len(ws) AS k FROM nl WHERE len(ws) > 0),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM x GROUP BY doc_id),
hd AS (SELECT source, count(DISTINCT coalesce(text, chr(1))) AS docs FROM documents GROUP BY source),
bl AS (SELECT source, norm FROM x JOIN hd USING (source) GROUP BY source, norm HAVING count(DISTINCT text) > {quality_rules.LINE_DOCS} AND count(DISTINCT text) > {quality_rules.LINE_SHARE} * any_value(docs)),
lost AS (SELECT doc_id, sum(k) AS lost FROM x SEMI JOIN bl USING (source, norm) GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, len(regexp_extract_all({_RAW}, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_words, 0) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * coalesce(n_words, 0) AS base_failed, CAST(coalesce(lost, 0) AS BIGINT) AS n_boilerplate_words
  FROM documents LEFT JOIN wc USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, NOT base_failed AND n_boilerplate_words <= {quality_rules.DEPLETED_SHARE} * n_words AS kept FROM o"""

OP9 = f"""WITH {_words(_LOWER, _ALNUM)},
bl AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark), bw AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, least(len(ws), 13) AS n FROM bl),
bg AS (SELECT item_id, n, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS k FROM bw WINDOW f AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
win AS (SELECT DISTINCT item_id, n, gram FROM bg WHERE k = n), sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT n, doc_id, i, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS k FROM w, sizes WINDOW f AS (PARTITION BY n, doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
h AS (SELECT doc_id, i, win.n, item_id FROM g JOIN win ON win.n = g.n AND win.gram = g.gram WHERE k = g.n),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM h), hit AS (SELECT doc_id, count(*) AS n_hit FROM cov GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM l LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP11 = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label = r.label AS same, r.id, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER o <= 10"""

OP13 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS pos, struct_pack(r := r, x := x, w := len(regexp_extract_all(x, {_SPACE}))) AS one
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [256 + ascii(ch), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
  lambda a, b: CASE WHEN b >= 256 THEN xor(a, b - 256) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, one FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT conv_id, pos, one FROM c JOIN t USING (conv_id) WHERE pos > h),
l AS (SELECT conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list(one ORDER BY pos) AS turns FROM r GROUP BY conv_id) USING (conv_id)),
e AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM l),
g AS (SELECT list_slice(turns, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM e GROUP BY ALL),
k AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
a AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * prefix[-1].w ELSE 0 END AS own FROM g LEFT JOIN k USING (prefix)),
u AS (SELECT list_slice(prefix, 1, up) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT prefix, n_children, own, unnest(range(0, depth + 1)) AS up FROM a) GROUP BY ALL)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256 FROM a JOIN u USING (prefix) LEFT JOIN g p ON a.depth > 0 AND p.prefix = list_slice(a.prefix, 1, a.depth - 1)"""

SQL = {"op2_substring_dedup": OP2, "op4_license_scan": OP4, "op6_jaccard_join": OP6, "op7_quality_rules": OP7, "op9_decontamination": OP9, "op11_hard_negatives": OP11, "op13_conversation_trie": OP13}
