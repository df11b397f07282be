"""Quality rules on lines and words, with line frequencies across documents. DataFrame functions only.

Per document: words (runs of anything but ASCII white space), their characters, symbol
characters, lines that repeat an earlier line, and words inside 8-word windows that the
text holds twice or more. Across documents: lines are normalised (words lower-cased and
joined by single spaces) and hashed; for each host (the source column) the distinct
documents that hold a line are counted, where documents of equal text count once: copies
of a document are what deduplication is for, and would make all its lines frequent. A
line above the limit is boilerplate; a document whose text is mostly boilerplate is
depleted and goes. The documents that stay lose their boilerplate lines (keep_good).

The limit is a share of the host's distinct documents, so the rule behaves alike at
every size. The text is read once, into a narrow table of one row per document; counts
are summed map-side per (host, line, text) and then per (host, line), so a host or a
line that holds a third of all rows is spread over as many tasks as any other.

Null text: no words, so the base rules fail. Null source: a host of its own. Rows with
equal doc_id and text are one document: each of them gets the same result (where they
stand under several hosts, the lines that are boilerplate on any of these go).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.common import doc_key, free_name, stage_table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate if over this share of its host's distinct documents hold it, and over this many.
LINE_SHARE = 0.10
LINE_DOCS = 20
#: A document is depleted if over this share of its words stand in boilerplate lines.
DEPLETED_SHARE = 0.70

_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _WHITE), "")


def window_hashes(words: Column, n: Column) -> Column:
    """Hashes of all runs of WINDOW words; words is looked at once per word."""
    at = lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))
    return let(F.transform(words, lambda w: F.xxhash64(w)), at)


def words_in_repeats(hashes: Column) -> Column:
    """Words covered by windows whose hash the document holds more than once."""

    def positions(s: Column) -> Column:
        twin = lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        marked = F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), twin(x, k).alias("d")))
        return F.array_sort(F.transform(F.filter(marked, lambda x: x["d"]), lambda x: x["i"]))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = lambda p: F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
    return F.aggregate(let(let(ordered, positions), step), F.lit(0), lambda a, x: a + x)


def normal(line: Column) -> Column:
    """(hash, words) of a normalised line."""
    return let(words_of(F.lower(line)), lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("line"), F.size(w).alias("words")))


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its measures, and (hash, words) of each distinct normalised line."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    base = docs.select("doc_id", doc_key().alias("doc_key"), F.col("source").alias("host"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    n = F.size("words")
    counted = base.select(
        "doc_id", "doc_key", "host", "lines", n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.when(n >= WINDOW, window_hashes(F.col("words"), n)).alias("hashes"),
    )
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return counted.select(
        "doc_id", "doc_key", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, words_in_repeats(F.col("hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("lines", normal).alias("lines"),
    )


def boilerplate_lines(lines: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS) -> DataFrame:
    """(host, line) of the lines held by too many distinct documents of a host."""
    texts = lines.select("host", "doc_key").groupBy("host", "doc_key").count()
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    held = lines.select("host", "doc_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    frequent = held.groupBy("host", "line", "doc_key").count().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
    over = frequent.alias("f").join(hosts.alias("h"), F.col("f.host").eqNullSafe(F.col("h.host")))
    return over.where(F.col("docs") > share * F.col("host_docs")).select("f.host", "f.line")


def judged(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS, depleted: float = DEPLETED_SHARE) -> DataFrame:
    """A row per row of docs: the measures, base_failed, n_boilerplate_words, kept, and the hashes of its boilerplate lines (null: none)."""
    rows = stage_table(measured(docs), "quality")
    over = boilerplate_lines(rows, share, least)
    lines = rows.select("doc_id", "doc_key", "host", F.explode("lines").alias("x")).select("doc_id", "doc_key", "host", "x.line", "x.words").alias("l")
    lost = (
        lines.join(over.alias("o"), (F.col("l.line") == F.col("o.line")) & F.col("l.host").eqNullSafe(F.col("o.host")), "left_semi")
        .groupBy("doc_id", "doc_key", "host", "line").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
        .groupBy("doc_id", "doc_key").agg(F.max("host").alias("host"), F.sum("w").alias("lost"), F.array_sort(F.collect_set("line")).alias("over_lines"))
    )
    copies = rows.groupBy("doc_id", "doc_key").agg(F.count("*").alias("copies"))
    lost = lost.drop("host").alias("a").join(copies.alias("c"), F.col("a.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("a.doc_key") == F.col("c.doc_key")))
    lost = lost.select(F.col("a.doc_id"), F.col("a.doc_key"), (F.col("lost") / F.col("copies")).alias("lost"), "over_lines")
    r, x = rows.drop("lines").alias("r"), lost.alias("x")
    joined = r.join(x, F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.doc_key") == F.col("x.doc_key")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.col("lost"), F.lit(0.0))
    return joined.select(
        "r.doc_id", "r.doc_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.cast("long").alias("n_boilerplate_words"),
        (~failed & (gone <= depleted * F.col("n_words"))).alias("kept"), "over_lines",
    )


def quality_rules(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS, depleted: float = DEPLETED_SHARE) -> DataFrame:
    """A row per row of docs: the measures, base_failed, n_boilerplate_words and kept."""
    return judged(docs, share, least, depleted).drop("over_lines")


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).drop("doc_key")


def without_lines(text: Column, over: Column) -> Column:
    """text without the lines whose normalised hash is in over; all else stays byte by byte."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(over, normal(x)["line"])), "\n")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, and without boilerplate lines in those that stay; n_chars follows."""
    kept = judged(docs).where("kept").select("doc_id", "doc_key", "over_lines").distinct()
    key, mark = free_name(docs, "doc_key"), free_name(docs, "cut")
    d = docs.withColumn(key, doc_key()).alias("d")
    k = kept.alias("k")
    rows = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{key}") == F.col("k.doc_key")))
    cut = F.col("k.over_lines").isNotNull()
    text = F.when(cut, without_lines(F.col("d.text"), F.col("k.over_lines"))).otherwise(F.col("d.text"))
    # The number of characters is taken from the text that is left, which is cut once.
    rows = rows.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns], cut.alias(mark))
    n_chars = lambda c: F.when(F.col(mark), F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
    return rows.select(*[n_chars(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
