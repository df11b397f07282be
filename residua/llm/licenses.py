"""License scan: phrases, and an exact set-similarity join of text blocks with templates. DataFrame functions only.

Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII characters.

Phrases: a label's phrase is found wherever its words stand consecutively.

Templates: a text meets a template if a window of as many consecutive words as the
template has, over line breaks, holds at least THRESHOLD of the template's distinct
words (a shorter text is one window). The join is exact:

* the templates' words are ordered by how many documents hold them, rarest first (one
  pass over all texts, counted map-side; as many counts as the templates have words);
* a window that holds `need` of a template's words holds one of its first
  size - need + 1 words in that order, so only texts with such a prefix word go on
  (an IN filter inside the scan, then an equi join on the word);
* length filter: texts with fewer than `need` of the template's words go;
* positional filter: a window begins with a word of the template, and the `need`-th
  of these from there must lie inside it;
* what remains is verified by the distinct words in the window.

The templates' side of the join is broadcast, at most MAX_TEMPLATE_WORDS words of it at a
time; more templates are taken in as many slices as that needs. Texts are never shuffled,
only the few pairs that are verified.

Null text is empty: no words, no labels, score 0. Rows with equal doc_id and text are
one document: each of them gets the same result. score is the largest containment of
any template, or 1 where a phrase was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.common import doc_key
from residua.llm.quality_rules import let

PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Notices of well-known public licenses, by label.
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.8
#: Most template words that one broadcast or one IN filter holds.
MAX_TEMPLATE_WORDS = 50_000

_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: Column) -> Column:
    """Words joined, led and followed by single spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(ascii_lower(text), _BREAKS, " "), "^ | $", ""), F.lit(" "))


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, counted in words from 0."""
    parts = phrase.split()
    wanted = F.array(*map(F.lit, parts))
    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: F.slice(words, i + 1, len(parts)) == wanted)


def template_words(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per template: label, words rarest first, need, prefix, and its length in words."""
    spark = docs.sparkSession
    given = spark.createDataFrame(list(templates), "label string, text string").select("label", F.array_remove(F.split(spaced(F.col("text")), " "), "").alias("words"))
    given = given.select("label", F.size("words").alias("length"), F.array_distinct("words").alias("words"))
    # Templates are a parameter, so they are on the driver anyway.
    vocabulary = sorted({w for r in given.collect() for w in r.words})
    distinct = F.array_distinct(F.split(spaced(F.col("text")), " "))
    if len(vocabulary) <= MAX_TEMPLATE_WORDS:
        held = docs.select(F.explode(F.filter(distinct, lambda w: w.isin(vocabulary))).alias("word"))
    else:
        held = docs.select(F.explode(distinct).alias("word")).join(given.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
    counts = held.groupBy("word").agg(F.count("*").alias("docs"))
    ranked = given.select("label", "length", F.explode("words").alias("word")).join(counts, "word", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word")))
    words = ranked.groupBy("label").agg(F.transform(order, lambda x: x["word"]).alias("words"), F.max("length").alias("length"))
    need = F.ceil(F.size("words") * F.lit(threshold) - 1e-9).cast("int")
    return words.select("label", "words", need.alias("need"), F.slice("words", 1, F.size("words") - need + 1).alias("prefix"), "length")


def slices(templates: list, most: int) -> list[list]:
    """Runs of templates of about `most` words each; one at least."""
    out, size = [[]], 0
    for t in templates:
        if out[-1] and size + len(t.words) > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t.words)
    return out


def most_in_window(at: Column, length: Column, need: Column) -> Column:
    """Most distinct words in a window of `length` words, null if under `need`. at: the template's words in the text, with their places i."""
    reached = lambda k: F.coalesce(F.get(at, k + need - 1)["i"] - F.get(at, k)["i"] < length, F.lit(False))
    starts = F.filter(F.transform(at, lambda x, k: F.struct(x["i"].alias("i"), k.alias("k"))), lambda x: reached(x["k"]))
    inside = lambda x: F.filter(F.slice(at, x["k"] + 1, length), lambda y: y["i"] < x["i"] + length)
    sizes = F.transform(starts, lambda x: F.size(F.array_distinct(F.transform(inside(x), lambda y: y["word"]))))
    return F.array_max(F.filter(sizes, lambda n: n >= need))


def matching_texts(docs: DataFrame, templates: list) -> DataFrame:
    """doc_id, doc_key, label and containment of every text that meets a template."""
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    first = sorted({w for t in templates for w in t.prefix})
    schema = "word string, label string, at int, need int, template array<string>, length int"
    prefixes = spark.createDataFrame([(w, t.label, i, t.need, t.words, t.length) for t in templates for i, w in enumerate(t.prefix)], schema)
    # Places only matter by their differences: an empty string before the first word or after the last changes none.
    words = F.split(ascii_lower(F.coalesce("text", F.lit(""))), _BREAKS)
    held = let(words, lambda ws: F.struct(ws.alias("words"), F.filter(F.array_distinct(ws), lambda w: w.isin(vocabulary)).alias("held")))
    # Filtered inside the generator, so that the words of a text are cut once.
    least = min((t.need for t in templates), default=0)
    passing = F.filter(F.array(held), lambda x: (F.size(x["held"]) >= least) & F.exists(x["held"], lambda w: w.isin(first)))
    rows = docs.select("doc_id", doc_key().alias("doc_key"), F.explode(passing).alias("x"))
    places = F.filter(F.transform("x.words", lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda y: y["word"].isin(vocabulary))
    rows = rows.select("doc_id", "doc_key", F.col("x.held").alias("held"), places.alias("places"))
    pairs = rows.select("doc_id", "doc_key", "held", "places", F.explode(F.filter("held", lambda w: w.isin(first))).alias("word")).join(F.broadcast(prefixes), "word")
    # Once for each template: by the first of its words that the text holds.
    is_first = ~F.arrays_overlap(F.slice("template", 1, F.col("at")), F.col("held"))
    pairs = pairs.where(is_first & (F.size(F.array_intersect("template", "held")) >= F.col("need")))
    own = F.filter("places", lambda y: F.array_contains("template", y["word"]))
    both = pairs.select("doc_id", "doc_key", "label", F.size("template").alias("size"), let(own, lambda at: most_in_window(at, F.col("length"), F.col("need"))).alias("both"))
    return both.where("both is not null").select("doc_id", "doc_key", "label", (F.col("both") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = None
    for part in slices(template_words(docs, templates, threshold).collect(), MAX_TEMPLATE_WORDS):
        some = matching_texts(docs, part)
        found = some if found is None else found.unionByName(some)
    found = found.groupBy("doc_id", "doc_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    line = spaced(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", doc_key().alias("doc_key"), line.alias("line"))
    any_phrase = F.lit(False)
    for _, p in phrases:
        any_phrase |= F.contains(F.col("line"), F.lit(f" {p} "))
    n_words = F.when(F.length("line") <= 2, 0).otherwise(F.length("line") - F.length(F.translate("line", " ", "")) - 1)

    def labelled(words: Column, label: str, phrase: str) -> Column:
        found = F.when(F.size(words) >= len(phrase.split()), places(words, phrase)).otherwise(F.array().cast("array<int>"))
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    def all_places(words: Column) -> Column:
        return F.concat(*[labelled(words, label, phrase) for label, phrase in phrases])

    at = F.when(any_phrase, let(F.array_remove(F.split("line", " "), ""), all_places))
    rows = rows.select("doc_id", "doc_key", n_words.cast("long").alias("n_words"), at.alias("at"))
    r, x = rows.alias("r"), found.alias("x")
    rows = r.join(x, F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.doc_key") == F.col("x.doc_key")), "left").select("r.*", "more", "containment")
    base = F.coalesce(F.array_distinct(F.transform("at", lambda x: x["label"])), F.array().cast("array<string>"))
    n_base = F.coalesce(F.size("at"), F.lit(0))
    return rows.select(
        "doc_id", "n_words", F.when(n_base > 0, n_base).otherwise(0).cast("long").alias("n_base"),
        F.array_min(F.transform("at", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("at", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
