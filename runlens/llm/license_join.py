"""License scans by an exact set-similarity join (DataFrame functions only).

Text blocks are the lines of a text and, so that a notice wrapped over lines lies in one
too, windows over the whole text's words; a line of more words than a window is cut the
same way.  Windows have ``BLOCK`` words, or twice the longest template's if that is more,
and overlap by half, so that every run of a template's length lies in one block.  A block
matches a template if it holds at least ``CONTAINMENT`` of the template's distinct words.
All matches are found:

1. the template words are counted over all texts, and ordered from rare to common;
   a text goes on only if its words as a whole hold one of the prefix words of a template
   and ``need`` words of it, since no block can hold more than its text (blocks are cut of
   these texts only);
2. prefix filter: a match must hold one of the rarest ``|T| - need + 1`` words of T, so
   only blocks with such a word go on;
3. length filter: a block must have ``need`` template words at all;
4. positional filter: behind the matching word, both sides must still have enough words;
5. the survivors' overlaps are counted.

Blocks are compared with templates only, never with each other; what is shuffled is the
matches.  The template list is a parameter of bounded size.

Base places are phrases whose words stand consecutively.  Defined results: null text ->
empty; no place -> null first_word and last_word, empty labels, score 0.  Score is 1 if a
phrase stands in the text, else the largest containment found, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import materialise

# Phrases and their labels, and notice texts with the labels they add.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
MAX_TEMPLATES = 1000
BLOCK, CONTAINMENT = 64, 0.9
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_GAP_IN_LINE = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _lower(text: Column) -> Column:
    # beyond A-Z this turns letters into letters only, so words and phrases are the same
    return F.lower(F.coalesce(text, F.lit("")))


def _template_run(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_words(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """Number, label and distinct words of each template."""
    out = []
    for i, (label, text) in enumerate(templates):
        out.append((i, label, sorted(set(_template_run(text)))))
    return out


def need(size: int, containment: float) -> int:
    """Smallest overlap that reaches the containment."""
    return max(1, -(-round(size * containment * 1e6) // 1_000_000))


def window_words(templates=TEMPLATES, block: int | None = None) -> int:
    """Words of a window: the given number, or as many as the longest template asks for."""
    least = 2 * max((len(_template_run(text)) for _, text in templates), default=0)
    if block is not None and block < least:
        raise ValueError(f"windows of {block} words do not hold every template: at least {least}")
    return block or max(BLOCK, least)


def row_name(*columns: str) -> Column:
    """Two 64-bit hashes of a row; rows equal in all columns share it, and their matches."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("h2"))


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """key (of id and text) and distinct words of every text block."""
    clean = F.regexp_replace(_lower(F.col("text")), _GAP_IN_LINE, " ")
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike("[^ ]"))
    # a text of one line has no other windows than that line's
    whole = F.when(F.size(lines) > 1, F.array(F.array_join(lines, " "))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(row_name("doc_id", "text").alias("key"), F.explode(F.concat(lines, whole)).alias("line"))
    rows = rows.select("key", F.array_remove(F.split("line", " "), "").alias("words"))
    step = block // 2
    last = F.ceil(F.greatest(F.size("words") - block, F.lit(0)) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i * step + 1, block))
    rows = rows.filter(F.size("words") > 0).select("key", F.explode(F.when(last > 0, cut).otherwise(F.array("words"))).alias("words"))
    return rows.select("key", F.array_distinct("words").alias("words"))


def possible(docs: DataFrame, known: list[str], prefix: list[str], sets: list[tuple[list[str], int]]) -> DataFrame:
    """The rows whose whole text holds enough words of some template (words, need): a hashed
    intersection with the template words, then the prefix words, then each template."""
    least = min((n for _, n in sets), default=1)
    words = F.split(F.regexp_replace(_lower(F.col("text")), _GAP, " "), " ")
    rows = docs.withColumn("__has", F.array_intersect(words, F.array(*map(F.lit, known))))
    rows = rows.filter((F.size("__has") >= least) & F.arrays_overlap("__has", F.array(*map(F.lit, prefix))))
    templates = F.array(*[F.struct(F.array(*map(F.lit, ws)).alias("ws"), F.lit(n).alias("need")) for ws, n in sets])
    return rows.filter(F.exists(templates, lambda t: F.size(F.array_intersect("__has", t["ws"])) >= t["need"])).drop("__has")


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words from rare to common, counted over all texts (a word that never
    occurs comes first, equal counts by code point)."""
    words = F.explode(F.split(F.regexp_replace(_lower(F.col("text")), _GAP, " "), " ")).alias("word")
    counts = docs.select(words).filter(F.col("word").isin(vocabulary)).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, block: int | None = None) -> DataFrame:
    """key, label, containment of every matching pair of text block and template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates, got {len(templates)}")
    block = window_words(templates, block)
    spark = docs.sparkSession
    sets = template_words(templates)
    order = word_order(docs, sorted({w for _, _, ws in sets for w in ws}))
    rank = {w: i for i, w in enumerate(order)}
    index = []  # one row per prefix word of a template
    for i, label, ws in sets:
        ranks = sorted(rank[w] for w in ws)
        n = need(len(ranks), containment)
        index += [(r, i, label, p, n, ranks) for p, r in enumerate(ranks[: len(ranks) - n + 1], start=1)]
    schema = "rank int, template int, label string, p int, need int, ranks array<int>"
    index_df = F.broadcast(spark.createDataFrame(index, schema))  # bounded by MAX_TEMPLATES
    least = min((r[4] for r in index), default=1)
    known, prefix = F.array(*map(F.lit, order)), F.array(*map(F.lit, sorted({r[0] for r in index})))
    ranks_of = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    first = sorted({order[r[0]] for r in index})
    some = possible(docs, order, first, [(ws, need(len(ws), containment)) for _, _, ws in sets])
    rows = blocks(some, block).withColumn("words", F.array_intersect("words", known)).filter(F.size("words") >= least)
    rows = rows.withColumn("ranks_b", F.array_sort(F.transform("words", lambda w: F.element_at(ranks_of, w)))).drop("words")
    rows = rows.withColumn("rank", F.explode(F.array_intersect("ranks_b", prefix)))
    rows = rows.join(index_df, "rank").filter(F.size("ranks_b") >= F.col("need"))
    q = F.array_position("ranks_b", F.col("rank")).cast("int")
    before = F.size(F.array_intersect(F.slice("ranks_b", 1, q), F.slice("ranks", 1, F.col("p"))))
    bound = before + F.least(F.size("ranks_b") - q, F.size("ranks") - F.col("p"))
    rows = rows.filter(bound >= F.col("need"))
    overlap = F.size(F.array_intersect("ranks_b", "ranks"))
    return rows.filter(overlap >= F.col("need")).select("key", "label", (overlap / F.size("ranks")).alias("containment"))


def base_places(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and the array __base of labels."""
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(_lower(F.col("text")), _GAP, " ")), F.lit(" "))
    any_phrase = "(?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"
    d = docs.withColumn("__line", line)
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1).cast("long")
    d = d.withColumn("n_words", F.when(F.col("__line") == "  ", F.lit(0).cast("long")).otherwise(spaces(F.col("__line"))))
    d = d.withColumn("n_base", F.regexp_count("__line", F.lit("(?<= )" + any_phrase)).cast("long"))
    before_first = F.regexp_extract("__line", "(?s)^(.*? )" + any_phrase, 1)
    before_last = F.regexp_extract("__line", "(?s)^(.* )" + any_phrase, 1)
    d = d.withColumn("first_word", F.when(F.col("n_base") > 0, spaces(before_first)))
    d = d.withColumn("last_word", F.when(F.col("n_base") > 0, spaces(before_last)))
    found = [F.when(F.col("__line").contains(f" {p} "), F.lit(label)) for p, label in sorted(PHRASES, key=lambda x: x[1])]
    return d.withColumn("__base", F.array_compact(F.array(*found))).drop("__line")


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every
    row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", "text")
    found = matches(own, templates, containment).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = materialise(found.withColumnRenamed("key", "__key"), "license-matches")
    rows = base_places(own.withColumn("__k", row_name("doc_id", "text"))).drop("text")
    rows = rows.join(found, F.col("__k") == F.col("__key"), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat("__base", more)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same result in DuckDB: every block (of lines and of whole texts) against every template, word by word."""
    rows = ", ".join(f"({i}, '{label}', {ws!r}, {need(len(ws), CONTAINMENT)})" for i, label, ws in template_words())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    at = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1 : i + {len(p.split())}], ' ') = '{p}')) AS i FROM d"
        for p, label in PHRASES
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM documents),
template(id, label, ws, need) AS (VALUES {rows}),
own AS (SELECT r, regexp_extract_all(unnest(string_split(t, chr(10))), '{word}') AS lw FROM d),
line AS (
  SELECT r, lw FROM own WHERE len(lw) > 0
  UNION ALL SELECT r, w FROM d WHERE r IN (SELECT r FROM own WHERE len(lw) > 0 GROUP BY r HAVING count(*) > 1)),
block AS (
  SELECT r, lw[k * {BLOCK // 2} + 1 : k * {BLOCK // 2} + {BLOCK}] AS bw
  FROM (SELECT r, lw, unnest(range(CAST(ceil(greatest(len(lw) - {BLOCK}, 0) / {BLOCK // 2}) AS BIGINT) + 1)) AS k FROM line WHERE len(lw) > 0)),
hit AS (
  SELECT r, label, len(list_intersect(ws, bw)) / len(ws) AS c FROM block, template
  WHERE len(list_intersect(ws, bw)) >= need),
best AS (SELECT r, max(c) AS best, list(DISTINCT label) AS more FROM hit GROUP BY r),
place AS ({at}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
