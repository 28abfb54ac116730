"""License scan by diagonal voting (operator 1).

Every position of a text yields the hash of the words that start there. The
hashes are joined to the positions of the same word grams in the license
templates; a match votes for (template, diagonal), the diagonal being text
position minus template position. Neighbouring diagonals (a few inserted or
deleted words apart) are merged into one span, and a span is verified by the
share of the template's grams it holds, word for word, and by its length.

A template's gram has ``GRAM`` words, or all its words if it is shorter, so a
short phrase is one gram and each of its matches is a place of the phrase.
Before the join a bitmap of the templates' leading word triples drops text
positions that cannot start any gram; it has no false negatives.

Defined results: NULL text counts as empty (no words, no labels, score 0);
labels are distinct, sorted and comma-joined, empty if there are none; each
input row gives one row, repeated rows and NULL ids included; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.common import long_array, table, words_expr

#: Words of a text in lower case (fixed by the contract).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4
LEAD = 3
#: Diagonals at most this many words apart belong to one span.
MERGE_GAP = 3
#: Share of a template's grams that a span must hold, and its longest length.
MIN_COVER, MAX_STRETCH = 0.7, 1.25
#: Templates are broadcast up to this many grams, and shuffled beyond it.
MAX_BROADCAST_GRAMS = 200_000

# The base phrases and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices as the license authors word them.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software.", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
     "implied.", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies.", "isc"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version.", "gpl-3"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     "cc-by-nc"),
    ("Released under the MIT License", "mit"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
)


@dataclass(frozen=True)
class Gram:
    """One word gram of a template: its place there and the template's size."""
    gram: str
    template: int
    label: str
    base: bool
    place: int
    n_words: int
    n_grams: int
    width: int


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def template_grams(phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
                   notices: Sequence[tuple[str, str]] = NOTICES) -> list[Gram]:
    """The grams of all templates (each of ``LEAD`` words at least)."""
    out = []
    for t, (text, label) in enumerate([*phrases, *notices]):
        words = words_of(text)
        width = min(GRAM, len(words))
        if width < LEAD:
            raise ValueError(f"a template needs {LEAD} words at least: {text!r}")
        n = len(words) - width + 1
        out += [Gram(" ".join(words[i:i + width]), t, label, t < len(phrases), i, len(words), n, width)
                for i in range(n)]
    return out


def _lead_bitmap(spark: SparkSession, grams: Sequence[Gram], cells: int) -> list[int]:
    """Bits of the leading word triples, by Spark's own hash."""
    leads = sorted({tuple(g.gram.split(" ")[:LEAD]) for g in grams})
    rows = spark.createDataFrame(leads, [f"w{i}" for i in range(LEAD)]).select(
        F.pmod(F.xxhash64(*[f"w{i}" for i in range(LEAD)]), F.lit(cells)).alias("cell")).collect()
    bits = [0] * (cells >> 6)
    for r in rows:
        bits[r.cell >> 6] |= 1 << (r.cell & 63)
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def _candidates(words: Column, bitmap: Column, cells: int) -> Column:
    """Word positions whose leading triple may start a template gram."""
    def may_start(i: Column) -> Column:
        lead = [F.get(words, i + j) for j in range(LEAD)]
        cell = F.pmod(F.xxhash64(*lead), F.lit(cells))
        block = F.get(bitmap, F.shiftright(cell, 6).cast("int"))
        return F.call_function("shiftright", block, cell.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    last = F.size(words) - LEAD
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), may_start)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
         notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """Spans of license templates: one row per (input row, template span),
    and one with NULL template for a row without any.

    Columns: row, doc_id, n_words, template, label, base, first_word,
    last_word (start of the first and last matching gram), places (matching
    grams), cover (share of the template's grams), verified.
    """
    spark = docs.sparkSession
    grams = template_grams(phrases, notices)
    cells = 1 << 12
    while cells < 128 * len(grams) and cells < 1 << 18:
        cells <<= 1
    widths = sorted({g.width for g in grams})

    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        words_expr(F.lower("text"), WORD).alias("words"))
    found = words.select("row", "doc_id", F.size("words").alias("n_words"), "words",
                         _candidates(F.col("words"), long_array(_lead_bitmap(spark, grams, cells)), cells).alias("at"))
    def grams_of(width: int) -> Column:
        return F.transform("at", lambda i: F.struct(
            i.alias("pos"), F.concat_ws(" ", F.slice(F.col("words"), i + 1, F.lit(width))).alias("gram")))

    each = F.flatten(F.array(*[grams_of(w) for w in widths]))
    grams_at = found.select("row", "doc_id", "n_words", F.explode_outer(each).alias("g")).select(
        "row", "doc_id", "n_words", "g.pos", "g.gram", F.xxhash64("g.gram").alias("hash"))
    places = spark.createDataFrame(
        [(g.gram, g.template, g.label, g.base, g.place, g.n_words, g.n_grams, g.width) for g in grams],
        "gram string, template int, label string, base boolean, place int, t_words int, t_grams int, width int"
    ).withColumn("hash", F.xxhash64("gram"))
    if len(grams) <= MAX_BROADCAST_GRAMS:
        places = F.broadcast(places)
    votes = grams_at.join(places, ["hash", "gram"], "left").withColumn("diagonal", F.col("pos") - F.col("place"))

    per_template = ["row", "doc_id", "n_words", "template", "label", "base", "t_words", "t_grams", "width"]
    diagonals = votes.groupBy(*per_template, "diagonal").agg(
        F.count("place").alias("votes"), F.min(F.when(F.col("place").isNotNull(), F.col("pos"))).alias("lo"),
        F.max(F.when(F.col("place").isNotNull(), F.col("pos"))).alias("hi"))
    # a phrase of one gram has no neighbours: each diagonal is a place of its own
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    islands = diagonals.withColumn("new", F.when((gap <= MERGE_GAP) & (F.col("t_grams") > 1), 0).otherwise(1)) \
        .withColumn("span", F.sum("new").over(along))
    spans = islands.groupBy(*per_template, "span").agg(
        F.sum("votes").alias("places"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"))
    cover = F.least(F.lit(1.0), F.col("places") / F.col("t_grams"))
    length = F.col("last_word") - F.col("first_word") + F.col("width")
    return spans.select(
        "row", "doc_id", "n_words", "template", "label", "base", "first_word", "last_word", "places",
        cover.alias("cover"),
        F.coalesce((cover >= MIN_COVER) & (length <= MAX_STRETCH * F.col("t_words") + MERGE_GAP),
                   F.lit(False)).alias("verified"))


def label_table(docs: DataFrame) -> DataFrame:
    """One row per input row: base places and labels, all labels, score."""
    ok, base = F.col("verified"), F.col("verified") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return scan(docs).groupBy("row", "doc_id", F.col("n_words").cast("bigint").alias("n_words")).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("last_word"))).cast("bigint").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(ok, F.col("label"))).alias("labels"),
        F.coalesce(F.round(F.max(F.when(ok, F.col("cover"))), 6), F.lit(0.0)).alias("score"),
    ).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_table(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",\n  ".join(
        f"('{g.gram}', {g.template}, '{g.label}', {str(g.base).lower()}, {g.place}, {g.n_words}, {g.n_grams}, {g.width})"
        for g in template_grams())
    leads = ", ".join(f"lead(w, {i}) OVER (PARTITION BY row ORDER BY pos) AS w{i}" for i in range(1, GRAM))
    grams = " UNION ALL ".join(
        f"SELECT row, pos, {n} AS width, concat_ws(' ', w, {', '.join(f'w{i}' for i in range(1, n))}) AS gram "
        f"FROM leads WHERE w{n - 1} IS NOT NULL" for n in sorted({g.width for g in template_grams()}))
    return rf"""
WITH templates(gram, template, label, base, place, t_words, t_grams, width) AS (VALUES
  {rows}),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
each AS (SELECT row, unnest(words) AS w, unnest(range(len(words))) AS pos FROM docs),
leads AS (SELECT row, pos, w, {leads} FROM each),
grams AS ({grams}),
diagonals AS (
  SELECT row, template, label, base, t_words, t_grams, t.width, pos - place AS diagonal,
         count(*) AS votes, min(pos) AS lo, max(pos) AS hi
  FROM grams g JOIN templates t ON g.gram = t.gram AND g.width = t.width
  GROUP BY ALL),
gaps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER along <= {MERGE_GAP} AND t_grams > 1 THEN 0 ELSE 1 END AS new
  FROM diagonals WINDOW along AS (PARTITION BY row, template ORDER BY diagonal)),
islands AS (
  SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM gaps),
spans AS (
  SELECT row, template, label, base, t_words, t_grams, width, span,
         least(1.0::DOUBLE, sum(votes)::DOUBLE / t_grams) AS cover, min(lo) AS first_word, max(hi) AS last_word
  FROM islands GROUP BY row, template, label, base, t_words, t_grams, width, span),
verified AS (
  SELECT * FROM spans
  WHERE cover >= {MIN_COVER} AND last_word - first_word + width <= {MAX_STRETCH} * t_words + {MERGE_GAP})
SELECT doc_id, len(words)::BIGINT AS n_words,
       count(*) FILTER (WHERE base) AS n_base,
       min(first_word) FILTER (WHERE base) AS first_word,
       max(last_word) FILTER (WHERE base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(round(max(cover), 6), 0.0) AS score
FROM docs LEFT JOIN verified USING (row)
GROUP BY row, doc_id, words
"""


SQL = _sql()
