"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates (operator 3).

DataFrame operations only.  A notice is found wherever a window of as many words as its template has, and a quarter more, holds the
template's share of distinct words: however its lines are wrapped, and wherever in a line it starts or ends.  Texts are cut into cells as long as the
longest window; a block is two neighbouring cells, so that every window lies in the block of the cell in which it starts.  Templates and blocks are sets of words
in one global order, from the words that the fewest documents hold.  A block can hold a share t of template T only if it has ceil(t|T|) of its words
(all of them where it is short), so (prefix filter) one of T's first |T| - ceil(t|T|) + 1 words, (length filter) enough template words in all and
(positional filter) enough words from the shared one on, on both sides.  In the blocks that are left the windows are counted exactly.

Words that no template has never count towards an overlap; the index leaves them out.  Defined results: null text counts as
empty; without words n_words is 0, places null, labels empty and the score 0; repeated rows each get their own result;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_or_empty

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and wording of common public license notices (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


#: Templates of fewer distinct words than this must be found whole.
SHORT = 12


def words_of(col: Column | str) -> Column:
    return F.filter(F.split(ascii_lower(col), NOT_WORD), lambda w: w != "")


def words_needed(words: list[str], threshold: float) -> int:
    """A notice of few words needs them all: without the name in it, it would match other licenses' notices."""
    return len(words) if len(words) < SHORT else math.ceil(threshold * len(words) - 1e-9)


def window_words(text: str, threshold: float) -> int:
    """How many words of a text a notice may take: its template's own, with repeats, and as many more as leave the share of them at the threshold."""
    return math.ceil(sum(1 for w in re.split(NOT_WORD, text.lower()) if w) / threshold - 1e-9)


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(NOT_WORD, text.lower()) if w})


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)]))
    there = (F.size(words) >= len(parts)) & _all([F.array_contains(words, p) for p in parts])
    return F.when(there, found).otherwise(F.array().cast("array<int>"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    score is the largest share of a template found in one window (1 where a base phrase stands); blocks lists (word, template, share) of the best window
    of every template that starts in each cell of the text, word being its first template word's number.
    """
    spark = docs.sparkSession
    sets = [(i, label, template_words(text), window_words(text, threshold)) for i, (label, text) in enumerate(templates)]
    need = {i: words_needed(ws, threshold) for i, _, ws, _ in sets}
    vocabulary, least = sorted({w for _, _, ws, _ in sets for w in ws}), min(need.values())
    cell = max(span for *_, span in sets)
    may_hold = lambda words: _any([F.size(F.array_intersect(words, F.lit(ws))) >= need[i] for i, _, ws, _ in sets])

    # One pass over the texts: phrase places, and the template words of each block that has enough of one template's.
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(text_or_empty()).alias("words"))
    places = [_places(F.col("words"), p).alias(f"p{k}") for k, (p, _) in enumerate(phrases)]
    known = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    found = texts.select("doc_id", "row", "words", F.size("words").cast("long").alias("n_words"), *places, known.alias("vocab"))
    columns = [F.col(f"p{k}") for k in range(len(phrases))]
    starts = F.concat(*columns)
    placed = lambda g: F.transform(F.slice("words", (g * cell + 1).cast("int"), 2 * cell), lambda w, i: F.struct((g * cell + i).cast("int").alias("at"), F.when(w.isin(vocabulary), w).alias("w")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / cell)), lambda g: F.struct(g.cast("int").alias("cell"), F.filter(placed(g), lambda t: t["w"].isNotNull()).alias("tokens")))
    blocks = F.transform(blocks, lambda b: F.struct(b["cell"].alias("cell"), b["tokens"].alias("tokens"), F.array_distinct(F.transform(b["tokens"], lambda t: t["w"])).alias("ws")))
    blocks = F.filter(blocks, lambda b: (F.size(b["ws"]) >= least) & may_hold(b["ws"]))
    base = found.select(
        "doc_id", "row", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(c) > 0, label) for c, (_, label) in zip(columns, phrases, strict=True)])).alias("base"),
        F.when((F.size("vocab") >= least) & may_hold(F.col("vocab")), blocks).alias("blocks"), "vocab",
    )
    base = materialize(base, "license-base")

    # The global order: by number of documents, over all of them.  At most one row per template word reaches the driver.
    held = dict(base.select(F.explode("vocab").alias("w")).groupBy("w").count().collect())
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = [(i, ws, span, sorted(rank[w] for w in ws)) for i, _, ws, span in sets]
    prefix = [(token, at, i, len(ws), need[i], ws, span, ranks) for i, ws, span, ranks in index for at, token in enumerate(ranks[: len(ranks) - need[i] + 1])]
    index = F.broadcast(spark.createDataFrame(prefix, "token int, at int, template int, size int, need int, names array<string>, span int, ranks array<int>"))  # a row per prefix word

    number = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    rare = [w for w in order if any(rank[w] == p[0] for p in prefix)]
    candidates = base.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).where(F.exists("b.ws", lambda w: w.isin(rare)))
    candidates = candidates.select("row", "b.cell", "b.tokens", F.array_sort(F.transform("b.ws", lambda w: F.element_at(number, w))).alias("mine"))
    probes = candidates.select("row", "cell", "tokens", "mine", F.posexplode("mine").alias("my_at", "token"))
    pairs = probes.join(index, "token").where((F.size("mine") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at") - 1, F.size("mine") - F.col("my_at") - 1) + F.least("at", "my_at") >= F.col("need")))
    pairs = pairs.where(F.size(F.array_intersect("mine", "ranks")) >= F.col("need"))
    # the exact count: distinct words of the template from each of its words on, as far as a window reaches
    own = pairs.select("row", "cell", "template", "size", "need", "span", F.filter("tokens", lambda t: F.array_contains("names", t["w"])).alias("own"))
    within = lambda s: F.size(F.array_distinct(F.transform(F.filter("own", lambda o: (o["at"] >= s["at"]) & (o["at"] < s["at"] + F.col("span"))), lambda o: o["w"])))
    windows = F.transform(F.filter("own", lambda s: s["at"] < (F.col("cell") + 1) * cell), lambda s: F.struct(within(s).alias("n"), (-s["at"]).alias("word")))
    best = own.withColumn("best", F.array_max(windows)).where("best.n >= need")
    labels = F.create_map(*[x for i, label, _, _ in sets for x in (F.lit(i), F.lit(label))])
    hits = best.groupBy("row").agg(F.collect_set(F.struct((-F.col("best.word")).alias("word"), "template", (F.col("best.n") / F.col("size")).alias("share"))).alias("hits"))
    hits = hits.select("row", "hits", F.array_distinct(F.transform("hits", lambda h: F.element_at(labels, h["template"]))).alias("more"))

    joined = base.drop("blocks", "vocab").join(hits, "row", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
                         F.array_join(every, ",").alias("labels"), score.alias("score"), F.col("hits").alias("blocks"))
