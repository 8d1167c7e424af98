"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of as many words as the template has, across line breaks: license
headers are wrapped. A template is found in a block that holds at least `containment` of the template's
distinct words; a short one also needs the word that tells it from other licenses. Words are ordered by how many documents hold them, rarest first; a block that shares
`need` words with a template shares one of the template's first (size - need + 1) words, so only those
are joined on. Blocks with too few template words (length filter) and pairs whose first shared word
stands too late in the block's order to reach `need` (positional filter) go before the exact count.
Windows are made only of texts that hold `need` words of the template at all, and only where one starts
at a template word: any other holds no more than the next that does.

Templates are a fixed parameter, so their index is the one small side that may be broadcast.

Defined cases: a null text is empty; an empty text has no words and no label; equal rows get equal
results; a null doc_id is an id like others; an empty table gives an empty table; other columns are
not read. Very long texts are scanned whole; of templates that match equally well all labels stand, in order.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences that license texts and notices hold, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
CONTAINMENT = 0.8
#: A template of at most so many distinct words is found only with those of these words that it holds: without them the rest is any license's.
SHORT, TELLING = 8, ("apache", "mit", "nc")


def template_run(text: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(WORD, lowered)


def template_words(text: str) -> list[str]:
    return sorted(set(template_run(text)))


#: Blocks of a text: the template vocabulary in each, and the template that a window is for (-1 for a line, which is for all).
BLOCKS = "array<struct<of: int, b: array<string>>>"


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), 0)


def _phrase_at(words: Column, phrase: str, i: Column) -> Column:
    parts = phrase.split()
    found = F.get(words, i) == parts[0]
    for k, p in enumerate(parts[1:], 1):
        found = found & (F.get(words, i + k) == p)
    return F.coalesce(found, F.lit(False))


def prepare(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One pass over the texts: base columns, and per block the template vocabulary in it where it may suffice. Staged, without texts."""
    sets = [template_words(t) for _, t in templates]
    vocab = F.array(*[F.lit(w) for w in sorted(set().union(*map(set, sets)))])
    needs = [ceil(containment * len(s) - 1e-9) for s in sets]
    least = min(needs)
    text = text_or_empty("text")
    d = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), ascii_lower(text).alias("lowered"))
    d = d.withColumn("words", words_of(F.col("lowered")))
    d = d.withColumn("known", F.array_intersect("words", vocab))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    d = d.withColumn("labels", F.array_compact(F.array(*[F.when(joined.contains(f" {p} "), F.lit(label)) for p, label in phrases.items()])))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _any(_phrase_at(F.col("words"), p, i) for p in phrases))
    d = d.withColumn("at", F.when(F.size("labels") > 0, places).otherwise(F.array().cast("array<int>")))
    lines = F.filter(F.transform(F.split("lowered", "\n"), lambda b: F.array_intersect(words_of(b), vocab)), lambda b: F.size(b) >= least)
    wrapped = F.col("lowered").contains("\n")
    windows = [_windows(t, s, len(template_run(text)), need, wrapped) for t, ((_, text), s, need) in enumerate(zip(templates, sets, needs))]
    blocks = F.concat(F.transform(lines, lambda b: F.struct(F.lit(-1).alias("of"), b.alias("b"))), *windows)
    return stage(d.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_sort("labels").alias("base"), "known", F.when(F.size("known") >= least, blocks).otherwise(F.array().cast(BLOCKS)).alias("blocks"),
    ), "licenses")


def _windows(template: int, t_words: list[str], length: int, need: int, wrapped: Column) -> Column:
    """The template's words in each window of its length that holds enough of them, distinct."""
    own = F.array(*[F.lit(w) for w in t_words])
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(own, F.get("words", i)))
    sets = F.filter(F.transform(starts, lambda i: F.array_intersect(own, F.slice("words", i + 1, F.lit(length)))), lambda b: F.size(b) >= need)
    found = F.transform(F.array_distinct(sets), lambda b: F.struct(F.lit(template).alias("of"), b.alias("b")))
    return F.when(wrapped & (F.size(F.array_intersect("known", own)) >= need), found).otherwise(F.array().cast(BLOCKS))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def template_join(prepared: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """key, block, label, template, overlap, containment of every block that reaches the threshold; told: whether it holds what tells a short template from others."""
    spark = prepared.sparkSession
    sets = [template_words(t) for _, t in templates]
    counts = dict(prepared.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect())  # one row a template word
    order = {w: r for r, w in enumerate(sorted(set().union(*map(set, sets)), key=lambda w: (counts.get(w, 0), w)))}
    index = []
    for t, ((label, _), words) in enumerate(zip(templates, sets)):
        ranked, need = sorted(words, key=order.get), ceil(containment * len(words) - 1e-9)
        telling = [w for w in words if w in TELLING and len(words) <= SHORT]
        index += [(ranked[p], p, t, label, ranked, len(ranked), need, telling) for p in range(len(ranked) - need + 1)]
    prefix = spark.createDataFrame(index, "word string, place int, template int, label string, t_words array<string>, t_size int, need int, telling array<string>")
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    blocks = prepared.select("key", F.posexplode("blocks").alias("block", "x")).select("key", "block", "x.of", "x.b")
    blocks = blocks.withColumn("b", F.transform(F.array_sort(F.transform("b", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"]))
    pairs = blocks.select("key", "block", "of", "b", F.posexplode("b").alias("at", "word")).join(F.broadcast(prefix), "word").where("of = -1 OR of = template")
    # positional filter: after its first shared word a pair can share no more than what follows on either side
    pairs = pairs.where(1 + F.least(F.size("b") - F.col("at") - 1, F.col("t_size") - F.col("place") - 1) >= F.col("need"))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("b", "t_words"))).where(F.col("overlap") >= F.col("need"))
    return pairs.select("key", "block", "label", "template", "overlap", (F.col("overlap").cast("double") / F.col("t_size")).alias("containment"), (F.size(F.array_except("telling", "b")) == 0).alias("told")).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best evidence: 1 for a phrase, else the largest containment found, else 0)."""
    prepared = prepare(docs, templates, phrases, containment)
    found = template_join(prepared, templates, containment).where("told").groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    d = prepared.drop("known", "blocks").join(found, "key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
