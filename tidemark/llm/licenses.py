"""License scans by diagonal voting: where a text runs along a license notice, though words of it are changed or missing.

1. Each template is a list of words; its k-grams (the whole of a template of up to k words) are rows (hash, template,
   position, words), and the rolling k-gram hashes of all texts join them in Spark. A match of a hash counts if its words match.
2. A match at a text's word p and a template's word t votes for the diagonal p - t. Votes are added up by diagonal.
3. Diagonals near each other, as inserted or missing words leave them, are one span.
4. A span is verified by the share of its template's words that its matches cover.

Base phrases are templates without tolerance: each of their places is a span of its own, covered whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, cut, rows_up_to, shingle_hashes
from tidemark.llm.tokens import LETTERS, gathered, translated

#: Words of a gram; matches are looked for by so many at once.
K = 5
#: Percentage of a template's words that a span has to cover.
PERCENT = 75
#: A span's diagonals are no farther apart than one in so many of the template's words.
SLACK = 4
#: Words of a text that a row of grams takes.
CHUNK = 512
#: Grams of all templates up to which they are broadcast (about 150 bytes each).
MOST_BROADCAST = 100_000

# The phrases of the contract, and the usual notices of well-known licenses.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


DEFAULT = [Template(*x, True) for x in PHRASES] + [Template(*x) for x in NOTICES]


def words_of(texts: list[str]) -> tuple[Words, pa.Array]:
    words = Words(translated(pa.array(texts, pa.large_string()), LETTERS))
    return words, gathered(words.bytes, words.starts, words.ends)


def template_grams(templates: list[Template], k: int) -> tuple[list[tuple], list[int]]:
    """Rows (hash, template, at, gram, size, gap, label, base), and the lengths of grams that occur. A template without words has none."""
    words, texts = words_of([t.text for t in templates])
    hashes, rows = words.hashes(), []
    for number, (t, a, b) in enumerate(zip(templates, words.first[:-1].tolist(), words.first[1:].tolist())):
        m = min(k, b - a)
        gap = 0 if t.base else (b - a) // SLACK
        rows += [(h, number, i, texts[a + i : a + i + m].to_pylist(), b - a, gap, t.label, t.base) for i, h in enumerate(shingle_hashes(hashes[a:b], m).view(np.int64).tolist())] if m else []
    return rows, sorted({len(r[3]) for r in rows})


GRAMS = "hash long, template int, at int, gram array<string>, size int, gap int, label string, base boolean"


def gram_batches(lengths: list[int], chunk: int):
    """From rows (digest, text), rows of up to `chunk` words each: where they start, the hashes of the grams that start there, by length, and the words."""
    longest = max(lengths)

    def run(batches):
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                words = Words(translated(text, LETTERS))
                n = len(words.starts)
                hashes, grams = words.hashes(), np.zeros((len(lengths), n), np.int64)
                for i, m in enumerate(lengths):
                    found = shingle_hashes(hashes, m).view(np.int64)
                    grams[i, : len(found)] = found
                cuts = [(doc, a, min(a + chunk, end), min(a + chunk + longest - 1, end), first) for doc, (first, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())) for a in range(first, end, chunk)]
                if not cuts:
                    continue
                doc, a, b, to, first = np.array(cuts).T
                at = np.concatenate([np.arange(x, y) for x, y in zip(a, to)])
                ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(doc)),
                        pa.array(a - first, pa.int64()),
                        pa.ListArray.from_arrays(ends((b - a) * len(lengths)), pa.array(np.concatenate([grams[:, x:y].ravel() for x, y in zip(a, b)]))),
                        pa.ListArray.from_arrays(ends(to - a), gathered(words.bytes, words.starts[at], words.ends[at])),
                    ],
                    names=["digest", "start", "hashes", "words"],
                )

    return run


def with_digest(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def license_spans(docs: DataFrame, templates: list[Template] = DEFAULT, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """digest (SHA-256 of the text), template, label, base, start, length (in words) and share of each span of any text.

    All spans that have a vote are given, with the share of the template's words that they cover; see licenses() for what is
    accepted. Texts that are equal have their spans once. Null and wordless texts, an empty table and templates without
    words give none.
    """
    spark = docs.sparkSession
    rows, lengths = template_grams(templates, k)
    known = spark.createDataFrame(rows, GRAMS)
    if not rows:
        return known.selectExpr("cast(null as binary) as digest", "template", "label", "base", "cast(at as long) as start", "cast(size as long) as length", "cast(0 as double) as share")
    if len(rows) <= MOST_BROADCAST:
        known = F.broadcast(known)
    grams = with_digest(docs).mapInArrow(gram_batches(lengths, chunk), "digest binary, start long, hashes array<long>, words array<string>")
    grams = grams.select("digest", "start", "words", (F.size("hashes") / len(lengths)).cast("int").alias("n"), F.posexplode("hashes").alias("i", "hash"))
    matches = grams.join(known, (grams["hash"] == known["hash"]) & (F.slice("words", F.col("i") % F.col("n") + 1, F.size("gram")) == F.col("gram")))
    votes = matches.select("digest", "template", "at", (F.col("start") + F.col("i") % F.col("n") - F.col("at")).alias("diagonal"))
    diagonals = votes.groupBy("digest", "template", "diagonal").agg(F.collect_set("at").alias("ats"))
    # A template's own facts are a row each; at most as many as its grams.
    facts = spark.createDataFrame(sorted({(r[1], len(r[3]), *r[4:]) for r in rows}), "template int, k int, size int, gap int, label string, base boolean")
    diagonals = diagonals.join(F.broadcast(facts) if len(rows) <= MOST_BROADCAST else facts, "template")
    along = Window.partitionBy("digest", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("gap")).cast("int")
    spans = diagonals.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("span", F.sum("apart").over(along)).withColumn("at", F.explode("ats"))
    start, end = F.col("diagonal") + F.col("at"), F.col("diagonal") + F.col("at") + F.col("k")
    spans = spans.groupBy("digest", "template", "label", "base", "k", "size", "span").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.collect_set("at").alias("ats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(at, at + F.col("k") - 1)))))
    return spans.select("digest", "template", "label", "base", "start", (F.col("end") - F.col("start")).alias("length"), (covered / F.col("size")).alias("share"))


def licenses(docs: DataFrame, templates: list[Template] = DEFAULT, k: int = K, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start; labels are those of
    base phrases and of notices of which a span covers at least `percent`; score is the largest share of any span. Labels
    are distinct, sorted and comma-joined, empty if there are none. A null text counts as empty; a text without matches
    has n_base 0, null places, empty labels and score 0. Rows that repeat are judged alike. Other columns are ignored. An empty table gives no rows.
    """
    spans = license_spans(docs, templates, k, chunk)
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    found = spans.groupBy(F.col("digest").alias("_digest")).agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("base") | (F.col("share") * 100 >= percent), F.col("label"))).alias("labels"),
        F.max("share").alias("score"),
    )
    # Stored, so that a text that a third of all rows have is split by adaptive execution.
    found = cut(found)
    rows = with_digest(docs, "doc_id").select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), "digest")
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(found, rows["digest"] == found["_digest"], "left").drop("digest", "_digest").fillna(none)
