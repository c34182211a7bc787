"""Collocations against plain Python."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import collocations, queries

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, max_n=4, least=30, share=80, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOW).decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for n in range(1, max_n + 1):
                counts.update(("und" if lang is None else lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {x: a for x, a in counts.items() if a >= least and len(x[1]) > 1}
    out = []
    for lang in {x for x, _ in found}:
        ranked = []
        for (own, p), a in found.items():
            if own != lang or any(len(q) > len(p) and o == lang and 100 * f >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), f in found.items()):
                continue
            score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), a, counts[lang, p[:k]], counts[lang, p[k:]], score))
        for rank, (_, _, p, a, left, right, score) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, totals[lang], score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_query(spark, sf_dir, docs):
    got = rows_of(queries.op13_phrase_collocations(spark, sf_dir))
    assert got and got == by_hand([(r.lang, r.text) for r in docs.collect()])


@pytest.mark.parametrize("max_n,least,share,top", [(4, 3, 80, 2000), (2, 2, 80, 5), (5, 2, 100, 7), (3, 1, 50, 2000), (1, 1, 80, 9)])
def test_drawn_texts(spark, max_n, least, share, top):
    """Phrases that repeat, overlap and extend each other, in several languages; a language without words."""
    draw = random.Random(3)
    sep = [" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "!?"]
    text = lambda: "".join(draw.choice(["a", "B", "b", "c", "a b c d", "x y z", "X y", "é", "東", " ", "İ", "d" * 70]) + draw.choice(sep) for _ in range(draw.randint(0, 60)))
    rows = [(draw.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(120)] + [("la", None), ("la", " . ")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = rows_of(collocations.collocations(df, max_n, least, share, top))
    assert got == by_hand(rows, max_n, least, share, top)


def test_awkward_rows(awkward, empty):
    for least in (1, 2, 30):
        small = awkward.filter("doc_id is null or doc_id <> 10 and doc_id <> 12")
        assert rows_of(collocations.collocations(small, least=least)) == by_hand([(r.lang, r.text) for r in small.collect()], least=least)
    assert rows_of(collocations.collocations(awkward)) == by_hand([(r.lang, r.text) for r in awkward.collect()])
    assert collocations.collocations(empty).count() == 0


def test_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", big - 1), ("en", "a", big), ("en", "b", big - 1), ("en", "", big)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", big - 1, ["a", "b"], 2)], "lang string, phrase string, a long, words array<string>, m int")
    got = collocations.scored(phrases, counts).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(big, big - 1, 2_000_000 * (big - 1) // (2 * big - 1))]
