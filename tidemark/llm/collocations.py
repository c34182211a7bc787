"""Phrase collocation mining: which words of a language stand together more often than their parts suggest.

1. All 1- to max_n-grams within pieces are exploded to rows and added up by language. A phrase counts from `least` on, and
   then so do its parts; so n-grams of three words and more are exploded only where each two consecutive words are a
   pair that counts, or share a slot of a map of fixed size with one; the exact counts then decide.
2. Each cut of a phrase joins the counts of its first part and of its rest; scores are exact decimals.
3. Phrases of which a one-word extension has nearly all occurrences are dropped by an anti-join: what a longer one has, each
   extension in between has as well.
4. Each language's best are ranked, first within groups by hash, then together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import SLOTS, bitmap
from tidemark.llm.shared import Words, cut, mix64, rows_up_to, shingle_hashes
from tidemark.llm.tokens import LOWER, gathered, translated

MAX_N = 4
LEAST = 30
#: A phrase is dropped if a longer one has this percentage of its occurrences.
SHARE = 80
TOP = 2_000
#: What the score is scaled by.
SCALE = 2_000_000
#: Groups by hash that a language's phrases are ranked in first.
GROUPS = 64
#: Bytes of text whose n-grams are exploded at once.
SLICE = 1 << 18

#: Ends of pieces become line feeds, A-Z lower-cased.
PIECES = LOWER.copy()
PIECES[list(b".,;:!?")] = 10


def pair_hashes(words: Words, langs: list[str]) -> np.ndarray:
    """A hash of each two consecutive words and the language of the first one's text."""
    lang = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
    owner = np.repeat(np.arange(len(langs)), np.diff(words.first))
    pairs = shingle_hashes(words.hashes(), 2)
    return mix64(pairs ^ mix64(lang + np.uint64(1))[owner[: len(pairs)]])


def gram_batches(lengths: range, bits=None):
    """From rows (lang, text), rows (lang, phrase, n) of the n-grams of these lengths; with length 1, the words of each text under an empty phrase."""

    def run(batches):
        for batch in batches:
            for rows, text in rows_up_to(batch, "text", SLICE):
                words = Words(translated(text, PIECES))
                n, lang = len(words.starts), rows.column(0)
                if not n:
                    continue
                owner = np.repeat(np.arange(len(text)), np.diff(words.first))
                ends = np.concatenate([[0], np.cumsum((words.bytes >= 10) & (words.bytes <= 13))])
                piece = ends[words.starts]
                # The words again, a blank after each: a phrase is a span of them.
                sizes = words.ends - words.starts + 1
                at = np.concatenate([[0], np.cumsum(sizes)])
                inside = np.repeat(words.starts - at[:-1], sizes) + np.arange(at[-1])
                inside[at[1:] - 1] = 0
                plain = words.bytes[inside]
                plain[at[1:] - 1] = 32
                joined = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])
                if bits is not None and n > 1:
                    slot = (pair_hashes(words, lang.to_pylist()) % np.uint64(SLOTS)).astype(np.int64)
                    joined &= (bits.value[slot >> 3] >> (slot & 7)) & 1 == 1
                if 1 in lengths:
                    yield pa.RecordBatch.from_arrays([lang, pa.array([""] * len(text)), pa.array(np.diff(words.first))], names=["lang", "phrase", "n"])
                for m in lengths:
                    if m > n:
                        break
                    ok = np.ones(n - m + 1, bool)
                    for j in range(m - 1):
                        ok &= joined[j : j + len(ok)]
                    first = np.flatnonzero(ok)
                    yield pa.RecordBatch.from_arrays(
                        [lang.take(pa.array(owner[first])), gathered(plain, at[first], at[first + m] - 1), pa.array(np.ones(len(first), np.int64))],
                        names=["lang", "phrase", "n"],
                    )

    return run


def hashed_pairs(batches):
    """From rows (lang, phrase) of two words, the hash of each."""
    for batch in batches:
        if batch.num_rows:
            words = Words(pa.concat_arrays([batch.column(1).cast(pa.large_string())]))
            at = words.first[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(words, batch.column(0).to_pylist())[at].view(np.int64))], names=["_hash"])


def words_in(phrase: str) -> F.Column:
    return F.split(phrase, " ")


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, phrase, f: how often each phrase of 1 to max_n words occurs within pieces, from `least` on; and all words of a language under an empty phrase."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def counted(lengths, bits=None):
        grams = rows.mapInArrow(gram_batches(lengths, bits), "lang string, phrase string, n long")
        return grams.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))

    short = cut(counted(range(1, min(max_n, 2) + 1)))
    if max_n < 3:
        return short
    pairs = short.filter(F.size(words_in("phrase")) == 2).select("lang", "phrase")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(pairs.mapInArrow(hashed_pairs, "_hash long")))
    return cut(short.unionByName(counted(range(3, max_n + 1), bits)))


def part(first: F.Column | int, size: F.Column | int) -> F.Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a, words, m) with l, r and score of the lowest-scoring cut, the first of such."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    of = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("num", exact("a") * F.lit(SCALE).cast("decimal(10,0)")).withColumn("den", exact("l") + exact("r"))
    cuts = cuts.withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to max_n words that occur `least` times or more.

    For docs (lang, text): n counts a language's words, a the phrase; l and r the parts of its lowest-scoring cut, whose
    score is floor(2000000 * a / (l + r)). Phrases of which a longer one, counted as often as `least`, has `share` percent are
    dropped. Order: score and a descending, phrase by UTF-8 bytes. A null lang is `und`; a null or empty text has no words. Rows that repeat
    count again. Other columns are ignored. An empty table gives no rows.
    """
    counts = phrase_counts(docs, max_n, least)
    candidates = counts.withColumn("words", words_in("phrase")).withColumn("m", F.size("words")).filter("m > 1").withColumnRenamed("f", "a")
    wholes = candidates.filter("m > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("m") - 1), part(F.lit(2), F.col("m") - 1))).alias("phrase"), "a")
    wholes = wholes.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    exact = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(10,0)")
    best = scored(candidates, counts).alias("p")
    best = best.join(wholes.alias("w"), (F.col("p.lang") == F.col("w.lang")) & (F.col("p.phrase") == F.col("w.phrase")) & (exact("longer", 100) >= exact("a", share)), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
