"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import queries, resampling

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOW).decode())


def buckets_of(text, order=2, buckets=10_000):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def by_hand(rows, target, percent=25, least=20, buckets=10_000):
    """For each (doc_id, text): n_features, weight, score; and the ranked doc_ids."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text, buckets=buckets))
    for text in target:
        t.update(buckets_of(text, buckets=buckets))
    big_s, big_t, out, fit = sum(s.values()), sum(t.values()), [], []
    for doc, text in rows:
        found = buckets_of(text, buckets=buckets)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(found), weight, score))
        if len(words_of(text)) >= least:
            fit.append((-score, doc is None, doc or 0, len(found)))
    return out, sorted(fit)[: percent * len(fit) // 100]


def check(got, rows, target, **more):
    every, drawn = by_hand(rows, target, **more)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(every, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0, r.n_features) for r in ranked] == drawn


@pytest.mark.parametrize("per_range,per_run", [(50_000, 100_000), (7, 5), (1, 3)])
def test_resampled(spark, docs, per_range, per_run):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = resampling.resampled(docs, target, per_range=per_range, per_run=per_run).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_query(spark, sf_dir, docs):
    got = queries.op11_importance_resampling(spark, sf_dir).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])


def test_awkward_rows(awkward, empty, spark):
    """Nulls, repeated rows, long words; an empty corpus and an empty target."""
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for target in (awkward, empty, spark.createDataFrame([(None,), ("w1 w2 W3",)], "text string")):
        texts = [r.text for r in target.select("text").collect()]
        for percent in (60, 100, 0):
            got = resampling.resampled(awkward, target, resampling.Draw(percent=percent), per_range=2, per_run=3).collect()
            check(got, rows, texts, percent=percent)
    assert resampling.resampled(empty, awkward).count() == 0
    assert resampling.drawn_documents(empty, awkward).count() == 0
    drawn = resampling.drawn_documents(awkward, awkward, resampling.Draw(percent=100))
    assert drawn.columns == awkward.columns and {r.doc_id for r in drawn.collect()} == {1, 2, 3, 10, 12}


def test_hot_rows(spark):
    """Rows that repeat, ids that repeat with other texts, and a score that many ids share."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 400 + [(5, text + " x")] * 30 + [(i, text) for i in range(300)] + [(None, text)] * 50
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 x",)], "text string")
    for percent in (30, 77, 100):
        check(resampling.resampled(df, target, resampling.Draw(percent=percent), per_range=9, per_run=40).collect(), rows, ["w1 w2 w3 x"], percent=percent)


def test_ranges():
    """A score of many rows is split by ids, null ids last; small ones share a range."""
    ranges = resampling.Ranges([(3, 100), (1, 5), (0, 4), (-2, 50)], {3: [10, 20, 20], -2: [7]}, 9)
    assert ranges.n == 3 + 1 + 2
    ids = [9, 10, 11, 25, 0, 1, 2, 7, 8]
    got = ranges.of(np.array([3, 3, 3, 3, 3, 1, 0, -2, -2]), np.array(ids), np.array([False] * 4 + [True] + [False] * 4))
    assert got.tolist() == [0, 0, 1, 2, 2, 3, 3, 4, 5]


def test_tournament():
    for seed in range(200):
        draw = random.Random(seed)
        runs = [sorted(draw.choices(range(20), k=draw.randint(0, 6))) for _ in range(draw.randint(1, 9))]
        tree, place, out = resampling.Tournament([r[0] if r else None for r in runs]), [0] * len(runs), []
        while tree.heads[tree.winner] is not None:
            i = tree.winner
            out.append(runs[i][place[i]])
            place[i] += 1
            tree.step(runs[i][place[i]] if place[i] < len(runs[i]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_features_by_hand():
    texts = ["Hello wörld A1\x00b2 “x” 東京", "", "x" * 200 + " the q " + "y" * 64 + " " + "z" * 65, " a ", "é"]
    found, first = resampling.features(pa.array(texts, pa.large_string()), 3, 997)
    got = Counter()
    for bucket, has in found:
        got.update(bucket[has].tolist())
    want = Counter()
    for t in texts:
        want.update(buckets_of(t, 3, 997))
    assert got == want and first.tolist()[-1] == sum(len(words_of(t)) for t in texts)
