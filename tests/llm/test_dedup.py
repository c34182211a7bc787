"""Exact and near duplicates against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup
from tidemark.llm.shared import cut

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    key = lambda d: (d is not None, d or 0)
    return {t: (max(g, key=key), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substr(F.sha2(t, 256), F.lit(1), F.lit(2)))], ids=["sha256", "colliding"])
def test_exact(awkward, docs, digest):
    for df in (awkward, docs):
        want = exact_by_hand([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        rows, decisions = exact_dedup.exact_dedup(df, digest=digest, hits_per_copy=2)
        got = rows.select("file", "row", "doc.text").join(decisions, ["file", "row"]).collect()
        assert len(got) == df.count()
        kept = defaultdict(int)
        for r in got:
            assert (r.keep_id, r.group_size) == want[r.text or ""]
            kept[r.text or ""] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1}


def test_exact_state_goes_on(spark, tmp_path):
    """A second stream over the same state counts on."""
    form = "digest binary, doc_id long, file string, row long"
    put = lambda rows: spark.createDataFrame([(hashlib.sha256(t).digest(), d, "f", d) for d, t in rows], form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for rows in ([(1, b"a"), (2, b"b")], [(3, b"a")]):
        put(rows)
        exact_dedup.fold(spark.readStream.schema(form).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    got = {r.digest.hex(): (r.keep.doc_id, r.n) for r in exact_dedup.held(spark, str(tmp_path / "state")).collect()}
    assert got == {hashlib.sha256(b"a").hexdigest(): (3, 2), hashlib.sha256(b"b").hexdigest(): (2, 1)}


def test_exact_empty_and_documents(empty, awkward):
    assert exact_dedup.exact_dedup(empty)[1].count() == 0 and exact_dedup.distinct_documents(empty).count() == 0
    kept = exact_dedup.distinct_documents(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == awkward.select(F.coalesce("text", F.lit(""))).distinct().count()


def near_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, j in {(a, b) for g in by.values() for a in g for b in g if a < b}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(sets[i]), least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_near(spark, awkward, docs):
    base = [f"b{i}" for i in range(60)]
    edits = [(1000 + i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 + i % 3 :])) for i in range(60)]
    chain = [(2000 + i, " ".join(f"c{j}" for j in range(i, i + 50))) for i in range(0, 60, 2)]
    passage = [(3000 + i, " ".join([f"p{j}" for j in range(50)] + [f"q{i}_{j}" for j in range(12)])) for i in range(40)]
    made = spark.createDataFrame(edits + chain + passage, "doc_id long, text string")
    for df in (awkward, docs, made):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = near_dedup.near_dedup(df).collect()
        assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == near_by_hand(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_empty_and_documents(empty, docs, awkward):
    assert near_dedup.near_dedup(empty).count() == 0 and near_dedup.one_of_each(empty).count() == 0
    assert near_dedup.one_of_each(awkward).columns == awkward.columns and near_dedup.one_of_each(awkward).count() == near_dedup.near_dedup(awkward).filter("kept").count()
    found = near_dedup.near_dedup(docs)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.filter("kept").collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in near_dedup.components(cut(spark.createDataFrame(edges, "a long, b long"))).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and got[103] == 100
