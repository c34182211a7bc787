"""The five stages, each held against what its predecessor kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_dedup import near_by_hand
from tidemark.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    raw, clean, single, few, mixed, packed = frames
    assert all(f.columns == raw.columns for f in frames[:5])
    texts = lambda f: {r.doc_id: r.text for r in f.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    assert set(texts(clean)) == {r.doc_id for r in toxicity.toxicity(raw, labels).filter("predicted = 0").collect()}
    last = {t: d for d, t in sorted(texts(clean).items())}
    assert texts(single) == {d: t for t, d in last.items()}
    components = near_by_hand(list(texts(single).items()))
    firsts = {c[0] for c in (eval(x) for x in components) if c[0] == c[2]}
    assert texts(few) == {d: t for d, t in texts(single).items() if d in firsts}
    taken = defaultdict(int)
    for r in mixed.collect():
        assert r.text in texts(few)[r.doc_id]
        taken[r.doc_id] += len(WORD.findall(r.text))
    sizes = {d: len(WORD.findall(t)) for d, t in texts(few).items()}
    assert all(n <= 3 * sizes[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())
    windows = Counter()
    for r in packed.collect():
        windows[r.sequence_id] += r.length
    assert {n for w, n in windows.items() if w < max(windows)} <= {4096}
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in packed.filter("start = 0").collect())


def test_odd_rows(spark, sf_dir, awkward, empty, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, awkward, sf_dir)
        assert name == "packing" or out.columns == awkward.columns
        assert out.count() > 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
