"""Mixing, language-model scores, packing and toxicity against plain Python."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import lm_score, mixing, packing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, "c": 10, None: 100}, {"a": 1, "b": 2, "c": 3, None: 1})
    assert got == {"b": 30, "c": 30, "a": 80, None: 80} and mixing.targets({}, {}) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))


def test_draws_add_up():
    slots = np.array([0, 500, 37, 1, 900])
    draws = [mixing.shard_draw(slots, h, 100, 3) for h in range(15)]
    assert (sum(d[1] for d in draws) == slots).all()
    assert all((draws[h][0] + draws[h][1] == draws[h + 1][0]).all() for h in range(14))


@pytest.mark.parametrize("drawn, counts, n", [(50, [400, 30, 70, 1], 250), (50, [400, 30, 70, 1], 30), (10**9, [3 * 10**13, 10**12, 7, 0, 5 * 10**9], 10**13)])
def test_large_draws(monkeypatch, drawn, counts, n):
    """Above numpy's bound, draws have the mean and the spread of draws without replacement."""
    monkeypatch.setattr(mixing, "DRAWN", drawn)
    rng, counts = np.random.default_rng(1), np.array(counts)
    got = np.array([mixing.share_out(rng, counts, n) for _ in range(3000)]).astype(float)
    assert (got.sum(1) == n).all() and (got <= counts).all() and (got >= 0).all()
    total = counts.sum()
    p = counts / total
    spread = np.sqrt(n * p * (1 - p) * (total - n) / (total - 1))
    assert (abs(got.mean(0) - n * p) <= 5 * spread / np.sqrt(3000) + 1e-9).all()
    assert (abs(got.std(0) - spread) <= 0.1 * spread + 1e-9).all()


def test_mix(awkward, docs, empty):
    for df, close in ((awkward, 0.05), (docs, 0.05)):
        got = mixing.taken_words(df).collect()
        want = [(r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in df.select("doc_id", "text", "source").collect()]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.size, r.source)) for r in got)
        sums = defaultdict(lambda: [0, 0, 0.0])
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            sums[r.source][0] += r.size
            sums[r.source][1] += r.taken
            sums[r.source][2] = r.target
            assert r.source_size == sum(n for _, n, s in want if s == r.source)
        for size, taken, target in sums.values():
            assert target <= 3 * size and abs(taken - target) <= max(96, close * target)
        again = mixing.taken_words(df.repartition(3)).collect()
        if df is docs:
            assert {r.doc_id: r.size for r in got} == {r.doc_id: r.size for r in again}
    assert mixing.taken_words(empty).count() == 0


def test_mixed_documents(docs, awkward, empty):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = Counter()
    for r in out.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        found[r.doc_id] += len(WORD.findall(r.text))
    assert {d: n for d, n in taken.items() if n} == dict(found)
    assert mixing.mixed_documents(awkward).columns == awkward.columns
    kept = {(r.doc_id, r._file, r.cut) for r in mixing.mixed_documents(awkward).collect()}
    assert {k[1:] for k in kept} == {("x", "x")} and mixing.mixed_documents(empty).count() == 0


def test_taken_words_by_hand(spark):
    """What the mix takes, from draws, permutations and blocks in plain Python."""
    block, per_shard, seed = 4, 8, 3
    rows = [(i, " ".join(["w"] * (3 + 5 * i % 17)), "ab"[i % 3 == 0]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.taken_words(df, block=block, per_shard=per_shard, seed=seed).collect()}
    places, _, goal = mixing.mix(df, block=block, per_shard=per_shard, seed=seed)
    owner = {"a": {}, "b": {}}
    for r in places.collect():
        owner[r.source] |= {r.start + j: r.doc_id for j in range(r.size)}
    blocks = {s: -(-len(o) // block) for s, o in owner.items()}
    slots = np.array([round(goal[s] * blocks[s] / len(owner[s])) for s in "ab"])
    taken, seen = Counter(), [0, 0]
    for shard in range(-(-int(slots.sum()) // per_shard)):
        _, counts = mixing.shard_draw(slots, shard, per_shard, seed)
        for k, s in enumerate("ab"):
            key = int.from_bytes(hashlib.blake2b(repr((seed, s)).encode(), digest_size=8).digest(), "little")
            for j in range(seen[k], seen[k] + counts[k]):
                round_, at = divmod(j, blocks[s])
                b = int(mixing.permuted(np.array([at]), blocks[s], key + round_ * 0x2545F4914F6CDD1D)[0])
                taken.update(owner[s][w] for w in range(b * block, min(len(owner[s]), (b + 1) * block)))
            seen[k] += int(counts[k])
    assert seen == slots.tolist() and got == {i: taken[i] for i in range(40)}


def test_lm_scores(awkward, docs, empty):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    for df, order in ((awkward, 2), (docs, 2), (docs, 3)):
        texts = [WORD.findall((r.text or "").encode().translate(low).decode()) for r in df.select("text").collect()]
        grams = lambda w, m: Counter(zip(*(w[i:] for i in range(m))))
        all_ = [sum((grams(w, m) for w in texts), Counter()) for m in range(1, order + 1)]
        words = sum(map(len, texts))
        want = []
        for w in texts:
            own, total = [grams(w, m) for m in range(1, order + 1)], 0.0
            for i in range(len(w)):
                score, factor = None, 0.0
                for m in range(min(order, i + 1), 1, -1):
                    g, before = tuple(w[i - m + 1 : i + 1]), tuple(w[i - m + 1 : i])
                    c, b = all_[m - 1][g] - own[m - 1][g], all_[m - 2][before] - own[m - 2][before]
                    if c > 0 and b > 0:
                        score = factor + math.log(c / b)
                        break
                    factor += math.log(0.4)
                total += score if score is not None else factor + math.log(max(1, all_[0][(w[i],)] - own[0][(w[i],)]) / (words - len(w) + 1))
            want.append((len(w), round(total, 5)))
        got = lm_score.lm_scores(df, order=order).collect()
        assert sorted((r.n_words, round(r.log_score, 5)) for r in got) == sorted(want)
        assert all((r.per_word is None) == (r.n_words == 0) for r in got)
    assert lm_score.lm_scores(empty).count() == 0


def test_lm_scores_read_longer_contexts(spark):
    texts = ["a b c", "a b c", "x b d", "x b d", "a b d"]
    got = {r.doc_id: r.log_score for r in lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # Of the others, one of two texts with "a b" goes on with c; by the bigram alone it would be one of four.
    assert math.isclose(got[0], math.log(2 / 13) + math.log(2 / 2) + math.log(1 / 2))


def test_lm_batches_by_bytes():
    rows = pa.record_batch({"doc_id": list(range(7)), "text": ["x" * n for n in (0, 900, 50, 3000, 10, 10, 990)]})
    got = [(b, t.column("doc_id").to_pylist()) for b, t in lm_score.batches_of([rows.slice(0, 2), rows.slice(2, 5)], 1000)]
    assert got == [(0, [0, 1, 2]), (1, [3]), (2, [4, 5]), (3, [6])]
    keys = np.sort(np.random.default_rng(1).integers(1, 1 << 64, 999, np.uint64, endpoint=False))
    assert (lm_score.unpacked(lm_score.packed(keys), 999) == keys).all()


def test_capitals_with_marks():
    pairs = {d.split()[0] + " " + d.split()[1] for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d.count(" ") == 1 and d[0] != "<"}
    assert all(0x300 <= int(b, 16) < 0x380 for a, b in map(str.split, pairs) if int(a, 16) < 128)
    tokenizer, marks = Tokenizer.from_file(TOKENIZER), list(map(chr, range(0x300, 0x370)))
    texts = [f"{c}{m}abc {c}x{m}" for c in "AHJTWYa" for m in marks] + [f"J{a}\u030cABC" for a in marks] + ["One \u00c9T\u0308A.", "J\u030cabc"]
    texts += ["", " \t", "it's it'S 'tis don't!! a'll'd (716) 555-8176 x=1,2 \u00df\u00f7\u00d7\u00e9\u0080 \u00bd \u00b5m \u212a \u0130x na\u00efve...", "<|endoftext|> <|x A<|startoftext|>B", "a\u00a0b\u3000c\x1cd\x85e", "z" * 300]
    want = [[*x.ids, 2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for encoder in (packing.encoder(TOKENIZER), packing.Encoder(TOKENIZER)):
        for part in (slice(0, 1), slice(0, None), slice(5, 9)):
            ids, at = encoder(pa.array(texts, pa.large_string())[part], 2)
            assert [x.tolist() for x in np.split(ids, at[1:-1])] == want[part]
    encoder.by_piece = False
    ids, at = encoder(pa.array(texts, pa.large_string()), 2)
    assert [x.tolist() for x in np.split(ids, at[1:-1])] == want and want[encoder.by_piece + texts.index("J\u030cabc")][:4] == [329, 136, 490, 5334]


def test_pack(awkward, docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for df in (awkward, docs):
        want = sorted((-1 if r.doc_id is None else r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in df.select("doc_id", "text").collect())
        pieces = packing.pack(df, TOKENIZER).collect()
        by_doc = defaultdict(list)
        for p in pieces:
            by_doc[-1 if p.doc_id is None else p.doc_id, p.doc_tokens].append(p)
        for (doc, ids), times in Counter(want).items():
            raw = np.array(ids, "<u4")
            own = [p for p in by_doc[doc, len(ids)] if p.ids_crc32 == zlib.crc32(raw[p.start : p.start + p.length].tobytes())]
            cover = Counter(i for p in own for i in range(p.start, p.start + p.length)) if len(ids) < 5000 else None
            assert sum(p.length for p in own) == times * len(ids)
            assert cover is None or set(cover.values()) == {times}
        windows = defaultdict(list)
        for p in pieces:
            windows[p.sequence_id].append(p)
        assert sorted(windows) == list(range(len(windows)))
        sizes = []
        for _, w in sorted(windows.items()):
            at = 0
            for p in sorted(w, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
            sizes.append(at)
        assert set(sizes[:-1]) <= {4096} and 0 < sizes[-1] <= 4096
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_shared_queues_keep_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 2)
    rows = [(i, "word " * 500, f"s{i}") for i in range(10)]
    weights = {f"s{i}": 1 + 3 * i for i in range(10)} | {"absent": 1000}
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER, weights, window=128, run=4).collect()
    shares, first = Counter(), Counter()
    for doc, queue in {(p.doc_id, p.queue) for p in pieces}:
        shares[queue] += weights[f"s{doc}"]
    for p in pieces:
        first[p.queue] += p.length * (p.sequence_id == 0)
    sizes = Counter(q for _, q in {(p.doc_id, p.queue) for p in pieces})
    assert len(shares) == 2 and sum(first.values()) == 128 and len(set(shares.values())) == 2, sizes
    assert all(abs(first[q] - 128 * n / sum(shares.values())) <= 2 for q, n in shares.items())


@pytest.mark.parametrize("shares", [[1, 1, 1, 1], [5, 1, 0.001, 3], [0, 0, 1, 0]])
def test_schedule(shares):
    sizes = np.array([100_000, 3, 70_001, 900])
    schedule = packing.Schedule(sizes, np.array(shares, float), 64, 16)
    windows, ends = defaultdict(list), []
    for q, n in enumerate(sizes):
        for a in range(0, n, 777):
            at = a
            for start, length, w, place in schedule.pieces(q, a, min(777, n - a)):
                assert a + start == at
                at += length
                windows[w].append((place, length, q))
            ends.append(at)
    for w in range(schedule.windows):
        at = 0
        for place, length, _ in sorted(windows[w]):
            assert place == at
            at += length
        assert at == (64 if w < schedule.windows - 1 else sizes.sum() - 64 * (schedule.windows - 1))
    if shares[0] == 5:  # while all last, each window is near its target
        assert all(abs(sum(n for _, n, q in windows[w] if q == 0) - 64 * 5 / 8) <= 2 + 64 * 1 / 8 for w in range(5))


def test_toxicity(spark, docs, awkward, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    # Labels of held-out rows are not learned from.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {d: r.score for d, r in got.items()}
    assert toxicity.toxicity(awkward, labels).count() == awkward.count()
    assert toxicity.toxicity(awkward, labels.limit(0)).count() == awkward.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels.select("doc_id", "toxic")).join(labels, "doc_id").filter("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    assert auc > 0.95 and all(g < 0.7 for g in good)


def test_ftrl_by_hand():
    """The trainer against the update rule, coordinate by coordinate."""
    p = toxicity.Ftrl(alpha=0.5, l1=0.3, l2=0.1, epochs=3, bits=5, most_features=60)
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(2)), sorted(rng.choice(32, rng.integers(0, 8), replace=False).tolist())) for _ in range(25)]
    batch = pa.RecordBatch.from_pydict({"place": list(range(25)), "toxic": [y for y, _ in rows], "features": [np.array(x, np.int32).tobytes() for _, x in rows]})
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        l1 = p.l1 if i < 32 else 0.0
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    fits, used = [], 0
    for y, x in rows:
        used += len(x)
        if used > 60:
            break
        fits.append((y, x))
    assert 5 < len(fits) < 25
    for _ in range(p.epochs):
        for y, x in fits:
            at = [*x, 32]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - y
            for i, wi in zip(at, w):
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i], n[i] = z[i] + g - s * wi, n[i] + g * g
    (got,) = toxicity.trainer(p)(iter([batch.slice(0, 4), batch.slice(4, 21)]))
    got = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    want = {i: weight(i) for i in range(33) if weight(i)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want) and len(want) < 33


def test_features_by_hand():
    """Texts share a feature just where they share a word, a beginning, a pair of neighbours or a pair around one word."""

    def of(text):
        w, out = text.lower().split(), set()
        out |= {("w", x) for x in w} | {(n, x[:n]) for x in w for n in toxicity.BEGINNINGS if len(x) > n}
        return out | {(g, a, b) for g in (1, 2) for a, b in zip(w, w[g:])}

    texts = ["You are a fool indeed", "fools ARE you a", "a you are", "indeedly x", "", "a fool a fool"]
    made = [set() for _ in texts]
    for owner, index in toxicity.features(pa.array(texts, pa.large_string()), 40):
        for o, i in zip(owner.tolist(), index.tolist()):
            made[o].add(i)
    for a, x in zip(texts, made):
        for b, y in zip(texts, made):
            assert len(x & y) == len(of(a) & of(b))


def test_sample_is_of_documents_at_hand(spark):
    docs = spark.createDataFrame([(i, "bad fool" if i % 2 else "fine day") for i in range(60)] + [(5, "bad fool")] * 9, "doc_id long, text string")
    labels = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, p=toxicity.Ftrl(most_rows=50, l1=0.1)).collect()}
    assert all((s > 0.5) == (d % 2 == 1) for d, s in got.items())


def test_workers_hold_little_between_tasks(monkeypatch):
    """When a task is over, its worker remembers no pieces and gives freed memory back; workers live on."""
    from tidemark.llm import shared

    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(len(packing.encoder(path).known)))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 7})())
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.record_batch({"doc_id": [1, 2], "queue": ["a", "b"], "text": ["one two", "three"]})
    rows = list(shared.tidy(packing.token_batches(path, 2))([batch, batch]))
    assert [r.column(2).to_pylist() for r in rows] == [[7, 7]] * 2 and given == [1]
    stopped = shared.tidy(packing.token_batches(path, 2))(iter([batch, batch]))
    next(stopped)
    stopped.close()
    assert len(given) == 2
