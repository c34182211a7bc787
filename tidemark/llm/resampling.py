"""Target-distribution importance resampling: documents are drawn by how much their words are like a target's.

1. Hashed n-grams of the corpus and of the target are counted by bucket; a bucket's gain is the logarithm of how much more
   often the target has it. A document's weight, the mean gain of its n-grams, is read from the array of gains.
2. Weight plus Gumbel noise is the score: the highest scores are a draw without replacement, by weight.
3. Scores are whole numbers of a bounded range, so their counts tell exactly at which score the draw ends, and how to
   split the order into ranges of about as many rows each. Each partition sorts its eligible rows, down to that score,
   into runs, and deals each run's parts to the ranges.
4. A range merges its parts of all runs by a tournament tree, and ranks what it emits from the number of rows in the
   ranges before it; the one in which the draw ends stops there.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, cut, rows_up_to
from tidemark.llm.tokens import LETTERS, translated

#: Rows that a partition sorts at once.
RUN = 100_000
#: Rows that a range merges, as long as that makes no more ranges than MOST_RANGES.
RANGE = 50_000
MOST_RANGES = 20_000
#: Ranks that one merged row stands for, at most.
COPIES = 4_096


class Draw(NamedTuple):
    """What is drawn: `percent` of the documents with at least `least_words` words, by n-grams of up to `order` words."""

    order: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


# ---- features

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
#: Bytes of a word that are taken by columns; what is left of a longer one is taken by itself.
LONG = 64


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states of a CRC-32 after the bytes of a span each: the j-th bytes of all spans at once."""
    sizes = np.minimum(ends - starts, LONG)
    order = np.argsort(-sizes.astype(np.int8), kind="stable")
    longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=LONG + 1))
    at, crc = starts[order], state[order]
    for j in range(int(sizes.max(initial=0))):
        m = longer[j]
        crc[:m] = CRC[(crc[:m] ^ data[at[:m] + j]) & 0xFF] ^ (crc[:m] >> 8)
    out = np.empty_like(crc)
    out[order] = crc
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = zlib.crc32(data[starts[i] + LONG : ends[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(text: pa.Array, order: int, buckets: int):
    """For n = 1 to order, the buckets of the runs of n words that start at each place, and which of the places have one; then the first word of each text."""
    words = Words(translated(text, LETTERS))
    n = len(words.starts)
    owner = np.repeat(np.arange(len(text)), np.diff(words.first))
    state, has, found = np.full(n, 0xFFFFFFFF, np.uint32), np.ones(n, bool), []
    for m in range(order):
        if m:  # the blank, then the next word
            has = has[: max(0, n - m)] & (owner[m:] == owner[: max(0, n - m)])
            state = CRC[(state[: len(has)] ^ np.uint32(32)) & 0xFF] ^ (state[: len(has)] >> 8)
        state = crc_on(state, words.bytes, words.starts[m:], words.ends[m:])
        found.append((((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), has))
    return found, words.first


def counted(order: int, buckets: int):
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, text in rows_up_to(batch, "text"):
                for bucket, has in features(text, order, buckets)[0]:
                    sums += np.bincount(bucket[has], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    return run


def bucket_counts(df: DataFrame, draw: Draw) -> np.ndarray:
    """How many features of all texts fall in each bucket; one number a bucket comes to the driver. A null text has none."""
    sent = df.select("text").mapInArrow(counted(draw.order, draw.buckets), "bucket long, n long")
    out = np.zeros(draw.buckets, np.int64)
    for r in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target by its share in the source, one added to each count."""
    pad, (all_s, all_t) = len(source), (int(source.sum()), int(target.sum()))
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + pad) / (float(s + 1) * float(all_t + pad)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, from a hash of its id (`null` if it has none)."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scorer(gain, draw: Draw):
    def run(batches):
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                found, first = features(text, draw.order, draw.buckets)
                sums, n = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
                for bucket, has in found:
                    for out, x in ((sums, np.where(has, gain.value[bucket], 0)), (n, has)):
                        upto = np.concatenate([[0], np.cumsum(x)])
                        a, b = np.minimum(first, len(x))[:-1], np.minimum(first, len(x))[1:]
                        out += upto[b] - upto[a]
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                ids = rows.column(0)
                score = weight + np.array([noise(x, draw.seed) for x in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, pa.int64()) for x in (n, weight, score)), pa.array(np.diff(first) >= draw.least_words)],
                    names=["doc_id", "n_features", "weight", "score", "eligible"],
                )

    return run


# ---- runs and ranges


class Ranges:
    """The order of (score descending, doc_id ascending, null last) in ranges; the same ids of a score share one.

    `counts` has the rows of each score from the highest to that in which the draw ends; a score of more rows than a range
    takes is split at `ids` of its own.
    """

    def __init__(self, counts: list[tuple[int, int]], ids: dict[int, list[int]], most: int):
        self.scores = np.array([-s for s, _ in counts], np.int64)
        self.ids = {s: np.unique(np.array(x, np.int64)) for s, x in ids.items() if len(x)}
        self.first, at, held = [], -1, most
        for s, n in counts:
            if held + n > most or s in self.ids:
                at, held = at + 1, 0
            self.first.append(at)
            at += len(self.ids.get(s, ()))
            held = most if s in self.ids else held + n
        self.first, self.n = np.array(self.first, np.int64), at + 1

    def of(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.scores, -score)
        out = self.first[at]
        for s in np.unique(score):
            if (cuts := self.ids.get(int(s))) is not None:
                rows = score == s
                out[rows] += np.where(none[rows], len(cuts), np.searchsorted(cuts, ids[rows], side="left"))
        return out


ENTRY = ("score", "doc_id", "none", "n_features", "weight", "copies")
RUNS = "range long, n long, " + ", ".join(f"{c} array<long>" for c in ENTRY)


def sorted_runs(ranges: Ranges, most: int):
    """From rows (score, doc_id, n_features, weight) sorted runs, a row for what each has of a range; rows that are alike are one entry with their number."""

    def run_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        none = rows.column("doc_id").is_null().to_numpy().astype(np.int64)
        score, ids, n, weight = (rows.column(c).fill_null(0).to_numpy() for c in ("score", "doc_id", "n_features", "weight"))
        order = np.lexsort((n, ids, none, -score))
        keys = np.stack([x[order] for x in (score, ids, none, n, weight)])
        new = np.flatnonzero(np.concatenate([[True], (keys[:4, 1:] != keys[:4, :-1]).any(axis=0)]))
        copies = np.diff(np.append(new, len(order)))
        entries = [*keys[:, new], copies]
        owner = ranges.of(entries[0], entries[1], entries[2] == 1)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        edges = pa.array(np.append(starts, len(owner)), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in entries]
        return pa.RecordBatch.from_arrays([pa.array(owner[starts]), pa.array(np.add.reduceat(copies, starts)), *lists], names=["range", "n", *ENTRY])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                held.append(part)
                n += part.num_rows
                if n >= most:
                    yield run_of(held)
                    held, n = [], 0
        if n:
            yield run_of(held)

    return run


class Tournament:
    """A tree of losers over sorted runs: its winner is the least head; after a step only the games on its path are played again."""

    def __init__(self, heads: list):
        """heads: the first key of each run, None where a run is empty."""
        self.size = 1 << max(0, len(heads) - 1).bit_length()
        self.heads = heads + [None] * (self.size - len(heads))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self.play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.heads[a], self.heads[b]
        return (b, a) if x is None or y is not None and y < x else (a, b)

    def step(self, head) -> None:
        """The winner's run goes on with this head, None at its end."""
        at = self.winner
        self.heads[at] = head
        node = (self.size + at) >> 1
        while node:
            at, self.losers[node] = self.play(at, self.losers[node])
            node >>= 1
        self.winner = at


def merged(before: dict[int, int], draws: int):
    """Merges a range's parts of all runs, up to the end of the draw; `rank` is that of the first copy, the rest come unranked."""

    def run(group: pa.Table) -> pa.Table:
        at = before[group.column("range")[0].as_py()]
        parts = [np.stack([np.asarray(x[c]) for c in ENTRY]) for x in (dict(zip(ENTRY, row)) for row in zip(*(group.column(c).to_pylist() for c in ENTRY)))]
        keys = [list(zip((-p[0]).tolist(), p[2].tolist(), p[1].tolist(), p[3].tolist())) for p in parts]
        tree, place, out = Tournament([k[0] for k in keys]), [0] * len(keys), []
        while at < draws and tree.heads[tree.winner] is not None:
            i = tree.winner
            entry = parts[i][:, place[i]].tolist()
            place[i] += 1
            tree.step(keys[i][place[i]] if place[i] < len(keys[i]) else None)
            taken = min(entry[-1], draws - at)
            out += copies_of(entry, taken, at + 1)
            out += copies_of(entry, entry[-1] - taken, None)
            at += entry[-1]
        for p, start in zip(parts, place):
            for entry in p[:, start:].T.tolist():
                out += copies_of(entry, entry[-1], None)
        names = ["doc_id", "n_features", "weight", "score", "copies", "rank"]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def copies_of(entry: list[int], n: int, rank: int | None):
    score, doc_id, none, n_features, weight, _ = entry
    for k in range(0, n, COPIES):
        yield None if none else doc_id, n_features, weight, score, min(COPIES, n - k), None if rank is None else rank + k


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), per_range: int = RANGE, per_run: int = RUN) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text), for a draw that is like target (text).

    The floor(percent * N / 100) highest scores of the N rows with at least `least_words` words have ranks 1, 2, 3...; ties
    go to the smaller doc_id (null is largest), then to fewer features. Other rows have a null rank. A null or wordless text has no features and
    weight 0. Rows that repeat are rows of their own, with a rank each. Other columns are ignored. An empty table gives
    no rows; an empty target still draws (all gains then follow from the added ones).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(rows, draw), bucket_counts(target, draw)))
    scored = cut(rows.mapInArrow(scorer(gain, draw), "doc_id long, n_features long, weight long, score long, eligible boolean"))
    fit = scored.filter("eligible")
    # A row for each score: gains and noise are logarithms of 64-bit numbers, so there are fewer than 250,000.
    counts = sorted(((r.score, r.n) for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draws = draw.percent * sum(n for _, n in counts) // 100
    upto, ranked = 0, []
    for score, n in counts:
        if upto >= draws:
            break
        ranked.append((score, n))
        upto += n
    if not ranked:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    last = ranked[-1][0]
    drawn = fit.filter(F.col("score") >= last).select("score", "doc_id", "n_features", "weight")
    most = max(per_range, -(-upto // MOST_RANGES))
    ranges = Ranges(ranked, split_ids(drawn, ranked, most), most)
    runs = cut(drawn.mapInArrow(sorted_runs(ranges, per_run), RUNS))
    before, at = {}, 0
    for r in runs.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # at most 3 * MOST_RANGES
        before[r.range], at = at, at + r.n
    places = runs.groupBy("range").applyInArrow(merged(before, draws), "doc_id long, n_features long, weight long, score long, copies long, rank long")
    places = places.select("doc_id", "n_features", "weight", "score", F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i", "_"), F.col("rank").alias("base"))
    places = places.select("doc_id", "n_features", "weight", "score", (F.col("base") + F.col("i")).alias("rank"))
    rest = scored.filter(~F.col("eligible") | (F.col("score") < last))
    return places.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def split_ids(drawn: DataFrame, counts: list[tuple[int, int]], most: int) -> dict[int, list[int]]:
    """Ids that split each score of more than `most` rows; they only have to be fair, so estimates will do."""
    parts = {s: -(-n // most) for s, n in counts if n > most}
    if not parts:
        return {}
    n = max(parts.values())
    found = drawn.groupBy("score").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], F.lit(max(1_000, 2 * n))).alias("ids")).collect()
    return {r.score: [r.ids[i * n // parts[r.score] - 1] for i in range(1, parts[r.score])] for r in found if r.score in parts and r.ids}


def drawn_documents(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with all their columns; of a repeated doc_id all rows, a null one never."""
    ids = resampled(docs, target, draw).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_drawn"], "left_semi")
