"""Mixing sources to target weights.

The words of each source are packed into blocks of fixed length. An output shard draws how many of its slots each source
fills; the draws are multinomial given the totals that the targets fix (a tree of multivariate hypergeometric draws, so
that any shard can be drawn by itself). The j-th slot of a source takes block p(j mod n), where p is a pseudorandom
permutation of the source's n blocks, another one for each round; slots and blocks are then joined by index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import located
from tidemark.llm.shared import cut, mix64, running_start, tidy

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SLOTS, SEED = 64, 4096, 7
#: The targets are a table on the driver; more sources than this are refused.
MOST_SOURCES = 100_000
#: numpy draws without replacement from fewer than so many.
DRAWN = 1_000_000_000


def source_order(source: str | None):
    """By code point, null last."""
    return source is None, source or ""


def targets(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """Shares the sum of sizes by weight; what goes beyond `most` times a source's size is shared anew by the others."""
    total, out, open_ = float(sum(sizes.values())), {}, dict(weights)
    while open_:
        left, sum_ = total - sum(out.values()), sum(open_.values())
        over = {s for s, w in open_.items() if left * w / sum_ > most * sizes[s]}
        if not over:
            out |= {s: left * w / sum_ for s, w in open_.items()}
            break
        out |= {s: most * sizes[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
    return out


def share_out(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n slots each source gets, drawn without replacement from `counts`."""
    """A draw of n out of all slots without replacement: how many are of each source.

    numpy draws from fewer than 10^9. Beyond, each slot is taken with the chance n / total (binomial counts), and what
    that is short of n, or over it, is drawn in turn: every set of n slots is then as likely as any other, and what is
    left to draw is about the root of what was.
    """
    total = int(counts.sum())
    if total < DRAWN:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    if n <= 64:
        left = counts.copy()
        for _ in range(n):
            left[np.searchsorted(np.cumsum(left), rng.integers(int(left.sum())), side="right")] -= 1
        return counts - left
    out = rng.binomial(counts, n / total)
    short = n - int(out.sum())
    return out + share_out(rng, counts - out, short) if short >= 0 else out - share_out(rng, out, -short)


def shard_draw(slots: np.ndarray, shard: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it)."""
    counts, before, low, high = slots.copy(), np.zeros_like(slots), 0, -(-int(slots.sum()) // per_shard)
    while high - low > 1:
        mid = (low + high) // 2
        left = share_out(np.random.default_rng([seed, low, high]), counts, (mid - low) * per_shard)
        if shard < mid:
            counts, high = left, mid
        else:
            counts, before, low = counts - left, before + left, mid
    return before, counts


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of 0 <= j < n under a pseudorandom permutation: four Feistel rounds, walked until the image is below n."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
    mask = np.uint64((1 << int(half)) - 1)
    x, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        y = x[todo]
        a, b = y >> half, y & mask
        for r in range(4):
            a, b = b, a ^ (mix64(b + np.uint64((key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) & mask)
        x[todo] = (a << half) | b
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def slot_batches(sources: list, blocks: list[int], slots: list[int], per_shard: int, seed: int):
    keys = [int.from_bytes(hashlib.blake2b(repr((seed, s)).encode(), digest_size=8).digest(), "little") for s in sources]

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, counts = shard_draw(np.array(slots, np.int64), shard, per_shard, seed)
                place = np.random.default_rng([seed, shard, 1]).permutation(int(counts.sum()))
                at = 0
                for s in np.flatnonzero(counts):
                    j = before[s] + np.arange(counts[s])
                    rounds = j // blocks[s]
                    block = np.empty_like(j)
                    for r in np.unique(rounds):
                        own = rounds == r
                        block[own] = permuted(j[own] % blocks[s], blocks[s], keys[s] + int(r) * 0x2545F4914F6CDD1D)
                    n = len(j)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(place[at : at + n]), pa.array([sources[s]] * n, pa.string()), pa.array(block), pa.array(rounds)], names=["shard", "slot", "source", "block", "round"])
                    at += n

    return run


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED, most: float = 3.0, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(places, spans, targets) of a mix of all documents; the mix has as many words as docs, but for rounding.

    docs has doc_id, text, source; rows: located(docs), where it is at hand. weights: a dict, or by default 1, 2, 3, repeating, by code point of the source, null
    last. places: doc_id, source, size (words), start (words of the same source before), file, row, a row for each row
    of docs. spans: shard, slot, source, block, round, start (of the document), first (word), length: what each slot
    takes. A null text has no words; a document without words, or a source of such documents, is never taken. No
    block is taken more than `most` times, hence no document. Rows that repeat are documents of their own. Reruns over the
    same rows agree, however they are partitioned. An empty table gives empty results.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = located(docs) if rows is None else rows
    sizes = cut(rows.select("doc.doc_id", "doc.source", words.alias("size"), "file", "row"))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    size_of = {r.source: int(r.n) for r in sorted(per_source, key=lambda r: source_order(r.source))}
    sources = list(size_of)
    goal = targets(size_of, weights or {s: 1 + i % 3 for i, s in enumerate(sources)}, most)
    blocks = {s: -(-n // block) for s, n in size_of.items()}
    # A slot takes size / blocks words on average; the rounding of `most` keeps to whole rounds.
    slots = {s: min(round(goal[s] * blocks[s] / size_of[s]), int(most * blocks[s])) if size_of[s] else 0 for s in sources}

    places = cut(running_start(sizes, "source", ["doc_id", "size", "file", "row"], "size", "start"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = places.filter("size > 0").select("source", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "start", (begin - F.col("start")).alias("first"), (end - begin).alias("length"))
    shards = -(-sum(slots.values()) // per_shard)
    drawn = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(tidy(slot_batches(sources, list(blocks.values()), list(slots.values()), per_shard, seed)), "shard long, slot long, source string, block long, round long")
    # A row of shards becomes thousands of slots, which Spark cannot foresee: without the hint it would broadcast them all.
    spans = drawn.hint("merge").join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")
    return places, spans, goal


def taken_words(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: how much of each document the mix takes; as mix() for odd rows."""
    places, spans, goal = mix(docs, **parameters)
    taken = spans.groupBy(F.col("source").alias("_source"), F.col("start").alias("_start")).agg(F.sum("length").alias("taken"))
    joined = places.join(taken, F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    of_source = places.groupBy(F.col("source").alias("_of")).agg(F.sum("size").alias("source_size"))
    goals = docs.sparkSession.createDataFrame([(s, float(x)) for s, x in goal.items()], "_goal string, target double")
    of_source = of_source.join(F.broadcast(goals), F.col("_of").eqNullSafe(F.col("_goal")))
    joined = joined.join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("_of")))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def cut_batches(names: list[str]):
    """Cuts runs of words out of texts, with what stands between them; rows are (document, (words, runs of (first, length)))."""
    import re

    word = re.compile(WORD)

    def run(batches):
        at = names.index("text")
        for batch in batches:
            for rows in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                columns, index, texts = rows.column(0).flatten(), [], []
                for i, (text, cut_) in enumerate(zip(columns[at].to_pylist(), rows.column(1).to_pylist())):
                    spans = None
                    for r in cut_["runs"]:
                        whole = r["length"] == cut_["words"]
                        if not whole and spans is None:
                            spans = [m.span() for m in word.finditer(text)]
                        index.append(i)
                        texts.append(text if whole else text[spans[r["first"]][0] : spans[r["first"] + r["length"] - 1][1]])
                out = {name: column.take(pa.array(index, pa.int64())) for name, column in zip(names, columns)} | {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents, with docs' columns: in each round, each run of blocks that a document gives is a row.

    A document that is taken whole keeps its text as it is; n_chars, where docs has it, is that of the row's text. A null
    or wordless text gives no row; rows that repeat are documents of their own; other columns stay as they are, whatever
    their names. An empty table gives no rows.
    """
    rows = located(docs)
    places, spans, _ = mix(docs, rows=rows, **parameters)
    by_round = spans.groupBy(F.col("source").alias("_source"), F.col("start").alias("_start"), "round").agg(F.array_sort(F.collect_list(F.struct("first", "length"))).alias("spans"))
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<first: bigint, length: bigint>>), (done, x) -> if(size(done) > 0 and "
        "element_at(done, -1).first + element_at(done, -1).length = x.first, concat(slice(done, 1, size(done) - 1), array(named_struct("
        "'first', element_at(done, -1).first, 'length', element_at(done, -1).length + x.length))), concat(done, array(x))))"
    )
    runs = by_round.select("_source", "_start", joined.alias("runs")).groupBy("_source", "_start").agg(F.flatten(F.collect_list("runs")).alias("_runs"))
    placed = places.filter("size > 0").join(runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")))
    cuts = placed.select("file", "row", F.col("size").alias("words"), F.col("_runs").alias("runs"))
    out = rows.join(cuts, ["file", "row"]).select("doc", F.struct("words", "runs").alias("cut")).mapInArrow(tidy(cut_batches(docs.columns)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
