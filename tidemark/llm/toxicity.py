"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate; L1 keeps most weights at exactly 0, so that the model is a short list of
(index, weight), which is broadcast. A text's features are the presence of: words, word beginnings (4 to 8 bytes),
pairs of neighbours, and pairs with one word between.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, mix64, rows_up_to, tidy

BEGINNINGS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 8
    bits: int = 20
    #: At most so many labelled rows are learned from: those with the smallest hash of their doc_id.
    most_rows: int = 15_000
    #: Of their features, so many: the first rows, by the hash of doc_id and text, that have no more together.
    most_features: int = 40_000_000


def features(text: pa.Array, bits: int):
    """Feature indexes of all texts, in several arrays of (text number, index); an index may come more than once."""
    words = Words(text)
    whole, shift = words.hashes(), np.uint64(64 - bits)
    owner = np.repeat(np.arange(len(text)), np.diff(words.first))
    kind = lambda h, k: (mix64(h + np.uint64(0x632BE59BD9B4E019 * k & 0xFFFFFFFFFFFFFFFF)) >> shift).astype(np.int64)
    yield owner, kind(whole, 1)
    for n in BEGINNINGS:
        at = np.flatnonzero(words.ends - words.starts > n)
        yield owner[at], kind(words.hashes(n)[at], 10 + n)
    for gap in (1, 2):
        at = np.flatnonzero(owner[:-gap] == owner[gap:]) if len(owner) > gap else np.zeros(0, np.int64)
        yield owner[at], kind(whole[at] * np.uint64(3) + mix64(whole[at + gap]), 20 + gap)


def feature_rows(bits: int):
    def run(batches):
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                pairs = np.unique(np.concatenate([(owner << bits) | index for owner, index in features(text, bits)]))
                ends = np.searchsorted(pairs >> bits, np.arange(len(text) + 1))
                index = (pairs & ((1 << bits) - 1)).astype(np.int32)
                blobs = [index[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(blobs, pa.binary())], names=["doc_id", "place", "toxic", "features"])

    return run


def trainer(p: Ftrl):
    def run(batches):
        # All features stand in one array, which goes back to the system as a whole.
        parts, sizes, wanted = [], [], []
        room = p.most_features
        for batch in batches:
            own = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4
            rows = batch.slice(0, int(np.searchsorted(np.cumsum(own), room, side="right")))
            wanted += rows.column(1).to_pylist()
            sizes += own[: rows.num_rows].tolist()
            parts.append(np.frombuffer(b"".join(x.as_buffer() for x in rows.column(2)), np.int32))
            room = room - int(own.sum()) if rows.num_rows == batch.num_rows else 0
        every, ends = np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([0, *sizes])
        del parts
        z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
        bias = 1 << p.bits
        for _ in range(p.epochs):
            for y, a, b in zip(wanted, ends[:-1], ends[1:]):
                index = np.append(every[a:b], bias)
                zi, ni = z[index], n[index]
                l1 = np.full(len(index), p.l1)
                l1[-1] = 0
                w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
                n[index] = ni + g * g
        l1 = np.full(len(z), p.l1)
        l1[-1] = 0
        w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
        index = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(w[index])], names=["index", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, weights) learned from labels (doc_id, toxic) of documents whose crc32(doc_id as text) mod 3 is not 1.

    Rows with a null doc_id or label are left out, and a text that is null counts as empty; a doc_id that repeats is
    learned from once, by the text with the smallest hash, and as toxic if any of its labels says so. The sample is
    drawn from the labels whose documents are at hand, and bounded by `most_rows` and `most_features`, so one task can
    take it; it does not depend on how the input is partitioned. Without any label, or with only one class, the model
    is still defined (its bias alone may differ from 0).
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter("crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "toxic")
    at_hand = usable.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = at_hand.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.most_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    place = F.xxhash64("doc_id", "text")
    made = texts.select("doc_id", place.alias("place"), F.col("toxic").cast("double").alias("toxic"), "text").mapInArrow(tidy(feature_rows(p.bits)), "doc_id long, place long, toxic double, features binary")
    once = made.groupBy("doc_id").agg(F.min(F.struct("place", "toxic", "features")).alias("first")).select("first.*")
    model = once.repartition(1).sortWithinPartitions("place").mapInArrow(tidy(trainer(p)), "index long, weight double").toPandas()
    return model["index"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def scored(text: pa.Array, dense: np.ndarray, bits: int) -> np.ndarray:
    hits = []
    for owner, feature in features(text, bits):
        at = np.flatnonzero(dense[feature])
        hits.append((owner[at] << bits) | feature[at])
    hits = np.unique(np.concatenate(hits))
    sums = dense[-1] + np.bincount(hits >> bits, dense[hits & ((1 << bits) - 1)], len(text))
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def dense_weights(model, bits: int) -> np.ndarray:
    index, weight = model.value
    dense = np.zeros((1 << bits) + 1)
    dense[index] = weight
    return dense


def score_batches(model, bits: int):
    def run(batches):
        dense = dense_weights(model, bits)
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scored(text, dense, bits))], names=["doc_id", "score"])

    return run


def clean_batches(model, bits: int, threshold: float):
    def run(batches):
        dense = dense_weights(model, bits)
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                yield rows.filter(pa.array(scored(text, dense, bits) < threshold))

    return run


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, p: Ftrl = Ftrl()) -> DataFrame:
    """The rows of docs whose score is below the threshold, with docs' columns, whatever their names.

    A null text counts as empty and is scored by the bias; rows that repeat have equal scores. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))
    return docs.mapInArrow(tidy(clean_batches(model, p.bits, threshold)), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, p: Ftrl = Ftrl()) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score, predicted; a row for each row of docs.

    A null text counts as empty and is scored by the bias; a null doc_id counts as not held out. Equal texts have equal
    scores; other columns play no part. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(score_batches(model, p.bits)), "doc_id long, score double")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
