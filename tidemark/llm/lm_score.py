"""LM scoring: stupid backoff, relationally.

Texts are exploded into n-grams of each order up to `order`; a batch of documents pre-aggregates its own, and deals them
by hash to buckets. A bucket is a part of the n-gram count table: it adds up what all batches sent, and joins the totals
back to the n-grams of each batch, where they are summed per document. Rows carry sorted arrays of n-gram hashes (their
differences, the high bytes compressed) rather than single n-grams. A document is scored by the counts of all other documents (its own are taken off), so that each
text meets a model that has not seen it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, cut, shingle_hashes

ORDER, BACKOFF = 3, 0.4
#: Bytes of text of a batch, and for each bucket, and what a row counts besides its text. A longer text is a batch by itself.
BATCH_BYTES, BUCKET_BYTES, LEAST_BUCKETS, ROW_BYTES = 10_000_000, 20_000_000, 8, 16


def ngrams(text: pa.Array, order: int):
    """(first word of each text, for each order the hash of the n-gram that ends at each word, 0 where there is none)."""
    words = Words(text)
    hashes = words.hashes()
    place = np.arange(len(hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
    keys = []
    for m in range(1, order + 1):
        k = np.zeros(len(hashes), np.uint64)
        k[m - 1 :] = shingle_hashes(hashes, m)
        k[place < m - 1] = 0
        keys.append(k)
    return words.first, keys


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; a bucket is a range of hashes."""
    bounds = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(key[key > 0], return_counts=True)
    return keys, counts


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte; the high bytes are few and small."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes() + pa.compress(planes[5:].tobytes(), "zstd", asbytes=True)


def unpacked(data, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    planes = np.concatenate([raw[: 5 * n], np.frombuffer(pa.decompress(raw[5 * n :].tobytes(), 3 * n, "zstd"), np.uint8)])
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts byte by byte, compressed: most are small."""
    return pa.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked_counts(data, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def batches_of(batches, most: int = BATCH_BYTES):
    """(batch, doc_ids and texts) of a partition's rows (doc_id, text), in order; the same each time."""
    base, number, open_, size = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0, 0, [], 0
    for rows in batches:
        rows = pa.Table.from_batches([rows]).set_column(1, "text", rows.column(1).cast(pa.large_string()))
        sizes = pc.binary_length(rows.column("text")).to_numpy() + ROW_BYTES
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            to = int(np.searchsorted(ends, most - size + (ends[at - 1] if at else 0), side="right"))
            if to <= at and open_:
                yield base + number, pa.concat_tables(open_)
                number, open_, size = number + 1, [], 0
                continue
            to = max(to, at + 1)
            open_.append(rows.slice(at, to - at))
            size += int(sizes[at:to].sum())
            at = to
    if open_:
        yield base + number, pa.concat_tables(open_)


def whole(texts: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(texts.chunks)


def text_batches(batches):
    """From rows (doc_id, text), one row a batch with all of its own."""
    for batch, rows in batches_of(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_table(rows.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "docs"])


def count_batches(order: int, buckets: int):
    """From rows (doc_id, text), the n-grams of each batch by bucket."""

    def run(batches):
        for batch, docs in batches_of(batches):
            _, keys = ngrams(whole(docs.column("text")), order)
            for m, key in enumerate(keys, 1):
                own, counts = counted(key)
                edges = bucket_edges(own, buckets)
                rows = [(b, batch, m, e - s, packed(own[s:e]), packed_counts(counts[s:e])) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(SENT, zip(*rows) if rows else [[]] * len(SENT))})

    return run


SENT = [("bucket", pa.int64()), ("batch", pa.int64()), ("m", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]


def totals(group: pa.Table) -> pa.Table:
    """One bucket and order: the totals over all batches, for the n-grams of each batch."""
    keys = [unpacked(x.as_buffer(), n) for x, n in zip(group.column("keys"), group.column("n").to_pylist())]
    counts = np.concatenate([unpacked_counts(x.as_buffer(), n) for x, n in zip(group.column("counts"), group.column("n").to_pylist())])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, counts)[inverse].astype("<u8")
    ends = np.cumsum([len(k) for k in keys])
    back = [packed_counts(x) for x in np.split(sums, ends[:-1])]
    return pa.table({"batch": group.column("batch"), "m": group.column("m"), "bucket": group.column("bucket"), "n": group.column("n"), "totals": pa.array(back, pa.binary())})


def scorer(order: int, backoff: float, all_words: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(docs.column("docs")[0].as_buffer()).read_all()
        text = whole(docs.column("text"))
        first, keys = ngrams(text, order)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        others, have = np.maximum(0, all_words - n)[owner], []
        by_order: dict[int, list] = {m: [] for m in range(1, order + 1)}
        for m, bucket, n_keys, blob in zip(*(found.column(c).to_pylist() for c in ("m", "bucket", "n", "totals"))):
            by_order[m].append((bucket, n_keys, blob))
        for m, key in enumerate(keys, 1):
            own, _ = counted(key)
            total = np.concatenate([unpacked_counts(x, k) for _, k, x in sorted(by_order[m])]) if len(own) else np.zeros(0)
            at = np.searchsorted(own, key)
            valid = key > 0
            pairs, inverse, mine = np.unique(owner[valid] * (len(own) + 1) + at[valid], return_inverse=True, return_counts=True)
            count = np.zeros(len(key))
            count[valid] = total[at[valid]] - mine[inverse]
            have.append(count)
        log = np.log(np.where(have[0] > 0, have[0], 1) / (others + 1.0)) if len(owner) else np.zeros(0)
        for m in range(2, order + 1):
            before = np.concatenate([[0.0], have[m - 2][:-1]])
            seen = (have[m - 1] > 0) & (before > 0)
            lower = np.where(keys[m - 1] > 0, np.log(backoff) + log, log)
            log = np.where(seen, np.log(np.where(seen, have[m - 1], 1) / np.where(seen, before, 1)), lower)
        sums = np.bincount(owner, log, len(n)) if len(owner) else np.zeros(len(n))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(sums)})

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score, per_word for each row of docs (doc_id, text).

    log_score sums, over the text's words, the logarithm of c(w1..wm) / c(w1..wm-1) for the longest n-gram that other
    documents have, times `backoff` for each order given up; a word alone counts c(w) / (N + 1), or 1 / (N + 1) if no other
    document has it. Words are as A-Z lower-cased runs without ASCII white space. A null or wordless text has n_words 0,
    log_score 0 and a null per_word. Rows that repeat are other documents to each other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + ROW_BYTES), F.lit(0)), F.coalesce(F.sum(words), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, size[0] // BUCKET_BYTES)
    # Both sides number their batches by partition and place: rows that come out of a shuffle are stored first, so that a
    # task that runs again numbers them alike.
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut(rows)
    sent = rows.mapInArrow(count_batches(order, buckets), "bucket long, batch long, m long, n long, keys binary, counts binary")
    back = sent.groupBy("bucket", "m").applyInArrow(totals, "batch long, m long, bucket long, n long, totals binary")
    texts = rows.mapInArrow(text_batches, "batch long, docs binary")
    scored = texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(scorer(order, backoff, int(size[1])), "doc_id long, n_words long, log_score double")
    return scored.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
