"""Packing: mixture-controlled, by deficit round-robin over source queues.

Each source is a queue of tokens. A window takes from each queue what its target share of 4096 tokens amounts to; the
fractions that are left are deficits, carried from window to window, and the largest deficits get the window's last
places. So that windows can be filled anywhere, they are dealt to runs of `run` windows: how many tokens each queue has
given before a run follows from the targets alone (the order of tokens by the time at which a fluid schedule would have
given half of each), and within a run the deficits are carried one by one. Only the last window can be short.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, process_cache, rows_up_to, tidy

WINDOW, RUN, END_ID = 4096, 256, 2
#: More sources than this share queues, by their hash.
MOST_QUEUES = 4096
#: Rows of (partition, source) that are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Pieces of text between white space that a task remembers, and the ids that they may have in all.
MOST_KNOWN, MOST_IDS = 400_000, 8_000_000
#: What stands for the end of a text among the pieces; no piece has white space.
END = " "
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: Lower-case Latin letters, as the tokenizer leaves them; words of these only, and pieces that the tokenizer's own pattern cuts.
LETTER = "a-zß-öø-ÿ"
WORD = re.compile(f"[{LETTER}]+")
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")
SIMPLE = re.compile(f"[{LETTER}!-@[-`{{-~]+")
#: Marks that a letter can be composed with, and what special tokens begin with.
ODD = "[\u0300-\u037f]|<\\|"

# How the tokenizer's file writes the rules by which words can be encoded one by one.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts by a tokenizer's file: (ids of all texts, where each text's begin).

    Where the file's rules are RULES, none of them looks across ASCII white space, so that each distinct piece between it
    is encoded once. The tokenizer composes, then lower-cases, but looks for its special tokens first: texts with marks or
    with what may be a special token are not lower-cased beforehand. By other rules, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        rules = json.loads(self.whole.to_str())
        self.by_piece = all(rules.get(k) == v for k, v in RULES.items()) and rules["model"]["end_of_word_suffix"] == "</w>"
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        assert len(self.last) <= 1 << 16
        self.forget()

    def forget(self) -> None:
        self.known = {"": 0}
        self.ids, self.ends = np.zeros(0, "<u2"), np.zeros(1, np.int64)

    def encoded(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        tokenizer = tokenizer or self.whole
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(x.ids, "<u2") for a in range(0, len(texts), 20_000) for x in many(texts[a : a + 20_000], add_special_tokens=False)]

    def keep(self, pieces: list[str], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        """Remembers new pieces, whose ids stand one after another in `ids`."""
        self.known.update(zip(pieces, range(len(self.ends), len(self.ends) + len(pieces))))
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))

    def gathered(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these entries, one after another, where each ends)."""
        size = np.diff(self.ends, prepend=0)[code]
        ends = np.cumsum(size)
        where = np.repeat(self.ends[code] - ends, size)
        where += np.arange(len(where))
        return self.ids[where], ends

    def learn(self, pieces: list[str]) -> None:
        """Simple pieces are cut as the tokenizer would cut them, and their words encoded many to a text; others as they are."""
        column = pa.array(pieces, pa.string())
        word, simple = (pc.match_substring_regex(column, f"^(?:{x.pattern})$").to_numpy(zero_copy_only=False) for x in (WORD, SIMPLE))
        simple &= ~pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        split = strings(column.filter(pa.array(simple & ~word)))
        cuts = list(map(CUT.findall, split))
        parts = set().union(*cuts).difference(self.known)
        whole = strings(column.filter(pa.array(word | ~simple)))
        self.learn_whole(list(parts.union(whole)))
        cut = [(p, c) for p, c in zip(split, cuts) if p not in parts]
        if cut:
            ids, ends = self.gathered(np.array([self.known[x] for _, c in cut for x in c]))
            sizes = np.diff(ends[np.cumsum([len(c) for _, c in cut]) - 1], prepend=0)
            self.keep([p for p, _ in cut], [ids], sizes)

    def learn_whole(self, pieces: list[str]) -> None:
        column = pa.array(pieces, pa.string())
        word = pc.match_substring_regex(column, f"^(?:{WORD.pattern})$")
        words, other = strings(column.filter(word)), strings(column.filter(pc.invert(word)))
        for a in range(0, len(words), 2_000):
            part = words[a : a + 2_000]
            ids = self.encoded([" ".join(part)], self.words)
            sizes = np.diff(np.flatnonzero(self.last[ids[0]]) + 1, prepend=0)
            if len(sizes) != len(part):
                ids = self.encoded(part)
                sizes = np.array([len(x) for x in ids])
            self.keep(part, ids, sizes)
        if other:
            ids = self.encoded(other)
            self.keep(other, ids, np.array([len(x) for x in ids]))

    def __call__(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """text: an array of large strings without nulls; each text's ids are followed by end_id."""
        if not self.by_piece:
            each = [np.append(x, np.array([end_id], "<u2")) for x in self.encoded(strings(text))]
            return np.concatenate([np.zeros(0, "<u2"), *each]), np.cumsum([0, *map(len, each)])
        if len(self.known) > MOST_KNOWN or len(self.ids) > MOST_IDS:
            self.forget()
        text = text.take(pa.array(np.arange(len(text))))  # pc.ascii_lower misreads slices
        pieces = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(text, ODD), text, pc.ascii_lower(text)))
        coded = pieces.flatten().dictionary_encode()
        distinct = strings(coded.dictionary)
        if fresh := [p for p in distinct if p not in self.known]:
            self.learn(fresh)
        if END not in self.known:
            self.keep([END], [np.array([end_id], "<u2")], np.ones(1, np.int64))
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        last = np.asarray(pieces.offsets, np.int64)[1:] - pieces.offsets[0].as_py()
        ids, ends = self.gathered(np.insert(index[coded.indices.to_numpy()], last, self.known[END]))
        return ids, np.append(0, ends[last + np.arange(len(last))])


def encoder(path: str) -> Encoder:
    """The encoder that this worker keeps from task to task."""
    cache = process_cache()
    if cache.get("tokenizer_path") != path:
        cache |= {"tokenizer_path": path, "encoder": Encoder(path)}
    return cache["encoder"]


def token_batches(path: str, end_id: int):
    def run(batches):
        encode, part, given = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for rows, text in rows_up_to(batch, "text", SLICE):
                ids, at = encode(text, end_id)
                starts, sizes = [], np.diff(at)
                for queue, n in zip(rows.column(1).to_pylist(), sizes.tolist()):
                    starts.append(given.get(queue, 0))
                    given[queue] = starts[-1] + n
                blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(sizes), part)), pa.array(starts, pa.int64()), pa.array(sizes), blobs], names=["doc_id", "queue", "part", "inside", "n", "ids"])
        encode.forget()  # between tasks a worker keeps the tokenizer, but no pieces

    return run


class Schedule:
    """Which tokens of each queue every window takes. sizes: tokens of each queue; shares: their targets."""

    def __init__(self, sizes: np.ndarray, shares: np.ndarray, window: int = WINDOW, run: int = RUN):
        self.sizes, self.window, self.run = sizes.astype(np.int64), window, run
        self.total = int(self.sizes.sum())
        self.windows = -(-self.total // window)
        # The fluid schedule is linear between the times at which a queue runs dry.
        times, given, left = [0.0], [np.zeros(len(sizes))], self.sizes.astype(float)
        while (left > 0).any():
            rate = np.where(left > 0, np.maximum(shares, 1e-12), 0)
            rate /= rate.sum()
            lasts = np.where(left > 0, left / np.where(rate > 0, rate, 1), np.inf)
            step = lasts.min()
            done = lasts <= step * (1 + 1e-12)
            gone = np.where(done, left, rate * step)
            left = np.where(done, 0, left - gone)
            times.append(times[-1] + step)
            given.append(given[-1] + gone)
        self.times, self.given = np.array(times), np.array(given)
        self.runs: dict[int, tuple] = {}
        self.bounds: dict[int, np.ndarray] = {}

    def fluid(self, t: float) -> np.ndarray:
        k = int(np.clip(np.searchsorted(self.times, t, side="right") - 1, 0, max(0, len(self.times) - 2)))
        if len(self.times) < 2:
            return self.given[0]
        f = (t - self.times[k]) / (self.times[k + 1] - self.times[k])
        return self.given[k] + np.clip(f, 0, 1) * (self.given[k + 1] - self.given[k])

    def before(self, run: int) -> np.ndarray:
        """Tokens that each queue has given before this run."""
        if run not in self.bounds:
            goal = min(run * self.run * self.window, self.total)
            count = lambda t: np.minimum(np.floor(self.fluid(t) + 0.5).astype(np.int64), self.sizes)
            low, high = 0.0, float(self.times[-1]) + 1
            if goal >= self.total:
                found = self.sizes.copy()
            elif goal == 0:
                found = np.zeros_like(self.sizes)
            else:
                for _ in range(200):
                    mid = (low + high) / 2
                    if mid in (low, high):
                        break
                    low, high = (low, mid) if count(mid).sum() >= goal else (mid, high)
                found, over = count(low), count(high)
                for s in np.flatnonzero(over > found):  # tokens that are due at the same time, by queue
                    found[s] += min(over[s] - found[s], goal - found.sum())
            self.bounds[run] = found
        return self.bounds[run]

    def filled(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each queue before each window of the run, places in each window before each queue)."""
        if run not in self.runs:
            start, stop = self.before(run), self.before(run + 1)
            n = min(self.run, self.windows - run * self.run)
            at, left, deficit = np.empty((n + 1, len(start)), np.int64), stop - start, self.fluid(run * self.run * self.window) - start
            at[0] = start
            for w in range(n):
                t = (run * self.run + w) * self.window
                room = int(min(self.window, left.sum()))
                deficit = deficit + self.fluid(t + self.window) - self.fluid(t)
                take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
                while (over := int(take.sum()) - room) > 0:
                    s = int(np.argmax(take))
                    take[s] -= min(over, take[s])
                while (short := room - int(take.sum())) > 0:
                    due = np.argsort(-(deficit - take), kind="stable")
                    due = due[(left - take)[due] > 0][:short]
                    take[due] += 1
                deficit, left = deficit - take, left - take
                at[w + 1] = at[w] + take
            taken = np.diff(at, axis=0)
            if len(self.runs) > 64:
                self.runs.clear()
            self.runs[run] = at, np.cumsum(taken, axis=1) - taken
        return self.runs[run]

    def pieces(self, queue: int, start: int, n: int):
        """(offset in the text's tokens, length, window, place) of each piece of tokens start..start+n of a queue."""
        t = float(np.interp(start, self.given[:, queue], self.times))
        run = int(t // (self.run * self.window))
        while run > 0 and self.before(run)[queue] > start:
            run -= 1
        at = start
        while at < start + n:
            while self.before(run + 1)[queue] <= at:
                run += 1
            cum, place = self.filled(run)
            w = int(np.searchsorted(cum[:, queue], at, side="right")) - 1
            while at < start + n and w < len(place):
                length = min(int(cum[w + 1, queue]), start + n) - at
                if length > 0:
                    yield at - start, length, run * self.run + w, int(place[w, queue] + at - cum[w, queue])
                    at += length
                w += 1


def piece_batches(queues: list, sizes: list[int], shares: list[float], window: int, run_length: int):
    def run(batches):
        schedule = Schedule(np.array(sizes), np.array(shares), window, run_length)
        number = {q: i for i, q in enumerate(queues)}
        for batch in batches:
            for rows in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                out = []
                for doc, queue, at, ids in zip(*(rows.column(i).to_pylist() for i in range(4))):
                    wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    for start, length, sequence, offset in schedule.pieces(number[queue], at, len(ids) // 2):
                        out.append((doc, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), len(ids) // 2, sequence, offset, queue))
                yield pa.RecordBatch.from_pydict({name: pa.array(column, kind) for (name, kind), column in zip(PIECES, zip(*out) if out else [[]] * 8)})

    return run


PIECES = [(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("queue", pa.string())]


def pack(docs: DataFrame, tokenizer: str, weights: dict | None = None, window: int = WINDOW, run: int = RUN, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents in windows of `window` tokens; each token is in exactly one piece.

    docs has doc_id, text, source. weights: the target share of each source (None among them), by default its tokens,
    so that every window has the mixture of the whole; where a queue runs dry its share goes to the others by weight.
    A null or empty text has the end id alone; a null source is a source. Rows that repeat are packed as often. Other
    columns play no part. With more than MOST_QUEUES sources, those that share a queue have the sum of their shares, in
    the order of their rows. An empty table gives no pieces. Columns: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, queue.
    """
    spark, weights = docs.sparkSession, weights or None
    several = docs.select("source").distinct().limit(MOST_QUEUES + 1).count()
    queue = F.col("source") if several <= MOST_QUEUES else F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string")
    tokens = cut(docs.select("doc_id", queue.cast("string").alias("queue"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(token_batches(tokenizer, end_id)), "doc_id long, queue string, part long, inside long, n long, ids binary"))
    sums = cut(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("queue").alias("_queue"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = sorted(((r.queue, int(r.n)) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    if sums.count() <= MOST_BROADCAST:
        base = F.broadcast(base)
    queues, sizes = [q for q, _ in totals], [n for _, n in totals]
    if weights and several > MOST_QUEUES:
        # A shared queue has the sum of its sources' targets.
        given = F.broadcast(spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_source string, weight double"))
        present = docs.select(F.col("source").cast("string").alias("source"), queue.alias("queue")).distinct()
        weights = {r.queue: r.weight for r in present.join(given, F.col("source").eqNullSafe(F.col("_source"))).groupBy("queue").agg(F.sum("weight").alias("weight")).collect()}
    shares = [float(weights.get(q, 0) if weights is not None else n) for q, n in totals]
    placed = tokens.join(base, F.col("queue").eqNullSafe(F.col("_queue")) & (F.col("part") == F.col("_part")))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return placed.select("doc_id", "queue", (F.col("base") + F.col("inside")).alias("at"), "ids").mapInArrow(tidy(piece_batches(queues, sizes, shares, window, run)), schema)
