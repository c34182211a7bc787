"""MinHash near-dedup: bottom-k sketches from one hash function.

1. Sketch: each text's set of distinct word shingles is hashed by one function; the k smallest values are kept. Texts
   with equal sets are one node from here on, so copies never form pairs.
2. Inverted lists of the retained values. Similar sets share at least least_shared() of them, but for a chance of about
   1e-8; of its values, sorted rarest first, a node is therefore listed under the first k - least_shared + 1. Passages
   that many documents share thus seldom make a list. Nodes that share a list with another are then listed in the same
   way under the values of their whole sets, where the bounds are certain.
3. Overlaps: values that the same nodes hold are one token, whose weight is their number. A listed token stands at some
   position of a node's sorted set; what follows it bounds the overlap of two nodes that meet there. Each list's hub (the
   member whose values are most frequent) meets its members; then, in lists that still hold several components, the
   members outside the hub's component meet the others.
4. A pair is dropped where the union of its two first sketches estimates too small a similarity; the rest is confirmed
   on full shingle sets, by counting.
5. Components by alternating large-star and small-star steps over confirmed links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, cut, mix64, rows_up_to, shingle_hashes, tidy

K = 64
#: A sketch of so many values is a whole set.
WHOLE = 1 << 40
#: Values that more than one in so many listed values are equal to are broadcast, so at most as many values.
MOST_HOT = 10_000
#: Bits of the map of texts that are wanted again.
SLOTS = 1 << 24


def least_shared(n: str, k: int, percent: int) -> str:
    """SQL: retained values that a set of n shares with any set that is similar enough; six deviations below the mean.

    The k smallest values of a union are a sample of it without replacement; the union has at most n / similarity values.
    Sets of fewer than k * similarity values, and all that are similar to them, are in their sketches whole.
    """
    t = percent / 100
    whole = f"ceil({n} * {percent} / 100)"
    if k >= WHOLE:
        return f"cast({whole} as int)"
    drawn = f"floor({t * k} - 6 * sqrt({t * (1 - t) * k} * (1 - {k} / greatest({k}, {n} / {t}))))"
    return f"cast(if({n} <= {t * k}, {whole}, greatest(1, least({whole}, {drawn}))) as int)"


def shingle_sets(text: pa.Array, n: int):
    """For each text the sorted distinct shingle hashes; of a text of fewer than n words, the hash of the whole sequence."""
    words = Words(text)
    hashes = words.hashes()
    shingles = shingle_hashes(hashes, n).view(np.int64)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            yield np.unique(shingles[a : b - n + 1])
        elif b > a:
            yield mix64(shingle_hashes(hashes[a:b], int(b - a)) ^ np.uint64(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def sketch_batches(n: int, k: int):
    def run(batches):
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                sizes, prints, values, ends = [], [], [], [0]
                for s in shingle_sets(text, n):
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    values.append(s[:k])
                    ends.append(ends[-1] + len(values[-1]))
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), sketch], names=["doc_id", "text_hash", "n_shingles", "print", "sketch"])

    return run


def set_batches(n: int):
    def run(batches):
        for batch in batches:
            for rows, text in rows_up_to(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in shingle_sets(text, n)], pa.binary())], names=["node", "shingles"])

    return run


def overlap_batches(batches):
    """Sizes of the intersection of two full sets."""
    for batch in batches:
        shared = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        size = lambda c: [len(x) // 8 for x in batch.column(c).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(size(2), pa.int64()), pa.array(size(3), pa.int64())], names=["a", "b", "shared", "size_a", "size_b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that can be reached.

    Links of a node with itself, and links that repeat, change nothing; without links there are no rows. What a node's
    smallest neighbour is, is stored before it is joined back, so that adaptive execution can split a node with many links.

    Alternating star operations: each moves links towards the smallest neighbour; no neighbour list is gathered, minima
    are partial aggregates, and the number of rounds grows with the logarithm of a component's diameter.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        marks = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (links, new)]
        links = new
        if marks[0] == marks[1]:
            break
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def value_batches(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            values = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in values])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(values))], names=["node", "value"])


def inverted_lists(nodes: DataFrame, values: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, node, n, weight, rest) of lists with two members or more; rest: the sketch's values from this one on.

    nodes: (node, n); values: (node, value), the k smallest values of each node, or all (k = WHOLE). A node's values are sorted rarest first;
    those that it alone has come first and make no list. Values that the same nodes hold make one list: `value` is what
    stands for these nodes, and `rest` counts from the first of the values.
    """
    frequent = cut(values.groupBy("value").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("df > 1"))
    # A value may belong to any share of the nodes: there can be at most MOST_HOT of more than 1 / MOST_HOT of all, and
    # these are broadcast; the others are dealt by value.
    total = frequent.agg(F.sum("df")).first()[0] or 0
    hot = F.broadcast(frequent.filter(F.col("df") > total / MOST_HOT))
    known = values.join(hot, "value", "left")
    often = known.filter("df is not null").select("node", "df", "who")
    seldom = known.filter("df is null").select("node", "value").join(frequent.filter(F.col("df") <= total / MOST_HOT), "value").select("node", "df", "who")
    held = often.unionByName(seldom).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "who"))).alias("held"), F.sum("df").alias("weight"))
    length = held.join(nodes, "node").withColumn("room", F.expr(f"least(size(held), size(held) - {least_shared('n', k, percent)} + 1)"))
    listed = length.filter("room > 0")
    first = F.expr("filter(transform(slice(held, 1, room), (x, i) -> named_struct('who', x.who, 'at', i)), (x, i) -> i = 0 or x.who <> get(held, i - 1).who)")
    at = listed.select("node", "n", "weight", F.size("held").alias("size"), F.explode(first).alias("h"))
    lists = cut(at.select(F.col("h.who").alias("value"), "node", "n", "weight", (F.col("size") - F.col("h.at")).alias("rest")))
    several = lists.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1").select("value")
    return lists.join(several, "value")


def bound(a: str, b: str, percent: int) -> str:
    """SQL: whether two nodes that meet in a list of whole sets can share enough, by sizes and by what is left of each."""
    n, m = f"n_{a}", f"n_{b}"
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {100 + percent} * least(rest_{a}, rest_{b}) >= {percent} * ({n} + {m})"


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that the union of their sketches lets pass, and whose full sets are similar enough."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    seen = F.size(F.array_intersect(F.array_intersect(union, F.col("sketch_a")), F.col("sketch_b")))
    few = F.expr(least_shared("1e9D", k, percent))
    likely = both.filter(seen >= F.when(F.size(union) < k, F.ceil(F.size(union) * percent / 100)).otherwise(few)).select("a", "b")
    full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    counted = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(overlap_batches), "a long, b long, shared long, size_a long, size_b long")
    return counted.filter(f"100 * shared >= {percent} * (size_a + size_b - shared)").select("a", "b")


def shared_sets(docs: DataFrame, nodes: DataFrame, n: int, k: int, percent: int) -> DataFrame:
    """(node, shingles): the whole sets of nodes that share a list of retained values with another."""
    met = inverted_lists(nodes.select("node", "n"), nodes.select("node", F.explode("sketch").alias("value")), k, percent)
    needed = nodes.join(met.select("node").distinct(), "node").select("node", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(needed))
    likely = docs.mapInArrow(tidy(marked_batches(bits)), "doc_id long, text string, text_hash long")
    texts = likely.join(needed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    return cut(texts.select("node", "text").mapInArrow(tidy(set_batches(n)), "node long, shingles binary").dropDuplicates(["node"]))


def bitmap(needed: DataFrame) -> np.ndarray:
    """A bit for each slot that a needed hash falls in: 2 MB, whatever the input; where most are set, it only saves less."""
    slot = F.pmod("_hash", F.lit(SLOTS)) + 1
    parts = needed.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in parts:
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def marked_batches(bits):
    """Rows whose hash may be needed; the join decides. It spares the shuffle most texts that are like no other."""

    def run(batches):
        for batch in batches:
            slot = batch.column(2).to_numpy() % SLOTS
            yield batch.filter(pa.array((bits.value[slot >> 3] >> (slot & 7)) & 1 == 1))

    return run


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 75, k: int = K) -> DataFrame:
    """Components of documents whose sets of n-word shingles have 100 * intersection >= percent * union.

    `docs` has doc_id and text; other columns are ignored. Returns a row for each row of docs: doc_id, n_shingles,
    component_id, kept, text_hash. Null or wordless texts are alone. Rows that repeat a doc_id are rows of their own; their
    component_id is the smallest doc_id of all rows that can be reached, and each row that bears it is kept. A null
    doc_id counts as larger than all others. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = cut(docs.mapInArrow(tidy(sketch_batches(n, k)), "doc_id long, text_hash long, n_shingles long, print binary, sketch array<long>"))
    # One node for each set; of equal sets, the text of the smallest doc_id.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n_shingles", "sketch")).alias("x")
    nodes = cut(rows.filter("n_shingles > 0").groupBy("print").agg(best).select("print", "x.doc_id", "x.text_hash", F.col("x.n_shingles").alias("n"), "x.sketch", F.monotonically_increasing_id().alias("node")))

    sets = shared_sets(docs, nodes, n, k, percent)
    sizes = sets.select("node", F.expr("cast(length(shingles) / 8 as bigint) as n"))
    lists = cut(inverted_lists(sizes, sets.mapInArrow(tidy(value_batches), "node long, value long"), WHOLE, percent))

    # What stands lower than this in its list can meet no member, be it the smallest that is similar.
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", "node", "n", "rest")).alias("hub"), F.min("n").alias("n_least")).select("value", "n_least", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.rest").alias("rest_hub"))
    member = lists.select("value", "node", F.col("n").alias("n_node"), F.col("rest").alias("rest_node")).join(hubs, "value").filter("node <> hub")
    pairs = member.filter(bound("node", "hub", percent)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = cut(confirmed(pairs, nodes, sets, k, percent))

    roots = components(links)
    rooted = lambda df, x: df.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left").withColumn(f"{x}_root", F.coalesce(f"{x}_root", x))
    able = f"{100 + percent} * rest_node >= {percent} * (n_node + greatest(n_least, ceil({percent} * n_node / 100)))"
    member = cut(rooted(rooted(member.filter(able).select("value", "node", "n_node", "rest_node", "hub"), "node"), "hub"))
    outside = member.filter("node_root <> hub_root").drop("hub", "hub_root")
    other = member.select("value", F.col("node").alias("other"), F.col("n_node").alias("n_other"), F.col("rest_node").alias("rest_other"), F.col("node_root").alias("other_root"))
    meet = (outside["value"] == other["value"]) & F.expr("node_root <> other_root") & F.expr(bound("node", "other", percent))
    pairs = outside.join(other, meet).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    more = cut(confirmed(pairs, nodes, sets, k, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    placed = rooted(nodes.select("print", "node", "doc_id"), "node")
    least = cut(placed.groupBy("node_root").agg(F.min("doc_id").alias("component_id")))
    found = placed.join(least, "node_root").select("print", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "print").join(found, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that bear their component's smallest doc_id, with docs' columns, whatever their names.

    Null or wordless texts are alone and stay; rows that repeat their doc_id all stay if it is the smallest. An empty
    table gives no rows.
    """
    dropped = near_dedup(docs, **parameters).filter("not kept").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("gone")) & (F.xxhash64(F.coalesce("doc.text", F.lit(""))) == F.col("hash"))
    return rows.join(dropped, same, "left_anti").select("doc.*")
