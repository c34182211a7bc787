"""Exact dedup: stateful streaming with disk-backed keyed state, in DataFrame operations only.

A stream of (digest, document, locator) rows is folded into RocksDB state that never expires: for each digest the number
of rows, and the identifier and content locator (file and row) of the row that stays. The state is then read as a table.
On hits the locators give both contents, and all bytes are compared; rows that share a digest but differ are grouped
by their texts instead.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, delete, scratch

#: State is kept on disk, in files that are no larger than what they hold: there may be many small stores. All stores of an
#: executor share one bounded cache and write buffer outside its heap, and soon go once their query has ended.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """doc (a row of docs, as a struct) with its content locator, file and row.

    Rows that come from no file, or that have a column _metadata of their own, are written to the shared folder first.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(doc, *place)
        except AnalysisException:
            pass
    docs.select(doc).write.parquet(path := scratch(docs.sparkSession, "located"))
    return docs.sparkSession.read.parquet(path).select("doc", *place)


@contextmanager
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fold(stream: DataFrame, state: str) -> None:
    """Folds a stream of (digest, doc_id, file, row) into the state at `state`; another call goes on from there."""
    index = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    with rocksdb(stream.sparkSession):
        query = index.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def held(spark, state: str) -> DataFrame:
    """The state as a table: digest, keep, n."""
    stored = spark.read.format("statestore").load(state)
    keep, n = stored.schema["value"].dataType.names
    return stored.select("key.digest", F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def exact_dedup(docs: DataFrame, digest=sha256, hits_per_copy: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(rows, decisions): located(docs), and for each of its rows what becomes of it.

    decisions: doc_id, keep_id, group_size, kept, digest, file, row. Texts are equal when their bytes are; a null text
    counts as empty. The row with the largest doc_id stays; a null doc_id counts as smallest. Of rows that repeat both
    doc_id and text, the one that is last by file and row stays, so exactly one row of each group is kept. Other
    columns play no part. An empty table gives no decisions. A group may hold any share of the rows: a copy of the
    text that stays serves at most about `hits_per_copy` comparisons.
    """
    spark, rows = docs.sparkSession, located(docs)
    text = F.coalesce("doc.text", F.lit(""))
    landing, state = scratch(spark, "landing"), scratch(spark, "state")
    try:
        rows.select(digest(text).alias("digest"), "doc.doc_id", "file", "row").write.parquet(landing)
        landed = spark.read.parquet(landing)
        fold(spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1000).parquet(landing), state)

        hits = held(spark, state).filter("n > 1")
        decided = landed.join(hits, "digest", "left")
        own = F.col("keep").isNull()
        kept = own | ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")))
        columns = ["doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "digest", "file", "row"]
        decisions = cut(decided.select(*columns))

        copies = F.ceil(F.col("n") / hits_per_copy).cast("int")
        shared = cut(rows.select(digest(text).alias("digest"), text.alias("text"), "file", "row").join(hits.select("digest", "keep", copies.alias("copies")), "digest"))
        stays = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
        first = shared.filter(stays).select("digest", F.col("text").alias("first"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        again = shared.filter(~stays).select("digest", "text", F.pmod(F.xxhash64("file", "row"), "copies").cast("int").alias("copy"))
        differ = cut(again.join(first, ["digest", "copy"]).filter(F.col("text") != F.col("first")).select("digest").distinct())
        if not differ.isEmpty():
            decisions = cut(regrouped(decisions, rows, differ, digest))
    finally:
        delete(spark, landing)
        delete(spark, state)
    return rows, decisions


def regrouped(decisions: DataFrame, rows: DataFrame, differ: DataFrame, digest) -> DataFrame:
    """decisions, where rows under the digests of `differ` are grouped by their texts."""
    text = F.coalesce("doc.text", F.lit(""))
    texts = rows.select("doc.doc_id", text.alias("text"), digest(text).alias("digest"), "file", "row").join(differ, "digest", "left_semi")
    groups = texts.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    stays = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    own = texts.join(groups, ["digest", "text"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "digest", "file", "row")
    return decisions.join(differ, "digest", "left_anti").select(*own.columns).unionByName(own)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names; nulls, ties and repeats as in exact_dedup()."""
    rows, decisions = exact_dedup(docs)
    dropped = decisions.filter("not kept").select("file", "row")
    return rows.join(dropped, ["file", "row"], "left_anti").select("doc.*")
