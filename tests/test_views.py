"""Views that Spark works out by another way than their SQL."""

from pyspark.sql import functions as F

from tidemark.plans import views


def test_issue_lines_are_numbered_by_ranges(spark, sf_dir, tmp_path, monkeypatch):
    """The same rows as the view's SQL, ids that repeat, null texts and a null source too; no task has an issue."""
    monkeypatch.setattr(views, "ID_RANGE", 8, raising=False)
    monkeypatch.setattr(views, "DOCUMENT_RANGE", 4, raising=False)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(900_001, None, "src1"), (900_002, "a", None), (900_003, "b\nc", None), (900_004, "", "alone"), (900_005, "same\nsame", "alone"), (900_005, "same\nsame", "alone")], docs.schema)
    docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source"))).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = views.Views(spark, str(tmp_path)).issue_lines
    want = spark.sql(views.with_clause("spark", ["v_issue_lines"], str(tmp_path)) + "select * from v_issue_lines")
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        sizes = [r.n for r in got.filter("issue = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 10 and max(sizes) < 0.3 * sum(sizes)


def test_ends_among_many_lines_and_texts_of_one_id(spark, tmp_path, monkeypatch):
    """The view's SQL with smaller places of its ends: documents and lines stand behind them; a doc_id has texts of several sizes in two sources."""
    monkeypatch.setattr(views, "END", 3, raising=False)
    monkeypatch.setitem(views.VIEWS, "v_issue_lines", views.VIEWS["v_issue_lines"].replace("1000000", "3"))
    # What the SQL leaves open, as it has the same place, is the same text.
    rows = [(n, "ABOUT ORCA NETWORK" if n == 3 else "a\nb\nc\n-\ne", "long") for n in range(13)]
    rows += [(20, "same", "x"), (20, "same\nother", "x"), (20, "same\nother\nlast", "y"), (21, "next", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = views.Views(spark, str(tmp_path)).issue_lines
    want = spark.sql(views.with_clause("spark", ["v_issue_lines"], str(tmp_path)) + "select * from v_issue_lines")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
