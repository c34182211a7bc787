import pytest

CLASHING = ["keep_id", "kept", "component_id", "n_shingles", "size", "target", "taken", "start", "length", "score", "batch", "queue", "part", "node", "value", "digest", "n", "print", "sketch", "place", "toxic", "features", "ids", "at", "base", "bucket", "keys", "m", "copies", "copy", "round", "block", "shard", "_file", "_row", "_size", "_runs", "_doc", "_hash", "_metadata", "_source", "_start", "_bucket", "file", "row", "doc", "cut", "words", "runs", "keep", "text_hash"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(40))
    near = words.replace("w39", "x")
    rows = [
        (1, words, "en", "a"),
        (2, words, "en", "b"),
        (2, words, "en", "b"),
        (3, near, "en", None),
        (4, None, None, "a"),
        (5, "", "en", "a"),
        (6, " \t\r\n", "en", "c"),
        (None, words, "en", "c"),
        (None, None, None, None),
        (7, "one two", "de", "é"),
        (8, "ONE  two", "de", "z"),
        (9, "<|endoftext|> “quoted” ẞ İ don't 12.5 \u0000 　 x", "en", "z"),
        (10, "word " * 30_000, "en", "a"),
        (11, "y" * 70_000, "en", "a"),
        (12, " ".join(f"v{i}" for i in range(5000)), "fr", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    return df.selectExpr("*", *(f"'x' as {c}" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
