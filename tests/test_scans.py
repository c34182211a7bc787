"""Running values and splits against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import issues, scans


def running(rows, how, before, backward):
    out, seen = {}, {}
    for g, n, x in sorted(rows, key=lambda r: r[1], reverse=backward):
        old = seen.get(g, None if how == "last" else 0)
        new = (old if x is None else x) if how == "last" else old + (x or 0)
        out[g, n], seen[g] = old if before else new, new
    return out


@pytest.mark.parametrize("how", ["last", "sum"])
@pytest.mark.parametrize("before,backward", [(False, False), (True, True)])
def test_running_values(spark, monkeypatch, how, before, backward):
    """A group of most rows, gaps in the numbers, null groups, and ranges of ranges."""
    draw = random.Random(2)
    rows = [(g, n, draw.choice([None, None, draw.randint(-5, 5)])) for g, most in (("hot", 400), ("b", 7), (None, 20), ("gaps", 3000)) for n in range(most) if g != "gaps" or n % 97 == 3]
    df = spark.createDataFrame(rows, "g string, n int, x int").repartition(3)
    for per in (4, 16_384):
        monkeypatch.setattr(scans, "PER", per)
        got = scans.scanned(df, ["g"], "n", {"y": F.col("x")}, how=how, before=before, backward=backward)
        assert got.columns == ["g", "n", "x", "y"]
        assert {(r.g, r.n): r.y for r in got.collect()} == running(rows, how, before, backward)


def parts_of(rows, most, whole):
    out, state = {}, {}
    for g, n, size, may in sorted(rows, key=lambda r: r[1]):
        part, length = state.get(g, (0, 0))
        if may and length > 0 and length + (size if whole else 0) > most:
            part, length = part + 1, 0
        out[g, n], state[g] = part, (part, length + size)
    return out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("short", [0, 60])
def test_splits(spark, monkeypatch, whole, short):
    """By doubling steps, by folds, and by both: a group of most rows, sizes beyond a part, rows that may not begin one."""
    monkeypatch.setattr(scans, "PER", 16)
    for seed, most, sizes in ((1, 10, [1, 2, 3, 9, 10, 11, 12, 30]), (2, 100, [1, 5, 20])):
        draw = random.Random(seed)
        rows = [(g, 3 * n, draw.choice(sizes), draw.random() < 0.7) for g, count in (("hot", 300), ("b", 40), ("c", 1), (None, 70)) for n in range(count)]
        df = spark.createDataFrame(rows, "g string, n int, _size int, _may boolean").repartition(3)
        got = scans.split(df, ["g"], "n", most, "part", whole=whole, short=short)
        assert {(r.g, r.n): r.part for r in got.collect()} == parts_of(rows, most, whole)


@pytest.mark.parametrize("whole", [True, False])
def test_a_long_group_takes_few_steps(spark, monkeypatch, whole):
    """However many parts a group has, what is stored on the way grows with the levels of its ranges only, here four."""
    monkeypatch.setattr(scans, "PER", 8)
    monkeypatch.setattr(scans, "FAN", 4, raising=False)
    draw = random.Random(5)
    rows = [(g, n + 5, draw.choice([1, 2, 7, 30]), draw.random() < 0.8) for g, count in (("hot", 900), (None, 100)) for n in range(count)]
    steps, stored = [], scans.stored
    monkeypatch.setattr(scans, "stored", lambda df: steps.append(df.columns) or stored(df))
    got = scans.split(spark.createDataFrame(rows, "g string, n int, _size int, _may boolean"), ["g"], "n", 10, "part", whole=whole, short=0)
    want = parts_of(rows, 10, whole)
    assert {(r.g, r.n): r.part for r in got.collect()} == want
    assert max(want.values()) > 300 and len(steps) <= 6


def test_lines_are_read_once(spark):
    """Sections come from one reading of the lines, though a scan looks at them twice."""
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    lines = ["GRAY WHALES", "Thu, Jul 9 - Puget Sound", "a", "", "Fri, Jul 10 - Hood Canal", "b", "c"]
    df = spark.createDataFrame([("i", n, x) for n, x in enumerate(lines)], "issue string, line_no int, line string").withColumn("line", look("line"))
    got = issues.sections(df).collect()
    assert sorted((r.header_line, r.text) for r in got) == [(1, "Thu, Jul 9 - Puget Sound\na"), (4, "Fri, Jul 10 - Hood Canal\nb\nc")]
    assert seen.value == len(lines)


def test_texts_of_chunks_are_not_stored_to_be_measured(spark, sf_dir, monkeypatch):
    """carried_headers stores what it asks of its chunks' texts, not the texts."""
    from tidemark.plans import catalogue

    kept, stored = [], scans.stored
    monkeypatch.setattr(scans, "stored", lambda df: kept.append(df.columns) or stored(df))
    catalogue.QUERIES["carried_headers"](spark, sf_dir)
    assert {"part_no", "carried_header"} <= set(kept[-1]) and "text" not in kept[-1]


def test_split_of_nothing(spark):
    none = spark.createDataFrame([], "g string, n int, _size int, _may boolean")
    assert scans.split(none, ["g"], "n", 5, "part", whole=True).count() == 0
    assert scans.scanned(none, ["g"], "n", {"y": F.col("_size")}).count() == 0


def test_an_issue_is_dealt_to_many_tasks(spark, monkeypatch):
    """One issue with nearly all lines: no task has more than a small share of them, and ownership is as by a plain loop."""
    monkeypatch.setattr(scans, "PER", 100)
    draw = random.Random(4)
    kinds = ["GRAY WHALES", "MINKE WHALES", "Thu, Jul 9 - Puget Sound", "Fri, Jul 10 - Hood Canal", "SEA LIONS", "-", *["a whale"] * 20]
    lines = [("hot", i, draw.choice(kinds)) for i in range(3000)] + [("hot", 3000, "ABOUT ORCA NETWORK")] + [("hot", 3001 + i, "GRAY WHALES") for i in range(50)] + [("b", 0, "MINKE WHALES"), ("b", 1, "x")]
    df = spark.createDataFrame(lines, "issue string, line_no int, line string")
    want, banner, header = {}, None, None
    for issue, n, line in lines[:3000]:
        if line.endswith("WHALES"):
            banner, header = (n, line), None
        elif banner:
            header = n if " - " in line else header
            want[n] = (banner[0], banner[1], header)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = issues.owned(df)
        rows = got.filter("issue = 'hot'").collect()
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.line_no: (r.banner_line, r.banner_name, r.header_line) for r in rows} == want
    assert max(sizes) < 0.2 * len(rows) and len(sizes) > 10
    unknown = [r.line for r in issues.unknown_banners(df).collect()]
    assert unknown == ["SEA LIONS"]


def test_a_summary_is_found_by_ranges(spark, monkeypatch):
    """A summary over several ranges, one without an end of its own, one after the banner."""
    monkeypatch.setattr(scans, "PER", 4)
    long_ = ["x", "ANNOUNCEMENTS", "SUMMARY", *(f"s{i}" for i in range(20)), "Announcements of all", "y", "GRAY WHALES", "ANNOUNCEMENTS"]
    rows = {"a": long_, "b": ["SUMMARY", "one", "two", "MINKE WHALES", "three"], "c": ["GRAY WHALES", "SUMMARY", "late", "ABOUT ORCA NETWORK"], "d": ["ABOUT ORCA NETWORK", "SUMMARY", "no"], "e": ["nothing"]}
    df = spark.createDataFrame([(k, i, x) for k, v in rows.items() for i, x in enumerate(v)], "issue string, line_no int, line string")
    got = issues.summaries(df)
    assert {(r.issue, r.summary) for r in got.collect()} == {("a", "\n".join(f"s{i}" for i in range(20))), ("b", "one\ntwo")}
