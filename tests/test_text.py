"""Text rules by example."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, records, text
from tidemark.operators import issues, places, reads


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("near [approx. 48.522500, -122.690800].", (48.5225, -122.6908)),
        ("48.04269N 122.40669", (48.04269, -122.40669)),
        ("47.812031° N, 122.419909° W", (47.812031, -122.419909)),
        ("47°22'15.1\"N 122°25'20.7\"W", (47.3708611, -122.4224167)),
        ("N 48d00.258' , W 122d17.825'", (48.0043, -122.2970833)),
        ("12.3456, 56.7890", None),
        ("about 3.5, 2.1 miles", None),
        ("17:20 - leaving", None),
        ("", None),
        (None, None),
        ("N 10d00.258' , W 122d17.825' or 48.522500,-122.690800", None),
    ],
)
def test_gps(spark, given, wanted):
    got = one(spark, text.gps, given)
    assert (got is None) == (wanted is None)
    if wanted:
        assert (got.lat, got.lng) == pytest.approx(wanted, abs=1e-6)


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Thu, Jul 9 - Puget Sound (T65A5)", (7, 9, "Puget Sound", "T65A5")),
        ("Tues. Sept 30 – San Juans", (9, 30, "San Juans", None)),
        ("sat jun 6 - South Sound (J pod) (K pod)", (6, 6, "South Sound (J pod)", "K pod")),
        ("Thu, Jul 9", None),
        ("Jul 9 - Puget Sound", None),
        ("Thu, Julember 9 - Puget Sound", None),
    ],
)
def test_header(spark, given, wanted):
    got = one(spark, text.header, given)
    assert (got and (got.month, got.day, got.water_body, got.pod)) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [(" bigg’s killer whales (transients)", "biggs"), ("GRAY WHALES(CRC53)", "gray"), ("DOLPHINS", "other"), ("GRAY WHALES seen today", None), ("PORPOISES", None)],
)
def test_banner(spark, given, wanted):
    got = one(spark, text.banner, given)
    assert (got and got.species) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("DOLPHINS ", "other"), ("dolphins\u00a0(two)", None), ("DOLPHINS  (two)", None), ("DOLPHINSS", None), ("DOLPHINS(" + "x" * 100, "other"), ("northern resident killer whales", "northern_resident"), ("NORTHERN RESIDENT KILLER WHALES (A)", "northern_resident"), ("DOLPHINS\u2028", None), ("dolphinſ", "other"), ("", None), (None, None)])
def test_banner_ends(spark, given, wanted):
    got = one(spark, text.banner, given)
    assert (got and got.species) == wanted


def test_strip_looks_at_the_ends_only(spark):
    """Runs of blanks inside of a line took time by their square, and a line of words was searched about thirty times for a banner."""
    run, began = "a" + " " * 200_000 + "b", time.monotonic()
    assert one(spark, text.strip, f" \u00a0\ufeff{run}\t\x0b\n ") == run
    assert one(spark, text.strip, "a \u2028") == "a \u2028" and one(spark, text.strip, " \n") == ""
    words = spark.range(20_000).select(F.concat(F.lit("a b c d e f g h " * 100), "id").alias("x"))
    assert words.filter(text.banner(F.col("x"))["name"].isNotNull()).count() == 0
    assert time.monotonic() - began < 20


def test_header_dates(spark):
    rows = spark.createDataFrame([(12, 30, "2026-01-05"), (7, 9, "2026-07-15"), (1, 2, "2025-12-31")], "m int, d int, i string")
    assert [r.x for r in rows.select(text.header_date(F.col("m"), F.col("d"), F.to_date("i")).alias("x")).collect()] == ["2025-12-30", "2026-07-09", "2026-01-02"]


def test_small_rules(spark):
    assert one(spark, text.norm, "  Point\t No  Point ") == "point no point"
    assert one(spark, text.clean, "﻿a\r\nb\rc d​") == "a\nb\nc d"
    assert one(spark, text.bracket_readings, "N [North] Beach") == ["N [North] Beach", "North Beach", "N Beach"]
    assert one(spark, text.split_lines, " a\r\n\r\nb \na") == ["a", "b"]
    got = spark.range(1).select(geo.bearing(F.lit(48.0), F.lit(-123.0), F.lit(48.0), F.lit(-122.0)).alias("b"), text.inland_label(F.lit(1500)).alias("l")).first()
    assert (got.b, got.l) == ("east", "1.5 km")


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ('[{"a": 1}, {"a": 2}]', 2),
        ('[{"a": "x\ny"}]', 1),
        ('[{"a": 1}, {"a": 2}, {"a": ', 2),
        ('see [x]: [{"a": 1}] and [{"b": 1}, {"c": 2}]', 1),
        ("nothing", None),
        ("[{broken", None),
        ("", None),
    ],
)
def test_salvage(given, wanted):
    got = records.salvage(given)
    assert (got and len(got)) == wanted


def test_parameters():
    assert reads.page_size(0) == 5000 and reads.page_size(99999) == 10000
    assert reads.listed(" a, ,b") == ["a", "b"] and reads.listed("") == []
    for bad in ("1,2,3", "a,b,c,d", "1,2,3,NaN"):
        with pytest.raises(ValueError):
            reads.bounding_box(bad)
    with pytest.raises(ValueError):
        reads.page_size(-1)


def test_anchors(spark):
    pool = spark.createDataFrame([(0, 1, "Rocky Point"), (2, 2, "Point"), (2, 3, "Beach"), (2, 4, "Alki"), (2, 5, "Bay"), (2, 6, "Rocky Point")], "source int, id long, name string")
    strings = spark.createDataFrame([("off R [Rocky] Point, Alki beach",)], "location_raw string")
    got = [(r.place, r.name, r.source) for r in places.anchors(strings, pool).orderBy("place").collect()]
    assert got == [(1, "Rocky Point", 0), (2, "Rocky Point", 2), (3, "Point", 2), (4, "Alki", 2)]


def test_chunks_hold_every_report(spark):
    lines = ["Jul 15, 2026", "GRAY WHALES", "Thu, Jul 9 - Puget Sound"]
    for i in range(400):
        lines += [f"{i}:00 report number {i} " + "x" * 60, "-"]
    lines += ["PORPOISES", "Fri, Jul 10 - Hood Canal", "one more", "MINKE WHALES", "Fri, Jul 10 - Admiralty", "a minke", "ABOUT ORCA NETWORK", "Fri, Jul 10 - nowhere"]
    df = spark.createDataFrame([("a", i, line) for i, line in enumerate(lines)], "issue string, line_no int, line string")
    got = issues.chunks(df).collect()
    joined = "\n".join(r.text for r in got)
    assert all(joined.count(f"report number {i} ") == 1 for i in range(400)) and "nowhere" not in joined
    assert all(r.text.startswith("Thu") or r.carried_header or r.text.startswith("Fri") for r in got)
    assert [r.line for r in issues.unknown_banners(df).collect()] == ["PORPOISES"]
    dates = issues.date_ranges(df).first()
    assert (dates.first_date, dates.last_date) == ("2026-07-09", "2026-07-10")
