"""Anchors by automaton against a plain loop."""

import random

import pytest

from tidemark.functions.vocab import GENERIC_NAMES, SHORTEST_ANCHOR
from tidemark.operators import places


@pytest.mark.parametrize("most_table", [4 << 20, 300, 20])
def test_occurrences(spark, monkeypatch, most_table):
    """One table that is broadcast, and many that are dealt: names within names, with shared heads, beyond ASCII; a reading that many strings share."""
    monkeypatch.setattr(places, "MOST_TABLE", most_table)
    draw = random.Random(5)
    words = ["point", "rocky", "isle", "île du", "ñandú", "bay", "north", "東京湾口", "a", "island"]
    names = {" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(80)}
    names = {n for n in names if len(n) >= SHORTEST_ANCHOR}
    readings = [" ".join(draw.choices(words, k=draw.randint(0, 7))) for _ in range(150)] + ["", "pt", "rocky point isle"] + ["rocky point bay"] * 50
    got = places.occurrences(spark.createDataFrame([(r,) for r in readings], "reading string").repartition(3), spark.createDataFrame([(n,) for n in names] * 2, "needle string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(r, n) for r in readings for n in names if n in r}


def test_no_names_and_no_strings(spark):
    pool = spark.createDataFrame([(0, 1, "Alki Point"), (1, 2, "x"), (2, 3, next(iter(GENERIC_NAMES)))], "source int, id long, name string")
    strings = spark.createDataFrame([("off ALKI [Alki] point",), (None,), ("",)], "location_raw string")
    assert [(r.location_raw, r.id, r.place) for r in places.anchors(strings, pool).collect()] == [("off ALKI [Alki] point", 1, 1)]
    assert places.anchors(strings, pool.limit(0)).count() == 0 and places.anchors(strings.limit(0), pool).count() == 0
    plan = places.anchors(strings, pool)._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in plan and "MapInArrow" in plan
