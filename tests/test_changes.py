"""Writes by example."""

from tidemark.operators import changes, geometry, measures


def test_patch_sets_present_fields_only(spark):
    rows = spark.createDataFrame([(1, 48.0, -123.0, "ai", True, "gray"), (2, 48.0, -123.0, "ai", True, "gray")], "id long, lat double, lng double, geo_method string, needs_review boolean, species string")
    patches = spark.createDataFrame([(1, ["lat"], None, None, None), (2, ["species"], None, 50.0, "minke")], "id long, present array<string>, geo_method string, lat double, species string")
    patches = patches.selectExpr("*", "cast(null as double) as lng")
    got = {r.id: r for r in changes.patched(rows, patches).collect()}
    assert got[1].lat is None and got[1].geo_method == "manual" and got[1].species == "gray"
    assert got[2].lat == 48.0 and got[2].geo_method == "ai" and got[2].species == "minke"


def test_upsert_without_aliases(spark):
    state = spark.createDataFrame([(1, "Alki", [], 47.0, -122.0)], "id long, name string, aliases array<string>, lat double, lng double")
    new = spark.createDataFrame([(9, "ALKI", None, 1.0, 1.0)], state.schema)
    got = changes.upsert_places(state, new).collect()
    assert [(r.id, r.name, r.aliases, r.lat, r.merged) for r in got] == [(1, "Alki", [], 47.0, True)]


def test_geometry_far_and_near(spark):
    square = [(1, 0, -123.0, 48.0, -122.9, 48.0), (1, 1, -122.9, 48.0, -122.9, 48.1), (1, 2, -122.9, 48.1, -123.0, 48.1), (1, 3, -123.0, 48.1, -123.0, 48.0)]
    edges = spark.createDataFrame(square, "poly_id int, k int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 48.05, -122.95), (2, 48.05, -122.89), (3, 46.0, -120.5), (4, None, None)], "pid long, lat double, lng double")
    got = {r.pid: r.metres for r in geometry.water_distance(points, edges).collect()}
    assert got[1] == 0 and 700 < got[2] < 800 and 250_000 < got[3] < 320_000 and 4 not in got


def test_upper_median_and_numbers(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate((4.0, 1.0, 3.0, 2.0))], "x double, i long")
    got = measures.median_and_most(df, "x", "i").first()
    assert (got.n, got.median_x, got.most_x) == (4, 3.0, 4.0)
    got = measures.numbered(df, ["x"], "n", range_rows=2).orderBy("x").collect()
    assert [r.n for r in got] == [1, 2, 3, 4]
