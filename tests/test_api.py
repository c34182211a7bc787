"""The store from an empty folder to edited sightings."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import api

ISSUE = """Jul 15, 2026
SUMMARY
quiet
ANNOUNCEMENTS
GRAY WHALES
Thu, Jul 9 - Puget Sound
9:15 gray whale off Alki
-
MINKE WHALES
Fri, Jul 10 - Hood Canal
a minke
-
ABOUT ORCA NETWORK
end"""


@pytest.fixture
def store(spark, tmp_path):
    s = api.Store(spark, str(tmp_path / "store"))
    s.write("gazetteer", spark.createDataFrame([(1, "Alki", ["off Alki"], 47.58, -122.42, None)], api.SCHEMAS["gazetteer"]))
    s.write("landmarks", spark.createDataFrame([(1, "Rocky Point", "Cape", "Island", 48.2, -122.5), (2, "Blake Island", "Island", "Kitsap", 47.54, -122.49)], api.SCHEMAS["landmarks"]))
    square = [(1, 0, -122.8, 47.4, -122.3, 47.4), (1, 1, -122.3, 47.4, -122.3, 47.9), (1, 2, -122.3, 47.9, -122.8, 47.9), (1, 3, -122.8, 47.9, -122.8, 47.4)]
    s.write("edges", spark.createDataFrame(square, api.SCHEMAS["edges"]))
    return s


def ingested(spark, store):
    lines = spark.createDataFrame([("i1", i, x) for i, x in enumerate(ISSUE.split("\n"))], "issue string, line_no int, line string")
    said = lambda **x: {"sighting_date": "2026-07-09", **x}
    gray = [said(location_raw="off Alki", species="gray", sighting_time="9:15"), said(location_raw="OFF ALKI", sighting_time="9:15"), said(location_raw="Nowhere", species="walrus"), said(location_raw="dry land", summary="seen", raw_excerpt="a whale", behaviors=["milling"], detection_methods=["visual", "smell"]), said(location_raw="Blake  Island")]
    cut_off = json.dumps([said(location_raw="48.522500,-122.690800", count=2.5)])[:-1] + ', {"sighting_date": "20'
    geo = [{"input": "Nowhere", "lat": 47.6, "lng": -122.5, "confidence": "low"}, {"input": "dry land", "lat": 48.5, "lng": -122.0, "confidence": "high", "reasoning": "by the road"}]
    calls = [("i1", "extract", 1, 0, "end_turn", "```json\n" + json.dumps(gray) + "\n```"), ("i1", "extract", 1, 1, "max_tokens", cut_off), ("i1", "geocode", 1, 0, "end_turn", json.dumps(geo))]
    form = "issue string, stage string, attempt int, key_no bigint, stop_reason string, text string"
    return lines, api.ingest(store, lines, spark.createDataFrame(calls, form)).collect()


def test_ingest_and_read(spark, store):
    lines, runs = ingested(spark, store)
    assert [(r.title, r.status, r.sighting_count, r.warning_text) for r in runs] == [("July 15, 2026", "complete", 5, "MINKE WHALES: cut off")]
    rows = {r.location_raw: r for r in store.table("sightings").collect()}
    assert {k: (r.geo_method, r.needs_review, r.species) for k, r in rows.items()} == {
        "off Alki": ("gazetteer", False, "gray"), "Nowhere": ("ai", False, "gray"), "dry land": ("ai", True, "gray"), "Blake  Island": ("landmark", False, "gray"), "48.522500,-122.690800": ("gps", False, "minke"),
    }
    assert rows["48.522500,-122.690800"].sighting_count == 3
    gray_ = rows["dry land"]
    assert (gray_.summary, gray_.raw_excerpt, gray_.behaviors, gray_.detection_methods, gray_.ai_reasoning, gray_.ai_confidence) == ("seen", "a whale", ["milling"], ["visual"], "by the road", "high")
    assert rows["off Alki"].ai_confidence is None and runs[0].pasted_at is not None
    assert api.ingest(store, lines, spark.createDataFrame([], "issue string, " + api.readers.CALLS)).count() == 0
    page = api.sightings(store, newsletter="latest", species="minke,gray", bbox="-123,47,-122,49")
    assert page.count() == 5 and json.loads(page.first().feature)["type"] == "Feature"
    flagged = api.sightings(store, needs_review=True, admin=True, format="json", sort="confidence").collect()
    assert [r.location_raw for r in flagged] == ["dry land"] and flagged[0].water_m > 60_000
    with pytest.raises(PermissionError):
        api.sightings(store, needs_review=True)
    assert api.sightings(store, species="").count() == 0
    whole = json.loads(api.sightings(store, newsletter="latest", format="response", limit=2).first().response)
    assert len(whole["sightings"]) == 2 and whole["newsletter"]["title"] == "July 15, 2026" and whole["range"] == {"from": "2026-07-09", "to": "2026-07-09"}
    assert "newsletter" not in json.loads(api.sightings(store, format="response").first().response)
    props = json.loads(api.sightings(store, admin=True).first().feature)["properties"]
    assert not {"raw_excerpt", "ai_reasoning", "ai_confidence", "lat"} & set(props) and "location_raw" in props
    assert api.sighting(store, gray_.id).first().raw_excerpt == "a whale"
    assert api.sightings(store, format="json").filter("raw_excerpt is not null or ai_reasoning is not null").count() == 0
    chunks, presence, unknown = api.preflight(lines)
    assert chunks.count() == 2 and unknown.count() == 0 and presence.filter("issues > 0").count() == 2
    assert api.project_cost(lines).first().reports == 2
    asked = spark.createDataFrame([("off alki",), ("Rocky Point",), ("x",), ("48.52251, -122.6908",)], "location_raw string")
    assert {r.location_raw: r.stage for r in api.explain_location(store, asked).collect()} == {"off alki": "gazetteer", "Rocky Point": "landmark", "x": "model", "48.52251, -122.6908": "gps"}


def test_editing(spark, store):
    ingested(spark, store)
    dry = store.table("sightings").filter("location_raw = 'dry land'").first().id
    with pytest.raises(api.NameTaken):
        api.upsert_place(store, "rocky point", 48.2, -122.5)
    api.upsert_place(store, "Dry Land Cove", 48.6, -122.6, ["dry land"], backfill="dry land")
    row = api.sighting(store, dry).first()
    assert (row.lat, row.geo_method, row.needs_review) == (48.6, "gazetteer", False)
    api.patch_sighting(store, dry, {"lat": None, "lng": None, "geo_method": "unresolved"})
    assert api.sighting(store, dry).first().lat is None
    with pytest.raises(ValueError):
        api.patch_sighting(store, dry, {"id": 5})
    api.patch_sighting(store, dry, {"sighting_date": "2026-07-01", "species_raw": "x", "pod_or_group": "T1", "sighting_count": 4, "direction": "N", "gazetteer_id": 1, "sighting_time": "10:00"})
    row = api.sighting(store, dry).first()
    assert (str(row.sighting_date), row.species_raw, row.pod_or_group, row.sighting_count, row.direction, row.gazetteer_id, row.sighting_time) == ("2026-07-01", "x", "T1", 4, "N", 1, "10:00")
    api.upsert_place(store, "ALKI", 1.0, 1.0, region="Puget Sound")
    assert (store.table("gazetteer").filter("id = 1").first().region, store.table("gazetteer").filter("id = 1").first().lat) == ("Puget Sound", 47.58)
    api.patch_place(store, 1, {"aliases": ["Alki Point"], "region": None})
    assert store.table("gazetteer").filter("id = 1").first().region is None
    with pytest.raises(ValueError):
        api.patch_place(store, 1, {"id": 3})
    assert api.gazetteer(store).count() == 2 and store.table("gazetteer").filter("id = 1").first().aliases == ["Alki Point"]
    api.delete_place(store, 1)
    assert store.table("gazetteer").count() == 1 and api.landmarks(store).count() == 3
    facts = {r.table: (r.rows, r.versions) for r in store.check().collect()}
    assert facts["gazetteer"] == (1, 5) and facts["calls"] == (3, 1)
    api.delete_newsletters(store, "complete")
    assert store.table("sightings").count() == 0 and api.newsletters(store).count() == 0


def test_failed_runs(spark, store):
    lines = spark.createDataFrame([("i2", 0, "Aug 1, 2026"), ("i2", 1, "GRAY WHALES"), ("i2", 2, "Thu, Jul 30 - Hood Canal"), ("i2", 3, "a gray"), ("i3", 0, "no date here")], "issue string, line_no int, line string")
    calls = spark.createDataFrame([("i2", "extract", 1, 0, "refusal", "")], "issue string, stage string, attempt int, key_no bigint, stop_reason string, text string")
    runs = {r.id: (r.status, r.warning_text) for r in api.ingest(store, lines, calls).collect()}
    assert runs == {"i2": ("failed", "no sightings were found; GRAY WHALES: refused"), "i3": ("failed", "no date was found")}
    # The header is there before the work, and an error of the work itself is the run's message, and raised again.
    with pytest.raises(Exception, match="boom"):
        api.ingest(store, lines.withColumn("issue", F.concat(F.lit("x"), "issue")), calls.withColumn("text", F.raise_error(F.lit("boom")).cast("string")))
    runs = {r.id: (r.status, r.warning_text) for r in store.table("newsletters").collect()}
    assert runs["xi2"][0] == "failed" and "boom" in runs["xi2"][1] and len(runs) == 4
    store.append("newsletters", spark.createDataFrame([("p", "Issue", "processing")], "id string, title string, status string"))
    lines = spark.createDataFrame([("p", 0, "Aug 9, 2026")], "issue string, line_no int, line string")
    assert api.ingest(store, lines, calls).count() == 0


def test_requests_and_replay(spark, store, tmp_path):
    from tidemark.sources import readers

    strings = spark.createDataFrame([("off Alki, near Blake Island", i) if i == 0 else (f"place {i}", i) for i in range(70)], "location_raw string, id bigint")
    sent = {r.batch_no: r for r in api.geocode_requests(strings, store.table("gazetteer"), store.table("landmarks"), "rules").collect()}
    assert {k: len(r.inputs) for k, r in sent.items()} == {0: 60, 1: 10} and sent[0].system == "rules"
    item = next(x for x in json.loads(sent[0].prompt[len(api.REQUEST) :]) if x["input"].startswith("off Alki"))
    assert item["anchors"] == [{"name": "Blake Island", "type": "Island", "county": "Kitsap", "lat": 47.54, "lng": -122.49}, {"name": "off Alki", "type": "Verified", "lat": 47.58, "lng": -122.42}, {"name": "Alki", "type": "Verified", "lat": 47.58, "lng": -122.42}]
    answers = spark.createDataFrame([("wet", 1, "high", 47.6, -122.5), ("near", 1, "high", 47.6, -122.28), ("far", 1, "high", 48.6, -121.0), ("none", 1, "none", 47.6, -122.28), ("near", 2, "high", 47.6, -122.31)], "input string, attempt int, confidence string, lat double, lng double")
    (again,) = api.retry_requests(answers, store.table("edges"), store.table("gazetteer"), store.table("landmarks")).collect()
    assert again.inputs == ["near"] and "inland; water is to the west" in again.prompt
    # A run's log is what it can be replayed from; a refusal is told before it is read.
    log = spark.createDataFrame([("geocode", 1, 0, "refusal", '{"category": "policy"}', "req"), ("geocode", 1, 1, "end_turn", "[]", "req"), ("extract", 1, 0, "end_turn", "[]", "req")], readers.CALLS + ", request string")
    readers.write_calls(log, str(tmp_path / "log"))
    back = readers.recorded_calls(spark, str(tmp_path / "log"))
    assert back.count() == 3 and readers.logged_calls(spark, str(tmp_path / "log"), "request string").filter("request = 'req'").count() == 3
    got = {r.batch_no: (r.state, r.message) for r in api.with_answers(api.geocode_requests(strings, store.table("gazetteer"), store.table("landmarks")), back, 1).collect()}
    assert got == {0: ("refused", "declined (policy)"), 1: ("whole", None)}


def test_measure_and_sample(spark, store, tmp_path):
    lines, _ = ingested(spark, store)
    answers = spark.createDataFrame([("dry land", 1, "high", 47.6, -122.5)], "input string, attempt int, confidence string, lat double, lng double")
    moves, far = api.measure(store, answers, write=True)
    assert [tuple(r) for r in moves.collect()] == [("dry", "wet", 1)] and 90 < far.first().most_km < 130
    assert store.table("sightings").filter("location_raw = 'dry land'").first().lat == 47.6
    calls = spark.createDataFrame([("i1", "extract", 1, k, "end_turn", json.dumps([{"sighting_date": "2026-07-09", "location_raw": f"p{k}", "species": ["minke", None][k]}])) for k in (0, 1)], "issue string, stage string, attempt int, key_no bigint, stop_reason string, text string")
    out = str(tmp_path / "out")
    assert [r.location_raw for r in api.extract_sample(store, lines, calls, species="gray", out=out).collect()] == ["p0"] and spark.read.json(out).count() == 1
    # A report of another species is its chunk's; of a longer issue, the two smallest chunks.
    assert [r.location_raw for r in api.extract_sample(store, lines, calls, species=["minke", "orca"]).collect()] == ["p1"]
    more = lines.unionByName(spark.createDataFrame([("i0", 0, "Jul 16, 2026"), ("i0", 1, "HUMPBACK WHALES"), ("i0", 2, "x" * 500)], lines.schema))
    for kinds, want in ((None, ["p0", "p1"]), ("all", ["p0", "p1", "q"])):
        every = calls.unionByName(calls.filter("key_no = 0").withColumns({"issue": F.lit("i0"), "text": F.lit('[{"sighting_date": "2026-07-09", "location_raw": "q"}]')}))
        assert sorted(r.location_raw for r in api.extract_sample(store, more, every, species=kinds).collect()) == want


def test_landmark_backfill_is_stored(spark, store):
    rows = [(1, "Blake Island", True), (2, "blake  island", False), (3, "x", True)]
    store.write("sightings", spark.createDataFrame(rows, "id bigint, location_raw string, needs_review boolean"))
    api.backfill_landmarks(store)
    got = {r.id: (r.geo_method, r.landmark_id, r.lat, r.needs_review) for r in store.table("sightings").collect()}
    assert got == {1: ("landmark", 2, 47.54, False), 2: (None, None, None, False), 3: (None, None, None, True)}


def test_request_values():
    from tidemark.operators import reads

    assert reads.bounding_box(" 1e1,+2,.5,") == (10.0, 2.0, 0.5, 0.0) and reads.number("0x10") == 16 and reads.number("1_0") is None
    for bad in ("1,2,3", "1,2,3,x", "1,2,3,NaN", "1,2,3,4,5"):
        with pytest.raises(ValueError):
            reads.bounding_box(bad)
    assert reads.issue_id("latest") == "latest" and reads.issue_id("0" * 8 + "-aaaa-BBBB-cccc-" + "1" * 12)
    with pytest.raises(ValueError):
        reads.issue_id("12")


def test_database_table(spark):
    """A table of an embedded database, read by ranges of its key."""
    from tidemark.sources import readers

    url, driver = "jdbc:derby:memory:tidemark;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.System.setProperty("derby.stream.error.field", "java.lang.System.err")
    spark.range(100).selectExpr("id as n", "id * id as square").write.jdbc(url, "squares", "overwrite", {"driver": driver})
    got = readers.jdbc_table(spark, url, "squares", "n", 0, 100, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.agg({"square": "sum"}).first()[0] == sum(i * i for i in range(100))


def test_constants(spark):
    from tidemark.functions import vocab
    from tidemark.sources import static

    assert sorted(map(tuple, static.sensors(spark).collect()), key=repr) == sorted([("hydrophone", *h, None) for h in vocab.HYDROPHONES] + [("webcam", *w) for w in vocab.WEBCAMS], key=repr)
    assert sorted(map(tuple, static.label_bands(spark).collect())) == sorted(map(tuple, vocab.LABEL_ZOOM))
    assert [(r.id, r.name, tuple(r.aliases), r.region) for r in static.seed_places(spark).orderBy("id").collect()] == [(i, x[0], tuple(x[1]), x[-1]) for i, x in enumerate(vocab.SEED_PLACES, 1)]


def test_fallbacks(spark, tmp_path):
    from tidemark.sources import readers

    with pytest.warns(UserWarning):
        assert readers.rules_document(spark, str(tmp_path / "none.md")) is None
    (tmp_path / "rules.md").write_text("a\nb")
    assert readers.rules_document(spark, str(tmp_path / "rules.md")) == "a\nb"


def test_hint(spark):
    dry = spark.createDataFrame([('a "b"', 48.0, -123.0, 1234.4, 48.01, -123.0)], "input string, lat double, lng double, metres double, near_lat double, near_lng double")
    assert api.retry_preamble(dry).first().hint == '["a \\"b\\""]: 48.0000, -123.0000 lies 1234 m inland; water is to the north, from 48.0100, -123.0000 on'


def test_sources(spark, tmp_path):
    from tidemark.sources import readers
    from tidemark.streaming import issues as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "i1.txt").write_text("﻿a\r\nb c", encoding="utf-8")
    batch = readers.issue_lines(readers.issue_texts(spark, str(tmp_path / "in")))
    stream.append_lines(stream.new_issue_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    wanted = [("i1", 0, "a"), ("i1", 1, "b c")]
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect())) == wanted
    (tmp_path / "named").mkdir()
    for name in ("report.2026-07-15.txt", "report.2026-07-22.txt", "plain"):
        (tmp_path / "named" / name).write_text(name)
    assert sorted(r.issue for r in readers.issue_texts(spark, str(tmp_path / "named")).collect()) == ["plain", "report.2026-07-15", "report.2026-07-22"]
    (tmp_path / "g.txt").write_text("﻿feature_id|feature_name|feature_class|county_name|prim_lat_dec|prim_long_dec\n1| Alki |Cape|King|47.5|-122.4\n2|Zero|Bay|King|0|0\n3|Bad|Bay|King|x|-122\n4|Town|Lake|King|47.5|-122\n", encoding="utf-8")
    good = readers.gnis(spark, str(tmp_path / "g.txt"))
    assert [(r.id, r.name) for r in good.collect()] == [(1, "Alki")]
    assert readers.checked_load(good, 1, 5, ["Alki"]).first().valid
    with pytest.raises(Exception, match="not plausible"):
        readers.checked_load(good, 2, 5, ["Alki"]).collect()
    df, there = readers.table_or_empty(spark, str(tmp_path / "none"), readers.LANDMARKS)
    assert not there and df.count() == 0
    assert readers.answered(spark.createDataFrame([(1,)], "key_no long"), spark.createDataFrame([], readers.CALLS), ["key_no"]).first().state == "lacking"
    assert good.select(F.col("lat")).first().lat == 47.5
