"""Commits over several tables, edits by key, failures at each step, and writers at once."""

import glob
import json
import threading

import pytest
from pyspark.sql import functions as F

from tests.test_api import ISSUE, ingested
from tests.test_api import store as api_store  # noqa: F401
from tidemark.plans import api
from tidemark.plans.store import SCHEMAS, Change, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=3)


def places(spark, *rows):
    return spark.createDataFrame([(i, n, [], 1.0, 2.0, None) for i, n in rows], SCHEMAS["gazetteer"])


def patch(spark, id, **values):
    row = spark.createDataFrame([(id, list(values), *values.values())], "id bigint, present array<string>, " + ", ".join(f"{k} {'double' if k in ('lat', 'lng') else 'string'}" for k in values))
    return row


def names(store, version=None):
    return sorted((r.id, r.name, r.lat, r.region) for r in store.table("gazetteer", version).collect())


def test_edits_follow_their_commits(spark, store):
    store.write("gazetteer", places(spark, (1, "a"), (2, "b")))
    store.append("gazetteer", places(spark, (3, "c")))
    store.patch("gazetteer", patch(spark, 1, name="A", region=None))
    store.patch("gazetteer", patch(spark, 9, name="none such"))
    with_two = Change(store)
    with_two.patch("gazetteer", patch(spark, 3, name="C1"))
    with_two.patch("gazetteer", patch(spark, 3, name="C2", region="sea"))
    with_two.drop("gazetteer", spark.range(2, 3))
    number = with_two.commit()
    assert names(store) == [(1, "A", 1.0, None), (3, "C2", 1.0, "sea")]
    # A row of a key that went is new: edits of its former row are not its own.
    store.append("gazetteer", places(spark, (2, "B")))
    assert names(store) == [(1, "A", 1.0, None), (2, "B", 1.0, None), (3, "C2", 1.0, "sea")]
    assert names(store, number) == [(1, "A", 1.0, None), (3, "C2", 1.0, "sea")] and names(store, 1) == [(1, "a", 1.0, None), (2, "b", 1.0, None)]
    before = names(store)
    store.compact("gazetteer")
    assert names(store) == before and [p["kind"] for p in store.manifest()["tables"]["gazetteer"]["parts"]] == ["base"]
    store.patch("gazetteer", patch(spark, 2, lat=5.0))
    store.kept(spark.range(3))
    store.clean()
    assert names(store) == [(1, "A", 1.0, None), (2, "B", 5.0, None), (3, "C2", 1.0, "sea")]
    assert len(glob.glob(f"{store.base}/gazetteer/*")) == 2 and len(glob.glob(f"{store.base}/_log/*.json")) == 1 and not glob.glob(f"{store.base}/_work")
    # Another session knows of no bucketed part yet.
    for t in spark.catalog.listTables():
        if t.name.startswith("tidemark_gazetteer"):
            spark.sql(f"drop table {t.name}")
    assert names(Store(spark, store.base)) == [(1, "A", 1.0, None), (2, "B", 5.0, None), (3, "C2", 1.0, "sea")]


def test_a_patch_is_one_small_file(spark, store):
    store.write("sightings", spark.range(2000).selectExpr("id", "'gray' as species", "47.5D as lat", "-122.5D as lng", "'gps' as geo_method"))
    files = set(glob.glob(f"{store.base}/**/*.parquet", recursive=True))
    group = "one patch"
    spark.sparkContext.setJobGroup(group, group)
    api.patch_sighting(store, 7, {"lat": 48.0})
    spark.sparkContext.setJobGroup("", "")
    (new,) = set(glob.glob(f"{store.base}/**/*.parquet", recursive=True)) - files
    assert spark.read.parquet(new).count() == 1
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1  # the write, and no look at the base
    assert api.sighting(store, 7).first().geo_method == "manual" and store.table("sightings").filter("lat = 48").count() == 1


def test_large_edits_do_not_move_the_base(spark, store):
    """Beyond what is broadcast, edits are dealt to the buckets, and the base is read where it lies."""
    store.write("sightings", spark.range(5000).selectExpr("id", "'gray' as species"))
    store.patch("sightings", spark.range(0, 5000, 2).select("id", F.array(F.lit("species")).alias("present"), F.lit("minke").alias("species")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        df = store.table("sightings")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.groupBy("species").count().orderBy("species").collect()[1]["count"] == 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan


def test_unfinished_changes_are_never_read(spark, store):
    change = Change(store)
    change.append("gazetteer", places(spark, (1, "a")))
    assert store.version() == 0 and store.table("gazetteer").count() == 0
    assert Change(store).commit() == 0
    change.commit()
    assert names(store) == [(1, "a", 1.0, None)]


def test_conflicts(spark, store):
    store.write("gazetteer", places(spark, (1, "a")))
    late, free = Change(store), Change(store)
    late.write("gazetteer", late.table("gazetteer").filter("id > 0"))
    free.patch("gazetteer", patch(spark, 1, name="b"))
    free.commit()
    with pytest.raises(Conflict):
        late.commit()
    assert names(store) == [(1, "b", 1.0, None)]
    ran = []

    def always_late(c):
        ran.append(1)
        store.append("gazetteer", places(spark))
        c.write("gazetteer", c.table("gazetteer"))

    with pytest.raises(Conflict):
        store.change(always_late, tries=3)
    assert len(ran) == 3 and names(store) == [(1, "b", 1.0, None)]


def test_a_number_is_given_once(spark, store):
    assert store.publish({"version": 1, "tables": {}}) and not store.publish({"version": 1, "tables": {"x": {}}})
    assert store.manifest() == {"version": 1, "tables": {}} and not glob.glob(f"{store.base}/_log/*.draft")


def test_writers_at_once_lose_nothing(spark, store):
    store.write("gazetteer", places(spark, (1, "a")))
    errors = []

    def writer(k):
        try:
            for i in range(3):
                api.upsert_place(store, f"place {k} {i}", 1.0, 2.0)
                store.patch("gazetteer", patch(spark, 1, **{"region" if k else "name": f"{k} {i}"}))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.table("gazetteer").collect()
    assert not errors and sorted(r.id for r in rows) == list(range(1, 11))
    one = next(r for r in rows if r.id == 1)
    assert one.name == "0 2" and one.region in ("1 2", "2 2") and len({r.name for r in rows}) == 10
    assert store.version() == 1 + 18


@pytest.mark.parametrize("step", ["extracted", "resolved", "append", "patch", "commit"])
def test_runs_that_fail_leave_nothing(spark, api_store, monkeypatch, step):  # noqa: F811
    """An error at any step: no sightings, the run says why; once it is mended, each sighting is there once."""

    def boom(*_, **__):
        raise RuntimeError("boom")

    target = {"extracted": (api, "extracted"), "resolved": (api.resolve, "resolved")}.get(step, (Change, step))
    real, calls = getattr(*target), []
    # The begin of the run passes; what fails is the work, or the commit that would end it.
    before = {"append": 1, "patch": 1, "commit": 1}.get(step, 0)
    monkeypatch.setattr(*target, lambda *a, **k: (calls.append(1), real(*a, **k) if len(calls) <= before or len(calls) > before + 1 else boom())[1])
    with pytest.raises(RuntimeError, match="boom"):
        ingested(spark, api_store)
    run = api_store.table("newsletters").first()
    assert (run.id, run.status, run.warning_text) == ("i1", "failed", "boom") and api_store.table("sightings").count() == 0
    monkeypatch.undo()
    _, runs = ingested(spark, api_store)
    assert [(r.status, r.sighting_count, r.warning_text) for r in runs] == [("complete", 5, "MINKE WHALES: cut off")]
    rows = api_store.table("sightings").collect()
    assert len(rows) == len({r.id for r in rows}) == 5 and api_store.table("newsletters").count() == 1


def test_two_ingests_of_one_issue(spark, api_store, monkeypatch):  # noqa: F811
    """Both see that the issue is new; the later one to begin looks again, and leaves it to the other."""
    real, first = Change.commit, []

    def commit(self):
        if not first:
            first.append(1)
            ingested(spark, api_store)
        return real(self)

    monkeypatch.setattr(Change, "commit", commit)
    _, runs = ingested(spark, api_store)
    assert runs == [] and api_store.table("newsletters").count() == 1 and api_store.table("sightings").count() == 5


def test_second_answers_and_replay(spark, api_store, tmp_path):  # noqa: F811
    """A second answer counts where the first lies on land near water, and nowhere else; the log gives the same run again."""
    lines = spark.createDataFrame([("i1", i, x) for i, x in enumerate(ISSUE.split("\n"))], "issue string, line_no int, line string")
    places_ = ["wet", "near", "far", "unplaced"]
    reports = json.dumps([{"sighting_date": "2026-07-09", "location_raw": p} for p in places_])
    spot = lambda p, lat, lng, confidence="high": {"input": p, "lat": lat, "lng": lng, "confidence": confidence}
    first = [spot("wet", 47.6, -122.5), spot("near", 47.6, -122.28), spot("far", 48.6, -121.0), spot("unplaced", None, None, "none")]
    second = [spot(p, 47.7, -122.6) for p in places_]
    calls = [("i1", "extract", 1, 0, "end_turn", reports), ("i1", "geocode", 1, 0, "end_turn", json.dumps(first)), ("i1", "geocode", 2, 0, "end_turn", json.dumps(second)), ("other", "geocode", 1, 0, "end_turn", "[]")]
    api.ingest(api_store, lines, spark.createDataFrame(calls, "issue string, stage string, attempt int, key_no bigint, stop_reason string, text string"))
    found = lambda s: {r.location_raw: (r.lat, r.lng, r.geo_method, r.needs_review) for r in s.table("sightings").collect()}
    assert found(api_store) == {"wet": (47.6, -122.5, "ai", False), "near": (47.7, -122.6, "ai", False), "far": (48.6, -121.0, "ai", True), "unplaced": (None, None, "unresolved", True)}
    log = api_store.table("calls").collect()
    assert sorted((r.stage, r.attempt, r.issue) for r in log) == [("extract", 1, "i1"), ("geocode", 1, "i1"), ("geocode", 2, "i1"), ("geocode request", 2, None)]
    assert all(("GRAY WHALES" in r.request) if r.stage == "extract" else ("near" in r.request and "far" not in r.request.split("inland")[0]) if r.stage == "geocode request" else r.request is None for r in log)
    other = Store(spark, str(tmp_path / "other"))
    other.write("edges", api_store.table("edges"))
    api.ingest(other, lines, api_store.table("calls"))
    assert found(other) == found(api_store) and other.table("newsletters").first().warning_text == api_store.table("newsletters").first().warning_text == "MINKE WHALES: lacking"


def test_purge(spark, api_store):  # noqa: F811
    rows = [("a", "failed"), ("b", "processing"), ("c", "complete")]
    api_store.append("newsletters", spark.createDataFrame(rows, "id string, status string"))
    api_store.append("sightings", spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows * 2)], "id bigint, newsletter_id string"))
    before = api_store.version()
    api.purge_runs(api_store)
    assert api_store.version() == before + 1
    assert [r.id for r in api_store.table("newsletters").collect()] == ["c"] and {r.newsletter_id for r in api_store.table("sightings").collect()} == {"c"}


def test_a_place_and_its_links_go_at_once(spark, api_store):  # noqa: F811
    api_store.append("sightings", spark.createDataFrame([(1, 1, 48.0), (2, None, 47.0)], "id bigint, gazetteer_id bigint, lat double"))
    before = api_store.version()
    api.delete_place(api_store, 1)
    assert api_store.version() == before + 1 and api_store.table("gazetteer").count() == 0
    assert sorted((r.id, r.gazetteer_id, r.lat) for r in api_store.table("sightings").collect()) == [(1, None, 48.0), (2, None, 47.0)]


def test_manifest_is_plain(spark, store):
    store.write("gazetteer", places(spark, (1, "a")))
    with open(f"{store.base}/_log/000000000001.json") as f:
        found = json.load(f)
    (part,) = found["tables"]["gazetteer"]["parts"]
    assert (part["kind"], part["at"], part["buckets"]) == ("base", 1, 3)


def test_a_task_has_a_bounded_share_of_rows_and_edits(spark, tmp_path, monkeypatch):
    """Buckets grow with the table, and edits and added rows that outgrow them are dealt to more tasks; results stay."""
    from tidemark.plans import store as module

    monkeypatch.setattr(module, "PER_BUCKET", 50, raising=False)
    s = Store(spark, str(tmp_path / "grown"))
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "concat('n', id) as name", "1.0D as lat", "2.0D as lng")
    s.write("gazetteer", rows(0, 1000))
    assert s.manifest()["tables"]["gazetteer"]["parts"][0]["buckets"] == 20
    s.append("gazetteer", rows(1000, 2000))
    s.patch("gazetteer", spark.range(0, 2000, 2).selectExpr("id", "array('region') as present", "'sea' as region"))
    s.patch("gazetteer", spark.range(0, 2000, 4).selectExpr("id", "array('region') as present", "'bay' as region"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = s.table("gazetteer").select("id", "region", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.id, r.region) for r in got} == {(i, "bay" if i % 4 == 0 else "sea" if i % 2 == 0 else None) for i in range(2000)} and len(got) == 2000
    tasks = {}
    for r in got:
        tasks[r.task] = tasks.get(r.task, 0) + 1
    assert len(tasks) > 60 and max(tasks.values()) < 60
    s.compact("gazetteer")
    assert [(p["kind"], p["buckets"]) for p in s.manifest()["tables"]["gazetteer"]["parts"]] == [("base", 40)]
    assert s.table("gazetteer").filter("region = 'bay'").count() == 500
