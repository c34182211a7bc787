"""What a user calls: reading, editing, ingesting and measuring over a store of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import records, text, vocab
from tidemark.operators import changes, issues, measures, places, reads, resolve
from tidemark.operators.scans import stored
from tidemark.plans.store import SCHEMAS, Change, Conflict, Store  # noqa: F401
from tidemark.sources import readers, static

class NameTaken(ValueError):
    """A landmark bears the name of a place to be saved; saving it anyway has to be confirmed."""


# ---- reading

def sightings(store: Store, *, newsletter=None, date_from=None, date_to=None, species: str | None = None, bbox: str | None = None, needs_review: bool | None = None, sort: str | None = None, limit: int | None = None, offset: int = 0, format: str = "geojson", admin: bool = False) -> DataFrame:
    """Filtered, ordered and paged sightings; flagged rows are for administrators, and come with their distance to water.

    format: "geojson" for a feature a row, "json" for the rows, "response" for one row of JSON with the issue and the archive's span.
    """
    if needs_review is not None and not admin:
        raise PermissionError("needs_review is for administrators")
    box = reads.bounding_box(bbox) if bbox is not None else None
    kinds = reads.listed(species) if species is not None else None
    df = reads.filtered(store.table("sightings"), issue=newsletter, newsletters=store.table("newsletters"), date_from=date_from, date_to=date_to, species=kinds, bbox=box, needs_review=needs_review, placed_only=format == "geojson")
    distance = None
    if needs_review:
        from tidemark.operators import geometry

        metres = geometry.water_distance(df.select(F.col("id").alias("pid"), "lat", "lng"), store.table("edges")).withColumnRenamed("metres", "water_m")
        df, distance = df.join(metres, F.col("id") == F.col("pid"), "left").drop("pid"), F.col("water_m")
    df = reads.paged(reads.masked(df, admin), reads.review_order(distance, sort == "confidence"), limit, offset)
    if format == "response":
        return reads.response(df, store.table("newsletters"), store.table("sightings"), newsletter)
    return df if format == "json" else reads.features(df)


def sighting(store: Store, id: int) -> DataFrame:
    return store.table("sightings").filter(F.col("id") == id)


def newsletters(store: Store) -> DataFrame:
    """All runs, the last one first."""
    return store.table("newsletters").select("id", "title", "date_from", "date_to", "status", "sighting_count", "pasted_at").orderBy(F.desc_nulls_last("pasted_at"), F.desc("id"))


def landmarks(store: Store) -> DataFrame:
    """Features, landmarks by class and name before verified places by name."""
    listed = reads.public_landmarks(store.table("landmarks"), store.table("gazetteer"))
    return reads.features(listed.orderBy(F.col("feature_class") == "Verified", "feature_class", "name"))


def gazetteer(store: Store) -> DataFrame:
    return reads.gazetteer_counts(store.table("gazetteer"), store.table("sightings"), text.norm(F.col("location_raw"))).orderBy("name")


# ---- editing

def _one_patch(store: Store, name: str, id: int, patch: dict, fields: tuple[str, ...]) -> DataFrame:
    if extra := set(patch) - set(fields):
        raise ValueError(f"not editable: {', '.join(sorted(extra))}")
    form = store.spark.createDataFrame([], SCHEMAS[name]).schema
    value = lambda c: F.array(*map(F.lit, patch[c])) if isinstance(patch[c], list) else F.lit(patch[c])
    return store.spark.range(1, numPartitions=1).select(F.lit(id).cast("bigint").alias("id"), F.array(*map(F.lit, patch)).cast("array<string>").alias("present"), *(value(c).cast(form[c].dataType).alias(c) for c in patch))


def patch_sighting(store: Store, id: int, patch: dict) -> None:
    """Sets the given fields, be it to None; unknown fields are refused. It writes one row, and reads none."""
    store.patch("sightings", _one_patch(store, "sightings", id, patch, changes.EDITABLE))


def upsert_place(store: Store, name: str, lat: float, lng: float, aliases: list[str] = (), region: str | None = None, *, confirmed: bool = False, backfill: str | None = None, except_id: int = -1) -> None:
    """Saves a verified place, and moves flagged sightings at the location text `backfill` to it, in one commit."""
    if not confirmed and not store.table("landmarks").filter(F.lower("name") == name.lower()).isEmpty():
        raise NameTaken(name)

    def work(c: Change) -> None:
        c.guard("gazetteer")  # for the new id, and for the place of that name
        known = c.table("gazetteer")
        new_id = (known.agg(F.max("id")).first()[0] or 0) + 1
        row = store.spark.range(1).select(F.lit(new_id).alias("id"), F.lit(name).alias("name"), F.array(*map(F.lit, aliases)).cast("array<string>").alias("aliases"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), F.lit(region).cast("string").alias("region"))
        place = changes.upsert_places(known.filter(F.lower("name") == F.lower(F.lit(name))), row)
        if place.first().merged:
            c.patch("gazetteer", changes.as_patches(place, "aliases", "region"))
        else:
            c.append("gazetteer", place)
        if backfill is not None:
            moved = changes.cluster_backfill(c.table("sightings"), backfill, except_id, lat, lng).filter("changed")
            c.patch("sightings", changes.as_patches(moved, "lat", "lng", "geo_method", "needs_review"))

    store.change(work)


def patch_place(store: Store, id: int, patch: dict) -> None:
    """Sets the given fields of a verified place, be it to None; unknown fields are refused."""
    store.patch("gazetteer", _one_patch(store, "gazetteer", id, patch, changes.EDITABLE_PLACE))


def delete_place(store: Store, id: int) -> None:
    """The place goes, and the links to it, in one commit; sightings keep their coordinates."""

    def work(c: Change) -> None:
        c.guard("sightings")  # else a link that is made meanwhile would stay
        linked = c.table("sightings").filter(F.col("gazetteer_id") == id)
        c.patch("sightings", changes.as_patches(linked.withColumn("gazetteer_id", F.lit(None).cast("bigint")), "gazetteer_id"))
        c.drop("gazetteer", store.spark.range(id, id + 1))

    store.change(work)


def backfill_landmarks(store: Store) -> None:
    """Flagged sightings whose location names one landmark only take its position."""

    def work(c: Change) -> None:
        flagged, known = c.table("sightings").filter("needs_review"), c.table("landmarks")
        spots = known.select(F.col("id").alias("landmark_id"), "lat", "lng")
        matches = places.by_landmark(flagged, known).join(spots, "landmark_id")
        moved = changes.placed_by_landmark(flagged, matches).filter("changed")
        c.patch("sightings", changes.as_patches(moved, "lat", "lng", "landmark_id", "geo_method", "needs_review"))

    store.change(work)


def delete_newsletters(store: Store, *statuses: str) -> None:
    """Runs of these statuses, failed ones if none are given, and their sightings go, in one commit."""

    def work(c: Change) -> None:
        c.guard("newsletters")
        gone = c.table("newsletters").filter(F.col("status").isin(*(statuses or ("failed",)))).select("id")
        c.drop("sightings", c.table("sightings").join(gone.withColumnRenamed("id", "newsletter_id"), "newsletter_id", "left_semi"))
        c.drop("newsletters", gone)

    store.change(work)


def purge_runs(store: Store) -> None:
    """Runs that failed or never came to an end go, with what they left."""
    delete_newsletters(store, "failed", "processing")


# ---- ingesting

def preflight(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with what they hold, banners that were found, capitals that may be unknown banners), before anything is spent."""
    found = lines.select("issue", text.banner(F.col("line"))["name"].alias("name")).filter("name is not null").groupBy("name").agg(F.countDistinct("issue").alias("issues"))
    presence = static.banners(lines.sparkSession).select("name").join(found, "name", "left").select("name", F.coalesce("issues", F.lit(0)).alias("issues"))
    return issues.chunk_diagnostics(issues.chunks(lines)), presence, issues.unknown_banners(lines)


def extraction_requests(lines: DataFrame, kept=None) -> DataFrame:
    """(issue, species, banner_name, key_no, prompt): one request per chunk; a part of a split section carries its header.

    kept: stores the chunks, which are used twice.
    """
    order = F.struct("banner_line", "chunk_no", "part_no")
    chunks = issues.chunks(lines) if kept is None else kept(issues.chunks(lines))
    ranks = chunks.groupBy("issue").agg(F.array_sort(F.collect_list(order)).alias("all"))
    key = (F.array_position("all", order) - 1).cast("bigint")
    head = F.concat_ws("\n", F.concat(F.lit("Section: "), "banner_name"), F.concat(F.lit("Header: "), "carried_header"))
    return chunks.join(ranks, "issue").select("issue", "species", "banner_name", key.alias("key_no"), F.concat(head, F.lit("\n\n"), "text").alias("prompt"))


def ingest(store: Store, lines: DataFrame, calls: DataFrame) -> DataFrame:
    """Lines of issues and the recorded answers of the model to stored sightings; returns the runs.

    calls: readers.CALLS and issue; stage extract by chunk, stage geocode with one object per location. An issue whose
    title is already complete or under way is left out. Its run is written as processing before the work; a refused or
    lacking answer costs its own chunk only and is a warning; an issue without a date or a sighting fails with that as
    its message, and if the work itself fails, all runs of this call do, and the error is raised again. Sightings become
    visible by the commit that finishes their run, so a run that fails, or dies, leaves none, and can be run again. A second
    answer for a location counts only if it was asked for: the first one lies on land, and not too far inland. The same
    commit adds what was asked and answered to the table `calls`, from which the run can be replayed.
    """
    every = store.kept(lines.select("issue").distinct().join(issues.issue_dates(lines), "issue", "left").withColumn("pasted_at", F.current_timestamp()))

    def begin(c: Change) -> DataFrame:
        c.guard("newsletters")  # of two calls with one issue, the later one sees that the run is under way
        there = c.table("newsletters")
        done = there.filter(F.col("status").isin("complete", "processing"))
        known = every.join(done.select("title"), "title", "left_semi").select("issue").unionByName(every.join(done.select(F.col("id").alias("issue")), "issue", "left_semi").select("issue"))
        fresh = store.kept(every.join(known, "issue", "left_anti"))
        runs = changes.begun_runs(fresh.select(F.col("issue").alias("id"), "title", "pasted_at")).withColumn("warning_text", F.lit(None).cast("string"))
        again = runs.join(there.select("id"), "id", "left_semi")
        c.patch("newsletters", changes.as_patches(again, "title", "status", "warning_text", "pasted_at"))
        c.append("newsletters", runs.join(again.select("id"), "id", "left_anti"))
        return fresh

    fresh = store.change(begin)
    runs = fresh.select(F.col("issue").alias("id"), "title", "pasted_at")
    try:
        stored, finished, log = _worked(store, lines, calls, fresh, runs)

        def finish(c: Change) -> None:
            c.append("sightings", stored)
            c.append("calls", log)
            c.patch("newsletters", changes.as_patches(finished, "status", "warning_text", "sighting_count", "date_from", "date_to"))

        store.change(finish)
    except Exception as e:
        store.patch("newsletters", changes.as_patches(changes.failed_runs(runs, F.lit(str(e))), "status", "warning_text"))
        raise
    return store.table("newsletters").join(runs.select("id"), "id", "left_semi")


#: What a report says, as it is stored.
SAID = ["sighting_date", "sighting_time", "species", "species_raw", "pod_or_group", "sighting_count", "direction", "behaviors", "detection_methods", "location_raw", "summary", "raw_excerpt", "reporter", "report_kind"]


def extracted(lines: DataFrame, calls: DataFrame, kept) -> tuple[DataFrame, DataFrame]:
    """(answers by chunk, reports): newsletter_id, key_no, pos and SAID, of reports that repeat the first."""
    return _reports(extraction_requests(lines, kept), calls, kept)


def _reports(requests: DataFrame, calls: DataFrame, kept) -> tuple[DataFrame, DataFrame]:
    answers = kept(readers.answered(requests, calls.filter("stage = 'extract'").select("issue", "key_no", "stop_reason", F.col("text").alias("txt")), ["issue", "key_no"]))
    usable = answers.filter(F.col("state").isin("whole", "cut off")).select(F.struct("issue", "key_no", "species").alias("id"), "txt")
    read = records.normalized(records.parsed(usable).select("id", "pos", "r"), F.col("id.species"))
    reports = read.select(F.col("id.issue").alias("newsletter_id"), F.col("id.key_no").alias("key_no"), "pos", *SAID)
    return answers, measures.first_of(reports, ["newsletter_id", "sighting_date", F.coalesce("sighting_time", F.lit("")), F.lower("location_raw")], ["key_no", "pos"])


def _worked(store: Store, lines: DataFrame, calls: DataFrame, fresh: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sightings, finished runs, calls), stored in the work folder; nothing of them is visible yet."""
    answers, reports = extracted(lines.join(fresh.filter("iso is not null").select("issue"), "issue", "left_semi"), calls, store.kept)
    first = store.kept(reports.withColumn("id", F.xxhash64("newsletter_id", "key_no", "pos")))
    placed = calls.filter("stage = 'geocode'").select(F.struct("issue", "attempt", "key_no").alias("id"), F.col("text").alias("txt"))
    located = records.parsed(placed).select(F.col("r.input").alias("input"), F.col("id.attempt").alias("attempt"), F.coalesce("r.confidence", F.lit("none")).alias("confidence"), "r.lat", "r.lng", "r.reasoning", F.struct("id.issue", "id.key_no", "pos").alias("place"))
    last = store.kept(measures.first_of(located, ["input", "attempt"], [F.desc("place")]).drop("place"))
    again = store.kept(retry_requests(last, store.table("edges"), store.table("gazetteer"), store.table("landmarks")))
    asked_again = again.select(F.explode("inputs").alias("input"), F.lit(2).alias("attempt"))
    last = store.kept(last.filter("attempt = 1").unionByName(last.join(asked_again, ["input", "attempt"], "left_semi")))
    resolved = store.kept(resolve.resolved(first, store.table("gazetteer"), store.table("landmarks"), last, store.table("edges")))
    # What the model said of the place goes with rows that it was asked for, placed or not.
    said = last.groupBy(F.col("input").alias("location_raw")).agg(F.min_by("reasoning", "attempt").alias("ai_reasoning"), F.min_by("confidence", "attempt").alias("ai_confidence"))
    stored = first.join(resolved, "id").join(said, "location_raw", "left")
    asked = F.col("geo_method").isin("ai", "unresolved")
    stored = store.kept(stored.withColumns({c: F.when(asked, F.col(c)) for c in ("ai_reasoning", "ai_confidence")}))
    counts = stored.groupBy(F.col("newsletter_id").alias("id")).agg(F.count("*").alias("sighting_count"), F.min("sighting_date").alias("date_from"), F.max("sighting_date").alias("date_to"))
    bad = answers.filter("state <> 'whole'").groupBy(F.col("issue").alias("id")).agg(F.array_sort(F.collect_set(F.concat("banner_name", F.lit(": "), "state"))).alias("w"))
    out = runs.join(counts, "id", "left").join(bad, "id", "left")
    none = F.array().cast("array<string>")
    whole = changes.finished_runs(out.filter("sighting_count > 0"), F.coalesce("w", none))
    why = F.when(F.col("title").isNull(), "no date was found").otherwise(F.concat_ws("; ", F.lit("no sightings were found"), F.coalesce("w", none)))
    finished = store.kept(whole.unionByName(changes.failed_runs(out.filter("sighting_count is null"), why)).drop("w"))
    return stored, finished, store.kept(_log(answers, calls, fresh, again))


def _log(answers: DataFrame, calls: DataFrame, fresh: DataFrame, again: DataFrame) -> DataFrame:
    """What was asked and answered, in the form of the recorded calls: chunks with their requests, answers on places, and the second requests on these.

    A lacking answer leaves no row. Second requests are for the places of all issues at once, so they are rows without an issue or an answer.
    """
    chunks = answers.filter("state <> 'lacking'").select("issue", F.lit("extract").alias("stage"), F.lit(1).alias("attempt"), "key_no", "stop_reason", F.col("txt").alias("text"), F.col("prompt").alias("request"))
    spots = calls.filter("stage = 'geocode'").join(fresh.select("issue"), "issue", "left_semi").select("issue", "stage", "attempt", "key_no", "stop_reason", "text")
    second = again.select(F.lit("geocode request").alias("stage"), F.lit(2).alias("attempt"), F.col("batch_no").alias("key_no"), F.col("prompt").alias("request"))
    return chunks.unionByName(spots, allowMissingColumns=True).unionByName(second, allowMissingColumns=True)


def extract_sample(store: Store, lines: DataFrame, calls: DataFrame, species: list[str] | str | None = None, out: str | None = None) -> DataFrame:
    """The reports of the two smallest chunks, of all chunks ("all"), or of the chunks of some species' sections; also written to `out`.

    Chunks are chosen before anything is read of their answers, and a chunk's species is its section's.
    """
    chunks = stored(extraction_requests(lines, store.kept).withColumn("n", F.length("prompt")))
    if species is None:
        chosen = chunks.orderBy("n", "issue", "key_no").limit(2)
    else:
        chosen = chunks if species == "all" else chunks.filter(F.col("species").isin([species] if isinstance(species, str) else list(species)))
    reports = _reports(chosen.drop("n"), calls, store.kept)[1]
    if out is not None:
        readers.write_result(reports, out)
    return reports


def measure(store: Store, answers: DataFrame, *, limit: int | None = 120, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(transitions, distances) of flagged sightings placed anew by `answers` (input, attempt, confidence, lat, lng).

    At most `limit` sightings are taken, in the order of their ids; all, if it is None. write: the new places are stored.
    """
    from tidemark.functions import geo
    from tidemark.operators import geometry

    sample = store.table("sightings").filter("needs_review and geo_method in ('ai', 'unresolved')").orderBy("id")
    sample = store.kept(sample if limit is None else sample.limit(limit))
    best = resolve.checked_answers(answers, store.table("edges"))
    new = store.kept(sample.select("id", "location_raw").join(best, F.col("location_raw") == F.col("input"), "left"))
    wet = geometry.covered(sample.select(F.col("id").alias("pid"), "lat", "lng"), store.table("edges")).select(F.col("pid").alias("id"), F.lit(True).alias("in"))
    before = sample.join(wet, "id", "left").select(F.col("id").alias("key"), F.when(F.col("lat").isNotNull(), F.col("in").isNotNull()).alias("wet"))
    moves = measures.transitions(before, new.select(F.col("id").alias("key"), "wet"))
    both = sample.select("id", "lat", "lng").join(new.select("id", F.col("lat").alias("lat2"), F.col("lng").alias("lng2")), "id").filter("lat is not null and lat2 is not null")
    far = measures.median_and_most(both.select("id", geo.km_between(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("km")), "km", "id")
    if write:
        results = new.filter("lat is not null").select(F.col("location_raw").alias("input"), F.lit("ai").alias("method"), "lat", "lng").distinct()

        def work(c: Change) -> None:
            c.patch("sightings", changes.as_patches(changes.regeocoded(c.table("sightings"), results).filter("changed"), "geo_method", "lat", "lng"))

        store.change(work)
    return moves, far


#: What a request begins with; the payload follows.
REQUEST = "Place each location. Where anchors are given, their coordinates hold for the names in that description: reckon the offset from them.\n\n"
AGAIN = "These positions of yours lie on land, where no whale can be:\n{}\n\nPlace each one anew, on the water. A location that really lies outside the waters that are covered (farther north, on the open coast, or in fresh water) is right as it is: give its position back unchanged.\n\n"


def geocode_requests(strings: DataFrame, gazetteer: DataFrame, landmarks: DataFrame, rules: str | None = None) -> DataFrame:
    """(batch_no, inputs, system, prompt): requests for strings (location_raw, id) that no cheaper stage has placed, 60 in each."""
    pool = places.located_pool(gazetteer, landmarks)
    items = places.request_items(strings, pool).join(places.batches(strings, vocab.BATCH), "location_raw")
    return _requests(items, F.lit(REQUEST), rules)


def _requests(items: DataFrame, head, rules: str | None) -> DataFrame:
    listed = F.array_sort(F.collect_list("item"))
    whole = items.groupBy("batch_no").agg(listed.alias("items"), *([F.array_sort(F.collect_list("hint")).alias("hints")] if "hint" in items.columns else []))
    return whole.select("batch_no", F.col("items.input").alias("inputs"), F.lit(rules).cast("string").alias("system"), F.concat(head, F.to_json("items")).alias("prompt"))


def retry_requests(answers: DataFrame, edges: DataFrame, gazetteer: DataFrame, landmarks: DataFrame, rules: str | None = None) -> DataFrame:
    """Second requests, for first answers (input, attempt, confidence, lat, lng) on land, but not farther inland than MOST_INLAND.

    Each request says how far inland each position was, and which way the water is.
    """
    from tidemark.functions import geo
    from tidemark.operators import geometry

    first = answers.filter("attempt = 1").filter(geo.placeable(F.col("confidence"), F.col("lat").cast("double"), F.col("lng").cast("double")))
    spots = first.select(F.col("input").alias("pid"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    spots = stored(spots)
    dry = stored(spots.join(geometry.covered(spots, edges), "pid", "left_anti"))
    dry = dry.join(geometry.nearest(dry, edges), "pid").filter(F.round("metres").between(1, vocab.MOST_INLAND)).withColumnRenamed("pid", "input")
    hints = stored(retry_preamble(dry).select(F.col("input").alias("location_raw"), "hint"))
    strings = measures.numbered(hints, ["location_raw"], "n").withColumn("batch_no", F.floor((F.col("n") - 1) / vocab.BATCH))
    items = places.request_items(strings, places.located_pool(gazetteer, landmarks)).join(strings.select("location_raw", "hint", "batch_no"), "location_raw")
    before, after = AGAIN.split("{}")
    head = F.concat(F.lit(before), F.array_join("hints", "\n"), F.lit(after + REQUEST))
    return _requests(items, head, rules)


def with_answers(requests: DataFrame, calls: DataFrame, attempt: int) -> DataFrame:
    """Requests with their recorded answers; a refusal is told from an answer before it is read, with its category."""
    said = calls.filter((F.col("stage") == "geocode") & (F.col("attempt") == attempt)).select(F.col("key_no").alias("batch_no"), "stop_reason", F.col("text").alias("txt"))
    out = readers.answered(requests, said, ["batch_no"])
    category = F.coalesce(F.get_json_object("txt", "$.category"), F.lit("no category"))
    return out.withColumn("message", F.when(F.col("state") == "refused", F.concat(F.lit("declined ("), category, F.lit(")"))).when(F.col("state") != "whole", F.concat("state", F.lit(", starts: "), F.coalesce(F.left("txt", F.lit(220)), F.lit("")))))


def explain_location(store: Store, strings: DataFrame) -> DataFrame:
    """(location_raw, stage, features): which stage would place each string without a model, and how many landmarks share its name."""
    g, m = store.table("gazetteer"), store.table("landmarks")
    named = places.by_gazetteer(strings, g).select("location_raw", F.lit(True).alias("by_name"))
    mapped = places.by_landmark(strings, m).select("location_raw", F.lit(True).alias("by_map"))
    same = places.ambiguous(m).select(F.col("name").alias("key"), "features")
    df = strings.select("location_raw").distinct().join(named, "location_raw", "left").join(mapped, "location_raw", "left")
    df = df.join(same, text.norm(F.col("location_raw")) == F.col("key"), "left")
    stage = F.when(text.gps(F.col("location_raw")).isNotNull(), "gps").when(F.col("by_name"), "gazetteer").when(F.col("by_map"), "landmark").otherwise("model")
    return df.select("location_raw", stage.alias("stage"), F.coalesce("features", F.lit(0)).alias("features"))


def retry_preamble(dry: DataFrame) -> DataFrame:
    """(input, hint) for answers on land (input, lat, lng, metres, near_lat, near_lng): how far inland, and which way the water is."""
    from tidemark.functions.geo import bearing

    way = bearing(F.col("lat"), F.col("lng"), F.col("near_lat"), F.col("near_lng"))
    hint = F.format_string("%s: %.4f, %.4f lies %d m inland; water is to the %s, from %.4f, %.4f on", F.to_json(F.array("input")), "lat", "lng", F.round("metres").cast("int"), way, "near_lat", "near_lng")
    return dry.select("input", hint.alias("hint"))


def project_cost(lines: DataFrame) -> DataFrame:
    """One row per issue: reports, strings for the model, calls and dollars to expect."""
    out = lines.groupBy("issue").agg(F.count_if(text.separator(F.col("line"))).alias("reports"))
    strings = F.floor(F.col("reports") * vocab.STRINGS_PER_SEPARATOR + 0.5)
    (_, made), (geo_in, geo_out) = vocab.PRICES["extract"], vocab.PRICES["geocode"]
    dollars = F.floor(F.col("reports") * vocab.OUT_PER_SEPARATOR + 0.5) * made + strings * (vocab.GEO_IN * geo_in + vocab.GEO_OUT * geo_out)
    return out.select("issue", "reports", strings.alias("strings"), F.ceil(strings / vocab.BATCH * vocab.CALLS_PER_BATCH).alias("calls"), F.round(dollars, 6).alias("dollars"))
