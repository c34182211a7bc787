"""Writes as functions from a state to the next one: the caller stores what they return (copy on write).

Each returns whole DataFrames; nothing is changed in place, so a failed job leaves the former state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_aliases(old: Column, new: Column) -> Column:
    """Sorted distinct aliases without blanks; an empty array if there are none."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(both, lambda a: F.trim(a) != "")))


def upsert_places(gazetteer: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, name, aliases, lat, lng, region, merged) of the union by lower-cased name.

    A known place keeps its coordinates and name, and its region unless it has none. Either side may lack regions.
    """
    gazetteer, incoming = (df if "region" in df.columns else df.withColumn("region", F.lit(None).cast("string")) for df in (gazetteer, incoming))
    old = gazetteer.select(F.lower("name").alias("key"), F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("aliases").alias("old_aliases"), F.col("lat").alias("old_lat"), F.col("lng").alias("old_lng"), F.col("region").alias("old_region"))
    new = incoming.select(F.lower("name").alias("key"), F.col("id").alias("new_id"), F.col("name").alias("new_name"), F.col("aliases").alias("new_aliases"), F.col("lat").alias("new_lat"), F.col("lng").alias("new_lng"), F.col("region").alias("new_region"))
    both = old.join(new, "key", "full")
    pick = lambda c: F.when(F.col("old_id").isNotNull(), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c)
    merged = F.col("old_id").isNotNull() & F.col("new_id").isNotNull()
    return both.select(pick("id"), pick("name"), merged_aliases(F.col("old_aliases"), F.col("new_aliases")).alias("aliases"), pick("lat"), pick("lng"), F.coalesce("old_region", "new_region").alias("region"), merged.alias("merged"))


def insert_ignore(state: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """state and the incoming rows whose key it lacks; rows with a null key never conflict."""
    fresh = incoming.filter(F.col(key).isNull()).unionByName(incoming.filter(F.col(key).isNotNull()).join(state.select(key), key, "left_anti").select(*incoming.columns))
    return state.unionByName(fresh)


def cluster_backfill(sightings: DataFrame, location: str, except_id: int, lat: float, lng: float) -> DataFrame:
    """Flagged rows with this location take the position and lose the flag; `changed` says which."""
    hit = (F.col("location_raw") == location) & F.col("needs_review") & (F.col("id") != except_id)
    return sightings.withColumns(
        {"changed": hit, "lat": F.when(hit, F.lit(lat)).otherwise(F.col("lat")), "lng": F.when(hit, F.lit(lng)).otherwise(F.col("lng")), "geo_method": F.when(hit, "gazetteer").otherwise(F.col("geo_method")), "needs_review": F.col("needs_review") & ~hit}
    )


EDITABLE = ("sighting_date", "sighting_time", "species", "species_raw", "pod_or_group", "sighting_count", "direction", "location_raw", "lat", "lng", "geo_method", "needs_review", "gazetteer_id")
EDITABLE_PLACE = ("name", "aliases", "lat", "lng", "region")


def patched_fields(present: Column, old: dict[str, Column], new: dict[str, Column]) -> dict[str, Column]:
    """The fields of a row after a patch: those whose names are present are set, be it to null.

    A position that moves makes the method manual, unless the patch gives a method itself.
    """
    given = lambda c: F.coalesce(F.array_contains(present, c), F.lit(False)) if c in new else F.lit(False)
    value = {c: F.when(given(c), new[c]).otherwise(x) if c in new else x for c, x in old.items()}
    if {"lat", "lng", "geo_method"} <= set(old) and {"lat", "lng"} <= set(new):
        moved = (given("lat") & ~old["lat"].eqNullSafe(new["lat"])) | (given("lng") & ~old["lng"].eqNullSafe(new["lng"]))
        value["geo_method"] = F.when(moved & ~given("geo_method"), "manual").otherwise(value["geo_method"])
    return value


def patched(sightings: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: id, `present` (names of the given fields) and new values, as patched_fields() sets them."""
    fields = [c for c in EDITABLE if c in patches.columns and c in sightings.columns]
    df = sightings.join(patches.select("id", "present", *(F.col(c).alias(f"new_{c}") for c in fields)), "id", "left")
    value = patched_fields(F.col("present"), {c: F.col(c) for c in sightings.columns}, {c: F.col(f"new_{c}") for c in fields})
    return df.select(*(x.alias(c) for c, x in value.items()))


def as_patches(rows: DataFrame, *fields: str, key: str = "id") -> DataFrame:
    """Patches that set these fields of the rows' keys to what the rows have."""
    return rows.select(key, F.array(*map(F.lit, fields)).alias("present"), *fields)


def patched_places(gazetteer: DataFrame, patches: DataFrame) -> DataFrame:
    """As patched(), for verified places: patches have id, `present` and new values of EDITABLE_PLACE."""
    fields = [c for c in EDITABLE_PLACE if c in patches.columns and c in gazetteer.columns]
    df = gazetteer.join(patches.select("id", "present", *(F.col(c).alias(f"new_{c}") for c in fields)), "id", "left")
    given = lambda c: F.coalesce(F.array_contains("present", c), F.lit(False))
    return df.select(*(F.when(given(c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in gazetteer.columns))


def with_aliases(gazetteer: DataFrame, more: Column) -> DataFrame:
    """Adds aliases, sorted; those that a place has already are not added again."""
    return gazetteer.withColumn("aliases", F.array_sort(F.array_union("aliases", more)))


def without_aliases(gazetteer: DataFrame, gone: Column) -> DataFrame:
    return gazetteer.withColumn("aliases", F.array_sort(F.array_except("aliases", gone)))


def placed_by_landmark(sightings: DataFrame, matches: DataFrame) -> DataFrame:
    """Flagged rows take the position of the landmark that bears their location's name, and lose the flag.

    matches: location_raw, landmark_id, lat, lng.
    """
    new = matches.select("location_raw", F.col("landmark_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    df = sightings.join(new, "location_raw", "left")
    hit = F.col("needs_review") & F.col("_id").isNotNull()
    value = {"lat": F.col("_lat"), "lng": F.col("_lng"), "landmark_id": F.col("_id"), "geo_method": F.lit("landmark"), "needs_review": F.lit(False)}
    return df.select(*(F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in sightings.columns), hit.alias("changed"))


def purged_runs(newsletters: DataFrame) -> DataFrame:
    """Without runs that failed or never came to an end."""
    return newsletters.filter(~F.col("status").isin("failed", "processing"))


def without_place(sightings: DataFrame, gazetteer: DataFrame, place: int) -> tuple[DataFrame, DataFrame]:
    """Deletes a place; sightings lose the link but keep their coordinates."""
    link = F.when(F.col("gazetteer_id") == place, F.lit(None)).otherwise(F.col("gazetteer_id"))
    return sightings.withColumn("gazetteer_id", link), gazetteer.filter(F.col("id") != place)


def without_issues(newsletters: DataFrame, sightings: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Deletes issues and their sightings."""
    ids = newsletters.filter(gone).select(F.col("id").alias("newsletter_id"))
    return newsletters.filter(~gone), sightings.join(ids, "newsletter_id", "left_anti")


def filled_from(sightings: DataFrame, answers: DataFrame, column: str, value: str, wanted: Column) -> DataFrame:
    """Null `column` of wanted rows takes `value` of the answer for the row's location."""
    new = answers.select(F.col("input").alias("location_raw"), F.col(value).alias("_new"))
    df = sightings.join(new, "location_raw", "left")
    return df.withColumn(column, F.when(wanted, F.coalesce(column, "_new")).otherwise(F.col(column))).drop("_new")


def regeocoded(sightings: DataFrame, results: DataFrame) -> DataFrame:
    """Flagged ai or unresolved rows take the new result for their location: input, method, lat, lng."""
    new = results.select(F.col("input").alias("location_raw"), F.col("method").alias("_method"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    df = sightings.join(new, "location_raw", "left")
    hit = F.col("geo_method").isin("ai", "unresolved") & F.col("needs_review") & F.col("_method").isNotNull()
    pick = lambda c, n: F.when(hit, F.col(n)).otherwise(F.col(c)).alias(c)
    return df.select(*(pick("geo_method", "_method") if c == "geo_method" else pick(c, f"_{c}") if c in ("lat", "lng") else F.col(c) for c in sightings.columns), hit.alias("changed"))


def renamed_method(sightings: DataFrame, old: str, new: str) -> DataFrame:
    return sightings.withColumn("geo_method", F.when(F.col("geo_method") == old, new).otherwise(F.col("geo_method")))


def begun_runs(issues: DataFrame) -> DataFrame:
    """Run rows (id, title) as they are written before any work: processing."""
    return issues.withColumn("status", F.lit("processing"))


def failed_runs(runs: DataFrame, message: Column, most: int = 2_000) -> DataFrame:
    """Run rows marked failed, with what went wrong, cut."""
    return runs.withColumns({"status": F.lit("failed"), "warning_text": F.left(message, F.lit(most))})


def finished_runs(runs: DataFrame, warnings: Column, most: int = 2_000) -> DataFrame:
    """Run rows marked complete, with their warnings joined and cut."""
    return runs.withColumns({"status": F.lit("complete"), "warning_text": F.left(F.array_join(warnings, "; "), F.lit(most))})
