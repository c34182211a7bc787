"""The read side: sightings by filters, order and page; issues; places; GeoJSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vocab import LABEL_ZOOM, PUBLIC_CLASSES, UNPUBLISHED

MOST, USUAL = 10_000, 5_000
WITHHELD = ("raw_excerpt", "reporter", "ai_reasoning", "ai_confidence")
#: What a GeoJSON feature does not carry as properties, even for administrators.
NO_PROPERTIES = ("lat", "lng", "raw_excerpt", "ai_reasoning", "ai_confidence")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?Infinity")
ID = re.compile(r"(?i)[0-9a-f-]{36}")


def page_size(limit: int | None) -> int:
    """5000 unless given, 10000 at most; 0 counts as not given."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    return min(limit or USUAL, MOST)


def bounding_box(text: str) -> tuple[float, float, float, float]:
    """west,south,east,north; each as number() reads it."""
    parts = [number(p) for p in text.split(",")]
    if len(parts) != 4 or None in parts:
        raise ValueError("bbox needs four numbers")
    return tuple(parts)


def number(text: str) -> float | None:
    """Decimal, with an exponent or not, or hexadecimal, octal, binary; blank is 0, and all else None."""
    text = text.strip()
    if re.fullmatch(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)", text):
        return float(int(text, 0))
    return float(text or 0) if NUMBER.fullmatch(text or "0") else None


def issue_id(text: str) -> str:
    """The id of an issue in a request, or "latest"."""
    if text != "latest" and not ID.fullmatch(text):
        raise ValueError("newsletter must be a uuid or 'latest'")
    return text


def short_id(id: Column) -> Column:
    return F.left(id, F.lit(8))


def short_title(title: Column) -> Column:
    """Without the suffix that all titles bear."""
    return F.regexp_replace(title, r"(?i) WS Report$", "")


def listed(text: str) -> list[str]:
    """Values of a comma-separated parameter, blanks dropped; an empty parameter is an empty list and matches nothing."""
    return [x.strip() for x in text.split(",") if x.strip()]


def latest_issue(newsletters: DataFrame) -> DataFrame:
    """The complete issue that ends last; ties by the largest id."""
    return newsletters.filter("status = 'complete'").orderBy(F.desc("date_to"), F.desc("id")).limit(1)


def review_order(distance: Column | None, by_confidence: bool) -> list[Column]:
    rank = F.when(F.col("ai_confidence") == "low", 1).when(F.col("ai_confidence") == "medium", 2).when(F.col("ai_confidence") == "high", 3).otherwise(4)
    out = [rank.asc()] if by_confidence else []
    if distance is not None:
        out.append(F.when(distance.between(100, 5000), distance).desc_nulls_last())
    return [*out, F.col("sighting_date").desc(), F.col("sighting_time").desc_nulls_last(), F.col("id").asc()]


def filtered(sightings: DataFrame, *, issue=None, newsletters: DataFrame | None = None, date_from=None, date_to=None, species: list[str] | None = None, bbox=None, needs_review: bool | None = None, placed_only: bool = False) -> DataFrame:
    """Each filter applies only if it is given; both ends of ranges belong to them. issue: an id, or "latest"."""
    df = sightings
    if issue == "latest":
        df = df.join(F.broadcast(latest_issue(newsletters).select(F.col("id").alias("newsletter_id"))), "newsletter_id", "left_semi")
    elif issue is not None:
        df = df.filter(F.col("newsletter_id") == issue)
    if date_from is not None:
        df = df.filter(F.col("sighting_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.filter(F.col("sighting_date") <= F.lit(date_to).cast("date"))
    if species is not None:
        df = df.filter(F.col("species").isin(species) if species else F.lit(False))
    if bbox is not None:
        west, south, east, north = bbox
        df = df.filter(F.col("lng").between(west, east) & F.col("lat").between(south, north))
    if needs_review is not None:
        df = df.filter(F.col("needs_review") == needs_review)
    return df.filter("geo_method <> 'unresolved'") if placed_only else df


def masked(df: DataFrame, admin: bool) -> DataFrame:
    """Columns that only an administrator sees are null for others, and are then not even read."""
    return df if admin else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in WITHHELD if c in df.columns})


def paged(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    if offset < 0:
        raise ValueError("offset must not be negative")
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(page_size(limit))


def archive_span(sightings: DataFrame) -> DataFrame:
    return sightings.agg(F.min("sighting_date").alias("first_date"), F.max("sighting_date").alias("last_date"))


def newsletters_list(newsletters: DataFrame) -> DataFrame:
    """Complete issues, the one that ends last first."""
    return newsletters.filter("status = 'complete'").select("id", "title", "date_from", "date_to", "sighting_count").orderBy(F.desc("date_to"), F.desc("id"))


def public_landmarks(landmarks: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Landmarks of the published classes that no verified place overrides, and the published verified places; with their label zoom."""
    federal = landmarks.filter(F.col("feature_class").isin(PUBLIC_CLASSES))
    verified = gazetteer.select(F.lower("name").alias("known")).distinct()
    federal = federal.join(verified, F.lower("name") == F.col("known"), "left_anti").select("name", "feature_class", "lat", "lng")
    both = federal.unionByName(gazetteer.filter(~F.col("name").isin(UNPUBLISHED)).select("name", F.lit("Verified").alias("feature_class"), "lat", "lng"))
    zoom = F.lit(None).cast("int")
    for name, z in LABEL_ZOOM:
        zoom = F.when(F.col("feature_class") == name, z).otherwise(zoom)
    return both.withColumn("min_zoom", zoom)


def gazetteer_counts(gazetteer: DataFrame, sightings: DataFrame, name_of: Column) -> DataFrame:
    """Verified places with the number of sightings that name them; 0 if none."""
    counts = sightings.groupBy(name_of.alias("_name")).agg(F.count("*").alias("n"))
    return gazetteer.join(counts, F.lower("name") == F.col("_name"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("sightings"))


def gazetteer_search(gazetteer: DataFrame, text: Column) -> DataFrame:
    """Places whose name or alias contains the text, with the first alias that does; `gazetteer` has aliases as an array."""
    from tidemark.functions.text import norm

    hits = F.filter("aliases", lambda a: F.contains(norm(a), text))
    found = gazetteer.withColumn("alias", F.get(hits, F.lit(0)))
    return found.filter(F.contains(norm(F.col("name")), text) | F.col("alias").isNotNull()).select("id", "name", "alias")


def response(rows: DataFrame, newsletters: DataFrame, sightings: DataFrame, issue: str | None) -> DataFrame:
    """One row of JSON: rows in their order, and where an issue is asked for, which it is and what the archive spans.

    The rows are a page, of at most MOST: they fit into one text.
    """
    listed = rows.select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("sightings"))
    if issue is None:
        return listed.select(F.to_json(F.struct("sightings")).alias("response"))
    one = latest_issue(newsletters) if issue == "latest" else newsletters.filter(F.col("id") == issue)
    of_issue = one.agg(F.first(F.struct("id", "title", F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"))).alias("newsletter"))
    span = archive_span(sightings).select(F.struct(F.col("first_date").cast("string").alias("from"), F.col("last_date").cast("string").alias("to")).alias("range"))
    whole = listed.join(F.broadcast(of_issue)).join(F.broadcast(span))
    return whole.select(F.to_json(F.struct("sightings", "newsletter", "range"), {"ignoreNullFields": "false"}).alias("response"))


def features(df: DataFrame, dropped: tuple[str, ...] = NO_PROPERTIES) -> DataFrame:
    """A GeoJSON feature per placed row; rows without a position are left out after paging, so a page can be short."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    rest = F.struct(*(c for c in df.columns if c not in dropped))
    made = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties"))
    return df.filter("lat is not null and lng is not null").select(F.to_json(made).alias("feature"))
