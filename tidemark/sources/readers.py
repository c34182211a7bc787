"""Files to relations: issues as text, delimited places, polygons as GeoJSON, recorded model calls; and their writers."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean
from tidemark.functions.vocab import IMPORT_CLASSES

ISSUES = "issue string, text string"
LANDMARKS = "id bigint, name string, feature_class string, county string, lat double, lng double"
PART_LINES = 5_000
CALLS = "stage string, attempt int, key_no bigint, stop_reason string, text string"


def issue_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: issue (the file's name) and its text, made plain."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"(?<=.)\.[^.]*$", "").alias("issue"), clean(F.col("value")).alias("text"))
    return files


def issue_lines(texts: DataFrame) -> DataFrame:
    return texts.select("issue", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def write_issues(lines: DataFrame, path: str) -> None:
    """Text files of up to PART_LINES lines each, by issue and part: an issue of any size is many files, none of them large."""
    parts = lines.groupBy("issue", F.floor(F.col("line_no") / PART_LINES).alias("part"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    whole.write.mode("overwrite").partitionBy("issue", "part").text(path)


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (issue, line_no, line) of write_issues(), numbered by their part and place; parts are as long as they were written."""
    files = spark.read.text(path, wholetext=True)
    text = clean(F.regexp_replace("value", r"\n\z", ""))
    lines = files.select(F.col("issue").cast("string").alias("issue"), "part", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select("issue", (F.col("part") * PART_LINES + F.col("pos")).cast("int").alias("line_no"), "line")


def gnis(spark: SparkSession, path: str, west: float = -130, south: float = 45, east: float = -120, north: float = 52) -> DataFrame:
    """Places from pipe-delimited files with a header: known classes within a box, without (0, 0) and broken coordinates."""
    raw = spark.read.csv(path, sep="|", header=True, mode="PERMISSIVE")
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    wanted = ["feature_id", "feature_name", "feature_class", "county_name", "prim_lat_dec", "prim_long_dec"]
    if lacking := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"columns are lacking: {', '.join(lacking)}")
    number = lambda c: F.trim(c).try_cast("double")
    out = raw.select(F.trim("feature_id").try_cast("bigint").alias("id"), F.trim("feature_name").alias("name"), F.trim("feature_class").alias("feature_class"), F.trim("county_name").alias("county"), number("prim_lat_dec").alias("lat"), number("prim_long_dec").alias("lng"))
    good = ~((F.col("lat") == 0) & (F.col("lng") == 0)) & ~F.isnan("lat") & ~F.isnan("lng")
    return out.filter(F.col("feature_class").isin(IMPORT_CLASSES) & good & F.col("lat").between(south, north) & F.col("lng").between(west, east))


def write_gnis(landmarks: DataFrame, path: str) -> None:
    landmarks.select(F.col("id").alias("feature_id"), F.col("name").alias("feature_name"), "feature_class", F.col("county").alias("county_name"), F.col("lat").alias("prim_lat_dec"), F.col("lng").alias("prim_long_dec")).write.mode("overwrite").csv(path, sep="|", header=True)


def checked_load(landmarks: DataFrame, least: int, most: int, probes: list[str]) -> DataFrame:
    """One row of facts about a load; it raises if the load is not plausible."""
    facts = landmarks.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("nameless"), *(F.max(F.col("name") == p).alias(f"has_{i}") for i, p in enumerate(probes)))
    fine = F.col("n").between(least, most) & (F.col("ids") == F.col("n")) & (F.col("nameless") == 0)
    for i in range(len(probes)):
        fine &= F.col(f"has_{i}")
    return facts.withColumn("valid", F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit("the load is not plausible")).cast("boolean"))).select("n", "ids", "nameless", "valid")


def polygons(spark: SparkSession, path: str, areas: list[str] | None = None) -> DataFrame:
    """Edge rows (poly_id, ring, k, x1, y1, x2, y2) of a GeoJSON collection of Polygons and MultiPolygons.

    areas: the names of the features to keep (vocab.WATER_AREAS, say); all, if none are given.
    """
    form = "features array<struct<properties: struct<id: bigint, name: string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(form).json(path, multiLine=True).select(F.explode("features").alias("f"))
    if areas is not None:
        features = features.filter(F.col("f.properties.name").isin(areas))
    features = features.select(F.col("f.properties.id").alias("poly_id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one = F.array(F.from_json("c", "array<array<array<double>>>"))
    rings = features.withColumn("polygons", F.when(F.col("type") == "Polygon", one).otherwise(F.from_json("c", "array<array<array<array<double>>>>")))
    rings = rings.select("poly_id", F.posexplode(F.flatten("polygons")).alias("ring", "points"))
    corners = rings.select("poly_id", "ring", "points", F.explode(F.sequence(F.lit(0), F.size("points") - 2)).alias("k"))
    at = lambda i, j: F.get(F.get("points", i), F.lit(j))
    return corners.select("poly_id", "ring", "k", at(F.col("k"), 0).alias("x1"), at(F.col("k"), 1).alias("y1"), at(F.col("k") + 1, 0).alias("x2"), at(F.col("k") + 1, 1).alias("y2"))


def write_polygons(edges: DataFrame, path: str) -> None:
    """One GeoJSON collection per part file; rings are closed."""
    ring = edges.groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("k", "x1", "y1"))).alias("p"))
    points = F.transform("p", lambda x: F.array(x["x1"], x["y1"]))
    ring = ring.select(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("poly_id").alias("id"), F.col("poly_id").cast("string").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(points, F.array(F.get(points, F.lit(0))))).alias("coordinates")).alias("geometry")).alias("f"))
    ring.groupBy(F.spark_partition_id().alias("part")).agg(F.collect_list("f").alias("features")).select(F.lit("FeatureCollection").alias("type"), "features").write.mode("overwrite").json(path)


def write_calls(calls: DataFrame, path: str) -> None:
    """A log of model calls as JSON, by stage; recorded_calls() reads it, so a run can be replayed from its own log.

    Columns beyond those of CALLS (the request, tokens, seconds) are kept.
    """
    calls.write.mode("append").partitionBy("stage").json(path)


def recorded_calls(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a model, recorded as JSON rows: a replayable stand-in for the model itself."""
    return spark.read.schema(CALLS).json(path)


def logged_calls(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """All of a log of write_calls(): CALLS and the columns `more`, such as "issue string"."""
    return spark.read.schema(CALLS + (f", {more}" if more else "")).json(path)


def write_result(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def rules_document(spark: SparkSession, path: str) -> str | None:
    """A document of rules for placing locations, whole; without it, requests go without, with a warning."""
    try:
        row = spark.read.text(path, wholetext=True).first()
        return row and row.value
    except AnalysisException:
        warnings.warn(f"{path} is not there: requests go without the rules", stacklevel=2)
        return None


def answered(requests: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their recorded answers: refused (by stop reason), cut off, lacking, or whole."""
    joined = requests.join(calls, keys, "left")
    state = F.when(F.col("stop_reason").isNull(), "lacking").when(F.col("stop_reason") == "refusal", "refused").when(F.col("stop_reason") == "max_tokens", "cut off").otherwise("whole")
    return joined.withColumn("state", state)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """A Parquet table, or an empty one of this schema if it is not there; and whether it is."""
    try:
        return spark.read.parquet(path), True
    except AnalysisException:
        return spark.createDataFrame([], schema), False


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table, read by ranges of a numeric key in parallel."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
