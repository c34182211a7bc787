"""The resolution chain, cheapest stage first: coordinates in the text, verified places, unique landmarks, model answers.

Work is done once per distinct string, and each stage sees only what the former ones left.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.text import gps
from tidemark.operators import geometry, places
from tidemark.operators.scans import stored


def checked_answers(answers: DataFrame, edges: DataFrame) -> DataFrame:
    """(input, lat, lng, wet) of usable answers: the second attempt counts if it lies nearer to water than the first."""
    usable = answers.filter(geo.placeable(F.col("confidence"), F.col("lat").cast("double"), F.col("lng").cast("double")))
    usable = usable.select(F.col("input"), "attempt", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.struct("input", "attempt").alias("pid"))
    metres = geometry.water_distance(usable, edges)
    first = F.min(F.struct("metres", "attempt", "lat", "lng"))
    best = usable.join(metres, "pid").groupBy("input").agg(first.alias("b"), F.count_if(F.col("attempt") == 1).alias("asked")).filter("asked > 0")
    return best.select("input", "b.lat", "b.lng", (F.col("b.metres") == 0).alias("wet"))


def resolved(sightings: DataFrame, gazetteer: DataFrame, landmarks: DataFrame, answers: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, geo_method, lat, lng, needs_review) of sightings (id, location_raw).

    What a stage leaves is stored, once, and the next stage reads that: none works out again what came before it.
    """
    strings = sightings.select("location_raw").distinct()
    form = ["location_raw", "method", "lat", "lng", "review"]
    point = gps(F.col("location_raw"))
    read = stored(strings.withColumn("p", point))
    found = [read.filter("p is not null").select("location_raw", F.lit("gps").alias("method"), "p.lat", "p.lng", F.lit(False).alias("review"))]
    left = read.filter("p is null").select("location_raw")

    def stage(left: DataFrame, hits: DataFrame, known: DataFrame, key: str, method: str) -> DataFrame:
        """Adds what the stage places, and returns what it leaves."""
        spots = known.select(F.col("id").alias(key), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
        placed = hits.join(spots, key).select("location_raw", F.lit(method).alias("method"), "lat", "lng", F.lit(False).alias("review"))
        both = stored(left.join(placed, "location_raw", "left").select(*form))
        found.append(both.filter("method is not null"))
        return both.filter("method is null").select("location_raw")

    left = stage(left, places.by_gazetteer(left, gazetteer), gazetteer, "gazetteer_id", "gazetteer")
    left = stage(left, places.by_landmark(left, landmarks), landmarks, "landmark_id", "landmark")
    asked = answers.join(left.withColumnRenamed("location_raw", "input"), "input", "left_semi")
    by_model = left.join(checked_answers(asked, edges), F.col("location_raw") == F.col("input"))
    found.append(by_model.select("location_raw", F.lit("ai").alias("method"), "lat", "lng", (~F.col("wet")).alias("review")))
    every = functools.reduce(DataFrame.unionByName, found)
    out = sightings.select("id", "location_raw").join(every, "location_raw", "left")
    return out.select("id", F.coalesce("method", F.lit("unresolved")).alias("geo_method"), "lat", "lng", F.coalesce("review", F.lit(True)).alias("needs_review"))
