"""Relations that are constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vocab import BANNERS, HYDROPHONES, LABEL_ZOOM, SEED_PLACES, SPECIES, WEBCAMS


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small relation as literals in the plan."""
    literal = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row))) for row in rows))
    return spark.range(1).select(F.explode(literal).alias("r")).select("r.*")


def species(spark: SparkSession) -> DataFrame:
    return values(spark, ["key", "label", "orca"], SPECIES)


def banners(spark: SparkSession) -> DataFrame:
    return values(spark, ["name", "species"], BANNERS)


def label_bands(spark: SparkSession) -> DataFrame:
    return values(spark, ["feature_class", "min_zoom"], LABEL_ZOOM)


def hydrophones(spark: SparkSession) -> DataFrame:
    return values(spark, ["name", "lat", "lng"], HYDROPHONES)


def webcams(spark: SparkSession) -> DataFrame:
    return values(spark, ["name", "lat", "lng", "facing"], WEBCAMS)


def sensors(spark: SparkSession) -> DataFrame:
    """(kind, name, lat, lng, facing) of all fixed sensors."""
    heard = hydrophones(spark).select(F.lit("hydrophone").alias("kind"), "name", "lat", "lng", F.lit(None).cast("string").alias("facing"))
    return heard.unionByName(webcams(spark).withColumn("kind", F.lit("webcam")))


def seed_places(spark: SparkSession) -> DataFrame:
    """(id, name, aliases, lat, lng, region): verified places to start with."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(SEED_PLACES, 1)], "id bigint, name string, aliases array<string>, lat double, lng double, region string")
