"""Counts, spans, rankings and before-and-after measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], out: str, range_rows: int = 50_000) -> DataFrame:
    """Adds 1, 2, ... by a total order, without one task seeing all rows: ranges are sorted and counted apart."""
    parts = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_base") + F.col("_row") + 1).drop("_place", "_part", "_row", "_base")


def by_method(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("geo_method").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("flagged"))


def first_of(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def deduped(sightings: DataFrame) -> DataFrame:
    """Of reports with the same date, time and lower-cased place, the first."""
    return first_of(sightings, ["sighting_date", F.coalesce("sighting_time", F.lit("")), F.lower("location_raw")], ["id"])


def median_and_most(df: DataFrame, value: str, tie: str) -> DataFrame:
    """One row: n, median_{value} (element floor(n/2) of the sorted values, counted from 0) and most_{value}."""
    placed = numbered(df.select(value, tie), [value, tie], "_n")
    total = df.agg(F.count("*").alias("n"), F.max(value).alias(f"most_{value}"))
    middle = placed.join(F.broadcast(total.select("n")), F.col("_n") == F.floor(F.col("n") / 2) + 1).select(F.col(value).alias(f"median_{value}"))
    return total.join(F.broadcast(middle), F.lit(True), "left")


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(was, now, n) of paired samples (key, wet): wet is null where there is no position."""
    state = lambda c: F.when(c.isNull(), "unplaced").when(c, "wet").otherwise("dry")
    both = before.select("key", F.col("wet").alias("was")).join(after.select("key", F.col("wet").alias("now")), "key")
    return both.groupBy(state(F.col("was")).alias("was"), state(F.col("now")).alias("now")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in columns))


def call_costs(calls: DataFrame, prices: dict) -> DataFrame:
    """(stage, calls, input_tokens, output_tokens, dollars)."""
    dollars = F.lit(None).cast("double")
    for stage, (given, made) in prices.items():
        dollars = F.when(F.col("stage") == stage, F.sum("input_tokens") * given + F.sum("output_tokens") * made).otherwise(dollars)
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(dollars, 6).alias("dollars"))
