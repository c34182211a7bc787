"""A folder of issues as a stream: each new file is read once, and gives the same rows as a batch read does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean


def new_issue_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=True)
    texts = files.select(F.regexp_replace("_metadata.file_name", r"(?<=.)\.[^.]*$", "").alias("issue"), clean(F.col("value")).alias("text"))
    return texts.select("issue", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def append_lines(lines: DataFrame, to: str, checkpoint: str):
    """Appends lines as Parquet; ends when the files that are there now have been read."""
    query = lines.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
