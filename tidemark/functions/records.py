"""Recorded model answers to typed records: JSON arrays, whole or damaged, and validated fields."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.functions.text import strip
from tidemark.functions.vocab import DETECTION_METHODS, REPORT_KINDS, SPECIES

RECORD = (
    "input string, species string, species_raw string, pod_or_group string, sighting_date string, sighting_time string, location_raw string, count double, "
    "direction string, behaviors array<string>, detection_methods array<string>, summary string, raw_excerpt string, reporter string, report_kind string, lat double, lng double, confidence string, reasoning string"
)

# The one Python function here travels by value, so that a worker needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bare(text: Column) -> Column:
    """Without a code fence."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*", ""), r"```\s*$", "")


def salvage(text: str) -> list[str] | None:
    """The objects of the first array of objects that ends, else those of the array with most whole objects; None if none.

    Objects are read one after the other, line breaks within strings allowed, until one is damaged.
    """
    decoder, best = json.JSONDecoder(strict=False), []
    for start in (m.end() - 1 for m in re.finditer(r"\[[\x00-\x20]*\{", text)):
        at, found = start, []
        while True:
            try:
                value, at = decoder.raw_decode(text, at)
            except ValueError:
                break
            found.append(json.dumps(value, ensure_ascii=False))
            at = re.compile(r"[\x00-\x20]*").match(text, at).end()
            mark, at = text[at : at + 1], re.compile(r"[\x00-\x20]*").match(text, at + 1).end()
            if mark == "]":
                return found
            if mark != ",":
                break
        best = max(best, found, key=len)
    return best or None


@F.pandas_udf(ArrayType(StringType()))
def salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else salvage(t))


def parsed(answers: DataFrame, key: str = "id", text: str = "txt") -> DataFrame:
    """(key, pos, r): a row per object; whole answers stay in the JVM, only damaged ones go through Python."""
    df = answers.select(key, bare(F.col(text)).alias("t"))
    whole = F.expr("try_parse_json(t)").isNotNull() & F.col("t").startswith("[")
    form = f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in RECORD.split(', '))}>>"
    good = df.filter(whole).select(key, F.posexplode(F.from_json("t", form)).alias("pos", "r"))
    bad = df.filter(~F.coalesce(whole, F.lit(False))).select(key, F.posexplode(salvaged("t")).alias("pos", "o"))
    return good.unionByName(bad.select(key, "pos", F.from_json("o", form[len("array<") : -1]).alias("r")))


def cut_text(value: Column, most: int) -> Column:
    """Trimmed, blank as null, at most so many characters."""
    return F.left(F.nullif(strip(value), F.lit("")), F.lit(most))


def species_or(value: Column, section: Column) -> Column:
    return F.when(value.isin([k for k, *_ in SPECIES]), value).otherwise(section)


def normalized(records: DataFrame, section: Column) -> DataFrame:
    """Valid records (with a possible date and a location) of column r, fields cut and checked, and what was wrong."""
    r = lambda c: F.col(f"r.{c}")
    date = F.when(r("sighting_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date(r.sighting_date, 'yyyy-MM-dd')"))
    methods = F.coalesce(r("detection_methods"), F.array().cast("array<string>"))
    known = lambda m: m.isin(DETECTION_METHODS)
    odd = F.coalesce(r("species"), F.lit("")) != ""
    keys = [k for k, *_ in SPECIES]
    warnings = F.concat(
        F.when(odd & ~r("species").isin(keys), F.array(F.concat(F.lit("unknown species "), r("species")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(methods, lambda m: ~known(m)), lambda m: F.concat(F.lit("unknown detection method "), m)),
    )
    out = records.withColumns({"sighting_date": date, "location_raw": cut_text(r("location_raw"), 500), "species": species_or(r("species"), section)})
    return out.filter("sighting_date is not null and location_raw is not null").withColumns(
        {
            "sighting_time": F.when(r("sighting_time").rlike(r"^\d{1,2}:\d{2}"), F.left(r("sighting_time"), F.lit(8))),
            "sighting_count": F.floor(r("count") + 0.5).cast("int"),
            "detection_methods": F.filter(methods, known),
            "behaviors": r("behaviors"),
            "species_raw": cut_text(r("species_raw"), 100),
            "pod_or_group": cut_text(r("pod_or_group"), 200),
            "direction": cut_text(r("direction"), 50),
            "summary": cut_text(r("summary"), 500),
            "raw_excerpt": cut_text(r("raw_excerpt"), 600),
            "reporter": cut_text(r("reporter"), 200),
            "report_kind": F.when(r("report_kind").isin(REPORT_KINDS), r("report_kind")),
            "warnings": warnings,
        }
    ).drop("r")
