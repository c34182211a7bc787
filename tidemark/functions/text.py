"""Text rules as column expressions: normal forms, banners, headers, dates, separators, coordinates in prose."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.vocab import BANNERS, MONTHS

SPACE = r"[ \t\n\x0B\f\r ﻿]"


#: The same characters as they are, for functions that take no pattern.
BLANKS = " \t\n\x0B\f\r\u00a0\ufeff"


def strip(text: Column) -> Column:
    """Without white space at both ends; a look at the ends only, however long the text or a run of blanks within it."""
    return F.trim(text, F.lit(BLANKS))


def norm(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def clean(text: Column) -> Column:
    """Without byte-order marks and zero-width spaces; no-break spaces and line ends made plain."""
    plain = F.translate(F.regexp_replace(text, "[﻿​]", ""), " ", " ")
    return F.regexp_replace(plain, "\r\n?", "\n")


#: One name, and after it nothing or an opening bracket.
BANNER = rf"^({'|'.join(re.escape(name) for name, _ in BANNERS)})(?: ?\(|\z)"
#: So many characters tell whether a line is a banner: the longest name, and one more than what may follow it.
BANNER_HEAD = max(len(name) for name, _ in BANNERS) + 3


def banner(line: Column) -> Column:
    """struct<name, species> of a section banner, else null."""
    # Upper case is never shorter, so a line beyond the head is longer than each name.
    shown = F.upper(F.translate(F.left(strip(line), F.lit(BANNER_HEAD)), "’‘", "''"))
    name = F.regexp_extract(shown, BANNER, 1)
    species = F.create_map(*(F.lit(x) for pair in BANNERS for x in pair))
    return F.when(shown.rlike(BANNER), F.struct(name.alias("name"), F.element_at(species, name).alias("species")))


# The forms of a date header and of an issue's date line.
DAY = "(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)"
MONTH = "((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)[a-z]*)"
HEADER = rf"(?i)^{DAY}[.,]?\s+{MONTH}[.,]?\s+(\d{{1,2}})\s*[-–]\s*(.+)$"


def month_number(word: Column) -> Column:
    """1 to 12 for a month's name, its first three letters, or sept; else null."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS, 1):
        known = {name, name[:3]} | ({"sept"} if name == "september" else set())
        out = F.when(F.lower(word).isin(*sorted(known)), F.lit(i)).otherwise(out)
    return out


def header(line: Column) -> Column:
    """struct<raw, month, day, water_body, pod> of a date header such as "Thu, Jul 9 - Puget Sound (T65A5)", else null."""
    line = strip(line)
    month = month_number(F.regexp_extract(line, HEADER, 1))
    rest = strip(F.regexp_extract(line, HEADER, 3))
    in_brackets = r"^(.*?)\s*\(([^)]+)\)$"
    bracketed = rest.rlike(in_brackets)
    water = F.when(bracketed, strip(F.regexp_extract(rest, in_brackets, 1))).otherwise(rest)
    pod = F.when(bracketed, strip(F.regexp_extract(rest, in_brackets, 2)))
    day = F.regexp_extract(line, HEADER, 2).try_cast("int")
    # Few lines begin with a day: the others are told by their first characters.
    found = F.left(line, F.lit(5)).rlike(f"(?i)^{DAY}") & line.rlike(HEADER) & month.isNotNull()
    return F.when(found, F.struct(line.alias("raw"), month.alias("month"), day.alias("day"), water.alias("water_body"), pod.alias("pod")))


def header_date(month: Column, day: Column, issue_date: Column) -> Column:
    """yyyy-mm-dd of a header in an issue: the year that puts it within half a year of the issue. The day isn't checked."""
    gap = month - F.month(issue_date)
    year = F.year(issue_date) + F.when(gap > 6, -1).when(gap < -6, 1).otherwise(0)
    return F.format_string("%d-%02d-%02d", year, month, day)


ISSUE_DATE = r"^([A-Z][a-z]+)\s+(\d{1,2}),\s*(\d{4})$"


def issue_date(line: Column) -> Column:
    """struct<title, iso> of an issue's date line such as "Jul 9, 2026", else null."""
    line = strip(line)
    word, day, year = (F.regexp_extract(line, ISSUE_DATE, i) for i in (1, 2, 3))
    month = month_number(word)
    day_number = day.try_cast("int")
    full = F.element_at(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), month)
    made = F.struct(F.format_string("%s %d, %s", full, day_number, year).alias("title"), F.format_string("%s-%02d-%02d", year, month, day_number).alias("iso"))
    return F.when(line.rlike(ISSUE_DATE) & month.isNotNull(), made)


def separator(line: Column) -> Column:
    """A line that stands between two reports."""
    return strip(line).rlike("^-(\\s*·)?\\s*$")


def footer(line: Column) -> Column:
    """Where the reports end; the two phrases are fixed values."""
    return F.left(strip(line), F.lit(21)).rlike(r"(?i)^(ABOUT ORCA NETWORK|Orca Network is a 501)")


def shouted(line: Column) -> Column:
    """Could be a banner that the vocabulary lacks."""
    line = strip(line)
    return F.length(line).between(4, 60) & (line == F.upper(line)) & line.rlike("[A-Z]{3}") & ~line.rlike(r"\d") & banner(line).isNull() & ~line.rlike("(?i)^(SUMMARY|ANNOUNCEMENTS)")


def split_lines(text: Column) -> Column:
    """Distinct lines that aren't blank, trimmed, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), strip), lambda x: x != ""))


def bracket_readings(text: Column) -> Column:
    """Ways to read "N [North] Beach": as it is, with what the bracket says for the word before it, and without the bracket."""
    meant = F.regexp_replace(text, r"\S+\s*\[([^\]]+)\]", "$1")
    return F.array_distinct(F.array(text, meant, F.regexp_replace(text, r"\s*\[[^\]]*\]", "")))


# ---- coordinates in prose

# The four forms in which reports give coordinates.
DEGREES = "[°º]"
MINUTES, SECONDS = "['’′]", "[\"”″]"
DMS = rf"(?i)(\d{{1,2}}){DEGREES}\s*(\d{{1,2}}){MINUTES}\s*([\d.]+){SECONDS}?\s*([NS])[,;\s]+(\d{{1,3}}){DEGREES}\s*(\d{{1,2}}){MINUTES}\s*([\d.]+){SECONDS}?\s*([EW])"
DECIMAL_MINUTES = rf"(?i)([NS])\s*(\d{{1,3}})d(\d{{1,2}}(?:\.\d+)?){MINUTES}?[,;\s]+([EW])\s*(\d{{1,3}})d(\d{{1,2}}(?:\.\d+)?){MINUTES}?"
HEMISPHERES = rf"(?i)(\d{{1,2}}\.\d+)\s*{DEGREES}?\s*([NS])[,;\s]+(\d{{1,3}}\.\d+)\s*{DEGREES}?\s*([EW])?"
PAIR = r"(-?\d{1,2}\.\d{3,})\s*,\s*(-?\d{1,3}\.\d{3,})"


def gps(text: Column) -> Column:
    """struct<lat, lng> of the first form that the text has, in this order; null if that one lies outside 45..52, -130..-120.

    S makes a latitude negative and W a longitude; without a hemisphere, 120..130 is taken as west.
    """

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    number = lambda pattern, i: part(pattern, i).try_cast("double")
    forms = [
        (DMS, number(DMS, 1) + number(DMS, 2) / 60 + number(DMS, 3) / 3600, number(DMS, 5) + number(DMS, 6) / 60 + number(DMS, 7) / 3600, part(DMS, 4), part(DMS, 8)),
        (DECIMAL_MINUTES, number(DECIMAL_MINUTES, 2) + number(DECIMAL_MINUTES, 3) / 60, number(DECIMAL_MINUTES, 5) + number(DECIMAL_MINUTES, 6) / 60, part(DECIMAL_MINUTES, 1), part(DECIMAL_MINUTES, 4)),
        (HEMISPHERES, number(HEMISPHERES, 1), number(HEMISPHERES, 3), part(HEMISPHERES, 2), part(HEMISPHERES, 4)),
        (PAIR, number(PAIR, 1), number(PAIR, 2), F.lit(""), F.lit("")),
    ]
    out = F.lit(None)
    for pattern, lat, lng, north, east in reversed(forms):
        lat = F.when(F.upper(north) == "S", -lat).otherwise(lat)
        west = (F.upper(east) == "W") | ((east == "") & lng.between(120, 130))
        lng = F.when(west, -F.abs(lng)).otherwise(lng)
        point = F.when(lat.between(45, 52) & lng.between(-130, -120), F.struct(lat.alias("lat"), lng.alias("lng")))
        out = F.when(text.rlike(pattern), point).otherwise(out)
    return out


# ---- display

def short_date(date: Column) -> Column:
    return F.date_format(date, "MMM d")


def range_text(first: Column, last: Column) -> Column:
    """"Aug 3 – Aug 9", one date if both are the same, empty if one is missing."""
    both = F.concat(short_date(first), F.lit(" – "), short_date(last))
    return F.when(first.isNull() | last.isNull(), "").when(first == last, short_date(first)).otherwise(both)


def inland_label(metres: Column) -> Column:
    """Null outside 100..5000 m; kilometres with one decimal from 1000 m."""
    km = F.concat(F.format_number(metres / 1000, 1), F.lit(" km"))
    return F.when((metres >= 100) & (metres <= 5000), F.when(metres >= 1000, km).otherwise(F.concat(metres.cast("string"), F.lit(" m"))))


def display(sighting: Column) -> dict[str, Column]:
    """The lines of a sighting's panel: who, when, doing, notes and the sensors that noticed it; blanks are left out.

    sighting: a struct with pod_or_group, individual_ids, sighting_date, sighting_time, direction, behaviors, detection_methods.
    """
    part = lambda c: F.nullif(sighting[c], F.lit(""))
    listed = lambda c: F.nullif(F.array_join(F.coalesce(sighting[c], F.array().cast("array<string>")), ", "), F.lit(""))
    return {
        "who": F.concat_ws(" · ", part("pod_or_group"), listed("individual_ids")),
        "when": F.concat_ws(" · ", sighting["sighting_date"].cast("string"), F.nullif(F.left(sighting["sighting_time"], F.lit(5)), F.lit(""))),
        "doing": F.concat_ws(" · ", part("direction"), listed("behaviors")),
        "notes": F.concat_ws(", ", part("direction"), F.filter(F.coalesce(sighting["behaviors"], F.array().cast("array<string>")), lambda b: b != "")),
        "badges": F.filter(F.coalesce(sighting["detection_methods"], F.array().cast("array<string>")), lambda m: m.isin("hydrophone", "webcam")),
    }


def stage_of(system: Column) -> Column:
    """The stage of a model call, by its system text."""
    return F.when(F.coalesce(system, F.lit("")).rlike("(?i)marine geography"), "geocode").otherwise("extract")
