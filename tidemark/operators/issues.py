"""Issues of a periodic digest: lines to sections to chunks. Lines are rows (issue, line_no, line); line_no counts from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.vocab import MAX_CHUNK
from tidemark.operators import scans


def running(lines: DataFrame) -> DataFrame:
    """Lines before the footer with what they stand under: `section` (line, name and species of the last banner) and `header_line`, the last header.

    An issue may have any share of all lines: they are scanned by ranges of their numbers. They are stored, with what each of them is,
    as a scan looks at them twice.
    """
    df = scans.stored(lines.withColumns({"banner": T.banner(F.col("line")), "header": T.header(F.col("line")), "footer": T.footer(F.col("line"))}))
    here = lambda c: F.when(c, F.col("line_no"))
    section = F.when(F.col("banner").isNotNull(), F.struct("line_no", "banner.name", "banner.species"))
    seen = {"section": section, "header_line": here(F.col("header").isNotNull()), "ended": here(F.col("footer"))}
    return scans.scanned(df, ["issue"], "line_no", seen).filter("ended is null").drop("ended", "footer")


def issue_dates(lines: DataFrame) -> DataFrame:
    """(issue, title, iso) by the first date line among the first ten."""
    dated = lines.filter("line_no < 10").select("issue", "line_no", T.issue_date(F.col("line")).alias("d")).filter("d is not null")
    return dated.groupBy("issue").agg(F.min_by("d", "line_no").alias("d")).select("issue", "d.title", "d.iso")


def owned(lines: DataFrame) -> DataFrame:
    """Lines under a banner and before the footer, with banner_line, species, and header_line (null before the first header)."""
    df = running(lines).filter("section is not null and line_no > section.line_no")
    own = F.when(F.col("header_line") > F.col("section.line_no"), F.col("header_line"))
    return df.select("issue", "line_no", "line", F.col("section.line_no").alias("banner_line"), F.col("section.name").alias("banner_name"), F.col("section.species").alias("species"), own.alias("header_line"), "header")


def unknown_banners(lines: DataFrame, ahead: int = 15) -> DataFrame:
    """(issue, line): lines in capitals that a header follows within 15 lines, with no known banner before it.

    Ranges of lines look ahead by themselves: the first lines of each go to the range before it as well.
    """
    df = running(lines).select("issue", "line_no", "line", F.col("banner").isNotNull().alias("banner"), F.col("header").isNotNull().alias("header"))
    of = lambda n: F.floor(n / scans.PER)
    df = df.withColumn("range", F.explode(F.array_distinct(F.array(of(F.col("line_no")), of(F.col("line_no") - ahead)))))
    next_ = Window.partitionBy("issue", "range").orderBy("line_no").rowsBetween(1, ahead)
    first = lambda c: F.min(F.when(F.col(c), F.col("line_no"))).over(next_)
    found = df.withColumns({"next_header": first("header"), "next_banner": first("banner")}).filter(F.col("range") == of(F.col("line_no"))).filter(T.shouted(F.col("line")))
    found = found.filter("next_header is not null and (next_banner is null or next_header < next_banner)")
    return found.select("issue", T.strip(F.col("line")).alias("line")).distinct()


def summaries(lines: DataFrame) -> DataFrame:
    """(issue, summary): what stands between SUMMARY and ANNOUNCEMENTS, or the first banner, or the footer."""
    first = lambda c: F.min(F.when(c, F.col("line_no")))
    line = T.strip(F.col("line"))
    at = lines.groupBy("issue").agg(first(line == "SUMMARY").alias("start"), first(T.banner(F.col("line")).isNotNull()).alias("banner"), first(T.footer(F.col("line"))).alias("footer"), (F.max("line_no") + 1).alias("last"))
    end = F.coalesce("footer", "last")
    at = at.select("issue", "start", end.alias("end"), F.when(F.col("banner") < end, F.col("banner")).alias("first_banner"))
    news = lines.filter(line.rlike(r"(?i)^ANNOUNCEMENTS\b")).select("issue", "line_no")
    after = news.join(at.select("issue", "start"), "issue").filter(F.col("line_no") > F.col("start")).groupBy("issue").agg(F.min("line_no").alias("news"))
    at = at.join(after, "issue", "left").withColumn("until", F.when(F.col("news") <= F.col("end"), F.col("news")).otherwise(F.coalesce("first_banner", "end")))
    # Lines meet what is asked for by ranges of their numbers, so that an issue is no key.
    of = lambda n: F.floor(F.col(n) / scans.PER)
    at = at.filter("start < end and start < until").select("issue", "start", "until", F.explode(F.sequence(of("start"), of("until"))).alias("range"))
    inside = lines.select("issue", "line_no", "line", of("line_no").alias("range")).join(at, ["issue", "range"]).filter("line_no > start and line_no < until")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy("issue").agg(T.strip(text).alias("summary")).filter("summary <> ''")


def sections(lines: DataFrame) -> DataFrame:
    """(issue, banner_line, banner_name, species, header_line, header, text) of each header's lines; blank ones left out."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    whole = owned(lines).groupBy("issue", "banner_line", "banner_name", "species", "header_line").agg(T.strip(text).alias("text"), F.max(F.when(F.col("line_no") == F.col("header_line"), F.col("header"))).alias("header"))
    return whole.filter("text <> ''")


def date_ranges(lines: DataFrame) -> DataFrame:
    """(issue, first_date, last_date) of the headers' dates, as text."""
    dated = sections(lines).filter("header is not null").join(issue_dates(lines), "issue")
    date = T.header_date(F.col("header.month"), F.col("header.day"), F.col("iso").try_cast("date"))
    return dated.select("issue", date.alias("d")).groupBy("issue").agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"))


def packed(texts: DataFrame, group: list[str], order: str, size: str, most: int = MAX_CHUNK) -> DataFrame:
    """Adds chunk_no per group: texts are put together in order while their sizes, and 2 between, stay within `most`.

    One that is larger than `most` stands alone. `order` is a number that differs within a group.
    """
    sized = texts.select(*group, order, (F.col(size) + 2).alias("_size"), F.lit(True).alias("_may"))
    return with_part(texts, scans.split(sized, group, order, most + 2, "chunk_no", whole=True), [*group, order], "chunk_no")


def oversize_parts(text_lines: DataFrame, group: list[str], order: str, most: int = MAX_CHUNK) -> DataFrame:
    """Adds part_no per group: before a separator line, a part of more than `most` characters ends; `order` is a number that differs within a group."""
    return with_part(text_lines, oversize_numbers(text_lines, group, order, most), [*group, order], "part_no")


def oversize_numbers(text_lines: DataFrame, group: list[str], order: str, most: int = MAX_CHUNK) -> DataFrame:
    """(group, order, _size, part_no) of oversize_parts, without the lines; _size: a line's length and its end's."""
    sized = text_lines.select(*group, order, (F.length("line") + 1).alias("_size"), T.separator(F.col("line")).alias("_may"))
    return scans.split(sized, group, order, most, "part_no", whole=False)


def with_part(rows: DataFrame, parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    parts = parts.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), out)
    return rows.join(parts, scans.both([(rows[k], parts[f"_{i}"]) for i, k in enumerate(keys)])).select(*(rows[c] for c in rows.columns), parts[out])


def chunks(lines: DataFrame, most: int = MAX_CHUNK) -> DataFrame:
    """(issue, species, banner_name, banner_line, chunk_no, part_no, carried_header, text): what goes to extraction, one row each."""
    # Sections are stored: their sizes, their texts and the lines of large ones are read from there, and the lines once.
    every = scans.stored(sections(lines).withColumns({"size": F.length("text"), "at": F.coalesce("header_line", "banner_line")}))
    every = packed(every, ["issue", "banner_line"], "at", "size", most)
    key = ["issue", "banner_line", "chunk_no"]
    head = F.struct("at", "text")
    small = every.filter(F.col("size") <= most).groupBy("species", "banner_name", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda x: x["text"]), "\n\n").alias("text"))
    small = small.withColumns({"part_no": F.lit(0).cast("long"), "carried_header": F.lit(None).cast("string")})
    large = every.filter(F.col("size") > most).select("species", "banner_name", *key, F.col("header.raw").alias("raw"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parts = oversize_parts(large, key, "pos", most).groupBy("species", "banner_name", *key, "raw", "part_no")
    parts = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    parts = parts.withColumn("carried_header", F.when(F.col("part_no") > 0, F.col("raw"))).drop("raw")
    return small.unionByName(parts)


def chunk_diagnostics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds headers, separators and timestamps per chunk, and whether it has none of them."""
    lines = F.split(text, "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    df = chunks.withColumns({"headers": count(lambda x: T.header(x).isNotNull()), "separators": count(T.separator), "timestamps": count(lambda x: T.strip(x).rlike(r"^\d{1,2}:\d{2}"))})
    return df.withColumn("barren", F.expr("headers = 0 and separators = 0 and timestamps = 0"))
