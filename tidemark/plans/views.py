"""Derived views over the base tables: the domain tables, by formulas that Spark and DuckDB evaluate alike (FIXTURES.md, part B), over all rows of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the two engines write differently.
TOKENS = {
    "spark": {
        "{HHMM}": "date_format(e.ts,'HH:mm')",
        "{SEQ6}": "select explode(sequence(0,5)) as k",
        "{LINES}": r"select source, doc_id, pos, line from documents lateral view posexplode(split(text,'\\n')) t as pos, line",
    },
    "duckdb": {
        "{HHMM}": "strftime(e.ts,'%H:%M')",
        "{SEQ6}": "select cast(unnest(range(0,6)) as int) as k",
        "{LINES}": "select source, doc_id, unnest(range(0,len(string_split(text,chr(10))))) as pos, unnest(string_split(text,chr(10))) as line from documents",
    },
}

BASE = ("nation", "part", "events", "documents")

VIEWS = {
    "v_names": r"""
select p_name, cast(row_number() over (order by p_name) as int) as rn from (select distinct p_name from part) d
""",
    "v_sightings": r"""
select e.event_id as id,
  cast(floor((extract(day from e.ts) - 1 + e.event_id % 3) / 7) as int) as newsletter_id,
  cast(e.ts as date) as sighting_date,
  case when e.event_id % 7 = 0 then null else {HHMM} end as sighting_time,
  case e.event_id % 9 when 0 then 'southern_resident' when 1 then 'northern_resident' when 2 then 'biggs'
    when 3 then 'gray' when 4 then 'humpback' when 5 then 'minke' when 6 then 'unidentified_orca'
    when 7 then 'unidentified_baleen' else 'other' end as species,
  case e.event_id % 5 when 0 then n.p_name when 1 then concat('  ', upper(n.p_name), ' ')
    when 2 then concat('north of ', n.p_name) when 3 then concat(left(n.p_name, 1), ' [', split_part(n.p_name, ' ', 1), '] ', split_part(n.p_name, ' ', 2))
    else concat('off ', n.p_name) end as location_raw,
  case when e.event_id % 6 = 5 then null else 46.9 + cast((e.event_id * 7919) % 31000 as double) / 10000.0 end as lat,
  case when e.event_id % 6 = 5 then null else -125.5 + cast((e.event_id * 104729) % 36000 as double) / 10000.0 end as lng,
  case e.event_id % 6 when 0 then 'gps' when 1 then 'gazetteer' when 2 then 'landmark' when 3 then 'ai'
    when 4 then 'manual' else 'unresolved' end as geo_method,
  (e.event_id % 6 in (3, 5) and e.event_id % 4 <> 0) as needs_review,
  case when e.event_id % 6 <> 3 then null when e.event_id % 4 = 1 then 'low' when e.event_id % 8 = 3 then 'medium' else 'high' end as ai_confidence,
  case when e.event_id % 3 = 0 then null else cast(floor(e.value) as int) end as sighting_count,
  concat('reporter ', cast(e.user_id as string)) as reporter
from events e join v_names n on n.rn = 1 + cast(e.event_id % 64 as int)
""",
    "v_newsletters": r"""
select newsletter_id as id, concat('Issue ', cast(newsletter_id as string), ' WS Report') as title,
  case when newsletter_id % 5 = 4 then 'failed' else 'complete' end as status,
  min(sighting_date) as date_from, max(sighting_date) as date_to, count(*) as sighting_count
from v_sightings group by newsletter_id
""",
    "v_gazetteer": r"""
select rn as id, p_name as name,
  case when rn % 8 = 1 then concat('off ', p_name, '|near ', p_name) else '' end as aliases_txt,
  47.0 + rn * 0.03 as lat, -123.5 + rn * 0.02 as lng
from v_names where rn % 4 = 1
""",
    "v_landmarks": r"""
select n.rn * 10 + c.dup as id, n.p_name as name,
  case n.rn % 12 when 0 then 'Bay' when 1 then 'Cape' when 2 then 'Island' when 3 then 'Bar' when 4 then 'Beach'
    when 5 then 'Cliff' when 6 then 'Pillar' when 7 then 'Gut' when 8 then 'Channel' when 9 then 'Sea'
    when 10 then 'Buoy' else 'Populated Place' end as feature_class,
  case when c.dup = 0 then 'Island' else 'Pierce' end as county,
  47.0 + n.rn * 0.03 + c.dup * 0.5 as lat, -123.5 + n.rn * 0.02 - c.dup * 0.4 as lng
from v_names n cross join (select 0 as dup union all select 1 as dup) c where c.dup = 0 or n.rn % 5 = 0
""",
    "v_edges": r"""
with ring as (
  select n_nationkey as poly_id, k, 47.0 + 0.11 * n_nationkey + 0.05 * sin(k * 1.0471975511965976) as lat,
    -125.4 + 0.13 * n_nationkey + 0.06 * cos(k * 1.0471975511965976) as lng
  from nation cross join ({SEQ6}) t)
select a.poly_id, a.k, a.lng as x1, a.lat as y1, b.lng as x2, b.lat as y2
from ring a join ring b on a.poly_id = b.poly_id and b.k = (a.k + 1) % 6
""",
    "v_answers": r"""
with s as (select location_raw, cast(row_number() over (order by location_raw) as int) as rn
  from (select distinct location_raw from v_sightings where geo_method in ('ai', 'unresolved')) d)
select a.attempt, s.location_raw as input, s.rn as pos,
  case when s.rn % 11 = 0 then 'none' when s.rn % 3 = 0 then 'low' when s.rn % 3 = 1 then 'medium' else 'high' end as confidence,
  case when s.rn % 11 = 0 then null else 47.0 + 0.11 * (s.rn % 25) + 0.013 * ((s.rn + a.attempt) % 6) end as lat,
  case when s.rn % 11 = 0 then null else -125.4 + 0.13 * (s.rn % 25) + 0.011 * ((s.rn * a.attempt) % 7) end as lng
from s cross join (select 1 as attempt union all select 2 as attempt) a
""",
    "v_gps_text": r"""
select event_id as id, case event_id % 8
  when 0 then concat('near [approx. 48.', lpad(cast(event_id * 7919 % 1000000 as string), 6, '0'), ', -123.', lpad(cast(event_id * 104729 % 1000000 as string), 6, '0'), '].')
  when 1 then concat('48.', lpad(cast(event_id % 100000 as string), 5, '0'), 'N 122.', lpad(cast(event_id % 100000 as string), 5, '0'))
  when 2 then concat('47.', lpad(cast(event_id % 100000 as string), 5, '0'), '° N, 122.', lpad(cast(event_id % 100000 as string), 5, '0'), '° W')
  when 3 then concat('47°', cast(event_id % 60 as string), '''15.1"N 122°', cast(event_id % 60 as string), '''20.7"W')
  when 4 then concat('N 48d', lpad(cast(event_id % 60 as string), 2, '0'), '.258'', W 122d17.825''')
  when 5 then '12.3456, 56.7890'
  when 6 then 'Southeast side of island, 3.5, 2.1'
  else '17:20 - leaving a milling whale' end as txt
from events
""",
    "v_issue_lines": r"""
with d as (select source, doc_id, cast(row_number() over (partition by source order by doc_id) - 1 as int) as r from documents),
raw as (
  select source, -4 as o1, 0 as o2, concat('Jul ', cast(10 + length(source) as string), ', 2026') as line from (select distinct source from documents) x
  union all select source, -3, 0, 'SUMMARY' from (select distinct source from documents) x
  union all select source, -2, 0, 'nothing here' from (select distinct source from documents) x
  union all select source, -1, 0, 'ANNOUNCEMENTS' from (select distinct source from documents) x
  union all select source, r, -2, case cast(floor(r / 10) as int) % 5 when 0 then 'GRAY WHALES' when 1 then 'PORPOISES' when 2 then 'MINKE WHALES'
    when 3 then 'HUMPBACK WHALES (all)' else 'DOLPHINS' end from d where r % 10 = 0
  union all select source, r, -1, concat('Thu, Jul ', cast(1 + r % 9 as string), ' - Puget Sound', case when r % 2 = 0 then ' (T65A5)' else '' end) from d where r % 5 = 0
  union all select d.source, d.r, cast(l.pos as int), l.line from d join ({LINES}) l on l.doc_id = d.doc_id
  union all select source, r, 1000000, '-' from d
  union all select source, 1000000, 0, 'ABOUT ORCA NETWORK' from (select distinct source from documents) x)
select source as issue, cast(row_number() over (partition by source order by o1, o2) - 1 as int) as line_no, line from raw
""",
    "v_model_text": r"""
select event_id as id, case event_id % 6
  when 0 then concat('[{"input":"a', cast(event_id as string), '","species":"biggs","lat":48.1,"lng":-122.5}]')
  when 1 then concat('```json', chr(10), '[{"input":"b","species":"gray","lat":48.2,"lng":-122.6}]', chr(10), '```')
  when 2 then '[{"input":"c","species":"minke","lat":48.3,"lng":-122.7},{"input":"d","lat":48'
  when 3 then concat('[{"input":"mid', chr(10), 'channel","species":"humpback","lat":48.4,"lng":-122.8}]')
  when 4 then 'Wonn Rd [Road]: placed. [{"input":"e [Road]","species":"other","lat":48.5,"lng":-122.9}]'
  else '[{"input":"f","species":"narwhal","lat":48.6,"lng":-123.0}]' end as txt
from events
""",
    "v_calls": r"""
select doc_id as call_no, case when doc_id % 3 = 0 then 'geocode' else 'extract' end as stage,
  cast(floor(n_chars / 4) as bigint) as input_tokens, cast(floor(n_chars / 10) as bigint) as output_tokens
from documents
""",
}

NEEDS = {
    "v_names": ["part"], "v_sightings": ["events", "v_names"], "v_newsletters": ["v_sightings"], "v_gazetteer": ["v_names"],
    "v_landmarks": ["v_names"], "v_edges": ["nation"], "v_answers": ["v_sightings"], "v_gps_text": ["events"],
    "v_issue_lines": ["documents"], "v_model_text": ["events"], "v_calls": ["documents"],
}


def chain(names: list[str]) -> list[str]:
    """The views and tables that these need, each after what it needs itself."""
    out: list[str] = []
    for name in names:
        for x in [*chain(NEEDS.get(name, [])), name]:
            if x not in out:
                out.append(x)
    return out


def with_clause(engine: str, names: list[str], sf_dir: str = "") -> str:
    """WITH ... for a query over these views; in Spark, of the base tables too."""
    parts = []
    for name in chain(names):
        if name in VIEWS:
            text = VIEWS[name]
            for token, meaning in TOKENS[engine].items():
                text = text.replace(token, meaning)
            parts.append(f"{name} as ({text})")
        elif engine == "spark":
            parts.append(f"{name} as (select * from parquet.`{sf_dir}/{name}.parquet`)")
    return "with " + ",\n".join(parts) + "\n" if parts else ""


#: Numbers of documents, and documents of an issue, whose rows are numbered by one task.
ID_RANGE, DOCUMENT_RANGE = 16_384, 256


def placed(rows: DataFrame, order: str, per: int, out: str, size: Column) -> DataFrame:
    """Adds the sum of `size` over the rows before, per source and by `order`: ranges of its numbers are summed apart, and what comes before a range is added."""
    of = rows.withColumns({"_range": F.floor(F.col(order) / per), "_size": size.cast("long")})
    up_to = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = of.groupBy("source", "_range").agg(F.sum("_size").alias("_n"))
    base = base.select(F.col("source").alias("_source"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = of.withColumn("_place", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(base, F.col("source").eqNullSafe(F.col("_source")) & F.col("_range").eqNullSafe(F.col("_of")))
    return both.withColumn(out, F.col("_base") + F.col("_place")).drop("_range", "_size", "_place", "_source", "_of", "_base")


#: What the view's SQL writes as the place of an issue's end among its documents, and of a document's end among its lines.
END = 1_000_000


def issue_lines(documents: DataFrame) -> DataFrame:
    """v_issue_lines, whose SQL numbers all lines of an issue in one task, with the same numbers: documents are placed by how many
    lines they have, and a line's number is its document's place and its own within; lines are not sorted."""
    n_lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0)
    d = placed(documents.select("source", "doc_id"), "doc_id", ID_RANGE, "r", F.lit(1)).withColumn("r", F.col("r").cast("int"))
    # Texts of one doc_id are all lines of each of its documents, one line of each in turn; the longest comes first.
    texts = documents.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(n_lines))).alias("sizes"))
    up_to = lambda n: F.aggregate("sizes", F.lit(0), lambda x, y: x + F.least(y, n))
    marks = F.expr("case when r % 10 = 0 then 1 else 0 end + case when r % 5 = 0 then 1 else 0 end")
    d = d.join(texts, "doc_id", "left").withColumn("sizes", F.coalesce("sizes", F.array().cast("array<int>"))).withColumns({"n": F.aggregate("sizes", F.lit(0), lambda x, y: x + y), "marks": marks})
    d = placed(d, "r", DOCUMENT_RANGE, "at", F.col("n") + F.col("marks") + 1)
    # Four lines are before all documents; the issue's end is before the lines of document END, a document's end before its line END.
    d = d.withColumns({"at": F.col("at") + 4 + F.when(F.col("r") > END, 1).otherwise(0), "first": F.col("at") + 4 + F.col("marks") + F.when(F.col("r") >= END, 1).otherwise(0)})
    ends = documents.select("source").distinct().alias("s").join(
        d.groupBy(F.col("source").alias("_source")).agg(F.sum(F.when(F.col("r") < END, F.col("n") + F.col("marks") + 1).when(F.col("r") == END, F.col("marks")).otherwise(0)).alias("before")), F.col("source").eqNullSafe(F.col("_source")))
    line = lambda no, x: f"struct(cast({no} as int) as line_no, {x} as line)"
    few = [line(0, "concat('Jul ', cast(10 + length(source) as string), ', 2026')"), line(1, "'SUMMARY'"), line(2, "'nothing here'"), line(3, "'ANNOUNCEMENTS'"), line("before + 4", "'ABOUT ORCA NETWORK'")]
    banner = "case cast(floor(r / 10) as int) % 5 when 0 then 'GRAY WHALES' when 1 then 'PORPOISES' when 2 then 'MINKE WHALES' when 3 then 'HUMPBACK WHALES (all)' else 'DOLPHINS' end"
    header = "concat('Thu, Jul ', cast(1 + r % 9 as string), ' - Puget Sound', case when r % 2 = 0 then ' (T65A5)' else '' end)"
    some = [f"case when r % 10 = 0 then {line('at', banner)} end", f"case when r % 5 = 0 then {line('at + marks - 1', header)} end", line("last", "'-'")]
    few = ends.select("source", F.expr(f"inline(array({', '.join(few)}))"))
    some = d.withColumn("last", F.col("first") + up_to(F.lit(END))).select("source", F.expr(f"inline(filter(array({', '.join(some)}), x -> x is not null))"))
    # Which of a doc_id's texts it is costs no shuffle: they are met by doc_id.
    nth = Window.partitionBy("doc_id").orderBy(F.desc("_n"))
    one = documents.select("doc_id", "text", n_lines.alias("_n")).withColumn("nth", F.row_number().over(nth) - 1).drop("_n")
    each = d.select("doc_id", "source", "first", "sizes").join(one, "doc_id").select("source", "first", "sizes", "nth", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    inside = F.when(F.size("sizes") == 1, F.col("pos")).otherwise(up_to(F.col("pos")) + F.col("nth"))
    each = each.select("source", (F.col("first") + inside + F.when(F.col("pos") >= END, 1).otherwise(0)).cast("int").alias("line_no"), "line")
    return few.unionByName(some).unionByName(each).withColumnRenamed("source", "issue")


class Views:
    """The views of one data folder as DataFrames: Views(spark, sf_dir).sightings."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        if view == "v_issue_lines":
            return issue_lines(self.spark.read.parquet(f"{self.sf_dir}/documents.parquet"))
        return self.spark.sql(with_clause("spark", [view], self.sf_dir) + f"select * from {view}")

    def sql(self, query: str, *names: str, **args) -> DataFrame:
        """A query over the named views, with bound parameters."""
        return self.spark.sql(with_clause("spark", [f"v_{n}" for n in names], self.sf_dir) + query, args=args or None)
