"""Every query by name, with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geo, records, text, vocab
from tidemark.operators import changes, geometry, issues, measures, places, reads, scans
from tidemark.plans.store import Change, Store
from tidemark.plans.views import Views, with_clause

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Registers a function of Views under its name; views: those that the SQL needs."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_clause("duckdb", [f"v_{x}" for x in views.split()]) + sql
        return f

    return keep


def aliased(gazetteer: DataFrame) -> DataFrame:
    """The view has aliases as one text."""
    none = F.array().cast("array<string>")
    return gazetteer.withColumns({"aliases": F.when(F.col("aliases_txt") == "", none).otherwise(F.split("aliases_txt", r"\|")), "lat": F.col("lat").cast("double"), "lng": F.col("lng").cast("double")})


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in columns})


def points(sightings: DataFrame) -> DataFrame:
    return sightings.select(F.col("id").alias("pid"), "lat", "lng")


SHOWN = ["id", "sighting_date", "sighting_time", "species", "location_raw", "lat", "lng", "geo_method"]
SHOWN_SQL = "id, sighting_date, sighting_time, species, location_raw, round(lat, 6) as lat, round(lng, 6) as lng, geo_method"
BY_DATE = "order by sighting_date desc, sighting_time desc nulls last, id"


def shown(df: DataFrame) -> DataFrame:
    return rounded(df.select(*SHOWN), "lat", "lng")


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return shown(reads.paged(df, reads.review_order(None, False), limit, offset))


# ---- reads

@query("sightings newsletters", f"select {SHOWN_SQL} from v_sightings where newsletter_id = (select id from v_newsletters where status = 'complete' order by date_to desc, id desc limit 1) and geo_method <> 'unresolved' {BY_DATE} limit 500")
def sightings_latest(v):
    return page(reads.filtered(v.sightings, issue="latest", newsletters=v.newsletters, placed_only=True), 500)


@query("sightings", f"select {SHOWN_SQL} from v_sightings where sighting_date between date '2024-01-05' and date '2024-01-09' {BY_DATE} limit 10000")
def sightings_date_range(v):
    return page(reads.filtered(v.sightings, date_from="2024-01-05", date_to="2024-01-09"), 10_000)


@query("sightings", f"select {SHOWN_SQL} from v_sightings where species in ('biggs', 'gray') {BY_DATE} limit 1000 offset 50")
def sightings_species(v):
    return page(reads.filtered(v.sightings, species=reads.listed("biggs, gray")), 1_000, 50)


@query("sightings", f"select {SHOWN_SQL} from v_sightings where false")
def sightings_species_empty(v):
    return page(reads.filtered(v.sightings, species=reads.listed("")), 100)


@query("sightings", f"select {SHOWN_SQL} from v_sightings where lng between -124.5 and -122.5 and lat between 47.5 and 49.0 {BY_DATE} limit 5000")
def sightings_bbox(v):
    return page(reads.filtered(v.sightings, bbox=reads.bounding_box("-124.5,47.5,-122.5,49")), 0)


def told(sightings: DataFrame) -> DataFrame:
    """With the columns that the view lacks."""
    return sightings.withColumns({"raw_excerpt": F.concat(F.lit("about "), "location_raw"), "ai_reasoning": F.concat(F.lit("said "), "ai_confidence")})


@query("sightings", "select id, species, cast(null as varchar) as raw_excerpt, cast(null as varchar) as reporter, cast(null as varchar) as ai_reasoning, cast(null as varchar) as ai_confidence, cast(sighting_date as varchar) as date_text from v_sightings")
def sightings_public_masked(v):
    return reads.masked(told(v.sightings), admin=False).select("id", "species", *reads.WITHHELD, F.col("sighting_date").cast("string").alias("date_text"))


@query("sightings", "select id, species, 'about ' || location_raw as raw_excerpt, reporter, 'said ' || ai_confidence as ai_reasoning, ai_confidence, cast(sighting_date as varchar) as date_text from v_sightings")
def sightings_admin(v):
    return reads.masked(told(v.sightings), admin=True).select("id", "species", *reads.WITHHELD, F.col("sighting_date").cast("string").alias("date_text"))


@query("sightings", "select * replace (round(lat, 6) as lat, round(lng, 6) as lng) from v_sightings where id = 42")
def single_sighting(v):
    return rounded(v.sightings.filter("id = 42"), "lat", "lng")


@query("sightings", "select count(*) as n, min(cast(sighting_date as varchar)) as first_date, max(cast(sighting_date as varchar)) as last_date from v_sightings where cast(sighting_date as varchar) between '2024-01-03' and '2024-01-20' and species in ('southern_resident', 'northern_resident', 'biggs', 'unidentified_orca')")
def client_filter(v):
    orcas = [k for k, _, orca in vocab.SPECIES if orca]
    kept = v.sightings.withColumn("d", F.col("sighting_date").cast("string")).filter(F.col("d").between("2024-01-03", "2024-01-20") & F.col("species").isin(orcas))
    return kept.agg(F.count("*").alias("n"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))


@query("sightings", f"select {SHOWN_SQL}, rank from (select *, 0 as rank from v_sightings where id = 77 union all (select *, 1 as rank from v_sightings where needs_review and id <> 77 {BY_DATE} limit 50)) x")
def opened_row_first(v):
    opened = v.sightings.filter("id = 77").withColumn("rank", F.lit(0))
    queue = reads.paged(v.sightings.filter("needs_review and id <> 77"), reads.review_order(None, False), 50).withColumn("rank", F.lit(1))
    return rounded(opened.unionByName(queue).select(*SHOWN, "rank"), "lat", "lng")


@query("sightings", "select min(sighting_date) as first_date, max(sighting_date) as last_date from v_sightings")
def archive_span(v):
    return reads.archive_span(v.sightings)


@query("newsletters", "select id, title, date_from, date_to, sighting_count from v_newsletters where status = 'complete'")
def newsletters_list(v):
    return reads.newsletters_list(v.newsletters)


ZOOM_SQL = "case " + " ".join(f"when feature_class = '{c}' then {z}" for c, z in vocab.LABEL_ZOOM) + " end"
PUBLIC_SQL = f"""select name, feature_class, lat, lng, {ZOOM_SQL} as min_zoom from (
  select name, feature_class, round(cast(lat as double), 6) as lat, round(cast(lng as double), 6) as lng from v_landmarks
  where feature_class in ({", ".join(f"'{c}'" for c in vocab.PUBLIC_CLASSES)}) and lower(name) not in (select lower(name) from v_gazetteer)
  union all select name, 'Verified', round(cast(lat as double), 6), round(cast(lng as double), 6) from v_gazetteer where name not in ({", ".join(f"'{x}'" for x in vocab.UNPUBLISHED)})) x"""


def verified_places(v) -> DataFrame:
    """The view's places, and the entries that are not published."""
    more = v.gazetteer.limit(1).select((F.col("id") + 1_000).alias("id"), F.explode(F.array(*map(F.lit, vocab.UNPUBLISHED))).alias("name"), "aliases_txt", "lat", "lng")
    return v.gazetteer.unionByName(more)


@query("landmarks gazetteer", PUBLIC_SQL)
def landmarks_public(v):
    return rounded(reads.public_landmarks(v.landmarks, verified_places(v)), "lat", "lng")


@query("landmarks gazetteer", f"with f as ({PUBLIC_SQL}) select name, 'Feature' as kind, 'Point' as geometry, lng as x, lat as y from f".replace("with f as", ", f as", 1))
def landmark_features(v):
    made = reads.features(rounded(reads.public_landmarks(v.landmarks, verified_places(v)), "lat", "lng"))
    f = F.from_json("feature", "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<name: string>")
    return made.select(f.alias("f")).select(F.col("f.properties.name").alias("name"), F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


@query("sightings", "select id, 'Point' as geometry, round(lng, 6) as x, round(lat, 6) as y, species, 'id,species,reporter' as properties from (select * from v_sightings order by id limit 300) p where lat is not null and lng is not null")
def geojson_features(v):
    page = reads.paged(told(v.sightings), [F.col("id")], 300)
    made = reads.features(rounded(page.select("id", "species", "lat", "lng", *reads.WITHHELD), "lat", "lng"))
    f = F.from_json("feature", "geometry struct<type: string, coordinates: array<double>>, properties struct<id: bigint, species: string>")
    made = made.select(f.alias("f"), F.array_join(F.json_object_keys(F.get_json_object("feature", "$.properties")), ",").alias("properties"))
    return made.select("f.properties.id", F.col("f.geometry.type").alias("geometry"), F.round(F.col("f.geometry.coordinates")[0], 6).alias("x"), F.round(F.col("f.geometry.coordinates")[1], 6).alias("y"), "f.properties.species", "properties")


NORM = "trim(regexp_replace(lower({}), '[ \\t]+', ' ', 'g'))"


@query("gazetteer sightings", f"select id, name, (select count(*) from v_sightings s where {NORM.format('s.location_raw')} = lower(g.name)) as sightings from v_gazetteer g")
def gazetteer_counts(v):
    return reads.gazetteer_counts(v.gazetteer, v.sightings, text.norm(F.col("location_raw")))


@query("gazetteer", "select id, name, case when 'near ' || name like '%near%a%' and aliases_txt <> '' then 'near ' || name end as alias from v_gazetteer where lower(name) like '%near%' or aliases_txt like '%near %'")
def gazetteer_search(v):
    return reads.gazetteer_search(aliased(v.gazetteer), text.norm(F.lit("  NEAR ")))


@query("gazetteer landmarks", "select l.id, l.name from v_landmarks l where lower(l.name) = (select lower(name) from v_gazetteer order by id limit 1) order by l.id limit 5")
def gnis_clash(v):
    first = v.gazetteer.orderBy("id").limit(1).select(F.lower("name").alias("wanted"))
    return v.landmarks.join(F.broadcast(first), F.lower("name") == F.col("wanted")).select("id", "name").orderBy("id").limit(5)


@query("newsletters", "select title from v_newsletters where status in ('complete', 'processing') and title in ('Issue 1 WS Report', 'Issue 4 WS Report')")
def duplicate_guard(v):
    asked = v.spark.range(1).select(F.explode(F.array(F.lit("Issue 1 WS Report"), F.lit("Issue 4 WS Report"))).alias("title"))
    return v.newsletters.filter(F.col("status").isin("complete", "processing")).join(asked, "title", "left_semi").select("title")


# ---- places

@query("sightings gazetteer", f"""select location_raw, min(rk) % 100000 as gazetteer_id from (
  select s.location_raw, k.rank * 100000 + k.id as rk from (select distinct location_raw from v_sightings) s join (
    select id, 0 as rank, {NORM.format('name')} as k from v_gazetteer union all
    select id, 1, unnest(string_split(aliases_txt, '|')) from v_gazetteer where aliases_txt <> '') k on k.k = {NORM.format('s.location_raw')}) x group by location_raw""")
def resolve_gazetteer(v):
    return places.by_gazetteer(v.sightings, aliased(v.gazetteer)).withColumn("gazetteer_id", F.col("gazetteer_id").cast("long"))


WATER_SQL = ", ".join(f"'{c}'" for c in vocab.WATER_CLASSES)


@query("sightings landmarks", f"""select s.location_raw, u.id as landmark_id from (select distinct location_raw from v_sightings) s
  join (select {NORM.format('name')} as k, min(id) as id from v_landmarks where feature_class in ({WATER_SQL}) group by 1 having count(*) = 1) u on u.k = {NORM.format('s.location_raw')}""")
def resolve_landmark(v):
    return places.by_landmark(v.sightings, v.landmarks)


@query("landmarks", f"select {NORM.format('name')} as name, count(*) as features from v_landmarks group by 1 having count(*) > 1")
def ambiguous_landmarks(v):
    return places.ambiguous(v.landmarks)


POOL_SQL = f"""select 0 as source, cast(id as bigint) as id, name from v_gazetteer
  union all select 1, id, unnest(string_split(aliases_txt, '|')) from v_gazetteer where aliases_txt <> ''
  union all select 2, id, name from v_landmarks where {NORM.format('name')} not in (select {NORM.format('name')} from v_gazetteer)"""


@query("gazetteer landmarks", POOL_SQL)
def anchor_pool(v):
    return places.anchor_pool(aliased(v.gazetteer), v.landmarks)


GENERIC_SQL = ", ".join(f"'{x}'" for x in vocab.GENERIC_NAMES)
READINGS_SQL = r"""select location_raw, lower(r) as reading from (select location_raw, unnest([location_raw,
    regexp_replace(location_raw, '\S+\s*\[([^\]]+)\]', '\1', 'g'), regexp_replace(location_raw, '\s*\[[^\]]*\]', '', 'g')]) as r
    from (select distinct location_raw from v_sightings) d) u"""
HITS_SQL = f"""select distinct {{group}}, p.source, p.id, p.name from ({READINGS_SQL}) r {{join}}
    join ({POOL_SQL}) p on contains(r.reading, lower(p.name)) where length(p.name) >= 4 and lower(p.name) not in ({GENERIC_SQL})"""


@query("sightings gazetteer landmarks", f"""select location_raw, source, id, name, place from (
  select *, row_number() over (partition by location_raw order by length(name) desc, source, id, name) as place from ({HITS_SQL.format(group='r.location_raw', join='')}) h) n where place <= 6""")
def anchors_per_string(v):
    return places.anchors(v.sightings.select("location_raw"), places.anchor_pool(aliased(v.gazetteer), v.landmarks))


BATCHES_SQL = "select location_raw, cast(floor((row_number() over (order by min(id)) - 1) / 60) as bigint) as batch_no from v_sightings group by location_raw"


@query("sightings", BATCHES_SQL)
def batches_of_60(v):
    return places.batches(v.sightings, vocab.BATCH)


@query("sightings gazetteer landmarks", f"""select batch_no, source, id, name, place from (
  select *, row_number() over (partition by batch_no order by length(name) desc, source, id, name) as place
  from ({HITS_SQL.format(group='b.batch_no', join=f'join ({BATCHES_SQL}) b on b.location_raw = r.location_raw')}) h) n where place <= 40""")
def anchors_batch(v):
    strings = places.batches(v.sightings, vocab.BATCH)
    return places.anchors(strings, places.anchor_pool(aliased(v.gazetteer), v.landmarks), vocab.MOST_BATCH_ANCHORS, "batch_no")


@query("sightings gazetteer landmarks", f"""select s.location_raw, coalesce(string_agg(n.name, '; ' order by n.place), '') as anchors from (select distinct location_raw from v_sightings) s
  left join (select * from (select *, row_number() over (partition by location_raw order by length(name) desc, source, id, name) as place
  from ({HITS_SQL.format(group='r.location_raw', join='')}) h) n where place <= 6) n using (location_raw) group by s.location_raw""")
def geocode_payload(v):
    strings = v.sightings.select("location_raw").distinct()
    found = places.anchors(strings, places.anchor_pool(aliased(v.gazetteer), v.landmarks)).groupBy("location_raw").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("a"))
    payload = strings.join(found, "location_raw", "left").select("location_raw", F.to_json(F.struct(F.col("location_raw").alias("input"), F.col("a.name").alias("anchors"))).alias("payload"))
    return payload.select("location_raw", F.coalesce(F.array_join(F.from_json("payload", "anchors array<string>")["anchors"], "; "), F.lit("")).alias("anchors"))


# ---- geometry

CROSSING = "sum(case when (e.y1 > p.lat) <> (e.y2 > p.lat) and p.lng < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 then 1 else 0 end) % 2 = 1"


def wet_sql(points: str) -> str:
    return f"select distinct id from (select p.id, e.poly_id from ({points}) p, v_edges e where p.lat is not null group by p.id, e.poly_id having {CROSSING}) w"


PLACED = "select id, lat, lng from v_sightings"


def near_sql(points: str) -> str:
    """The nearest edge point of each point; ties by polygon and edge."""
    return f"""select id, d, y1 + t * (y2 - y1) as near_lat, x1 + t * (x2 - x1) as near_lng, poly_id from (
      select *, row_number() over (partition by id order by d, poly_id, k) as rn from (
        select *, sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (by_ - ay), 2)) as d from (
          select *, least(1.0, greatest(0.0, case when (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) = 0 then 0.0 else -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) end)) as t from (
            select p.id, e.*, (e.x1 - p.lng) * {geo.DEGREE} * cos(radians(p.lat)) as ax, (e.y1 - p.lat) * {geo.DEGREE} as ay, (e.x2 - p.lng) * {geo.DEGREE} * cos(radians(p.lat)) as bx, (e.y2 - p.lat) * {geo.DEGREE} as by_
            from ({points}) p, v_edges e where p.lat is not null) a) b) c) n where rn = 1"""


@query("sightings edges", f"select s.id, w.id is not null as wet from v_sightings s left join ({wet_sql(PLACED)}) w on w.id = s.id where s.lat is not null")
def in_water(v):
    wet = geometry.covered(points(v.sightings), v.edges).select(F.col("pid").alias("id"), F.lit(True).alias("w"))
    return v.sightings.filter("lat is not null").join(wet, "id", "left").select("id", F.col("w").isNotNull().alias("wet"))


@query("sightings edges", f"select id from v_sightings where lat is not null and id not in ({wet_sql(PLACED)})")
def dry_points(v):
    wet = geometry.covered(points(v.sightings), v.edges)
    return v.sightings.filter("lat is not null").join(wet, F.col("id") == F.col("pid"), "left_anti").select("id")


@query("sightings edges", f"select id, cast(round(d) as bigint) as metres, round(near_lat, 5) as near_lat, round(near_lng, 5) as near_lng from ({near_sql(PLACED)}) n")
def nearest_water(v):
    near = geometry.nearest(points(v.sightings), v.edges)
    return near.select(F.col("pid").alias("id"), F.round("metres").cast("long").alias("metres"), F.round("near_lat", 5).alias("near_lat"), F.round("near_lng", 5).alias("near_lng"))


@query("edges", f"select poly_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2 * cos(radians(avg(y1))) * {geo.DEGREE * geo.DEGREE} / 1e6, 3) as km2 from v_edges group by poly_id")
def water_area(v):
    return geometry.areas(v.edges).withColumn("km2", F.round("km2", 3))


COMPASS_SQL = "[" + ", ".join(f"'{c}'" for c in geo.COMPASS) + "]"


@query("sightings edges", f"""select id, {COMPASS_SQL}[1 + cast(floor(((degrees(atan2((near_lng - lng) * cos(radians(lat)), near_lat - lat)) + 360) - 360 * floor((degrees(atan2((near_lng - lng) * cos(radians(lat)), near_lat - lat)) + 360) / 360)) / 45 + 0.5) as int) % 8] as way
  from ({near_sql(PLACED)}) n join v_sightings s using (id) where id not in ({wet_sql(PLACED)})""")
def bearing_to_water(v):
    wet = geometry.covered(points(v.sightings), v.edges)
    dry = points(v.sightings).join(wet, "pid", "left_anti")
    near = geometry.nearest(dry, v.edges).join(dry, "pid")
    return near.select(F.col("pid").alias("id"), geo.bearing(F.col("lat"), F.col("lng"), F.col("near_lat"), F.col("near_lng")).alias("way"))


@query("sightings edges", f"""select s.id, case when w.id is not null then 0 else cast(round(n.d) as bigint) end as water_m from
  (select * from v_sightings where needs_review) s left join ({wet_sql(PLACED)}) w on w.id = s.id left join ({near_sql(PLACED)}) n on n.id = s.id
  order by case when (case when w.id is not null then 0 else round(n.d) end) between 100 and 5000 then (case when w.id is not null then 0 else round(n.d) end) end desc nulls last, sighting_date desc, sighting_time desc nulls last, s.id limit 200""")
def review_by_distance(v):
    return review(v, False)


@query("sightings edges", f"""select s.id, case when w.id is not null then 0 else cast(round(n.d) as bigint) end as water_m from
  (select * from v_sightings where needs_review) s left join ({wet_sql(PLACED)}) w on w.id = s.id left join ({near_sql(PLACED)}) n on n.id = s.id
  order by case ai_confidence when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end,
  case when (case when w.id is not null then 0 else round(n.d) end) between 100 and 5000 then (case when w.id is not null then 0 else round(n.d) end) end desc nulls last, sighting_date desc, sighting_time desc nulls last, s.id limit 200""")
def review_by_confidence(v):
    return review(v, True)


def review(v, by_confidence: bool) -> DataFrame:
    """The distance is worked out for flagged rows with a position only; the others have none."""
    flagged = reads.filtered(v.sightings, needs_review=True)
    metres = geometry.water_distance(points(flagged), v.edges).withColumnRenamed("metres", "water_m")
    df = flagged.join(metres, F.col("id") == F.col("pid"), "left")
    return reads.paged(df, reads.review_order(F.col("water_m"), by_confidence), 200).select("id", "water_m")


ANSWERS = "select pos as id, cast(lat as double) as lat, cast(lng as double) as lng from v_answers where attempt = {}"


@query("answers", "select attempt, pos from v_answers where confidence <> 'none' and lat > 45 and lat < 52 and lng > -130 and lng < -120")
def placeable_filter(v):
    return v.answers.filter(geo.placeable(F.col("confidence"), F.col("lat").cast("double"), F.col("lng").cast("double"))).select("attempt", "pos")


def placed(v, attempt: int) -> DataFrame:
    return v.answers.filter(F.col("attempt") == attempt).select(F.col("pos").alias("pid"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))


@query("answers edges", f"""with m1 as (select n.id, case when w.id is not null then 0 else round(n.d) end as m from ({near_sql(ANSWERS.format(1))}) n left join ({wet_sql(ANSWERS.format(1))}) w on w.id = n.id),
  m2 as (select n.id, case when w.id is not null then 0 else round(n.d) end as m from ({near_sql(ANSWERS.format(2))}) n left join ({wet_sql(ANSWERS.format(2))}) w on w.id = n.id)
  select m1.id as pos, m1.m < 0 or (m1.m > 0 and m2.m < m1.m) as retried, cast(case when m1.m > 0 and m2.m < m1.m then m2.m else m1.m end as bigint) as metres from m1 join m2 using (id)""".replace("with m1", ", m1", 1))
def retry_accept_if_better(v):
    # Both attempts are measured in one pass; the second counts only where the first lies on land.
    both = placed(v, 1).withColumn("pid", F.col("pid") * 2).unionByName(placed(v, 2).withColumn("pid", F.col("pid") * 2 + 1))
    metres = geometry.water_distance(both, v.edges).groupBy(F.floor(F.col("pid") / 2).cast("int").alias("pos"))
    pair = metres.agg(F.max(F.when(F.col("pid") % 2 == 0, F.col("metres"))).alias("was"), F.max(F.when(F.col("pid") % 2 == 1, F.col("metres"))).alias("now"))
    better = F.coalesce((F.col("was") > 0) & (F.col("now") < F.col("was")), F.lit(False))
    return pair.select("pos", better.alias("retried"), F.when(better, F.col("now")).otherwise(F.col("was")).alias("metres"))


@query("answers edges", f"select a.pos, not (a.confidence <> 'none' and w.id is not null) as needs_review from v_answers a left join ({wet_sql(ANSWERS.format(1))}) w on w.id = a.pos where a.attempt = 1")
def review_gate(v):
    wet = geometry.covered(placed(v, 1), v.edges).withColumn("wet", F.lit(True))
    first = v.answers.filter("attempt = 1").join(wet, F.col("pos") == F.col("pid"), "left")
    return first.select("pos", (~(F.col("wet").isNotNull() & (F.col("confidence") != "none"))).alias("needs_review"))


KM = "6371.0 * sqrt(power(radians(b.lng - a.lng) * cos(radians(a.lat)), 2) + power(radians(b.lat - a.lat), 2))"
MOVED_SQL = f"select a.id, {KM} as km from ({ANSWERS.format(1)}) a join ({ANSWERS.format(2)}) b on a.id = b.id where a.lat is not null and b.lat is not null"


@query("answers", f"select count(*) as n, round(list_sort(list(km))[1 + cast(floor(count(*) / 2) as int)], 6) as median_km, round(max(km), 6) as most_km from ({MOVED_SQL}) m")
def movement_km(v):
    a, b = placed(v, 1).filter("lat is not null"), placed(v, 2).filter("lat is not null").select("pid", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    km = a.join(b, "pid").select("pid", geo.km_between(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("km"))
    return rounded(measures.median_and_most(km, "km", "pid"), "median_km", "most_km")


STATE = "case when {0}.lat is null then 'unplaced' when {1}.id is not null then 'wet' else 'dry' end"


@query("answers edges", f"""select {STATE.format('a', 'wa')} as was, {STATE.format('b', 'wb')} as now, count(*) as n from ({ANSWERS.format(1)}) a join ({ANSWERS.format(2)}) b on a.id = b.id
  left join ({wet_sql(ANSWERS.format(1))}) wa on wa.id = a.id left join ({wet_sql(ANSWERS.format(2))}) wb on wb.id = b.id group by 1, 2""")
def transition_matrix(v):
    def state(attempt):
        p = placed(v, attempt)
        wet = geometry.covered(p, v.edges).withColumn("in", F.lit(True))
        return p.join(wet, "pid", "left").select(F.col("pid").alias("key"), F.when(F.col("lat").isNotNull(), F.col("in").isNotNull()).alias("wet"))

    return measures.transitions(state(1), state(2))


# ---- measures

@query("sightings", "select geo_method, count(*) as n, count(*) filter (needs_review) as flagged from v_sightings group by geo_method")
def geo_method_summary(v):
    return measures.by_method(v.sightings)


@query("sightings edges", f"select s.geo_method, count(*) as n, count(w.id) as wet from v_sightings s left join ({wet_sql(PLACED)}) w on w.id = s.id where s.lat is not null group by s.geo_method")
def wet_share(v):
    wet = geometry.covered(points(v.sightings), v.edges)
    return v.sightings.filter("lat is not null").join(wet, F.col("id") == F.col("pid"), "left").groupBy("geo_method").agg(F.count("*").alias("n"), F.count("pid").alias("wet"))


@query("sightings", "select location_raw, count(*) as n from v_sightings where needs_review group by location_raw")
def flagged_strings(v):
    return v.sightings.filter("needs_review").groupBy("location_raw").agg(F.count("*").alias("n"))


@query("sightings", "select count(*) as n, count(sighting_time) as n_sighting_time, count(lat) as n_lat, count(ai_confidence) as n_ai_confidence, count(sighting_count) as n_sighting_count from v_sightings")
def completeness(v):
    return measures.completeness(v.sightings, ["sighting_time", "lat", "ai_confidence", "sighting_count"])


@query("sightings", "select count(distinct location_raw) as n from v_sightings")
def distinct_locations(v):
    return v.sightings.agg(F.countDistinct("location_raw").alias("n"))


@query("landmarks", "select feature_class, count(*) as n from v_landmarks group by feature_class")
def class_counts(v):
    return v.landmarks.groupBy("feature_class").agg(F.count("*").alias("n"))


@query("sightings edges", f"""select count(*) as flagged, count(*) filter (m between 100 and 5000) as inland from (
  select s.id, case when w.id is not null then 0 else round(n.d) end as m from v_sightings s left join ({wet_sql(PLACED)}) w on w.id = s.id left join ({near_sql(PLACED)}) n on n.id = s.id where s.needs_review) x""")
def queue_counters(v):
    flagged = v.sightings.filter("needs_review")
    metres = geometry.water_distance(points(flagged), v.edges)
    return flagged.join(metres, F.col("id") == F.col("pid"), "left").agg(F.count("*").alias("flagged"), F.count_if(F.col("metres").between(100, 5000)).alias("inland"))


@query("landmarks", "select count(*) as n, count(distinct id) as ids, count(*) filter (trim(name) = '') as nameless, true as valid from v_landmarks")
def load_validation(v):
    from tidemark.sources import readers

    probes = [r.name for r in v.landmarks.orderBy("id").limit(5).collect()]
    return readers.checked_load(v.landmarks, 10, 5_000, probes)


@query("sightings", "select * replace (round(lat, 6) as lat, round(lng, 6) as lng) from (select distinct on (sighting_date, coalesce(sighting_time, ''), lower(location_raw)) * from v_sightings order by sighting_date, coalesce(sighting_time, ''), lower(location_raw), id) d")
def dedupe_first_wins(v):
    return rounded(measures.deduped(v.sightings), "lat", "lng")


@query("sightings", f"select {SHOWN_SQL} from (select distinct on (location_raw) * from v_sightings order by location_raw, id) d")
def distinct_on_location(v):
    return shown(measures.first_of(v.sightings, ["location_raw"], ["id"]))


@query("sightings", "select id, location_raw, n from (select id, location_raw, count(*) over () as n from v_sightings where geo_method = 'ai') x order by id limit 1")
def count_over_all(v):
    # The total is one row, so it joins as a broadcast instead of gathering all rows in one window.
    rows = v.sightings.filter("geo_method = 'ai'").select("id", "location_raw")
    return rows.orderBy("id").limit(1).join(F.broadcast(rows.agg(F.count("*").alias("n"))))


@query("sightings", f"select {SHOWN_SQL} from (select * from v_sightings where (geo_method = 'ai' and lat is not null and needs_review) or (geo_method in ('ai', 'unresolved') and needs_review)) x order by id limit 120")
def remeasure_sample(v):
    kept = v.sightings.filter("needs_review and (geo_method = 'unresolved' or geo_method = 'ai')")
    return shown(kept.orderBy("id").limit(120))


@query("sightings", "select cast(floor(lng / 0.25) as bigint) as cx, cast(floor(lat / 0.25) as bigint) as cy, count(*) as n, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng, case when count(*) >= 50 then 'large' when count(*) >= 10 then 'medium' else 'small' end as size from v_sightings where lat is not null group by 1, 2")
def cluster_cells(v):
    df = v.sightings.filter("lat is not null").groupBy(F.floor(F.col("lng") / 0.25).alias("cx"), F.floor(F.col("lat") / 0.25).alias("cy"))
    n = F.count("*")
    return df.agg(n.alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"), F.when(n >= 50, "large").when(n >= 10, "medium").otherwise("small").alias("size"))


PRICE_SQL = "case stage when 'extract' then sum(input_tokens) * 3e-6 + sum(output_tokens) * 15e-6 else sum(input_tokens) * 4e-6 + sum(output_tokens) * 20e-6 end"


@query("calls", f"select stage, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, round({PRICE_SQL}, 6) as dollars from v_calls group by stage")
def token_cost(v):
    return measures.call_costs(v.calls, vocab.PRICES)


@query("issue_lines", """select issue, s as separators, cast(floor(s * 343 + 0.5) as bigint) as extract_out, cast(floor(s * 1.04 + 0.5) as bigint) as strings,
  cast(ceil(floor(s * 1.04 + 0.5) / 60.0 * 1.2) as bigint) as calls, round(floor(s * 343 + 0.5) * 15e-6 + floor(s * 1.04 + 0.5) * (240 * 4e-6 + 270 * 20e-6), 6) as dollars
  from (select issue, count(*) filter (regexp_matches(trim(line), '^-(\\s*·)?\\s*$')) as s from v_issue_lines group by issue) x""")
def cost_projection(v):
    s = v.issue_lines.groupBy("issue").agg(F.count_if(text.separator(F.col("line"))).alias("separators"))
    out, strings = F.floor(F.col("separators") * vocab.OUT_PER_SEPARATOR + 0.5), F.floor(F.col("separators") * vocab.STRINGS_PER_SEPARATOR + 0.5)
    (_, out_price), (geo_in, geo_out) = vocab.PRICES["extract"], vocab.PRICES["geocode"]
    dollars = out * out_price + strings * (vocab.GEO_IN * geo_in + vocab.GEO_OUT * geo_out)
    return s.select("issue", "separators", out.alias("extract_out"), strings.alias("strings"), F.ceil(strings / vocab.BATCH * vocab.CALLS_PER_BATCH).alias("calls"), F.round(dollars, 6).alias("dollars"))


# ---- changes

INCOMING = "select 1000 + id as id, case when id % 2 = 0 then upper(name) else name || ' new' end as name, 'extra ' || name as alias, 48.0 as lat, -123.0 as lng from v_landmarks where id % 10 = 0"


def incoming(v) -> DataFrame:
    rows = v.landmarks.filter("id % 10 = 0")
    name = F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" new")))
    return rows.select((F.col("id") + 1000).alias("id"), name.alias("name"), F.array(F.concat(F.lit("extra "), "name"), F.lit(" ")).alias("aliases"), F.lit(48.0).alias("lat"), F.lit(-123.0).alias("lng"))


@query("gazetteer landmarks", f"""select cast(coalesce(g.id, i.id) as int) as id, coalesce(g.name, i.name) as name,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(coalesce(g.aliases_txt, ''), '|'), [coalesce(i.alias, '')]), lambda x: trim(x) <> ''))), '|') as aliases,
  round(cast(coalesce(g.lat, i.lat) as double), 6) as lat, round(cast(coalesce(g.lng, i.lng) as double), 6) as lng, g.id is not null and i.id is not null as merged,
  coalesce(case when g.id % 8 = 1 then 'old' end, case when i.id is not null then 'new' end) as region
  from v_gazetteer g full join ({INCOMING}) i on lower(g.name) = lower(i.name)""")
def gazetteer_upsert(v):
    known = aliased(v.gazetteer).withColumn("region", F.when(F.col("id") % 8 == 1, "old"))
    out = changes.upsert_places(known, incoming(v).withColumn("region", F.lit("new")))
    return rounded(out.withColumn("aliases", F.array_join("aliases", "|")), "lat", "lng")


@query("gazetteer", "select id, array_to_string(list_sort(list_distinct(list_filter(string_split(aliases_txt || '|' || name || '|near ' || name, '|'), lambda x: x <> ''))), '|') as added, array_to_string(list_sort(list_filter(string_split(aliases_txt, '|'), lambda x: x <> '' and x <> 'near ' || name)), '|') as removed from v_gazetteer")
def alias_add_remove(v):
    near = F.concat(F.lit("near "), "name")
    g = aliased(v.gazetteer)
    added = changes.with_aliases(g, F.array("name", near)).select("id", F.array_join("aliases", "|").alias("added"))
    return added.join(changes.without_aliases(g, F.array(near)).select("id", F.array_join("aliases", "|").alias("removed")), "id")


@query("gazetteer", "select id, array_to_string(list_sort(list_distinct(list_filter(string_split(aliases_txt || '|' || aliases_txt || '|  ', '|'), lambda x: trim(x) <> ''))), '|') as aliases from v_gazetteer")
def alias_merge(v):
    g = aliased(v.gazetteer)
    return g.select("id", F.array_join(changes.merged_aliases(F.col("aliases"), F.concat("aliases", F.array(F.lit("  ")))), "|").alias("aliases"))


@query("landmarks", "select id, name from v_landmarks where id % 3 <> 0 union all select id, name from v_landmarks where id % 3 = 0 union all select null, 'unnamed' from v_landmarks where id = 10")
def insert_ignore(v):
    known = v.landmarks.filter("id % 3 <> 0").select("id", "name")
    extra = v.landmarks.filter("id = 10").select(F.lit(None).cast("int").alias("id"), F.lit("unnamed").alias("name"))
    return changes.insert_ignore(known, v.landmarks.select("id", "name").unionByName(extra), "id")


BACKFILLED = "location_raw = (select location_raw from v_sightings where needs_review order by id limit 1) and needs_review and id <> (select min(id) from v_sightings where needs_review)"


@query("sightings", f"select id, case when {BACKFILLED} then 48.5 else round(lat, 6) end as lat, case when {BACKFILLED} then 'gazetteer' else geo_method end as geo_method, needs_review and not ({BACKFILLED}) as needs_review from v_sightings")
def cluster_backfill(v):
    first = v.sightings.filter("needs_review").orderBy("id").first()  # the row that an editor has open
    out = changes.cluster_backfill(v.sightings, first.location_raw, first.id, 48.5, -123.1)
    return rounded(out.select("id", "lat", "geo_method", "needs_review"), "lat")


@query("sightings", """select id, case when id % 50 = 1 then null when id % 50 = 2 then 48.25 else round(lat, 6) end as lat, case when id % 50 = 1 then null else round(lng, 6) end as lng,
  case when id % 50 = 1 then 'unresolved' when id % 50 = 2 and lat is distinct from 48.25 then 'manual' else geo_method end as geo_method,
  case when id % 50 = 1 then false else needs_review end as needs_review, case when id % 50 = 3 then 'minke' else species end as species,
  case when id % 50 = 4 then date '2024-02-29' else sighting_date end as sighting_date, case when id % 50 = 4 then null else sighting_time end as sighting_time,
  case when id % 50 = 4 then 9 else sighting_count end as sighting_count, case when id % 50 = 4 then 'here' else location_raw end as location_raw,
  case when id % 50 = 4 then 'raw' end as species_raw, case when id % 50 = 4 then 'T1' else 'pod' end as pod_or_group, case when id % 50 = 4 then null else 'N' end as direction, case when id % 50 = 4 then 7 end as gazetteer_id from v_sightings""")
def patch_present_keys(v):
    state = v.sightings.select("*", F.lit(None).cast("string").alias("species_raw"), F.lit("pod").alias("pod_or_group"), F.lit("N").alias("direction"), F.lit(None).cast("int").alias("gazetteer_id"))
    kind = F.col("id") % 50
    names = lambda *xs: F.array(*map(F.lit, xs))
    fields = F.when(kind == 1, names("lat", "lng", "geo_method", "needs_review")).when(kind == 2, names("lat")).when(kind == 3, names("species"))
    fields = fields.otherwise(names("sighting_date", "sighting_time", "sighting_count", "location_raw", "species_raw", "pod_or_group", "direction", "gazetteer_id"))
    new = {"species": F.when(kind == 3, "minke"), "lat": F.when(kind == 2, 48.25), "lng": F.lit(None).cast("double"), "geo_method": F.when(kind == 1, "unresolved"), "needs_review": F.when(kind == 1, False)}
    new |= {"sighting_date": F.lit("2024-02-29").cast("date"), "sighting_time": F.lit(None).cast("string"), "sighting_count": F.lit(9), "location_raw": F.lit("here"), "species_raw": F.lit("raw"), "pod_or_group": F.lit("T1"), "direction": F.lit(None).cast("string"), "gazetteer_id": F.lit(7)}
    patches = state.filter(kind.isin(1, 2, 3, 4)).select("id", fields.alias("present"), *(c.alias(n) for n, c in new.items()))
    return rounded(changes.patched(state, patches).select("id", *changes.EDITABLE), "lat", "lng")


@query("gazetteer", """select id, case when id % 8 = 1 then upper(name) else name end as name, case when id % 8 = 1 then 'x' when id % 8 = 5 then null else 'sea' end as region,
  case when id % 8 = 5 then 50.5 else round(cast(lat as double), 6) end as lat, case when id % 8 = 5 then 'new' else replace(aliases_txt, '|', '/') end as aliases from v_gazetteer""")
def gazetteer_patch(v):
    state = aliased(v.gazetteer).drop("aliases_txt").withColumn("region", F.lit("sea"))
    odd = F.col("id") % 8 == 1
    fields = F.when(odd, F.array(F.lit("name"), F.lit("region"))).otherwise(F.array(F.lit("region"), F.lit("lat"), F.lit("aliases")))
    patches = state.filter("id % 8 in (1, 5)").select("id", fields.alias("present"), F.upper("name").alias("name"), F.array(F.lit("new")).alias("aliases"), F.lit(50.5).alias("lat"), F.lit(None).cast("double").alias("lng"), F.when(odd, "x").alias("region"))
    out = changes.patched_places(state, patches)
    return rounded(out.select("id", "name", "region", "lat", F.array_join("aliases", "/").alias("aliases")), "lat")


LINK = "case when id % 4 = 0 then cast(1 + (id % 8) * 8 as int) end"


@query("sightings gazetteer", f"select id, case when {LINK} = 33 then null else {LINK} end as gazetteer_id, round(lat, 6) as lat, (select count(*) from v_gazetteer where id <> 33) as places from v_sightings")
def delete_unlink(v):
    linked = v.sightings.withColumn("gazetteer_id", F.expr(LINK))
    left, gazetteer = changes.without_place(linked, v.gazetteer, 33)
    return rounded(left.select("id", "gazetteer_id", "lat").join(F.broadcast(gazetteer.agg(F.count("*").alias("places")))), "lat")


@query("sightings newsletters", "select newsletter_id, count(*) as n from v_sightings where newsletter_id not in (select id from v_newsletters where status = 'failed') group by newsletter_id")
def cascade_delete(v):
    _, left = changes.without_issues(v.newsletters, v.sightings, F.col("status") == "failed")
    return left.groupBy("newsletter_id").agg(F.count("*").alias("n"))


@query("newsletters", "select id, title, status from v_newsletters where status not in ('failed', 'processing')")
def failed_run_purge(v):
    return changes.purged_runs(v.newsletters).select("id", "title", "status")


@query("answers sightings", "select distinct input from v_answers where input not in (select location_raw from v_sightings where geo_method = 'gps')")
def orphan_keys(v):
    known = v.sightings.filter("geo_method = 'gps'").select(F.col("location_raw").alias("input"))
    return v.answers.select("input").distinct().join(known, "input", "left_anti")


@query("sightings answers", "select s.id, case when s.geo_method = 'ai' then coalesce(s.ai_confidence, a.confidence) else s.ai_confidence end as ai_confidence from v_sightings s left join (select * from v_answers where attempt = 1) a on a.input = s.location_raw")
def update_from_join(v):
    return changes.filled_from(v.sightings, v.answers.filter("attempt = 1"), "ai_confidence", "confidence", F.col("geo_method") == "ai").select("id", "ai_confidence")


@query("sightings answers", """select case when a.input is not null then 'regeocoded' else s.geo_method end as geo_method, count(*) as n, count(a.input) as changed from v_sightings s
  left join (select input from v_answers where attempt = 2 and lat is not null) a on a.input = s.location_raw and s.needs_review and s.geo_method in ('ai', 'unresolved') group by 1""")
def regeocode_writeback(v):
    results = v.answers.filter("attempt = 2 and lat is not null").select("input", F.lit("regeocoded").alias("method"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    return changes.regeocoded(v.sightings, results).groupBy("geo_method").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("sightings landmarks", f"""select s.id, u.id as landmark_id, round(coalesce(cast(u.lat as double), s.lat), 6) as lat, case when u.id is null then s.geo_method else 'landmark' end as geo_method, s.needs_review and u.id is null as needs_review
  from v_sightings s left join (select {NORM.format('name')} as k, min(id) as id, min(lat) as lat from v_landmarks where feature_class in ({WATER_SQL}) group by 1 having count(*) = 1) u
  on u.k = {NORM.format('s.location_raw')} and s.needs_review""")
def landmark_backfill(v):
    flagged = v.sightings.filter("needs_review")
    spots = v.landmarks.select(F.col("id").alias("landmark_id"), "lat", "lng")
    matches = places.by_landmark(flagged, v.landmarks).join(spots, "landmark_id")
    out = changes.placed_by_landmark(v.sightings.withColumn("landmark_id", F.lit(None).cast("int")), matches)
    return rounded(out.select("id", "landmark_id", "lat", "geo_method", "needs_review"), "lat")


@query("sightings", "select id, case when geo_method = 'gazetteer' then 'verified' else geo_method end as geo_method from v_sightings")
def method_rename(v):
    return changes.renamed_method(v.sightings, "gazetteer", "verified").select("id", "geo_method")


@query("newsletters sightings", "select n.id, 'complete' as status, left(string_agg('placed at ' || s.location_raw, '; ' order by s.location_raw), 2000) as warning_text from v_newsletters n join (select distinct newsletter_id, location_raw from v_sightings) s on s.newsletter_id = n.id group by n.id")
def run_finalize(v):
    places_ = v.sightings.select("newsletter_id", "location_raw").distinct()
    warnings = places_.groupBy(F.col("newsletter_id").alias("id")).agg(F.array_sort(F.collect_list("location_raw")).alias("w"))
    runs = v.newsletters.join(warnings, "id")
    return changes.finished_runs(runs, F.transform("w", lambda x: F.concat(F.lit("placed at "), x))).select("id", "status", "warning_text")


@query("newsletters", "select id, 'processing' as status, cast(null as varchar) as warning_text from v_newsletters where id % 2 = 0 union all select id, 'failed', left(repeat('broken at ' || title || '; ', 150), 2000) from v_newsletters where id % 2 = 1")
def run_begin_or_fail(v):
    begun = changes.begun_runs(v.newsletters.select("id", "title"))
    failed = changes.failed_runs(begun.filter("id % 2 = 1"), F.repeat(F.concat(F.lit("broken at "), "title", F.lit("; ")), 150))
    return begun.filter("id % 2 = 0").withColumn("warning_text", F.lit(None).cast("string")).unionByName(failed).select("id", "status", "warning_text")


# ---- scalar rules

@query("sightings", f"select distinct location_raw, {NORM.format('location_raw')} as norm, replace(replace(location_raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as clean from v_sightings")
def norm_text(v):
    return v.sightings.select("location_raw").distinct().select("location_raw", text.norm(F.col("location_raw")).alias("norm"), text.clean(F.col("location_raw")).alias("clean"))


@query("sightings", "select id, round(lat, 6) as lat6, round(lng, 5) as lng5 from v_sightings where lat is not null")
def coordinate_rounding(v):
    return v.sightings.filter("lat is not null").select("id", F.round("lat", 6).alias("lat6"), F.round("lng", 5).alias("lng5"))


@query("gazetteer", "select id, case when aliases_txt = '' then name else name || '/' || replace(aliases_txt, '|', '/') end as lines from v_gazetteer")
def split_lines(v):
    typed = F.concat(F.lit("\r\n "), "name", F.lit(" \r\n\n"), F.replace("aliases_txt", F.lit("|"), F.lit("\n")), F.lit("\n"), "name")
    return v.gazetteer.select("id", F.array_join(text.split_lines(typed), "/").alias("lines"))


@query("sightings", "select id, case when m between 100 and 5000 then case when m >= 1000 then printf('%.1f km', m / 1000.0) else m || ' m' end end as label from (select id, id * 37 % 7000 as m from v_sightings) x")
def inland_label(v):
    return v.sightings.select("id", text.inland_label(F.col("id") * 37 % 7000).alias("label"))


@query("newsletters", "select id, case when date_from = date_to then strftime(date_from, '%b %-d') else strftime(date_from, '%b %-d') || ' – ' || strftime(date_to, '%b %-d') end as dates from v_newsletters")
def range_text(v):
    return v.newsletters.select("id", text.range_text(F.col("date_from"), F.col("date_to")).alias("dates"))


@query("sightings", "select id, concat_ws(' · ', species, sighting_time, nullif(ai_confidence, 'low'), reporter) as line from v_sightings")
def display_line(v):
    return v.sightings.select("id", F.concat_ws(" · ", "species", "sighting_time", F.nullif("ai_confidence", F.lit("low")), "reporter").alias("line"))


@query("sightings", """select id, concat_ws(' · ', case when id % 3 = 0 then 'T' || id end, case id % 4 when 0 then 'a, b' when 1 then 'a' end) as who,
  concat_ws(' · ', cast(sighting_date as varchar), left(sighting_time, 5)) as "when", concat_ws(' · ', case when id % 2 = 0 then 'N' end, case id % 4 when 0 then 'a, b' when 1 then 'a' end) as doing,
  concat_ws(', ', case when id % 2 = 0 then 'N' end, case id % 4 when 0 then 'a, b' when 1 then 'a' end) as notes, case when id % 5 = 0 then 'hydrophone,webcam' when id % 5 = 1 then 'webcam' else '' end as badges from v_sightings""")
def display_joins(v):
    some = F.when(F.col("id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") % 4 == 1, F.array(F.lit("a"))).when(F.col("id") % 4 == 2, F.array().cast("array<string>"))
    noticed = F.when(F.col("id") % 5 == 0, F.array(F.lit("hydrophone"), F.lit("visual"), F.lit("webcam"))).when(F.col("id") % 5 == 1, F.array(F.lit("webcam")))
    row = F.struct(F.when(F.col("id") % 3 == 0, F.concat(F.lit("T"), "id")).when(F.col("id") % 3 == 1, "").alias("pod_or_group"), some.alias("individual_ids"), "sighting_date", "sighting_time", F.when(F.col("id") % 2 == 0, "N").alias("direction"), some.alias("behaviors"), noticed.alias("detection_methods"))
    lines = text.display(F.col("s"))
    return v.sightings.select("id", row.alias("s")).select("id", *(c.alias(n) for n, c in lines.items() if n != "badges"), F.array_join(lines["badges"], ",").alias("badges"))


@query("newsletters", "select id, 'Issue ' || id as title, left('0123456789' || id, 8) as short, case when id % 2 = 0 then 'geocode' else 'extract' end as stage from v_newsletters")
def misc_strings(v):
    system = F.when(F.col("id") % 2 == 0, "You know Marine Geography well.")
    return v.newsletters.select("id", reads.short_title(F.col("title")).alias("title"), reads.short_id(F.concat(F.lit("0123456789"), "id")).alias("short"), text.stage_of(system).alias("stage"))


SPECIES_SQL = "(values " + ", ".join(f"('{k}', '{label.replace(chr(39), chr(39) * 2)}', {str(orca).lower()})" for k, label, orca in vocab.SPECIES) + ") d(key, label, orca)"


@query("sightings", f"select s.species, coalesce(d.label, s.species) as label, coalesce(d.orca, false) as orca, count(*) as n from v_sightings s left join {SPECIES_SQL} on d.key = s.species group by 1, 2, 3")
def species_dim(v):
    from tidemark.sources import static

    dim = static.species(v.spark)
    counted = v.sightings.groupBy("species").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(dim), F.col("species") == F.col("key"), "left").select("species", F.coalesce("label", "species").alias("label"), F.coalesce("orca", F.lit(False)).alias("orca"), "n")


@query("answers", "select pos, confidence, round(cast(lat as double), 6) as lat from v_answers where attempt = 1")
def zip_unnest(v):
    packed = v.answers.filter("attempt = 1").groupBy(F.floor(F.col("pos") / 40).alias("g")).agg(F.array_sort(F.collect_list(F.struct("pos", "confidence", "lat"))).alias("a"))
    flat = packed.select(F.inline(F.arrays_zip(F.col("a.pos").alias("pos"), F.col("a.confidence").alias("confidence"), F.col("a.lat").alias("lat"))))
    return rounded(flat, "lat")


@query("gps_text", r"""with f as (select id, txt,
    regexp_extract(txt, '(?i)(\d{1,2})[°º]\s*(\d{1,2})[''’′]\s*([\d.]+)["”″]?\s*([NS])[,;\s]+(\d{1,3})[°º]\s*(\d{1,2})[''’′]\s*([\d.]+)["”″]?\s*([EW])', ['a','b','c','h','d','e','g','w']) as m1,
    regexp_extract(txt, '(?i)([NS])\s*(\d{1,3})d(\d{1,2}(?:\.\d+)?)[''’′]?[,;\s]+([EW])\s*(\d{1,3})d(\d{1,2}(?:\.\d+)?)[''’′]?', ['h','a','b','w','d','e']) as m2,
    regexp_extract(txt, '(?i)(\d{1,2}\.\d+)\s*[°º]?\s*([NS])[,;\s]+(\d{1,3}\.\d+)\s*[°º]?\s*([EW])?', ['a','h','d','w']) as m3,
    regexp_extract(txt, '(-?\d{1,2}\.\d{3,})\s*,\s*(-?\d{1,3}\.\d{3,})', ['a','d']) as m4 from v_gps_text),
  r as (select id, case
      when m1.a <> '' then try_cast(m1.a as double) + try_cast(m1.b as double) / 60 + try_cast(m1.c as double) / 3600
      when m2.a <> '' then try_cast(m2.a as double) + try_cast(m2.b as double) / 60
      when m3.a <> '' then try_cast(m3.a as double) when m4.a <> '' then try_cast(m4.a as double) end as lat,
    case when m1.a <> '' then try_cast(m1.d as double) + try_cast(m1.e as double) / 60 + try_cast(m1.g as double) / 3600
      when m2.a <> '' then try_cast(m2.d as double) + try_cast(m2.e as double) / 60
      when m3.a <> '' then try_cast(m3.d as double) when m4.a <> '' then try_cast(m4.d as double) end as lng,
    upper(case when m1.a <> '' then m1.h when m2.a <> '' then m2.h when m3.a <> '' then m3.h else '' end) as h,
    upper(case when m1.a <> '' then m1.w when m2.a <> '' then m2.w when m3.a <> '' then m3.w else '' end) as w from f),
  s as (select id, case when h = 'S' then -lat else lat end as lat, case when w = 'W' then -abs(lng) when w = '' and lng between 120 and 130 then -lng else lng end as lng from r)
  select id, case when lat between 45 and 52 and lng between -130 and -120 then round(lat, 6) end as lat, case when lat between 45 and 52 and lng between -130 and -120 then round(lng, 6) end as lng from s""".replace("with f as", ", f as", 1))
def gps_parse(v):
    p = text.gps(F.col("txt"))
    return v.gps_text.select("id", F.round(p["lat"], 6).alias("lat"), F.round(p["lng"], 6).alias("lng"))


# ---- issues

HEADER_SQL = r"(?i)^(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)[.,]?\s+((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)[a-z]*)[.,]?\s+(\d{1,2})\s*[-–]\s*(.+)$"
MONTH_SQL = "case " + " ".join(f"when m in ({', '.join(repr(x) for x in sorted({n, n[:3]} | ({'sept'} if n == 'september' else set())))}) then {i}" for i, n in enumerate(vocab.MONTHS, 1)) + " end"
LINE = "regexp_replace(line, '^[\\s\u00a0\ufeff]+|[\\s\u00a0\ufeff]+$', '', 'g')"
BANNER_SQL = "case " + " ".join(f"when n = '{b}' or starts_with(n, '{b} (') or starts_with(n, '{b}(') then {{}}".format(f"'{x}'").replace("BIGG'S", "BIGG''S") for b, x in vocab.BANNERS) + " end"
BANNER_NAME_SQL = "case " + " ".join(f"when n = '{b}' or starts_with(n, '{b} (') or starts_with(n, '{b}(') then '{b}'".replace("BIGG'S", "BIGG''S") for b, _ in vocab.BANNERS) + " end"
MARKED_SQL = f"""select *, {BANNER_SQL} as species, {BANNER_NAME_SQL} as banner_name,
  case when regexp_matches(t, '{HEADER_SQL}') then {MONTH_SQL} end as month, try_cast(regexp_extract(t, '{HEADER_SQL}', 2) as int) as day, regexp_extract(t, '{HEADER_SQL}', 3) as rest,
  coalesce(min(case when regexp_matches(t, '(?i)^(ABOUT ORCA NETWORK|Orca Network is a 501)') then line_no end) over (partition by issue), max(line_no) over (partition by issue) + 1) as stop
  from (select issue, line_no, line, {LINE} as t, upper(replace(replace({LINE}, '’', ''''), '‘', '''')) as n, lower(regexp_extract({LINE}, '{HEADER_SQL}', 1)) as m from v_issue_lines) b"""
OWNED_SQL = f"""select * from (select *, max(case when month is not null then line_no end) over (partition by issue, banner_line order by line_no) as header_line from (
  select * from (select *, max(case when species is not null then line_no end) over (partition by issue order by line_no) as banner_line from ({MARKED_SQL}) m where line_no < stop) w
  where banner_line is not null and line_no > banner_line) o) h"""
SECTIONS_SQL = f"""select issue, banner_line, header_line, text from (select issue, banner_line, header_line, regexp_replace(string_agg(line, chr(10) order by line_no), '^[\\s\u00a0\ufeff]+|[\\s\u00a0\ufeff]+$', '', 'g') as text
  from ({OWNED_SQL}) o group by issue, banner_line, header_line) s where text <> ''"""


@query("issue_lines", f"select issue, line_no, month, day, trim(case when regexp_matches(trim(rest), '^.*?\\s*\\([^)]+\\)$') then regexp_extract(trim(rest), '^(.*?)\\s*\\(([^)]+)\\)$', 1) else trim(rest) end) as water_body, case when regexp_matches(trim(rest), '^.*?\\s*\\([^)]+\\)$') then trim(regexp_extract(trim(rest), '^(.*?)\\s*\\(([^)]+)\\)$', 2)) end as pod from ({MARKED_SQL}) m where month is not null")
def header_parse(v):
    h = v.issue_lines.select("issue", "line_no", text.header(F.col("line")).alias("h")).filter("h is not null")
    return h.select("issue", "line_no", "h.month", "h.day", "h.water_body", "h.pod")


@query("issue_lines", f"select issue, line_no, species from ({MARKED_SQL}) m where species is not null")
def banner_map(v):
    return v.issue_lines.select("issue", "line_no", text.banner(F.col("line"))["species"].alias("species")).filter("species is not null")


@query("issue_lines", "select issue, 'July ' || cast(10 + length(issue) as varchar) || ', 2026' as title, '2026-07-' || cast(10 + length(issue) as varchar) as iso from (select distinct issue from v_issue_lines) d")
def issue_date(v):
    return issues.issue_dates(v.issue_lines)


@query("issue_lines", f"select issue, line_no, 2026 + case when month - 7 > 6 then -1 when month - 7 < -6 then 1 else 0 end || '-' || lpad(cast(month as varchar), 2, '0') || '-' || lpad(cast(day as varchar), 2, '0') as iso from ({MARKED_SQL}) m where month is not null")
def header_iso_date(v):
    h = v.issue_lines.select("issue", "line_no", text.header(F.col("line")).alias("h")).filter("h is not null")
    dated = h.join(issues.issue_dates(v.issue_lines), "issue")
    return dated.select("issue", "line_no", text.header_date(F.col("h.month"), F.col("h.day"), F.to_date("iso")).alias("iso"))


@query("issue_lines", f"select issue, line_no, banner_line, header_line from ({OWNED_SQL}) o")
def section_ownership(v):
    return issues.owned(v.issue_lines).select("issue", "line_no", "banner_line", "header_line")


@query("issue_lines", f"""select distinct issue, t as line from (select *, min(case when month is not null then line_no end) over ahead as nh, min(case when species is not null then line_no end) over ahead as nb
  from ({MARKED_SQL}) m where line_no < stop window ahead as (partition by issue order by line_no rows between 1 following and 15 following)) x
  where length(t) between 4 and 60 and t = upper(t) and regexp_matches(t, '[A-Z]{{3}}') and not regexp_matches(t, '\\d') and species is null and not regexp_matches(t, '(?i)^(SUMMARY|ANNOUNCEMENTS)')
  and nh is not null and (nb is null or nh < nb)""")
def unknown_banners(v):
    return issues.unknown_banners(v.issue_lines)


@query("issue_lines", "select distinct issue, 'nothing here' as summary from v_issue_lines")
def summary_block(v):
    return issues.summaries(v.issue_lines)


@query("issue_lines", f"select s.issue, min('2026-' || lpad(cast(month as varchar), 2, '0') || '-' || lpad(cast(day as varchar), 2, '0')) as first_date, max('2026-' || lpad(cast(month as varchar), 2, '0') || '-' || lpad(cast(day as varchar), 2, '0')) as last_date from ({SECTIONS_SQL}) s join ({MARKED_SQL}) m on m.issue = s.issue and m.line_no = s.header_line group by s.issue")
def issue_date_range(v):
    return issues.date_ranges(v.issue_lines)


GREEDY_SQL = f""", recursive_in as (select *, row_number() over (partition by issue, banner_line order by coalesce(header_line, banner_line)) as n, length(text) as s from ({SECTIONS_SQL}) x),
  fold as (with recursive f as (
    select issue, banner_line, n, s, cast(case when s > 12000 then 0 else 0 end as bigint) as own, cast(case when s > 12000 then 1 else 0 end as bigint) as no, cast(case when s > 12000 then 0 else s + 2 end as bigint) as len from recursive_in where n = 1
    union all select r.issue, r.banner_line, r.n, r.s,
      case when r.s > 12000 then case when f.len > 0 then f.no + 1 else f.no end when f.len > 0 and f.len + r.s > 12000 then f.no + 1 else f.no end,
      case when r.s > 12000 then case when f.len > 0 then f.no + 2 else f.no + 1 end when f.len > 0 and f.len + r.s > 12000 then f.no + 1 else f.no end,
      case when r.s > 12000 then 0 when f.len > 0 and f.len + r.s > 12000 then r.s + 2 else f.len + r.s + 2 end
    from f join recursive_in r on r.issue = f.issue and r.banner_line = f.banner_line and r.n = f.n + 1) select * from f)"""


@query("issue_lines", GREEDY_SQL + """
  select issue, banner_line, own as chunk_no, count(*) as sections, cast(sum(s) as bigint) as chars from fold group by issue, banner_line, own""")
def greedy_chunks(v):
    sizes = issues.sections(v.issue_lines).select("issue", "banner_line", F.coalesce("header_line", "banner_line").alias("at"), F.length("text").alias("size"))
    packed = issues.packed(scans.stored(sizes), ["issue", "banner_line"], "at", "size")
    return packed.groupBy("issue", "banner_line", "chunk_no").agg(F.count("*").alias("sections"), F.sum("size").alias("chars"))


@query("issue_lines", """, l as (select issue, row_number() over (partition by issue order by line_no) as n, length(line) as s, regexp_matches(trim(line), '^-(\\s*·)?\\s*$') as sep from v_issue_lines),
  fold as (with recursive f as (select issue, n, cast(0 as bigint) as no, cast(s + 1 as bigint) as len from l where n = 1
    union all select l.issue, l.n, case when l.sep and f.len > 12000 then f.no + 1 else f.no end, case when l.sep and f.len > 12000 then l.s + 1 else f.len + l.s + 1 end from f join l on l.issue = f.issue and l.n = f.n + 1) select * from f)
  select f.issue, f.no as part_no, count(*) as lines, cast(sum(l.s + 1) as bigint) as chars from fold f join l using (issue, n) group by f.issue, f.no""")
def oversize_split(v):
    parts = issues.oversize_numbers(v.issue_lines, ["issue"], "line_no")
    return parts.groupBy("issue", "part_no").agg(F.count("*").alias("lines"), F.sum("_size").alias("chars"))


@query("issue_lines", GREEDY_SQL + f""", counted as (select issue, banner_line, row_number() over (partition by issue, banner_line order by coalesce(header_line, banner_line)) as n,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '{HEADER_SQL}'))) as h, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^-(\\s*·)?\\s*$'))) as s,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^\\d{{1,2}}:\\d{{2}}'))) as t from ({SECTIONS_SQL}) x)
  select f.issue, f.banner_line, f.own as chunk_no, cast(sum(h) as bigint) as headers, cast(sum(c.s) as bigint) as separators, cast(sum(t) as bigint) as timestamps, sum(h + c.s + t) = 0 as barren
  from fold f join counted c using (issue, banner_line, n) group by 1, 2, 3""")
def chunk_diagnostics(v):
    found = issues.chunk_diagnostics(issues.chunks(v.issue_lines))
    sums = [F.sum(c).alias(c) for c in ("headers", "separators", "timestamps")]
    return found.groupBy("issue", "banner_line", "chunk_no").agg(*sums, F.min("barren").alias("barren"))


@query("issue_lines", GREEDY_SQL + f""", long_lines as (select f.issue, f.banner_line, f.own as chunk_no, x.header_line, unnest(range(1, 1 + len(string_split(x.text, chr(10))))) as n, length(unnest(string_split(x.text, chr(10)))) as s,
    regexp_matches(trim(unnest(string_split(x.text, chr(10)))), '^-(\\s*·)?\\s*$') as sep
    from (select *, row_number() over (partition by issue, banner_line order by coalesce(header_line, banner_line)) as n from ({SECTIONS_SQL}) y) x join fold f using (issue, banner_line, n) where length(x.text) > 12000),
  parts as (with recursive p as (select issue, banner_line, chunk_no, header_line, n, cast(0 as bigint) as no, cast(s + 1 as bigint) as len from long_lines where n = 1
    union all select l.issue, l.banner_line, l.chunk_no, l.header_line, l.n, case when l.sep and p.len > 12000 then p.no + 1 else p.no end, case when l.sep and p.len > 12000 then l.s + 1 else p.len + l.s + 1 end
    from p join long_lines l on l.issue = p.issue and l.banner_line = p.banner_line and l.chunk_no = p.chunk_no and l.n = p.n + 1) select * from p)
  select p.issue, p.banner_line, p.chunk_no, p.no as part_no, count(*) as lines, case when p.no > 0 then max(m.t) end as carried_header from parts p left join ({MARKED_SQL}) m on m.issue = p.issue and m.line_no = p.header_line group by 1, 2, 3, 4""")
def carried_headers(v):
    """Parts of split sections: those after the first carry the section's header."""
    # What is asked of a text is stored, not the text.
    measured = {"lines": F.size(F.split("text", "\n")).cast("long"), "chars": F.length("text")}
    parts = scans.stored(issues.chunks(v.issue_lines).withColumns(measured).select("issue", "banner_line", "chunk_no", "part_no", "lines", "chars", "carried_header"))
    split = parts.groupBy("issue", "banner_line", "chunk_no").agg(F.max("part_no").alias("most"), F.sum("chars").alias("chars")).filter(f"most > 0 or chars > {vocab.MAX_CHUNK}")
    return parts.join(split, ["issue", "banner_line", "chunk_no"], "left_semi").select("issue", "banner_line", "chunk_no", "part_no", "lines", "carried_header")


@query("issue_lines", f"select b.name, count(distinct m.issue) as issues from (values {', '.join('(' + repr(n).replace(chr(34), chr(39)).replace('BIGG' + chr(39) + 'S', 'BIGG' + chr(39) * 2 + 'S') + ')' for n, _ in vocab.BANNERS)}) b(name) left join ({MARKED_SQL}) m on m.banner_name = b.name group by b.name")
def banner_presence(v):
    from tidemark.sources import static

    found = v.issue_lines.select("issue", text.banner(F.col("line"))["name"].alias("name")).filter("name is not null").groupBy("name").agg(F.countDistinct("issue").alias("issues"))
    return static.banners(v.spark).select("name").join(found, "name", "left").select("name", F.coalesce("issues", F.lit(0)).alias("issues"))


@query("issue_lines", f"select issue, banner_line, header_line, length(text) as chars from ({SECTIONS_SQL}) s order by chars, issue, banner_line, header_line nulls first limit 2")
def smallest_sections(v):
    chars = issues.sections(v.issue_lines).select("issue", "banner_line", "header_line", F.length("text").cast("long").alias("chars"))
    return chars.orderBy("chars", "issue", "banner_line", "header_line").limit(2)


# ---- records

ITEMS_SQL = """select id, cast(pos as int) as pos, input, species, lat, lng from (
  select id, 0 as pos, case id % 6 when 0 then 'a' || id when 1 then 'b' when 2 then 'c' when 3 then 'mid' || chr(10) || 'channel' when 4 then 'e [Road]' else 'f' end as input,
  case id % 6 when 0 then 'biggs' when 1 then 'gray' when 2 then 'minke' when 3 then 'humpback' when 4 then 'other' else 'narwhal' end as species,
  cast(48.1 + (id % 6) * 0.1 as double) as lat, cast(-122.5 - (id % 6) * 0.1 as double) as lng from v_model_text) x"""


@query("model_text", f"select id, pos, input, species, round(lat, 6) as lat, round(lng, 6) as lng from ({ITEMS_SQL}) i")
def parse_json_array(v):
    r = records.parsed(v.model_text)
    return rounded(r.select("id", "pos", "r.input", "r.species", "r.lat", "r.lng"), "lat", "lng")


@query("model_text", f"select id, input from ({ITEMS_SQL}) i where input = 'c'")
def salvage_truncated(v):
    cut_off = v.model_text.filter(~F.rtrim("txt").endswith("]") & ~F.contains("txt", F.lit("```")))
    return records.parsed(cut_off).select("id", "r.input")


@query("model_text", f"select id, case when species = 'narwhal' then 'gray' else species end as species from ({ITEMS_SQL}) i")
def species_fallback(v):
    return records.parsed(v.model_text).select("id", records.species_or(F.col("r.species"), F.lit("gray")).alias("species"))


RAW = """named_struct('sighting_date', case id % 5 when 0 then '2026-02-30' when 1 then 'June' else '2026-07-0' || (1 + id % 9) end, 'location_raw', if(id % 7 = 0, '  ', concat(' place ', id, ' ')),
  'species', if(id % 4 = 0, 'narwhal', 'gray'), 'count', id % 10 + 0.5, 'sighting_time', if(id % 3 = 0, 'dawn', '9:15 am PDT'), 'detection_methods', array('visual', 'sonar'))"""
RAW_SQL = """select id, '2026-07-0' || (1 + id % 9) as d, 'place ' || id as location_raw, case when id % 4 = 0 then 'minke' else 'gray' end as species, cast(id % 10 + 1 as int) as sighting_count,
  case when id % 3 <> 0 then '9:15 am ' end as sighting_time, 'visual' as methods, case when id % 4 = 0 then 'unknown species narwhal; ' else '' end || 'unknown detection method sonar' as warnings
  from v_model_text where id % 5 not in (0, 1) and id % 7 <> 0"""


def raw_records(v) -> DataFrame:
    made = v.model_text.select("id", F.to_json(F.expr(RAW)).alias("o"))
    form = ", ".join(x.strip().replace(" ", ":", 1) for x in records.RECORD.split(", "))
    return records.normalized(made.select("id", F.from_json("o", f"struct<{form}>").alias("r")), F.lit("minke"))


@query("model_text", f"select id, cast(d as date) as sighting_date, location_raw, species, sighting_count, sighting_time, methods from ({RAW_SQL}) r")
def normalize_record(v):
    return raw_records(v).select("id", "sighting_date", "location_raw", "species", "sighting_count", "sighting_time", F.array_join("detection_methods", "|").alias("methods"))


@query("model_text", f"select id, warnings from ({RAW_SQL}) r")
def warnings_distinct(v):
    return raw_records(v).select("id", F.array_join(F.array_distinct(F.concat("warnings", "warnings")), "; ").alias("warnings"))


# ---- sources, sinks and the whole chain

def scratch(v: Views, what: str) -> str:
    """A path in the folder that driver and executors share."""
    import uuid

    return f"{scans.shared_dir(v.spark).rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"


IMPORT_SQL = ", ".join(f"'{c}'" for c in vocab.IMPORT_CLASSES)


@query("landmarks", f"select cast(id as bigint) as id, name, feature_class, county, round(cast(lat as double), 6) as lat, round(cast(lng as double), 6) as lng from v_landmarks where feature_class in ({IMPORT_SQL})")
def gnis_import(v):
    from tidemark.sources import readers

    readers.write_gnis(v.landmarks, path := scratch(v, "gnis"))
    return rounded(readers.gnis(v.spark, path), "lat", "lng")


AREAS_SQL = ", ".join(f"'{a}'" for a in vocab.WATER_AREAS)


@query("edges", f"select cast(poly_id as bigint) as poly_id, k, round(x1, 9) as x1, round(y1, 9) as y1, round(x2, 9) as x2, round(y2, 9) as y2 from v_edges where cast(poly_id as varchar) in ({AREAS_SQL})")
def polygon_import(v):
    """All polygons are written; those of the named areas are kept."""
    from tidemark.sources import readers

    readers.write_polygons(v.edges, path := scratch(v, "polygons"))
    return rounded(readers.polygons(v.spark, path, vocab.WATER_AREAS).drop("ring"), "x1", "y1", "x2", "y2", to=9)


@query("issue_lines", "select issue, count(*) as lines, cast(sum(length(line)) as bigint) as chars, cast(sum(line_no) as bigint) as numbers, max(line_no) as last from v_issue_lines group by issue")
def sources_roundtrip(v):
    """Issues as text files of some thousand lines each, read back and numbered."""
    from tidemark.sources import readers

    readers.write_issues(v.issue_lines, path := scratch(v, "issues"))
    lines = readers.written_lines(v.spark, path)
    return lines.groupBy("issue").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.sum("line_no").alias("numbers"), F.max("line_no").alias("last"))


@query("landmarks", "select 'there' as source, count(*) as n from v_landmarks union all select 'lacking', 0")
def landmarks_tolerant(v):
    """A table that is there, and one that is not: an empty one of its schema."""
    from tidemark.sources import readers

    v.landmarks.write.parquet(path := scratch(v, "landmarks"))
    (there, found), (lacking, none) = readers.table_or_empty(v.spark, path, readers.LANDMARKS), readers.table_or_empty(v.spark, scratch(v, "nothing"), readers.LANDMARKS)
    assert found and not none and set(lacking.columns) == set(there.columns)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return count(there, "there").unionByName(count(lacking, "lacking"))


def store(v: Views) -> Store:
    return Store(v.spark, scratch(v, "store"))


@query("sightings", "select id, cast(newsletter_id as varchar) as newsletter_id, species, location_raw, round(lat, 6) as lat, needs_review from v_sightings")
def append_rows(v):
    """Sightings stored by one write and one append, and read as a table."""
    s = store(v)
    s.write("sightings", v.sightings.filter("id % 3 = 0"))
    s.append("sightings", v.sightings.filter("id % 3 <> 0"))
    return rounded(s.table("sightings").select("id", "newsletter_id", "species", "location_raw", "lat", "needs_review"), "lat")


@query("landmarks", "select cast(id as bigint) as id, name from v_landmarks where id % 2 = 0")
def clear_and_reload(v):
    s = store(v)
    s.append("landmarks", v.landmarks)
    s.append("landmarks", v.landmarks)
    s.write("landmarks", v.landmarks.filter("id % 2 = 0"))
    return s.table("landmarks").select("id", "name")


@query("landmarks gazetteer", """select 'landmarks' as "table", 6 as columns, count(*) as "rows", 1 as versions, 'id,name,feature_class,county,lat,lng' as names from v_landmarks
  union all select 'gazetteer', 6, count(*) + count(*), 2, 'id,name,aliases,lat,lng,region' from v_gazetteer""")
def store_catalog(v):
    s = store(v)
    s.write("landmarks", v.landmarks)
    for _ in range(2):
        s.append("gazetteer", aliased(v.gazetteer))
    return s.check().filter("versions > 0").select("table", "columns", "rows", "versions", F.array_join("names", ",").alias("names"))


EDITED_SQL = """select id, case when id % 10 = 3 then 'gray' else species end as species, case when id % 6 = 4 then null when id % 10 in (3, 5) then 48.25 else round(lat, 6) end as lat,
  case when id % 6 = 4 then 'unresolved' when id % 10 in (3, 5) and lat is distinct from 48.25 then 'manual' else geo_method end as geo_method, case when id % 6 = 4 then true when id % 10 = 7 then false else needs_review end as needs_review,
  case when id % 21 = 0 then 'again' else location_raw end as location_raw from v_sightings where id % 7 <> 0 or id % 21 = 0"""


def edited_store(v, compacted: bool):
    """A base, added rows, and edits by key: two fields, one that is set again, null, rows that go, and rows of their keys that come after."""
    s, named = store(v), lambda *xs: F.array(*map(F.lit, xs))
    s.write("sightings", v.sightings.filter("id % 3 <> 1"))
    s.append("sightings", v.sightings.filter("id % 3 = 1"))
    ids = v.sightings.select("id")
    s.patch("sightings", ids.filter("id % 10 in (3, 5)").select("id", named("lat", "species").alias("present"), F.lit(1.0).alias("lat"), F.lit("orca").alias("species")).filter("id % 10 = 3"))
    s.patch("sightings", ids.filter("id % 10 = 3").select("id", named("species").alias("present"), F.lit("gray").alias("species")))
    if compacted:
        s.compact("sightings")
    s.patch("sightings", ids.filter("id % 10 in (3, 5)").select("id", named("lat").alias("present"), F.lit(48.25).alias("lat")))
    s.patch("sightings", ids.filter("id % 10 = 7").select("id", named("needs_review").alias("present"), F.lit(False).alias("needs_review"), F.lit("unread").alias("species")))
    s.patch("sightings", ids.filter("id % 6 = 4").select("id", named("lat", "geo_method", "needs_review").alias("present"), F.lit(None).cast("double").alias("lat"), F.lit("unresolved").alias("geo_method"), F.lit(True).alias("needs_review")))
    s.change(lambda c: c.drop("sightings", ids.filter("id % 7 = 0")))
    s.append("sightings", s.table("sightings", s.version() - 1).filter("id % 21 = 0").withColumn("location_raw", F.lit("again")))
    return rounded(s.table("sightings").select("id", "species", "lat", "geo_method", "needs_review", "location_raw"), "lat")


@query("sightings", EDITED_SQL)
def edits_by_key(v):
    """Edits are read with the rows, which stay as they are."""
    return edited_store(v, False)


@query("sightings", EDITED_SQL)
def edits_compacted(v):
    """A part of the edits, and what they edit, became a new base meanwhile."""
    return edited_store(v, True)


@query("sightings newsletters", """select cast(n.id as varchar) as id, case when n.id % 2 = 0 then 'failed' else 'complete' end as status, case when n.id % 2 = 1 then (select count(*) from v_sightings s where s.newsletter_id = n.id) else 0 end as sightings
  from v_newsletters n""")
def commits_together(v):
    """Runs and their sightings by one commit each; of every other run the work fails before its commit, and leaves nothing."""
    s = store(v)
    ids = v.newsletters.select("id")
    s.append("newsletters", changes.begun_runs(ids))
    for odd, status in ((0, "failed"), (1, "complete")):
        try:
            with_rows = v.sightings.filter(F.col("newsletter_id") % 2 == odd)
            change = Change(s)
            change.append("sightings", with_rows)
            change.patch("newsletters", ids.filter(F.col("id") % 2 == odd).select("id", F.array(F.lit("status")).alias("present"), F.lit("complete").alias("status")))
            if status == "failed":
                raise RuntimeError("the work failed")
            change.commit()
        except RuntimeError:
            s.patch("newsletters", ids.filter(F.col("id") % 2 == odd).select("id", F.array(F.lit("status")).alias("present"), F.lit("failed").alias("status")))
    counts = s.table("sightings").groupBy(F.col("newsletter_id").alias("id")).agg(F.count("*").alias("sightings"))
    return s.table("newsletters").select("id", "status").join(counts, "id", "left").fillna(0, ["sightings"])


@query("sightings gazetteer", """select 'sightings' as "table", count(*) as "rows", count(*) filter (species = 'gray') as gray, 3 as writes from (select case when id % 5 = 0 then 'gray' else species end as species from v_sightings)
  union all select 'gazetteer', count(*) filter (id % 2 = 1), 0, 3 from v_gazetteer""")
def writers_at_once(v):
    """Two changes from one state: added rows and edits both hold; a table that both replace is done anew by the later one."""
    s = store(v)
    s.write("gazetteer", aliased(v.gazetteer))
    s.write("sightings", v.sightings.filter("id % 2 = 0"))
    one, two = Change(s), Change(s)
    one.append("sightings", v.sightings.filter("id % 2 = 1"))
    one.commit()
    two.patch("sightings", v.sightings.filter("id % 5 = 0").select("id", F.array(F.lit("species")).alias("present"), F.lit("gray").alias("species")))
    two.commit()
    late = []

    def halved(c):
        rows = c.table("gazetteer").filter("id % 2 = 1")
        if not late:
            late.append(s.append("gazetteer", aliased(v.gazetteer).limit(0)))
        c.write("gazetteer", rows)

    s.change(halved)
    count = lambda name, gray: s.table(name).agg(F.lit(name).alias("table"), F.count("*").alias("rows"), gray.alias("gray"))
    facts = count("sightings", F.count_if(F.col("species") == "gray")).unionByName(count("gazetteer", F.lit(0)))
    return facts.join(F.broadcast(s.check().select("table", F.col("versions").alias("writes"))), "table")


@query("sightings newsletters", f"""select s.id, s.species, round(s.lat, 6) as lat, n.title, n.date_from, r.first_date as span_from, r.last_date as span_to from (select * from v_sightings where newsletter_id =
  (select id from v_newsletters where status = 'complete' order by date_to desc, id desc limit 1) {BY_DATE} limit 40) s, (select title, cast(date_from as varchar) as date_from from v_newsletters where status = 'complete' order by date_to desc, id desc limit 1) n,
  (select cast(min(sighting_date) as varchar) as first_date, cast(max(sighting_date) as varchar) as last_date from v_sightings) r""")
def sightings_json(v):
    """One row of JSON with rows, their issue and the archive's span, taken apart again."""
    rows = reads.paged(reads.filtered(v.sightings, issue="latest", newsletters=v.newsletters), reads.review_order(None, False), 40)
    said = reads.response(rows, v.newsletters, v.sightings, "latest")
    form = "sightings array<struct<id: bigint, species: string, lat: double>>, newsletter struct<title: string, date_from: string>, range struct<`from`: string, `to`: string>"
    j = said.select(F.from_json("response", form).alias("j")).select(F.explode("j.sightings").alias("s"), "j.newsletter", "j.range")
    return rounded(j.select("s.id", "s.species", "s.lat", "newsletter.title", "newsletter.date_from", F.col("range.from").alias("span_from"), F.col("range.to").alias("span_to")), "lat")


@query("calls", "select stage, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(call_no) as bigint) as numbers from v_calls group by stage")
def call_log(v):
    """Calls logged as JSON by stage, and read back for a replay and for their cost."""
    from tidemark.sources import readers

    log = v.calls.select("stage", F.lit(1).alias("attempt"), F.col("call_no").alias("key_no"), F.lit("end_turn").alias("stop_reason"), F.lit("[]").alias("text"), "input_tokens", "output_tokens")
    readers.write_calls(log, path := scratch(v, "calls"))
    back = readers.logged_calls(v.spark, path, "input_tokens bigint, output_tokens bigint")
    return back.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("key_no").alias("numbers"))


POOLED_SQL = f"""(select 0 as source, cast(id as bigint) as id, name, 'Verified' as type, null as county, cast(lat as double) as lat, cast(lng as double) as lng from v_gazetteer
  union all select 1, id, unnest(string_split(aliases_txt, '|')), 'Verified', null, lat, lng from v_gazetteer where aliases_txt <> ''
  union all select 2, id, name, feature_class, county, lat, lng from v_landmarks)"""


@query("sightings gazetteer landmarks", f"""select n.location_raw, cast(n.place as bigint) as place, p.name, p.type, p.county, round(p.lat, 6) as lat, round(p.lng, 6) as lng from (
  select *, row_number() over (partition by location_raw order by length(name) desc, source, id, name) as place from ({HITS_SQL.format(group='r.location_raw', join='')}) h) n join {POOLED_SQL} p using (source, id, name) where place <= 6""")
def geocode_anchors(v):
    """What requests say of each string's anchors, with their coordinates."""
    items = places.request_items(v.sightings.select("location_raw"), places.located_pool(aliased(v.gazetteer), v.landmarks))
    told_ = items.select("location_raw", F.from_json(F.to_json("item"), "anchors array<struct<name: string, type: string, county: string, lat: double, lng: double>>").alias("i"))
    flat = told_.select("location_raw", F.posexplode("i.anchors").alias("pos", "a"))
    return rounded(flat.select("location_raw", (F.col("pos") + 1).cast("long").alias("place"), "a.*"), "lat", "lng")


@query("answers edges", f"""select input, cast(floor((row_number() over (order by input) - 1) / 60) as bigint) as batch_no from (select a.input, round(n.d) as m from (select * from v_answers where attempt = 1 and confidence <> 'none' and lat > 45 and lat < 52 and lng > -130 and lng < -120) a
  join ({near_sql(ANSWERS.format(1))}) n on n.id = a.pos left join ({wet_sql(ANSWERS.format(1))}) w on w.id = a.pos where w.id is null) x where m between 1 and 5000""")
def retry_selection(v):
    """The strings that a second request asks for: placed on land, not too far inland."""
    from tidemark.plans import api

    none = v.spark.createDataFrame([], api.SCHEMAS["gazetteer"]), v.spark.createDataFrame([], api.SCHEMAS["landmarks"])
    return api.retry_requests(v.answers, v.edges, *none).select(F.explode("inputs").alias("input"), "batch_no")


@query("sightings gazetteer landmarks answers edges", f""", g as (select location_raw, min(rk) % 100000 as gid from (
    select s.location_raw, k.rank * 100000 + k.id as rk from (select distinct location_raw from v_sightings) s join (
      select id, 0 as rank, {NORM.format('name')} as k from v_gazetteer union all
      select id, 1, unnest(string_split(aliases_txt, '|')) from v_gazetteer where aliases_txt <> '') k on k.k = {NORM.format('s.location_raw')}) x group by location_raw),
  l as (select {NORM.format('name')} as k, min(id) as lid from v_landmarks where feature_class in ({WATER_SQL}) group by 1 having count(*) = 1),
  a as (select *, pos * 2 + attempt as id from (select input, pos, attempt, confidence, cast(lat as double) as lat, cast(lng as double) as lng from v_answers) q where confidence <> 'none' and lat > 45 and lat < 52 and lng > -130 and lng < -120),
  m as (select n.id, case when w.id is not null then 0 else round(n.d) end as m from ({near_sql('select id, lat, lng from a')}) n left join ({wet_sql('select id, lat, lng from a')}) w on w.id = n.id),
  b as (select distinct on (input) input, lat, lng, m from a join m using (id) where input in (select input from a where attempt = 1) order by input, m, attempt)
  select s.id, case when g.gid is not null then 'gazetteer' when l.lid is not null then 'landmark' when b.input is not null then 'ai' else 'unresolved' end as geo_method,
    round(case when g.gid is not null then cast(vg.lat as double) when l.lid is not null then cast(vl.lat as double) else b.lat end, 6) as lat,
    round(case when g.gid is not null then cast(vg.lng as double) when l.lid is not null then cast(vl.lng as double) else b.lng end, 6) as lng,
    case when g.gid is not null or l.lid is not null then false when b.input is not null then b.m <> 0 else true end as needs_review
  from v_sightings s left join g on g.location_raw = s.location_raw left join v_gazetteer vg on vg.id = g.gid left join l on l.k = {NORM.format('s.location_raw')} left join v_landmarks vl on vl.id = l.lid left join b on b.input = s.location_raw""")
def resolve_chain(v):
    from tidemark.operators import resolve

    out = resolve.resolved(v.sightings, aliased(v.gazetteer), v.landmarks, v.answers, v.edges)
    return rounded(out, "lat", "lng")


@query("issue_lines", f"select issue, count(*) as reports from (select issue from v_issue_lines where line = '-') x group by issue")
def extraction_separators(v):
    """The chunks that go to extraction hold every report separator under a banner."""
    found = issues.chunk_diagnostics(issues.chunks(v.issue_lines))
    return found.groupBy("issue").agg(F.sum("separators").alias("reports"))
