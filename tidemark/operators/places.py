"""From free text to places: exact lookup, aliases, unique landmarks, and anchors for what is left."""

from __future__ import annotations

import itertools
import sys

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import bracket_readings, norm
from tidemark.functions.vocab import GENERIC_NAMES, MOST_ANCHORS, SHORTEST_ANCHOR, WATER_CLASSES
from tidemark.operators.scans import stored

# The search travels by value, so that a worker needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of names that one automaton holds (it takes about 40 times as many); up to that, they are broadcast.
MOST_TABLE = 4 << 20
#: Tasks that share the readings of one table of names beyond that.
SHARES = 16


def by_gazetteer(strings: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(location_raw, gazetteer_id): name equal after norm(), else alias equal; the first by id. gazetteer has aliases as an array."""
    names = gazetteer.select(norm(F.col("name")).alias("key"), F.lit(0).alias("rank"), "id")
    aliases = gazetteer.select(F.explode("aliases").alias("alias"), "id").select(norm(F.col("alias")).alias("key"), F.lit(1).alias("rank"), "id")
    first = names.unionByName(aliases).groupBy("key").agg(F.min(F.struct("rank", "id")).alias("first"))
    keyed = strings.select("location_raw").distinct().withColumn("key", norm(F.col("location_raw")))
    return keyed.join(first, "key").select("location_raw", F.col("first.id").alias("gazetteer_id"))


def by_landmark(strings: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(location_raw, landmark_id): the one landmark of a water class with this name; none if there are several."""
    unique = landmarks.filter(F.col("feature_class").isin(WATER_CLASSES)).groupBy(norm(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("landmark_id")).filter("n = 1")
    keyed = strings.select("location_raw").distinct().withColumn("key", norm(F.col("location_raw")))
    return keyed.join(unique, "key").select("location_raw", "landmark_id")


def ambiguous(landmarks: DataFrame) -> DataFrame:
    return landmarks.groupBy(norm(F.col("name")).alias("name")).agg(F.count("*").alias("features")).filter("features > 1")


def anchor_pool(gazetteer: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(source, id, name): verified names and aliases, then landmarks that no verified name covers."""
    return located_pool(gazetteer, landmarks).select("source", "id", "name")


def located_pool(gazetteer: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(source, id, name, type, county, lat, lng): anchor_pool() with what a request tells of each anchor."""
    spot = [F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")]
    verified_ = [F.lit("Verified").alias("type"), F.lit(None).cast("string").alias("county"), *spot]
    names = gazetteer.select(F.lit(0).alias("source"), F.col("id").cast("long").alias("id"), "name", *verified_)
    aliases = gazetteer.select(F.lit(1).alias("source"), F.col("id").cast("long").alias("id"), F.explode("aliases").alias("name"), *verified_)
    verified = gazetteer.select(norm(F.col("name")).alias("key")).distinct()
    federal = landmarks.join(verified, norm(F.col("name")) == F.col("key"), "left_anti")
    return names.unionByName(aliases).unionByName(federal.select(F.lit(2).alias("source"), F.col("id").cast("long").alias("id"), "name", F.col("feature_class").alias("type"), "county", *spot))


def automaton(names: list[str]):
    table = ahocorasick.Automaton()
    for name in names:
        table.add_word(name, name)
    table.make_automaton()
    return table


def found_rows(readings: list[str], table) -> pa.RecordBatch:
    """(reading, needle) for each name that a reading has, by one pass over it."""
    rows = [(r, n) for r in readings for n in {n for _, n in table.iter(r)}] if len(table) else []
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)], names=["reading", "needle"])


def occurrences(readings: DataFrame, needles: DataFrame) -> DataFrame:
    """(reading, needle) for each distinct name (needle, at least SHORTEST_ANCHOR letters) that a reading contains.

    Names up to MOST_TABLE bytes are one automaton, built once a Python worker. More are dealt to tables of that size by their
    first letters; a reading goes to the tables that its own letters name, to one of SHARES tasks each, and each task reads its
    table's names before its readings.
    """
    needles = stored(needles.distinct())
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]
    form = "reading string, needle string"
    if size <= MOST_TABLE:
        known = needles.sparkSession.sparkContext.broadcast(sorted(r.needle for r in needles.collect()))

        def search(batches):
            table = automaton(known.value)
            for batch in batches:
                yield found_rows(batch.column(0).to_pylist(), table)

        return readings.select("reading").distinct().mapInArrow(search, form)
    tables = -(-size // MOST_TABLE)
    table_of = lambda letters: F.pmod(F.xxhash64(letters), F.lit(tables))
    share = F.pmod(F.xxhash64("reading", F.lit(1)), F.lit(SHARES))
    starts = F.sequence(F.lit(1), F.greatest(F.length("reading") - SHORTEST_ANCHOR + 1, F.lit(1)))
    named = F.array_distinct(F.transform(starts, lambda i: table_of(F.substr("reading", i, F.lit(SHORTEST_ANCHOR)))))
    sent = readings.select("reading").distinct().select(F.explode(named).alias("table"), share.alias("share"), F.lit(1).alias("kind"), F.col("reading").alias("text"))
    known = needles.select(table_of(F.left("needle", F.lit(SHORTEST_ANCHOR))).alias("table"), F.explode(F.sequence(*(F.lit(i).cast("long") for i in (0, SHARES - 1)))).alias("share"), F.lit(0).alias("kind"), F.col("needle").alias("text"))

    def search_dealt(batches):
        place, names, table = None, [], None
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (own, kind), some in itertools.groupby(rows, key=lambda r: (r[:2], r[2])):
                texts = [r[3] for r in some]
                if own != place:
                    place, names, table = own, [], None
                if kind == 0:
                    names += texts
                else:
                    table = table or automaton(names)
                    yield found_rows(texts, table)

    keys = ["table", "share"]
    return known.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(search_dealt, form)


def anchors(strings: DataFrame, pool: DataFrame, most: int = MOST_ANCHORS, group: str = "location_raw") -> DataFrame:
    """(group, source, id, name, place): pool names that occur in any reading of a string, longest first, `most` at most."""
    names = pool.withColumn("needle", F.lower("name")).filter((F.length("needle") >= SHORTEST_ANCHOR) & ~F.col("needle").isin(GENERIC_NAMES))
    readings = strings.filter("location_raw is not null").select(*dict.fromkeys([group, "location_raw"])).distinct().withColumn("reading", F.explode(F.transform(bracket_readings(F.col("location_raw")), F.lower)))
    found = occurrences(readings, names.select("needle"))
    hits = readings.select(group, "reading").join(found, "reading").select(group, "needle").distinct().join(names, "needle").select(group, "source", "id", "name").distinct()
    order = Window.partitionBy(group).orderBy(F.length("name").desc(), "source", "id", "name")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def request_items(strings: DataFrame, pool: DataFrame) -> DataFrame:
    """(location_raw, item): what a request says of each string: the string itself, and its anchors with their coordinates."""
    found = anchors(strings, pool.select("source", "id", "name")).join(pool, ["source", "id", "name"])
    anchor = F.struct("name", "type", "county", "lat", "lng")
    listed = found.groupBy("location_raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", anchor.alias("a")))), lambda x: x["a"]).alias("anchors"))
    return strings.select("location_raw").distinct().join(listed, "location_raw", "left").select("location_raw", F.struct(F.col("location_raw").alias("input"), "anchors").alias("item"))


def batches(strings: DataFrame, size: int) -> DataFrame:
    """(location_raw, batch_no): distinct strings in batches of `size`, in the order of their first sighting."""
    first = strings.groupBy("location_raw").agg(F.min("id").alias("first_id"))
    from tidemark.operators.measures import numbered

    return numbered(first, ["first_id"], "n").select("location_raw", F.floor((F.col("n") - 1) / size).alias("batch_no"))
