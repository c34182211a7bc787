"""A store of Parquet tables: writes to several tables become visible at once, and edits are small files beside the rows.

A commit is a manifest, a small JSON file under a number of its own. It names the parts of every table: a base, rows that
were added since, and edits. Readers take one manifest, and so see all tables as of one commit. Parts are written
before their manifest; what never gets one is never read. The file of a number can be made only once, so that of two
writers the later one looks again at what has been committed meanwhile.

Edits are keyed rows: a patch carries the names of the fields that it sets, a drop none. A table is read as its rows and the
edits of their keys, folded in the order of the commits. Bases are bucketed by key, so that no edit makes them move.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes
from tidemark.sources import readers

SCHEMAS = {
    "newsletters": "id string, title string, status string, date_from date, date_to date, sighting_count bigint, warning_text string, pasted_at timestamp",
    "sightings": "id bigint, newsletter_id string, sighting_date date, sighting_time string, species string, species_raw string, pod_or_group string, individual_ids array<string>, sighting_count int, direction string, behaviors array<string>, "
    "detection_methods array<string>, location_raw string, gazetteer_id bigint, landmark_id bigint, lat double, lng double, geo_method string, needs_review boolean, summary string, raw_excerpt string, reporter string, report_kind string, ai_reasoning string, ai_confidence string",
    "gazetteer": "id bigint, name string, aliases array<string>, lat double, lng double, region string",
    "landmarks": readers.LANDMARKS,
    "edges": "poly_id bigint, k int, x1 double, y1 double, x2 double, y2 double",
    "calls": f"issue string, {readers.CALLS}, request string",
}
#: Tables whose rows have a key, by which they are edited and bucketed.
KEYED = {"newsletters": "id", "sightings": "id", "gazetteer": "id"}
#: Rows and edits of a bucket. A task that folds edits into rows has one bucket, and takes about 2 KB a row.
PER_BUCKET = 100_000
LEAST_BUCKETS = 8


class Conflict(RuntimeError):
    """Another commit has touched a table that this one replaces, or builds on."""


class Store:
    def __init__(self, spark: SparkSession, base: str, buckets: int | None = None):
        """buckets: of each base that is written from now on; by default one for PER_BUCKET rows, and LEAST_BUCKETS at least."""
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    # ---- manifests

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, files.makeQualified(path)

    def version(self) -> int:
        """The number of the last commit, 0 where there is none."""
        files, log = self._files(f"{self.base}/_log")
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """{"version", "tables": {name: {"parts": [{"kind", "path", "at", "buckets", "rows"}], "last", "writes"}}} as of a commit, the last one if none is given."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}}
        files, path = self._files(f"{self.base}/_log/{version:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict[str, Any]) -> bool:
        """Makes the file of the manifest's number, whole or not at all; False if that number is taken.

        A link (local files) or a rename that never replaces (others) is what makes it one step; object stores without
        such a rename are not supported.
        """
        files, target = self._files(f"{self.base}/_log/{manifest['version']:012d}.json")
        _, draft = self._files(f"{self.base}/_log/{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if draft.toUri().getScheme() == "file":
                of = jvm.java.nio.file.Paths.get
                jvm.java.nio.file.Files.createLink(of(target.toUri()), of(draft.toUri()))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        finally:
            files.delete(draft, False)
        return True

    # ---- reading

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the last one if none is given; empty where nothing was written yet."""
        return self.at(name, self.manifest(version))

    def at(self, name: str, manifest: dict[str, Any]) -> DataFrame:
        form = self.spark.createDataFrame([], SCHEMAS[name]).schema
        parts = manifest["tables"].get(name, {"parts": []})["parts"]
        rows = [(p["buckets"], self._part(name, p, form).withColumn("_at", F.lit(p["at"]))) for p in parts if p["kind"] != "edits"]
        if not rows:
            return self.spark.createDataFrame([], form)
        edits = [self.spark.read.schema(edit_form(name)).parquet(f"{self.base}/{p['path']}").withColumn("_at", F.lit(p["at"])) for p in parts if p["kind"] == "edits"]
        if not edits:
            return union([r for _, r in rows]).select(*form.names)
        # All sides are dealt to the same number of tasks, which grows with the table; a base that has as many buckets stays where it is.
        key, n = KEYED[name], dealt_to(parts)
        by_key = grouped_edits(union(edits).repartition(n, key), key)
        still, moved = [r for b, r in rows if b == n], [r for b, r in rows if b != n]
        sides = still + ([union(moved).repartition(n, key)] if moved else [])
        return union([edited(r, by_key, key, form.names) for r in sides]).select(*form.names)

    def _part(self, name: str, part: dict[str, Any], form) -> DataFrame:
        """Spark knows of buckets by its catalog only, so a bucketed part is named there, once a session."""
        path = f"{self.base}/{part['path']}"
        if not part["buckets"]:
            return self.spark.read.schema(form).parquet(path)
        known = f"tidemark_{part['path'].replace('/', '_')}"
        if not self.spark.catalog.tableExists(known):
            columns, key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in form), KEYED[name]
            place = self._files(path)[1].toString().replace("'", "\\'")
            self.spark.sql(f"create table {known} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {part['buckets']} buckets location '{place}'")
        return self.spark.table(known)

    def check(self) -> DataFrame:
        """(table, columns, rows, versions, names, types) of each table; names and types are those of its columns, in order."""
        literal = lambda xs: F.array(*map(F.lit, xs))
        manifest = self.manifest()

        def of(name):
            df, writes = self.at(name, manifest), manifest["tables"].get(name, {"writes": 0})["writes"]
            return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(len(df.columns)).alias("columns"), "rows", F.lit(writes).alias("versions"), literal(df.columns).alias("names"), literal([t for _, t in df.dtypes]).alias("types"))

        return union([of(n) for n in SCHEMAS])

    # ---- writing

    def change(self, work: Callable[[Change], Any], tries: int = 10) -> Any:
        """Does `work` and commits it; where another commit was in the way, all over again from the new state."""
        for left in reversed(range(tries)):
            change = Change(self)
            out = work(change)
            try:
                change.commit()
                return out
            except Conflict:
                if not left:
                    raise

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces a table by a new base."""
        self.change(lambda c: c.write(name, df))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table; what is there is not read or written again."""
        self.change(lambda c: c.append(name, df))

    def patch(self, name: str, patches: DataFrame) -> None:
        """Edits rows by key: see Change.patch."""
        self.change(lambda c: c.patch(name, patches))

    def compact(self, name: str) -> None:
        """Base, added rows and edits become one base; what reads get is the same."""
        self.change(lambda c: c.write(name, c.table(name), sum(p.get("rows", 0) for p in c.start["tables"].get(name, {"parts": []})["parts"] if p["kind"] != "edits") or None))

    def kept(self, df: DataFrame) -> DataFrame:
        """Rows written to the store's work folder and read again: later steps start from there."""
        path = f"{self.base}/_work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def clean(self) -> None:
        """Deletes the work folder, and the parts and manifests that the last commit does not need; nobody may be writing meanwhile."""
        manifest = self.manifest()
        needed = {p["path"] for t in manifest["tables"].values() for p in t["parts"]}
        files, base = self._files(self.base)
        for name in [s.getPath().getName() for s in files.listStatus(base)] if files.exists(base) else []:
            if name == "_work":
                files.delete(self._files(f"{self.base}/{name}")[1], True)
                continue
            for s in files.listStatus(self._files(f"{self.base}/{name}")[1]):
                own = s.getPath().getName()
                old = name == "_log" and own.endswith(".json") and own != f"{manifest['version']:012d}.json"
                if old or name in SCHEMAS and f"{name}/{own}" not in needed:
                    files.delete(s.getPath(), True)


class Change:
    """What is to become one commit. It reads all tables as of the commit that it started from."""

    def __init__(self, store: Store):
        self.store, self.start = store, store.manifest()
        self.parts: list[tuple[str, dict[str, Any]]] = []
        self.alone: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self.store.at(name, self.start)

    def guard(self, name: str) -> None:
        """The commit holds only if no other touches this table before it."""
        self.alone.add(name)

    def _save(self, name: str, kind: str, writer, buckets: int = 0) -> None:
        part = {"kind": kind, "path": f"{name}/{uuid.uuid4().hex}", "buckets": buckets}
        writer(path := f"{self.store.base}/{part['path']}", f"tidemark_{part['path'].replace('/', '_')}")
        # The files' footers have the number of rows.
        self.parts.append((name, part | {"rows": self.store.spark.read.schema(edit_form(name)).parquet(path).count()}))

    def write(self, name: str, df: DataFrame, rows: int | None = None) -> None:
        """Replaces a table; the commit conflicts with any other that touches it meanwhile.

        rows: about as many as df has, if that is known; they are counted for a table with a key otherwise.
        """
        self.guard(name)
        df, key, n = in_form(self.store.spark, name, df), KEYED.get(name), self.store.buckets
        if key:
            n = n or max(LEAST_BUCKETS, -(-(df.count() if rows is None else rows) // PER_BUCKET))
            self._save(name, "base", lambda path, known: df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", self.store._files(path)[1].toString()).format("parquet").saveAsTable(known), n)
        else:
            self._save(name, "base", lambda path, _: df.write.parquet(path))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows; never conflicts."""
        self._save(name, "rows", lambda path, _: in_form(self.store.spark, name, df).write.parquet(path))

    def patch(self, name: str, patches: DataFrame) -> None:
        """Sets fields of the rows of a key. patches: the key, `present` (names of the fields to set) and their values.

        A field that is present is set, be it to null. Of several patches of a field, the last commit's holds, and within a
        commit that of the last call; a call has one row a key. Keys that the table lacks are ignored. Never conflicts, so it may not hang on
        what was read, unless that is guarded.
        """
        self._edit(name, patches.withColumn("gone", F.lit(False)))

    def drop(self, name: str, keys: DataFrame) -> None:
        """Takes away the rows of these keys that are there by this commit; later rows of such a key stay."""
        self._edit(name, keys.select(KEYED[name], F.array().cast("array<string>").alias("present"), F.lit(True).alias("gone")))

    def _edit(self, name: str, edits: DataFrame) -> None:
        form = self.store.spark.createDataFrame([], edit_form(name)).schema
        edits = edits.withColumn("call", F.lit(len(self.parts)))
        columns = [(F.col(f.name) if f.name in edits.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in form]
        self._save(name, "edits", lambda path, _: edits.select(*columns).write.parquet(path))

    def commit(self) -> int:
        """Makes all parts visible at once, and returns the commit's number; raises Conflict if it may not."""
        if not self.parts:
            return self.start["version"]
        while True:
            now = self.store.manifest()
            for name in self.alone:
                if now["tables"].get(name, {"last": 0})["last"] > self.start["version"]:
                    raise Conflict(f"{name} was written by commit {now['tables'][name]['last']}, after {self.start['version']}")
            number = now["version"] + 1
            tables = {n: dict(t) for n, t in now["tables"].items()}
            for name, part in self.parts:
                old = tables.get(name, {"parts": [], "last": 0, "writes": 0})
                before = [] if part["kind"] == "base" else old["parts"]
                tables[name] = {"parts": [*before, part | {"at": number}], "last": number, "writes": old["writes"] + (old["last"] < number)}
            if self.store.publish({"version": number, "tables": tables}):
                return number


def dealt_to(parts: list[dict[str, Any]]) -> int:
    """The tasks that a table's edits are folded in: the buckets of its base, or more where rows and edits have outgrown them."""
    return max(1, *(p["buckets"] for p in parts), -(-sum(p.get("rows", 0) for p in parts) // PER_BUCKET))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_form(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    form = spark.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in form))


def edit_form(name: str) -> str:
    return f"{SCHEMAS[name]}, present array<string>, gone boolean, call int"


def grouped_edits(edits: DataFrame, key: str) -> DataFrame:
    """(_key, _edits): each key's edits in order; there are as many as were made since the last compaction."""
    order = ["_at", "call"]
    return edits.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in edits.columns if c not in (*order, key))))).alias("_edits"))


def edited(rows: DataFrame, by_key: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows after the edits that were committed after them."""
    own = [c for c in columns if c != key]
    df = rows.join(by_key, rows[key] == by_key["_key"], "left")
    start = F.struct(F.lit(True).alias("_there"), *(F.col(c) for c in own))

    def step(row, edit):
        new = changes.patched_fields(edit["present"], {c: row[c] for c in own}, {c: edit[c] for c in own})
        return F.struct((row["_there"] & ~edit["gone"]).alias("_there"), *(new[c].alias(c) for c in own))

    later = F.filter("_edits", lambda e: e["_at"] > F.col("_at"))
    # Rows without edits skip the fold.
    df = df.withColumn("_row", F.when(F.col("_edits").isNull(), start).otherwise(F.aggregate(later, start, step)))
    return df.filter("_row._there").select(key, *(F.col(f"_row.{c}").alias(c) for c in own), "_at")
