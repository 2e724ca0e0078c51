"""Runs of several tables that become visible as one, and analyses that follow edits of the review.

A run's tables are written apart and listed in a manifest, which is put in place last; readers go by the manifest,
so a run is there as a whole or not at all.

Reviewed analyses are stored in buckets of clips.  A new review version is compared with the one before by
digests of its parts; what a result reads of the review says which of its buckets are
worked out again, from the stored observations of these buckets alone.  All other buckets
of the version point at the files of an earlier one, and no version's files are changed.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluation, motion, review
from ..operators.timeline import CLIP

MANIFEST = "MANIFEST.json"
#: Buckets of clips: what is read and rewritten at least when one clip's review changes.
BUCKETS = 64


class Folder:
    """Small files below a folder, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._spark = spark

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def claim(self, name: str) -> bool:
        """Create an empty file; false if it is there already."""
        self._fs.mkdirs(self._at(name).getParent())
        return self._fs.createNewFile(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def put(self, name: str, text: str) -> None:
        """Write a file under another name and move it into place."""
        self._fs.mkdirs(self._at(name).getParent())
        aside = self._at(f"{name}.{uuid.uuid4().hex}._tmp")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(name) or not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{self.root}/{name} is there already")

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise FileNotFoundError(f"{self.root}/{name}")
        return self._spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]


def publish_run(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Write all ``tables`` as run ``run``; none can be read before all are complete.

    Only one writer at a time may claim a run, and a published one is never replaced.  A failure removes what was
    written, leaves a note of its cause under ``_failed`` and the name free for another attempt.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, attempt = Folder(spark, root), uuid.uuid4().hex
    if not folder.claim(f"{run}/_claim"):
        raise FileExistsError(f"run {run} is being written by another writer")
    try:
        if folder.exists(f"{run}/{MANIFEST}"):
            raise FileExistsError(f"run {run} is published already")
        entries = []
        for name, df in tables.items():
            path = f"{run}/{attempt}/{name}"
            df.write.mode("errorifexists").parquet(f"{folder.root}/{path}")
            entries.append({"table": name, "path": path, "schema": df.schema.json(), "n_rows": spark.read.schema(df.schema).parquet(f"{folder.root}/{path}").count()})
        folder.put(f"{run}/{MANIFEST}", json.dumps({"run": run, "tables": entries}))
    except BaseException as failure:
        folder.remove(f"{run}/{attempt}")
        folder.put(f"_failed/{run}-{attempt}.json", json.dumps({"run": run, "error": str(failure)[:2000]}))
        raise
    finally:
        folder.remove(f"{run}/_claim")


def read_run(spark: SparkSession, root: str, run: str) -> dict[str, DataFrame]:
    """The tables of a published run."""
    folder = Folder(spark, root)
    listed = json.loads(folder.read(f"{run}/{MANIFEST}"))["tables"]
    return {t["table"]: spark.read.schema(T.StructType.fromJson(json.loads(t["schema"]))).parquet(f"{folder.root}/{t['path']}") for t in listed}


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """Rows ``run, table, n_rows`` of all published runs; runs in the making or failed have none."""
    manifests = spark.read.schema("run string, tables array<struct<table:string,n_rows:long>>").json(f"{root.rstrip('/')}/*/{MANIFEST}")
    return manifests.select("run", F.explode("tables").alias("t")).select("run", "t.table", "t.n_rows")


# Analyses under review versions ------------------------------------------------------

#: Parts of a review, and the observations that results read.
PARTS = ("identity", "rallies", "events", "targets")
OBSERVED = ("motion", "frames", "clips")


def _doubles(t: dict[str, DataFrame]) -> DataFrame:
    return t["labelled"].join(t["clips"].where("mode = 'doubles'").select(CLIP), CLIP, "left_semi")


#: Each result's parts of the review and how it follows from them and the observations.
RESULTS: dict[str, tuple[tuple[str, ...], Callable[[dict[str, DataFrame]], DataFrame]]] = {
    "fragment_summary": (("identity",), lambda t: motion.fragment_summary(t["labelled"], t["frames"])),
    "identified_players": (("identity",), lambda t: review.identified_players(motion.fragment_summary(t["labelled"], t["frames"]))),
    "pair_spacing": (("identity",), lambda t: review.pair_spacing(_doubles(t))),
    "pair_summary": (("identity",), lambda t: review.pair_summary(review.pair_spacing(_doubles(t)))),
    "rally_summary": (("identity", "rallies"), lambda t: review.rally_summary(t["rallies"], t["labelled"], t["frames"])),
    "reviewed_events": (("identity", "events"), lambda t: review.reviewed_events(t["events"], t["labelled"])),
    "events_in_rallies": (("events", "rallies"), lambda t: review.events_in_rallies(t["events"], review.rally_spans(t["rallies"], t["frames"]))),
    "recovery": (("identity", "targets"), lambda t: review.recovery(t["targets"], t["labelled"], t["frames"])),
}


class ReviewedAnalysis:
    """Results of stored observations under versions of the review, in one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, Folder(spark, root), buckets

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(CLIP), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, path: str) -> None:
        """Partitions of the rows at hand are put in place, others stay: a repeated attempt replaces its own."""
        rows = self._dealt(df)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder.root}/{path}"))

    def _read(self, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder.root}/{path}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def observe(self, tables: dict[str, DataFrame]) -> None:
        """Store the observations (``motion``, ``frames``, ``clips``), once."""
        for name in OBSERVED:
            self._write(tables[name], f"observations/{name}")
        self.folder.put("observations/schemas.json", json.dumps({name: tables[name].schema.json() for name in OBSERVED}))

    def _state(self, version: str) -> dict:
        return json.loads(self.folder.read(f"versions/{version}.json"))

    def _review(self, part: str, version: str, buckets: list[int] | None = None) -> DataFrame:
        return self._read(f"reviews/{part}/version={version}", T.StructType.fromJson(json.loads(self._state_schema(part, version))), buckets)

    def _state_schema(self, part: str, version: str) -> str:
        return json.loads(self.folder.read(f"reviews/{part}/{version}.json"))["schema"]

    def edited(self, parts: dict[str, DataFrame], base: str) -> dict[str, list[int]]:
        """Buckets that hold a clip whose rows differ from version ``base``, for each part of the review: at most ``buckets`` numbers each."""
        out = {}
        for name, new in parts.items():
            old = self._review(name, base).select(*new.columns)
            clips = evaluation.changed_clips(evaluation.clip_digests(old), evaluation.clip_digests(new))
            out[name] = sorted(r.bucket for r in self._dealt(clips).select("bucket").distinct().collect())
        return out

    def run(self, parts: dict[str, DataFrame], version: str, base: str | None = None, results: tuple[str, ...] = tuple(RESULTS)) -> dict[str, list[int]]:
        """Store a review version and its ``results``; returns the buckets that each result was worked out for.

        With ``base`` only the buckets that the edit reaches are; without, all.
        """
        if self.folder.exists(f"versions/{version}.json"):
            raise FileExistsError(f"version {version} is there already")
        every = list(range(self.buckets))
        for name in PARTS:
            self._write(parts[name], f"reviews/{name}/version={version}")
            if not self.folder.exists(f"reviews/{name}/{version}.json"):
                self.folder.put(f"reviews/{name}/{version}.json", json.dumps({"schema": parts[name].schema.json()}))
        stored = {name: self._review(name, version) for name in PARTS}
        changed = self.edited(stored, base) if base else {name: every for name in PARTS}
        before = self._state(base)["results"] if base else {}
        schemas = json.loads(self.folder.read("observations/schemas.json"))
        done, state = {}, {}
        for name in results:
            reads, work = RESULTS[name]
            buckets = sorted({b for part in reads for b in changed[part]})
            where = {int(b): v for b, v in before[name]["at"].items()} if base else {}
            schema = before[name]["schema"] if base else None
            if buckets:
                t = {o: self._read(f"observations/{o}", T.StructType.fromJson(json.loads(schemas[o])), buckets) for o in OBSERVED}
                t |= {part: self._review(part, version, buckets) for part in PARTS}
                t["labelled"] = motion.with_identity(t["motion"], t["identity"])
                result = work(t)
                self._write(result, f"results/{name}/version={version}")
                schema = result.schema.json()
                where |= {b: version for b in buckets}
            done[name], state[name] = buckets, {"schema": schema, "at": where}
        self.folder.put(f"versions/{version}.json", json.dumps({"version": version, "base": base, "results": state}))
        return done

    def result(self, name: str, version: str) -> DataFrame:
        """A result under a version, from the files of the versions that its buckets were last worked out for."""
        state, out = self._state(version)["results"][name], None
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        for source in sorted(set(state["at"].values())):
            rows = self._read(f"results/{name}/version={source}", schema, [int(b) for b, v in state["at"].items() if v == source])
            out = rows if out is None else out.unionByName(rows)
        return out
