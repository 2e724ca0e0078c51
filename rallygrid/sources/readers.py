"""Per-clip files to tables.

``clip_id`` is the name of the folder a file lies in.  Files are one JSON
document per clip, as the tools that produce observations write them; the
reader turns them into rows once, and Parquet is the format to keep.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import CORNER_ORDER, MEDIA_SUFFIXES
from .. import schemas
from .long_json import LongDocuments


def clip_of_path(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(path), r"([^/]+)/[^/]+$", 1)


def _documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """One row per file.  A byte order mark in front of the text is dropped."""
    text = spark.read.text(path, wholetext=True).select(
        clip_of_path(F.input_file_name()).alias("clip_id"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return text.withColumn("doc", F.from_json("value", schema))


def long_frames(spark: SparkSession, path: str, frame, range_bytes: int) -> DataFrame:
    """Rows ``clip_id, f`` of documents too long for one task, cut into byte ranges; ranges that are no frames give none (``LongDocuments.faults`` lists them)."""
    docs = LongDocuments(spark, path, frame, range_bytes=range_bytes)
    version = F.from_json(F.regexp_replace("header", "^\ufeff", ""), "struct<schema_version:string>")["schema_version"]
    good = docs.headers().where(version == "1.0").select("path")  # a row for each file
    return docs.frames().where("problem is null").join(good, "path", "left_semi").select(clip_of_path(F.col("path")).alias("clip_id"), "f")


def read_shuttle(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Shuttle rows; documents of another version or without frames give none (see :func:`rejected_documents`).

    With ``range_bytes`` a document is read by as many tasks as it has ranges of that size.
    """
    if range_bytes:
        return long_frames(spark, path, schemas.DETECTION, range_bytes).select("clip_id", "f.*")
    d = _documents(spark, path, schemas.document(schemas.DETECTION)).where("doc.schema_version = '1.0'")
    return d.select("clip_id", F.explode("doc.frames").alias("f")).select("clip_id", "f.*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    d = _documents(spark, path, schemas.document(schemas.DETECTION))
    return d.select("clip_id", F.col("doc.schema_version").alias("schema_version"), F.col("doc.metadata").alias("metadata"))


def rejected_documents(spark: SparkSession, path: str) -> DataFrame:
    """Observation files that cannot be used, with the reason."""
    d = _documents(spark, path, schemas.document(schemas.DETECTION))
    reason = (F.when(F.col("doc").isNull() | F.col("doc.schema_version").isNull(), "unreadable")
               .when(F.col("doc.schema_version") != "1.0", "unsupported_version")
               .when(F.coalesce(F.size("doc.frames"), F.lit(0)) <= 0, "no_frames"))
    return d.select("clip_id", reason.alias("reason")).where("reason is not null")


def read_players(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, observations); frames without players stay in the first table.  ``range_bytes`` as for shuttle rows."""
    if range_bytes:
        rows = long_frames(spark, path, schemas.PLAYER_FRAME, range_bytes).select("clip_id", "f.*")
    else:
        d = _documents(spark, path, schemas.document(schemas.PLAYER_FRAME)).where("doc.schema_version = '1.0'")
        rows = d.select("clip_id", F.explode("doc.frames").alias("f")).select("clip_id", "f.*")
    obs = rows.select("clip_id", "frame_index", "timestamp_s", F.explode("players").alias("p")).select(
        "clip_id", "frame_index", "timestamp_s", "p.*")
    return rows.drop("players"), obs


def read_calibrations(spark: SparkSession, path: str, clips: DataFrame | None = None) -> DataFrame:
    """One row per calibration, corners as eight columns; ``problem`` names what makes it unusable."""
    d = _documents(spark, path, schemas.CALIBRATION).select("clip_id", "doc.*")
    xy = [F.try_element_at(F.try_element_at("corners_px", F.lit(i + 1)), F.lit(j + 1)).alias(f"{'xy'[j]}{i}") for i in range(4) for j in range(2)]
    out = d.select("clip_id", F.get("source_dimensions", F.lit(0)).alias("width"), F.get("source_dimensions", F.lit(1)).alias("height"), *xy,
                   F.coalesce(F.trim("method"), F.lit("manual")).alias("method"), F.coalesce("reference_frame", F.lit(0)).alias("reference_frame"),
                   F.coalesce(F.lower(F.col("metadata")["manually_reviewed"]) == "true", F.lit(False)).alias("manually_reviewed"),
                   F.col("metadata")["input_video_sha256"].alias("source_digest"), "corner_order", F.size("corners_px").alias("n"))
    order = F.array(*[F.lit(c) for c in CORNER_ORDER])
    problem = F.when(F.col("n") != 4, "not_four_corners").when(F.col("corner_order") != order, "corner_order_unsupported")
    if clips is not None:
        out = out.join(clips.select("clip_id", F.col("width").alias("cw"), F.col("height").alias("ch")), "clip_id", "left")
        problem = problem.when((F.col("cw") != F.col("width")) | (F.col("ch") != F.col("height")), "dimensions_differ")
    return out.withColumn("problem", problem).drop("corner_order", "n", "cw", "ch")


def read_reviews(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Annotations as tables: reviews, identity, rallies, events, targets.

    List order is kept in ``ordinal``.  ``raw`` holds the text for the shape check.
    """
    d = _documents(spark, path, schemas.REVIEW)
    one = d.select("clip_id", "doc.*")

    def items(name: str) -> DataFrame:
        return one.select("clip_id", F.posexplode(name).alias("ordinal", "i")).select("clip_id", F.col("ordinal").cast("long"), "i.*")
    return {
        "raw": d.select("clip_id", "value"),
        "reviews": one.select("clip_id", F.lower("source_video_sha256").alias("source_digest")),
        "identity": one.select("clip_id", F.explode("identity_map").alias("track", "i")).select(
            "clip_id", F.expr("try_cast(track as bigint)").alias("track_id"), F.trim("i.player_label").alias("player_label"), "i.side", "i.team"),
        "rallies": items("rallies").withColumnRenamed("id", "rally_id"), "events": items("events"), "targets": items("recovery_targets")}


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Regions given as a bare list or under ``points``; a repeated closing point is dropped."""
    text = spark.read.text(path, wholetext=True).select(
        clip_of_path(F.input_file_name()).alias("clip_id"), F.regexp_replace("value", "^﻿", "").alias("value"))
    pts = F.coalesce(F.from_json("value", "struct<points:array<array<double>>>")["points"], F.from_json("value", "array<array<double>>"))
    shaped = text.select("clip_id", F.transform(pts, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("points"))
    closed = (F.size("points") > 1) & (F.element_at("points", 1) == F.element_at("points", -1))
    return shaped.withColumn("points", F.when(closed, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels, positions as image fractions."""
    return (spark.read.csv(path, header=True, schema=schemas.LABELS, encoding="UTF-8")
            .select(clip_of_path(F.input_file_name()).alias("clip_id"), F.col("Frame").alias("frame_index"),
                    (F.col("Ball") == 1).alias("visible"), "x", "y"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files (below 2 GB each)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256"))


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """Video files, names with "rally" first; the content is not read."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime", name.alias("name"))
            .where(F.col("name").rlike(r"\.(" + "|".join(MEDIA_SUFFIXES) + ")$"))
            .orderBy(~F.col("name").contains("rally"), "name"))


def list_runs(runs: DataFrame, validations: DataFrame, frames: DataFrame) -> DataFrame:
    """Complete runs, those with insights first, then newest.

    ``runs``: run, milestone, status, modified_at, has_insights.  A run without
    a status is complete when its validation covered all of its frames
    (``validations``: run, frames_analyzed; ``frames``: run, frame rows).
    """
    counted = frames.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    v = validations.join(counted, "run", "left").select("run", (F.col("frames_analyzed") == F.coalesce("n", F.lit(0))).alias("covered"))
    done = (F.col("status") == "complete") | (F.col("status").isNull() & F.coalesce("covered", F.lit(False)))
    first = (F.coalesce("milestone", F.lit("")) == "M5") | F.coalesce("has_insights", F.lit(False))
    return (runs.join(v, "run", "left").where(done).withColumn("with_insights", first).drop("covered")
                .orderBy(F.desc("with_insights"), F.desc("modified_at")))


def load_run(run: DataFrame, **artefacts: DataFrame) -> DataFrame:
    """The chosen runs with one struct per stored artefact, null where there is none.

    Each artefact table has one row per run.
    """
    out = run.where("status = 'complete'")
    for name, table in artefacts.items():
        cols = [c for c in table.columns if c != "run"]
        out = out.join(table.select("run", F.struct(*cols).alias(name)), "run", "left")
    return out
