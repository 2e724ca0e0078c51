"""Tables to exchange formats.  Existing output is never overwritten."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import KEYPOINTS

# Column names and their order in the exchange format.
SHUTTLE_COLUMNS = ["clip_id", "frame_index", "timestamp_s", "x", "y", "confidence", "source", "low_confidence", "raw_x", "raw_y", "raw_confidence"]
PLAYER_MOTION_COLUMNS = ["frame_index", "timestamp_s", "track_id", "player_label", "side", "team", "x_m", "y_m", "valid_position", "smoothed_x_m",
                         "smoothed_y_m", "interval_start_frame", "interval_start_timestamp_s", "interval_duration_s", "distance_m", "speed_m_s",
                         "zone", "quality_flags"]
SHUTTLE_MOTION_COLUMNS = ["frame_index", "timestamp_s", "x_px", "y_px", "source", "valid_observation", "interval_start_frame", "interval_duration_s",
                          "displacement_px", "image_speed_px_s", "physical_speed_km_h", "quality_flags"]


def publish(df: DataFrame, path: str, fmt: str = "parquet", by_clip: bool = False, **options) -> None:
    """Write once; the committer makes output visible only after success."""
    w = df.write.format(fmt).mode("errorifexists").options(**options)
    (w.partitionBy("clip_id") if by_clip else w).save(path)


def _flat(df: DataFrame) -> DataFrame:
    """Lists and structs as JSON text, for CSV."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    publish(_flat(df), path, "csv", header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    publish(df, path, "json", ignoreNullFields=False)


def write_shuttle(df: DataFrame, path: str) -> None:
    write_csv(df.select(*SHUTTLE_COLUMNS), f"{path}/csv")
    write_json(df.select(*SHUTTLE_COLUMNS), f"{path}/json")


def write_motion(motion: DataFrame, path: str, columns: list[str] = PLAYER_MOTION_COLUMNS) -> None:
    cols = ["clip_id"] + [c for c in columns if c in motion.columns]
    write_csv(motion.select(*cols), f"{path}/csv")
    write_json(motion.select(*cols), f"{path}/json")


def players_wide(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per observation with four columns for each pose point."""
    f = frames.select("clip_id", "frame_index", "expected_player_count", "observed_player_count", "count_mismatch",
                      F.concat_ws(";", "flags").alias("frame_flags"))
    rows = obs.join(f, ["clip_id", "frame_index"])
    box, mid = F.col("bbox"), F.col("ankle_midpoint")
    points = [F.get("keypoints", F.lit(i))[part].alias(f"{name}_{part}") for i, name in enumerate(KEYPOINTS) for part in ("x", "y", "confidence", "visible")]
    court = []
    if "x_m" in obs.columns:
        court = [F.col("x_m").alias("court_x_m"), F.col("y_m").alias("court_y_m"), "in_doubles_court", "in_singles_court",
                 F.concat_ws(";", "court_flags").alias("court_flags")]
    return rows.select(
        "clip_id", "frame_index", "timestamp_s", "expected_player_count", "observed_player_count", "count_mismatch", "frame_flags", "track_id",
        "identity_source", "confidence", *[F.get(box, F.lit(i)).alias(f"bbox_{n}") for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.get(mid, F.lit(0)).alias("ankle_midpoint_x"), F.get(mid, F.lit(1)).alias("ankle_midpoint_y"), "low_confidence", *points, *court)


def _nested(frames: DataFrame, rows: DataFrame, item) -> DataFrame:
    """Frames with their players as a list sorted by track; the players of one frame are few.

    A window holds the rows of one frame at a time, where an aggregate would sort a task's whole lists.  Rows that
    :func:`pose.by_frame` has dealt are not moved or sorted again.
    """
    key = ["clip_id", "frame_index"]
    ordered = Window.partitionBy(*key).orderBy("track_id")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = (rows.select(*key, F.collect_list(item).over(whole).alias("players"), F.row_number().over(ordered).alias("place"))
                 .where("place = 1").select(*key, F.array_sort("players").alias("players")))
    out = frames.join(lists, key, "left")
    none = F.array().cast(lists.schema["players"].dataType)
    return out.withColumn("players", F.coalesce("players", none))


def players_nested(frames: DataFrame, obs: DataFrame) -> DataFrame:
    """Player frames as written to JSON; empty frames are kept."""
    cols = [c for c in ("track_id", "identity_source", "bbox", "confidence", "keypoints", "ankle_midpoint", "low_confidence", "court_flags") if c in obs.columns]
    return _nested(frames, obs, F.struct(*cols))


def court_positions(positions: DataFrame) -> DataFrame:
    """Flat position rows; a missing position is null, not dropped."""
    return positions.select("clip_id", "frame_index", "timestamp_s", "track_id", "x_m", "y_m", "in_doubles_court", "in_singles_court",
                            F.concat_ws(";", "court_flags").alias("quality_flags"))


def court_positions_nested(frames: DataFrame, positions: DataFrame) -> DataFrame:
    item = F.struct("track_id", "x_m", "y_m", "in_doubles_court", "in_singles_court", F.col("court_flags").alias("quality_flags"))
    return _nested(frames, positions, item)


def append_review(review: DataFrame, clips: DataFrame, path: str, version: str) -> None:
    """Store a new review version bound to each clip's source; earlier ones stay as they are.

    A review that names another source is refused.
    """
    bound = review.join(clips.select("clip_id", F.col("source_digest").alias("clip_digest")), "clip_id")
    wrong = bound.where(F.col("source_digest") != F.col("clip_digest")).select("clip_id").take(1)
    if wrong:
        raise ValueError(f"the review of clip {wrong[0][0]} belongs to a different source")
    publish(bound.withColumn("source_digest", F.col("clip_digest")).drop("clip_digest"), f"{path}/version={version}")


def review_version(spark, path: str, version: str | None = None) -> DataFrame:
    """One stored version, the latest by default."""
    rows = spark.read.parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version)
