"""Explicit schemas; nothing is inferred from files."""
from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
KEYPOINT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("visible", T.BooleanType())])
DETECTION = T.StructType([
    T.StructField("frame_index", T.LongType()), T.StructField("timestamp_s", T.DoubleType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()), T.StructField("low_confidence", T.BooleanType()),
    T.StructField("raw_x", T.DoubleType()), T.StructField("raw_y", T.DoubleType()), T.StructField("raw_confidence", T.DoubleType())])
PLAYER = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("identity_source", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("confidence", T.DoubleType()),
    T.StructField("keypoints", T.ArrayType(KEYPOINT)), T.StructField("ankle_midpoint", T.ArrayType(T.DoubleType())),
    T.StructField("low_confidence", T.BooleanType()),
    T.StructField("court_position", T.StructType([
        T.StructField("x_m", T.DoubleType()), T.StructField("y_m", T.DoubleType()),
        T.StructField("in_doubles_court", T.BooleanType()), T.StructField("in_singles_court", T.BooleanType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType()))])),
    T.StructField("court_flags", T.ArrayType(T.StringType()))])
PLAYER_FRAME = T.StructType([
    T.StructField("frame_index", T.LongType()), T.StructField("timestamp_s", T.DoubleType()), T.StructField("players", T.ArrayType(PLAYER)),
    T.StructField("expected_player_count", T.LongType()), T.StructField("observed_player_count", T.LongType()),
    T.StructField("count_mismatch", T.BooleanType()), T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("court_quality_flags", T.ArrayType(T.StringType()))])
METADATA = T.MapType(T.StringType(), T.StringType())


def document(item: T.DataType) -> T.StructType:
    """Observation file: version, metadata, frames."""
    return T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("metadata", METADATA),
                         T.StructField("frames", T.ArrayType(item))])


CALIBRATION = T.StructType([
    T.StructField("schema_version", T.LongType()), T.StructField("source_dimensions", T.ArrayType(T.LongType())),
    T.StructField("corners_px", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("corner_order", T.ArrayType(T.StringType())),
    T.StructField("method", T.StringType()), T.StructField("reference_frame", T.LongType()), T.StructField("metadata", METADATA)])
REVIEW = T.StructType([
    T.StructField("schema_version", T.LongType()), T.StructField("source_video_sha256", T.StringType()),
    T.StructField("identity_map", T.MapType(T.StringType(), T.StructType([
        T.StructField(n, T.StringType()) for n in ("player_label", "side", "team")]))),
    T.StructField("rallies", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType()),
        T.StructField("notes", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("winner_label", T.StringType())]))),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("frame_index", T.LongType()), T.StructField("kind", T.StringType()),
        T.StructField("player_label", T.StringType()), T.StructField("note", T.StringType())]))),
    T.StructField("recovery_targets", T.ArrayType(T.StructType([
        T.StructField("player_label", T.StringType()), T.StructField("contact_frame", T.LongType()), T.StructField("until_frame", T.LongType()),
        T.StructField("target_x_m", T.DoubleType()), T.StructField("target_y_m", T.DoubleType()), T.StructField("radius_m", T.DoubleType())])))])
LABELS = T.StructType([T.StructField("Frame", T.LongType()), T.StructField("Ball", T.LongType()),
                       T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SUMMARY = T.StructType([T.StructField("status", T.StringType()), T.StructField("provenance", T.StructType([T.StructField("milestone", T.StringType())]))])
