"""Clip-level quality measures and warnings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.court import calibration_confirmed
from ..policy import note
from .timeline import CLIP, raw_gaps


def tracking_summary(shuttle: DataFrame) -> DataFrame:
    """Coverage of the shuttle detector per clip."""
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.col("source") == s)
    s = shuttle.groupBy(CLIP).agg(
        n.alias("frames_analyzed"), of("detected").alias("detected"), of("missing").alias("missing"),
        of("interpolated").alias("interpolated"), (of("detected") / n).alias("observed_fraction"),
        (F.count_if((F.col("source") == "detected") & ~F.col("low_confidence")) / n).alias("reliable_observed_fraction"),
        ((of("detected") + of("interpolated")) / n).alias("available_fraction_after_interpolation"),
        F.count_if("low_confidence").alias("low_confidence_frames"), F.avg("raw_confidence").alias("mean_raw_heatmap_score"),
        F.min_by("timestamp_s", "frame_index").alias("time_first_frame_s"),
        F.max_by("timestamp_s", "frame_index").alias("time_last_frame_s"))
    return s.join(raw_gaps(shuttle), CLIP, "left")


def source_counts(shuttle: DataFrame) -> DataFrame:
    return shuttle.groupBy(CLIP, "source").agg(F.count(F.lit(1)).alias("frames"))


def analyzed_span(shuttle: DataFrame, clips: DataFrame) -> DataFrame:
    """Time covered: last minus first stamp plus one nominal frame."""
    s = shuttle.groupBy(CLIP).agg(F.min("timestamp_s").alias("lo"), F.max("timestamp_s").alias("hi"))
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(1.0)
    return s.join(clips.select(CLIP, "fps"), CLIP, "left").select(
        CLIP, (F.col("hi") - F.col("lo") + 1 / F.coalesce(rate, F.lit(1.0))).alias("analyzed_span_s"))


def quality(motion: DataFrame, records: DataFrame, calibrations: DataFrame) -> DataFrame:
    """The quality block of a clip."""
    m = motion.groupBy(CLIP).agg(F.count_if("valid_position").alias("valid_player_positions"),
                                 F.count(F.lit(1)).alias("player_observations"))
    f = records.groupBy(CLIP).agg(F.count(F.lit(1)).alias("frame_count"), F.count_if("count_mismatch").alias("count_mismatch_frames"))
    c = calibrations.select(CLIP, calibration_confirmed(F.col("method"), F.col("manually_reviewed")).alias("calibration_reviewed"))
    return (f.join(m, CLIP, "left").join(c, CLIP, "left").na.fill(0, ["valid_player_positions", "player_observations"])
             .na.fill(False, ["calibration_reviewed"]))


def warnings(clips: DataFrame, quality: DataFrame, fragments: DataFrame, identity: DataFrame, rallies: DataFrame,
             shuttle: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Warnings in fixed order.

    ``clips`` gives the mode, ``shuttle`` a shuttle summary; ``reviews`` may say
    that a clip's annotations carry no digest (``unbound``).
    """
    tracks = fragments.groupBy(CLIP).agg(F.count(F.lit(1)).alias("tracks"),
                                         F.max(F.col("excluded_motion_intervals") > 0).alias("partial"))
    mapped = identity.select(CLIP).distinct().withColumn("mapped", F.lit(True))
    timed = rallies.select(CLIP).distinct().withColumn("timed", F.lit(True))
    rows = (clips.select(CLIP, "mode").join(quality, CLIP, "left").join(tracks, CLIP, "left").join(mapped, CLIP, "left")
                 .join(timed, CLIP, "left").join(shuttle.select(CLIP, "jump_count"), CLIP, "left"))
    if reviews is not None:
        rows = rows.join(reviews.select(CLIP, "unbound"), CLIP, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    unbound = yes("unbound") if reviews is not None else F.lit(False)
    expected = F.when(F.col("mode") == "singles", 2).otherwise(4)
    mism, jumps = F.col("count_mismatch_frames"), F.col("jump_count")
    messages = F.array_compact(F.array(
        F.when(unbound, F.lit(note("unbound_annotations"))),
        F.when(~yes("calibration_reviewed"), F.lit(note("calibration_unreviewed"))),
        F.when(mism > 0, F.concat(mism.cast("string"), F.lit(" " + note("player_count")))),
        F.when(yes("partial"), F.lit(note("partial_motion"))),
        F.when(F.col("tracks") > expected, F.lit(note("many_fragments"))),
        F.when(~yes("mapped"), F.lit(note("identity_unreviewed"))),
        F.when(~yes("timed"), F.lit(note("rallies_unreviewed"))),
        F.when(jumps > 0, F.concat(jumps.cast("string"), F.lit(" " + note("large_jumps"))))))
    return rows.select(CLIP, messages.alias("warnings"))
