"""Shuttle image motion between consecutive reliable observations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flags import cut_only, empty, flag_set, merge, or_empty
from ..functions.ordered import carry_over, with_halo
from ..functions.stats import finite
from ..policy import LAYOUT, POLICY, Layout, Policy
from .timeline import CLIP, _measured_caps


def attach_frame_flags(rows: DataFrame, frames: DataFrame, into: str = "flags") -> DataFrame:
    """Bring the review flags of the frame to each row."""
    f = frames.select(CLIP, "frame_index", F.col("flags").alias(into))
    return rows.drop(into).join(f, [CLIP, "frame_index"], "left").withColumn(into, or_empty(F.col(into)))


def shuttle_observations(shuttle: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Validity and flags of each row.

    ``flags`` (optional) holds the frame's own flags, of which only view cuts are
    inherited; ``width``/``height`` (optional) bound the image.
    """
    flags = or_empty(F.col("flags")) if "flags" in shuttle.columns else empty()
    known = {"width", "height"} <= set(shuttle.columns)
    x, y, conf = finite(F.col("x")), finite(F.col("y")), finite(F.col("confidence"))
    weak, observed = F.coalesce("low_confidence", F.lit(False)), F.col("source") == "detected"
    has_xy = x.isNotNull() & y.isNotNull()
    cuts = cut_only(flags)
    valid = F.coalesce(observed & ~weak & (conf >= policy.min_shuttle_confidence) & has_xy & (F.size(cuts) == 0), F.lit(False))
    outside = valid & ~((x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height"))) if known else F.lit(False)
    outside = F.coalesce(outside, F.lit(False))
    own = flag_set((weak | (conf < policy.min_shuttle_confidence), "low_confidence_shuttle"),
                   (conf.isNull(), "shuttle_confidence_unavailable"),
                   (~observed, "shuttle_not_observed"),
                   (outside, "shuttle_outside_image"),
                   (~has_xy, "shuttle_position_unavailable"))
    return (shuttle.withColumn("x_px", x).withColumn("y_px", y)
                   .withColumn("valid_observation", valid & ~outside)
                   .withColumn("quality_flags", merge(F.array_sort(cuts), own)))


def shuttle_motion(shuttle: DataFrame, timeline: DataFrame | None = None, policy: Policy = POLICY,
                   layout: Layout = LAYOUT, gap_cap_s: float | None = None) -> DataFrame:
    """Displacement and image speed from the row just before.

    Only the row before counts, so a one-frame halo per block is enough; whether
    an older neighbour was usable (for the gap flag) comes from the carry.
    """
    obs = shuttle_observations(shuttle, policy)
    if gap_cap_s is None:
        caps = _measured_caps(timeline if timeline is not None else shuttle, policy, layout)
        obs = obs.join(caps, CLIP, "left")
        cap = F.coalesce("gap_cap_s", F.lit(policy.min_gap_cap_s))
    else:
        cap = F.lit(gap_cap_s)
    pos = F.col("frame_index")
    carry = carry_over(obs.select(CLIP, "frame_index", "valid_observation"), [CLIP], pos, layout.block_frames,
                   F.max_by("valid_observation", pos))
    known = {"width", "height"} <= set(shuttle.columns)
    keep = [CLIP, "frame_index", "timestamp_s", "x_px", "y_px", "source", "valid_observation", "quality_flags"]
    rows = obs.select(*keep, cap.alias("cap"), *(["width", "height"] if known else []))
    rows = with_halo(rows, pos, layout.block_frames, before=1).join(carry, [CLIP, "block"], "left")
    w = Window.partitionBy(CLIP, "block").orderBy("frame_index")
    prev = F.lag(F.struct("frame_index", "timestamp_s", "x_px", "y_px", F.col("valid_observation").alias("ok"))).over(w)
    rows = rows.withColumn("prev", prev).where("is_core")
    dt = F.col("timestamp_s") - F.col("prev.timestamp_s")
    both = F.col("valid_observation") & F.coalesce(F.col("prev.ok"), F.col("carried"), F.lit(False))
    joined = both & F.coalesce((F.col("prev.frame_index") == pos - 1) & (dt <= F.col("cap")), F.lit(False))
    dx, dy = F.col("x_px") - F.col("prev.x_px"), F.col("y_px") - F.col("prev.y_px")
    moved = F.sqrt(dx * dx + dy * dy)
    jump = F.lit(False)
    if known:
        diagonal = F.sqrt(F.col("width").cast("double") * F.col("width") + F.col("height").cast("double") * F.col("height"))
        jump = F.coalesce(joined & (diagonal > 0) & (moved / diagonal >= policy.jump_fraction_of_diagonal), F.lit(False))
    extra = flag_set((jump, "large_image_jump_review"), (both & ~joined, "observation_gap"))
    return rows.select(
        *keep[:-1],
        F.when(joined, F.col("prev.frame_index")).alias("interval_start_frame"),
        F.when(joined, dt).alias("interval_duration_s"),
        F.when(joined, moved).alias("displacement_px"),
        F.when(joined, F.try_divide(moved, dt)).alias("image_speed_px_s"),
        F.lit(None).cast("double").alias("physical_speed_km_h"),
        merge(F.col("quality_flags"), extra).alias("quality_flags"))


def shuttle_summary(motion: DataFrame) -> DataFrame:
    """Totals per clip; image motion only, never a physical speed."""
    accepted = F.col("image_speed_px_s").isNotNull()
    s = motion.groupBy(CLIP).agg(
        F.count_if("valid_observation").alias("observed_frames"), F.count(F.lit(1)).alias("total_frames"),
        F.count_if(accepted).alias("valid_motion_intervals"),
        F.coalesce(F.sum("interval_duration_s"), F.lit(0.0)).alias("valid_motion_time_s"),
        F.sum("displacement_px").alias("distance"), F.max("image_speed_px_s").alias("max_image_speed_px_s"),
        F.count_if(F.array_contains("quality_flags", "large_image_jump_review")).alias("jump_count"))
    return s.select(
        CLIP, "observed_frames", "total_frames", "valid_motion_intervals",
        F.greatest(F.lit(0), F.col("total_frames") - 1 - F.col("valid_motion_intervals")).cast("long").alias("excluded_motion_intervals"),
        "valid_motion_time_s", F.try_divide("distance", "valid_motion_time_s").alias("average_image_speed_px_s"),
        "max_image_speed_px_s", F.lit(None).cast("double").alias("physical_speed_km_h"), "jump_count")
