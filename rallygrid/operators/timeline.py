"""Gap caps, gap filling, runs and source timing of frame series."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import fill_forward, match_ranges, previous_row, with_halo
from ..functions.stats import exact_median
from ..policy import LAYOUT, POLICY, TICKS_PER_SECOND, Layout, Policy

CLIP = "clip_id"


def _measured_caps(timeline: DataFrame, policy: Policy, layout: Layout) -> DataFrame:
    """Caps of the clips that have at least one pair of consecutive frames.

    Steps are counted in cells that widen with them (a thousandth of the step), so a clip has some twenty thousand cells
    at most, however its steps differ; the cell of a middle rank is then opened if it holds different steps.  All steps too
    short to lift the cap above its floor share one cell, and their longest is
    the only one that a median above the floor can touch, so a clip at ordinary cadence has a single cell.
    """
    rows = with_halo(timeline.select(CLIP, "frame_index", "timestamp_s"),
                     F.col("frame_index"), layout.block_frames, before=1)
    w = Window.partitionBy(CLIP, "block").orderBy("frame_index")
    floor = policy.min_gap_cap_s / policy.gap_cap_multiplier
    prev = F.lag(F.struct("frame_index", "timestamp_s")).over(w)
    dt = F.when(prev["frame_index"] == F.col("frame_index") - 1, F.col("timestamp_s") - prev["timestamp_s"])
    steps = rows.select(CLIP, "is_core", dt.alias("step")).where("is_core and step is not null")
    cell = F.when(F.col("__v") <= floor, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.floor(F.log(F.col("__v") / floor) * 1000))).cast("long")
    median = exact_median(steps, [CLIP], "step", cell, "median_step", closed=F.col("__cell") < 0)
    return median.select(CLIP, F.greatest(F.lit(policy.min_gap_cap_s), F.col("median_step") * policy.gap_cap_multiplier).alias("gap_cap_s"))


def gap_caps(timeline: DataFrame, policy: Policy = POLICY, layout: Layout = LAYOUT) -> DataFrame:
    """Longest step still taken as continuous motion, per clip."""
    return (timeline.select(CLIP).distinct()
            .join(_measured_caps(timeline, policy, layout), CLIP, "left")
            .select(CLIP, F.coalesce("gap_cap_s", F.lit(policy.min_gap_cap_s)).alias("gap_cap_s")))


def with_gap_cap(rows: DataFrame, timeline: DataFrame, policy: Policy = POLICY,
                 layout: Layout = LAYOUT) -> DataFrame:
    caps = _measured_caps(timeline, policy, layout)
    return (rows.join(caps, CLIP, "left")
                .withColumn("gap_cap_s", F.coalesce("gap_cap_s", F.lit(policy.min_gap_cap_s))))


def with_raw(shuttle: DataFrame) -> DataFrame:
    """Keep the detector's own values beside the accepted ones; estimates have none."""
    observed = F.col("source") != "interpolated"
    for raw, accepted in (("raw_x", "x"), ("raw_y", "y"), ("raw_confidence", "confidence")):
        have = F.col(raw) if raw in shuttle.columns else F.lit(None).cast("double")
        shuttle = shuttle.withColumn(raw, F.when(observed, F.coalesce(have, F.col(accepted))).otherwise(have))
    return shuttle


def restore_raw(shuttle: DataFrame, threshold: float) -> DataFrame:
    """Undo processing: accepted values become the stored detector output."""
    missing = F.col("raw_x").isNull()
    weak = missing | F.col("raw_confidence").isNull() | (F.col("raw_confidence") < threshold)
    return (shuttle.withColumn("x", F.col("raw_x")).withColumn("y", F.col("raw_y"))
                   .withColumn("confidence", F.col("raw_confidence"))
                   .withColumn("source", F.when(missing, "missing").otherwise("detected"))
                   .withColumn("low_confidence", weak))


def head_frames(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` frames of every clip."""
    return rows.where(F.col("frame_index") < n)


def interpolate_gaps(shuttle: DataFrame, max_gap: int = POLICY.max_fill_frames,
                     layout: Layout = LAYOUT) -> DataFrame:
    """Fill short runs of missing rows by elapsed time between reliable ends.

    A fillable run is at most ``max_gap`` frames, so both ends lie within
    ``max_gap`` rows and bounded frames plus a halo of that width suffice.
    """
    shuttle = with_raw(shuttle)
    if max_gap <= 0:
        return shuttle
    cols = shuttle.columns
    rows = with_halo(shuttle, F.col("frame_index"), layout.block_frames, max_gap + 1, max_gap + 1)
    w = Window.partitionBy(CLIP, "block").orderBy("frame_index")
    end = F.when(F.col("source") != "missing", F.struct("frame_index", "timestamp_s", "x", "y", (
        (F.col("source") == "detected") & ~F.col("low_confidence")).alias("ok")))
    rows = (rows.withColumn("left", F.last(end, ignorenulls=True).over(w.rowsBetween(-max_gap, -1)))
                .withColumn("right", F.first(end, ignorenulls=True).over(w.rowsBetween(1, max_gap))))
    fill = ((F.col("source") == "missing") & F.col("left.ok") & F.col("right.ok")
            & (F.col("right.frame_index") - F.col("left.frame_index") - 1 <= max_gap))
    part = F.try_divide(F.col("timestamp_s") - F.col("left.timestamp_s"), F.col("right.timestamp_s") - F.col("left.timestamp_s"))
    rows = rows.where("is_core").withColumn("fill", F.coalesce(fill, F.lit(False)))
    for c in ("x", "y"):
        rows = rows.withColumn(c, F.when(F.col("fill"), F.col(f"left.{c}") + part * (F.col(f"right.{c}") - F.col(f"left.{c}")))
                               .otherwise(F.col(c)))
    return (rows.withColumn("confidence", F.when(~F.col("fill"), F.col("confidence")))
                .withColumn("source", F.when(F.col("fill"), "interpolated").otherwise(F.col("source")))
                .withColumn("low_confidence", F.col("fill") | F.col("low_confidence"))
                .select(*cols))


def raw_gaps(shuttle: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Runs of rows without a detection (estimates count as gap), per clip.

    A gap is what lies between two successive detections; the open ends come
    from the first and last frame of the clip.
    """
    detected = shuttle.where("source = 'detected'").select(CLIP, "frame_index")
    inner = (previous_row(detected, [CLIP], "frame_index", ["frame_index"], layout.block_frames)
             .groupBy(CLIP).agg(
                 F.count_if(F.col("frame_index") - F.col("prev.frame_index") > 1).alias("inner_gaps"),
                 F.max(F.col("frame_index") - F.col("prev.frame_index") - 1).alias("inner_longest")))
    is_hit = F.col("source") == "detected"
    span = shuttle.groupBy(CLIP).agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"),
        F.min(F.when(is_hit, F.col("frame_index"))).alias("first_hit"),
        F.max(F.when(is_hit, F.col("frame_index"))).alias("last_hit"))
    head, tail = F.col("first_hit") - F.col("lo"), F.col("hi") - F.col("last_hit")
    none = F.col("first_hit").isNull()
    return span.join(inner, CLIP, "left").select(
        CLIP,
        F.when(none, F.lit(1)).otherwise(
            F.coalesce("inner_gaps", F.lit(0)) + (head > 0).cast("int") + (tail > 0).cast("int")).cast("long").alias("raw_gap_count"),
        F.when(none, F.col("n")).otherwise(
            F.greatest(F.coalesce("inner_longest", F.lit(0)), head, tail)).cast("long").alias("longest_raw_gap_frames"))


def track_gaps(obs: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """One row per hole inside a track: the frames around it and its length."""
    rows = previous_row(obs.select(CLIP, "track_id", "frame_index"), [CLIP, "track_id"],
                        "frame_index", ["frame_index"], layout.block_frames)
    missing = F.col("frame_index") - F.col("prev.frame_index") - 1
    return rows.where(missing > 0).select(
        CLIP, "track_id", F.col("prev.frame_index").alias("after_frame"),
        F.col("frame_index").alias("before_frame"), missing.alias("missing_frames"))


def contiguous_runs(obs: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Observed frames and number of unbroken runs per track.

    A run starts where the frame before is absent, which a one-frame halo shows.
    """
    rows = with_halo(obs.select(CLIP, "track_id", "frame_index"), F.col("frame_index"), layout.block_frames, 1)
    w = Window.partitionBy(CLIP, "track_id", "block").orderBy("frame_index")
    starts = F.coalesce(F.lag("frame_index").over(w) != F.col("frame_index") - 1, F.lit(True))
    return (rows.withColumn("starts", starts).where("is_core").groupBy(CLIP, "track_id").agg(
        F.count(F.lit(1)).alias("frames_observed"), F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"), F.count_if("starts").alias("contiguous_segments")))


def normalize_pts(frame_pts: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Seconds since the start from presentation stamps.

    The origin is fixed by the first real stamp; a frame without a stamp takes
    the time before it plus one nominal step.
    """
    step = F.try_divide(F.lit(1.0), "fps")
    absolute = F.col("pts") * F.try_divide("time_base_num", "time_base_den")
    rows = frame_pts.withColumn("absolute", absolute).withColumn("step", step)
    origin = rows.where("absolute is not null").groupBy(CLIP).agg(
        F.min_by(F.col("absolute") - F.col("frame_index") * F.col("step"), "frame_index").alias("origin"))
    rows = (rows.join(origin, CLIP, "left")
                .withColumn("stamped", F.col("absolute") - F.col("origin")))
    anchor = F.when(F.col("stamped").isNotNull(), F.struct(F.col("stamped").alias("t"), F.col("frame_index").alias("f")))
    rows = fill_forward(rows, [CLIP], "frame_index", anchor, layout.block_frames, "anchor")
    rows = rows.withColumn("t", F.when(F.col("anchor").isNull(), F.col("frame_index") * F.col("step")).otherwise(
        F.col("anchor.t") + (F.col("frame_index") - F.col("anchor.f")) * F.col("step")))
    rows = previous_row(rows, [CLIP], "frame_index", ["t"], layout.block_frames)
    bad = (F.col("t") < -1e-6) | F.coalesce(F.col("t") <= F.col("prev.t"), F.lit(False))
    return rows.select(CLIP, "frame_index", F.greatest(F.lit(0.0), F.col("t")).alias("timestamp_s"),
                       bad.alias("invalid_timing"))


def check_intervals(intervals: DataFrame, max_s: float = 300.0) -> DataFrame:
    """A row ``clip_id, interval_id, rule`` for each broken rule; such intervals aren't extracted."""
    start, end = F.col("start_s"), F.col("end_s")
    rules = [("missing_bound", start.isNull() | end.isNull()), ("negative_start", start < 0), ("empty_or_reversed", end <= start), ("too_long", end - start > max_s)]
    return intervals.select(CLIP, "interval_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))).alias("rule"))


def extract_intervals(frames: DataFrame, intervals: DataFrame, max_s: float = 300.0) -> DataFrame:
    """Frames inside each requested interval, renumbered and rebased to its first frame.

    :func:`check_intervals` names every interval that this leaves out.
    """
    eps = 1e-8
    wanted = (intervals.where((F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s"))
                              & (F.col("end_s") - F.col("start_s") <= max_s))
              .select(CLIP, "interval_id", (F.col("start_s") - eps).alias("lo"), (F.col("end_s") - eps).alias("hi")))
    hits = (match_ranges(frames.select(CLIP, "frame_index", "timestamp_s"), wanted, [CLIP], "timestamp_s", "lo", "hi", 60.0)
            .where("timestamp_s < hi"))
    # An interval is at most max_s seconds long, so this group is bounded.
    w = Window.partitionBy(CLIP, "interval_id").orderBy("frame_index")
    since = F.col("timestamp_s") - F.first("timestamp_s").over(w)
    ticks = F.bround(since * TICKS_PER_SECOND) / TICKS_PER_SECOND
    return hits.select(CLIP, "interval_id", (F.row_number().over(w) - 1).cast("long").alias("frame_index"),
                       F.col("frame_index").alias("source_frame"), ticks.alias("timestamp_s"),
                       F.abs(ticks - since).alias("timing_error_s"))


def sequence_windows(frames: DataFrame, length: int = 8) -> DataFrame:
    """Fixed-length windows; the last one repeats its final frame, marked as padding."""
    rows = frames.select(CLIP, F.floor(F.col("frame_index") / length).alias("window"),
                         (F.col("frame_index") % length).alias("slot"), "frame_index",
                         F.lit(False).alias("is_padding"))
    last = frames.groupBy(CLIP).agg(F.max("frame_index").alias("frame_index"))
    pads = (last.where((F.col("frame_index") + 1) % length != 0)
                .withColumn("slot", F.explode(F.sequence(F.col("frame_index") % length + 1, F.lit(length - 1).cast("long"))))
                .select(CLIP, F.floor(F.col("frame_index") / length).alias("window"), "slot", "frame_index",
                        F.lit(True).alias("is_padding")))
    return rows.unionByName(pads)


def sample_frames(frames: DataFrame, k: int = 64, seed: int = 0) -> DataFrame:
    """A repeatable sample of at most ``k`` frames per clip (1 to 512)."""
    if not 1 <= k <= 512:
        raise ValueError("a sample holds 1 to 512 frames per clip")
    draw = F.md5(F.concat_ws(":", CLIP, "frame_index", F.lit(seed)))
    # The rank filter is pushed below the shuffle as a per-task group limit.
    w = Window.partitionBy(CLIP).orderBy("draw", "frame_index")
    return (frames.select(CLIP, "frame_index", "timestamp_s", draw.alias("draw"))
                  .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank", "draw"))


def resolve_rate(clips: DataFrame) -> DataFrame:
    """Frame rate and where it came from; a note when a hint disagrees."""
    def usable(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (v > 0) & (v != F.lit(float("inf"))), v)
    order = ("average_rate", "guessed_rate", "base_rate")
    measured = F.coalesce(*[usable(c) for c in order])
    source = F.coalesce(*[F.when(usable(c).isNotNull(), F.lit(c)) for c in order],
                        F.when(usable("fps_hint").isNotNull(), F.lit("fps_hint")))
    return clips.select(CLIP, F.coalesce(measured, usable("fps_hint")).alias("fps"), measured.alias("metadata_fps"),
                        source.alias("fps_source"),
                        F.coalesce(F.abs(measured - usable("fps_hint")) / measured > 0.01, F.lit(False)).alias("hint_differs"))
