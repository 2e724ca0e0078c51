"""Data-quality rules.  Each check returns violations: clip_id, rule, key.

Nothing raises; a caller decides whether to fail, set rows aside or go on
(:func:`fail_on`, :func:`quarantine`).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import previous_row
from ..functions.stats import finite
from ..policy import (COURT_LENGTH, COURT_WIDTH, EVENT_KINDS, KEYPOINTS, LAYOUT, POLICY, SHUTTLE_SOURCES,
                      TICKS_PER_SECOND, Layout)
from .timeline import CLIP

FRAME = [CLIP, "frame_index"]
AT_FRAME = ("frame_index",)


def _report(df: DataFrame, rules: list[tuple[str, Column]], key: tuple[str, ...] = AT_FRAME) -> DataFrame:
    """One row per broken rule; a rule that comes out null is not broken."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return (df.select(CLIP, F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("key"), broken.alias("rules"))
              .select(CLIP, F.explode("rules").alias("rule"), "key"))


def _duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(CLIP, F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys[1:]]).alias("key")))


def union(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def fail_on(violations: DataFrame) -> None:
    """Raise when there is any violation, naming one."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{first[0]['rule']} in clip {first[0][CLIP]} at {first[0]['key']}")


def quarantine(rows: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of sound clips and rows of clips with a violation."""
    bad = violations.select(CLIP).distinct()
    return rows.join(bad, CLIP, "left_anti"), rows.join(bad, CLIP, "left_semi")



def check_timeline(df: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Unique non-negative frames, finite non-negative time, both rising."""
    frames = df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_s").alias("timestamp_s"),
                                    F.count_if(finite(F.col("timestamp_s")).isNull()).alias("odd"))
    rows = previous_row(frames, [CLIP], "frame_index", ["timestamp_s"], layout.block_frames)
    t = F.col("timestamp_s")
    return _report(rows, [("duplicate_frame", F.col("n") > 1), ("negative_frame", F.col("frame_index") < 0), ("time_not_finite", F.col("odd") > 0),
                          ("negative_time", t < 0), ("time_not_rising", t <= F.col("prev.timestamp_s"))])


def _place(df: DataFrame) -> str | None:
    """The column with a row's place in its file."""
    return "ordinal" if "ordinal" in df.columns else None


def check_shuttle(df: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Shuttle rows: consecutive from zero, paired and finite values, source agrees with coordinates.

    Consecutive from zero means the row before has the frame before.  Rows that
    repeat a frame are checked one by one, in the order of ``ordinal`` if given.
    """
    rows = previous_row(df, [CLIP], "frame_index", ["frame_index", "timestamp_s"], layout.block_frames, then=_place(df))
    values = [c for c in ("x", "y", "confidence", "raw_x", "raw_y", "raw_confidence") if c in df.columns]
    odd = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & finite(F.col(c)).isNull() for c in values])
    t = finite(F.col("timestamp_s"))
    return _report(rows, [
        ("frames_not_consecutive", F.col("frame_index") != F.coalesce(F.col("prev.frame_index") + 1, F.lit(0))),
        ("bad_time", t.isNull() | (t < 0)), ("time_not_rising", F.col("timestamp_s") <= F.col("prev.timestamp_s")),
        ("unpaired_coordinates", F.col("x").isNull() != F.col("y").isNull()), ("value_not_finite", odd),
        ("detected_without_coordinates", (F.col("source") == "detected") & F.col("x").isNull()),
        ("missing_with_coordinates", (F.col("source") == "missing") & F.col("x").isNotNull())])


def check_source(df: DataFrame) -> DataFrame:
    return _report(df, [("unknown_source", ~F.coalesce(F.col("source").isin(*SHUTTLE_SOURCES), F.lit(False)))])


def check_track_ids(obs: DataFrame) -> DataFrame:
    return union(_report(obs, [("track_id_not_positive", F.coalesce(F.col("track_id") < 1, F.lit(True)))], ("frame_index", "track_id")),
                 _duplicates(obs, [*FRAME, "track_id"], "duplicate_track_in_frame"))


# Names of stored metadata and settings.
VIDEO_FIELDS = ("width", "height", "fps", "frame_count", "duration_s", "time_base", "codec")
SHUTTLE_SETTINGS = ("confidence_threshold", "heatmap_threshold", "background_samples")
PLAYER_SETTINGS = ("players_mode", "pose_image_size", "player_confidence", "keypoint_confidence", "pose_nms_iou",
                   "tracker_settings")


def _check_metadata(stored: DataFrame, clips: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Stored run metadata against what is known of the clips now.

    Every field has to be stored, known and equal.  A clip without a stored run, a stored run without a clip, and a field
    that either table lacks or leaves empty are violations: incomplete provenance can't be reused.
    """
    fields = ("source_digest", *fields)
    of = lambda df, name: df.select(CLIP, F.struct(F.lit(True).alias("there"), *[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]).alias(name))
    rows = of(stored, "a").join(of(clips, "b"), CLIP, "full")
    issue = lambda rule, key="": F.struct(F.lit(rule).alias("rule"), F.lit(key).alias("key"))
    # A field that a table lacks is null there, so it needs no common type to be compared.
    each = [F.when(F.col(f"a.{f}").isNull(), issue("field_not_stored", f)).when(F.col(f"b.{f}").isNull(), issue("field_not_known", f)).when(
        ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}").cast(stored.schema[f].dataType) if f in stored.columns else F.col(f"b.{f}").cast("string")), issue(f"{f}_mismatch")) for f in fields]
    broken = (F.when(F.col("a.there").isNull(), F.array(issue("run_not_stored"))).when(F.col("b.there").isNull(), F.array(issue("clip_not_known")))
              .otherwise(F.array_compact(F.array(*each))))
    return rows.select(CLIP, F.explode(broken).alias("x")).select(CLIP, "x.rule", "x.key")


def _check_against_frames(rows: DataFrame, frames: DataFrame, tolerance: float) -> DataFrame:
    """Every frame once on both sides, at the same time."""
    a = rows.select(*FRAME, F.col("timestamp_s").alias("ta"), F.lit(True).alias("a"))
    b = frames.select(*FRAME, F.col("timestamp_s").alias("tb"), F.lit(True).alias("b"))
    return _report(a.join(b, FRAME, "full"), [
        ("frame_not_stored", F.col("a").isNull()), ("frame_not_in_source", F.col("b").isNull()),
        ("time_differs_from_source", ~F.coalesce(F.abs(F.col("ta") - F.col("tb")) <= tolerance,
                                                 F.col("a").isNull() | F.col("b").isNull()))])


def check_shuttle_reuse(shuttle: DataFrame, frames: DataFrame, stored: DataFrame, clips: DataFrame) -> DataFrame:
    """Whether stored shuttle observations may stand in for new ones."""
    raw = [F.col(c) for c in ("raw_x", "raw_y", "raw_confidence")]
    odd = reduce(lambda a, b: a | b, [c.isNotNull() & finite(c).isNull() for c in raw])
    return union(_check_metadata(stored, clips, VIDEO_FIELDS + SHUTTLE_SETTINGS), _check_against_frames(shuttle, frames, 1e-5),
                 _report(shuttle, [("raw_unpaired", raw[0].isNull() != raw[1].isNull()), ("raw_not_finite", odd)]))


def check_player_reuse(obs: DataFrame, records: DataFrame, frames: DataFrame, stored: DataFrame, clips: DataFrame,
                       regions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Whether stored player observations may stand in for new ones; ``regions`` are those of the stored runs and of now.

    Adds to the shuttle rules: counts, flags, boxes, scores, ordered pose points
    that agree with the threshold, and a midpoint that is the two ankles' own.
    """
    pts, box, mid = F.col("keypoints"), F.col("bbox"), F.col("ankle_midpoint")
    size = clips.select(CLIP, F.col("width").alias("__w"), F.col("height").alias("__h"))
    rows = obs.join(size, CLIP)
    names = F.array(*[F.lit(n) for n in KEYPOINTS])
    unit = lambda v: F.coalesce(finite(v).between(0, 1), F.lit(False))

    def good_point(p):
        shown = (finite(p["x"]).between(0, F.col("__w")) & finite(p["y"]).between(0, F.col("__h"))
                 & (p["confidence"] >= POLICY.keypoint_threshold) & ~((p["x"] == 0) & (p["y"] == 0)))
        return unit(p["confidence"]) & F.when(p["visible"], F.coalesce(shown, F.lit(False))).otherwise(
            p["visible"].isNotNull() & p["x"].isNull() & p["y"].isNull())
    both = F.col("keypoints")[15]["visible"] & F.col("keypoints")[16]["visible"]
    near = lambda i, c: F.abs(mid[i] - (pts[15][c] + pts[16][c]) / 2) <= 1e-5
    ordered = F.coalesce(F.transform(pts, lambda p: p["name"]) == names, F.lit(False))
    player = _report(rows, [
        ("track_id_not_positive", F.coalesce(F.col("track_id") < 1, F.lit(True))),
        ("box_invalid", ~F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: finite(v).isNotNull())
                                    & (box[2] > box[0]) & (box[3] > box[1]), F.lit(False))),
        ("score_invalid", ~unit(F.col("confidence"))), ("weakness_unknown", F.col("low_confidence").isNull()),
        ("keypoints_not_seventeen_ordered", ~ordered),
        ("keypoint_invalid", ordered & ~F.forall(pts, good_point)),
        ("midpoint_disagrees", ordered & both & ~F.coalesce(near(0, "x") & near(1, "y"), F.lit(False))),
        ("midpoint_invented", ordered & ~both & mid.isNotNull())], ("frame_index", "track_id"))
    seen = obs.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("rows"))
    counted = records.join(seen, FRAME, "left").join(clips.select(CLIP, F.col("expected_player_count").alias("__e")), CLIP)
    n = F.coalesce("rows", F.lit(0))
    counts = _report(counted, [
        ("observed_count_wrong", F.col("observed_player_count") != n),
        ("expected_count_wrong", F.col("expected_player_count") != F.col("__e")),
        ("mismatch_flag_wrong", F.col("count_mismatch") != (n != F.col("__e"))),
        ("flags_missing", F.col("flags").isNull() | F.exists("flags", lambda f: f.isNull()))])
    same = [check_roi_equal(*regions)] if regions else []
    return union(_check_metadata(stored, clips, VIDEO_FIELDS + PLAYER_SETTINGS), _check_against_frames(records, frames, 1e-5),
                 _duplicates(obs, [*FRAME, "track_id"], "duplicate_track_in_frame"), player, counts, *same)


def check_roi_equal(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Regions of a stored run and of now, equal to 1e-6."""
    a, b = stored.select(CLIP, F.col("points").alias("a")), current.select(CLIP, F.col("points").alias("b"))
    same = (F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", lambda p, q: (
        F.abs(p["x"] - q["x"]) <= 1e-6) & (F.abs(p["y"] - q["y"]) <= 1e-6)), lambda v: v)
    return a.join(b, CLIP, "full").where(~F.coalesce(same, F.lit(False))).select(
        CLIP, F.lit("roi_mismatch").alias("rule"), F.lit("").alias("key"))


def check_alignment(shuttle: DataFrame, frames: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Shuttle and player times of the same frame agree; frames of one side only are fine."""
    b = frames.select(*FRAME, F.col("timestamp_s").alias("tb"))
    return _report(shuttle.join(b, FRAME), [("times_not_aligned", F.abs(F.col("timestamp_s") - F.col("tb")) > tolerance)])


def check_overlay_alignment(shuttle: DataFrame, records: DataFrame, obs: DataFrame, motion: DataFrame) -> DataFrame:
    """Everything drawn together covers the same frames at the same times."""
    seen = obs.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("rows"))
    counted = records.join(seen, FRAME, "left")
    box = F.col("bbox")
    return union(
        _check_against_frames(records, shuttle, 1e-5),
        _report(motion.select(*FRAME, "timestamp_s").join(shuttle.select(*FRAME, F.col("timestamp_s").alias("tb")), FRAME, "full"),
                [("motion_row_differs", ~F.coalesce(F.abs(F.col("timestamp_s") - F.col("tb")) <= 1e-5, F.lit(False)))]),
        _report(counted, [("observed_count_wrong", F.col("observed_player_count") != F.coalesce("rows", F.lit(0)))]),
        _report(obs, [("box_not_finite", ~F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: finite(v).isNotNull()), F.lit(False)))],
                ("frame_index", "track_id")))


def check_export_timing(frames: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Frames stay consecutive and apart on the export clock (round half to even)."""
    place = _place(frames)
    rows = frames.select(*FRAME, "timestamp_s", *[place] * bool(place), F.bround(F.col("timestamp_s") * TICKS_PER_SECOND).alias("tick"))
    rows = previous_row(rows, [CLIP], "frame_index", ["frame_index", "timestamp_s", "tick"], layout.block_frames, then=place)
    return _report(rows, [
        ("frames_not_consecutive", F.col("frame_index") != F.coalesce(F.col("prev.frame_index") + 1, F.lit(0))),
        ("time_not_rising", F.col("timestamp_s") <= F.col("prev.timestamp_s")), ("negative_time", F.col("timestamp_s") < 0),
        ("tick_not_rising", F.col("tick") <= F.col("prev.tick"))])


def check_corners(calib: DataFrame) -> DataFrame:
    """Four court corners inside the image, convex, clockwise, far pair above near pair."""
    xs, ys = [F.col(f"x{i}") for i in range(4)], [F.col(f"y{i}") for i in range(4)]
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    known = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in xs + ys])
    inside = reduce(lambda a, b: a & b, [x.between(0, w - 1) for x in xs] + [y.between(0, h - 1) for y in ys])
    ex, ey = [xs[(i + 1) % 4] - xs[i] for i in range(4)], [ys[(i + 1) % 4] - ys[i] for i in range(4)]
    turn = F.least(*[ex[i] * ey[(i + 1) % 4] - ey[i] * ex[(i + 1) % 4] for i in range(4)])
    area = reduce(lambda a, b: a + b, [xs[i] * ys[(i + 1) % 4] - ys[i] * xs[(i + 1) % 4] for i in range(4)]) / 2
    order = (xs[0] < xs[1]) & (xs[3] < xs[2]) & ((ys[0] + ys[1]) / 2 < (ys[2] + ys[3]) / 2)
    return _report(calib, [
        ("image_size_invalid", (w < 2) | (h < 2)), ("corner_not_finite", ~known), ("corner_outside_image", known & ~inside),
        ("not_convex_in_order", known & (turn <= F.greatest(F.lit(1e-8), w * h * 1e-10))),
        ("area_degenerate", known & (area <= F.greatest(F.lit(1e-6), w * h * 1e-7))), ("corner_order_wrong", known & ~order)], ())


def check_rois(rois: DataFrame, min_area: float = 1e-6) -> DataFrame:
    """Region polygons: at least three distinct points in [0, 1], an area, no self-crossing.

    ``points`` is an array of (x, y); a polygon has few corners, so its edge
    pairs are compared inside the row.
    """
    p = F.col("points")
    n = F.size(p)
    nxt = lambda i: F.element_at(p, F.when(i + 1 >= n, F.lit(1)).otherwise(i + 2))
    unit = F.forall(p, lambda q: F.coalesce(finite(q["x"]).between(0, 1) & finite(q["y"]).between(0, 1), F.lit(False)))
    edges = F.transform(p, lambda a, i: F.struct(i.alias("i"), a.alias("a"), nxt(i).alias("b")))
    area = F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2

    def side(a, b, c):
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def touches(a, b, c):
        return ((F.abs(side(a, b, c)) <= 1e-12) & c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
                & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])))

    def meet(e, f):
        a, b, c, d = e["a"], e["b"], f["a"], f["b"]
        proper = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
        return proper | touches(a, b, c) | touches(a, b, d) | touches(c, d, a) | touches(c, d, b)

    crossed = F.exists("__edges", lambda e: F.exists("__edges", lambda f: (
        (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1)) & meet(e, f))))
    enough = F.coalesce(n >= 3, F.lit(False))
    return _report(rois.withColumn("__edges", edges), [
        ("too_few_points", ~enough), ("point_outside_unit_square", enough & ~unit),
        ("points_repeat", enough & (F.size(F.array_distinct(p)) != n)),
        ("no_area", enough & unit & (area < min_area)), ("self_intersection", enough & unit & crossed)], ())


REVIEW_FIELDS = ("schema_version", "source_video_sha256", "identity_map", "rallies", "events", "recovery_targets")


def check_review_shape(raw: DataFrame) -> DataFrame:
    """Raw review text (``value``, one document per clip): known fields, version one, hex digest."""
    doc = F.from_json("value", "map<string,string>")
    rows = raw.withColumn("doc", doc)
    version, digest = F.col("doc")["schema_version"], F.col("doc")["source_video_sha256"]
    known = F.array(*[F.lit(f) for f in REVIEW_FIELDS])
    return _report(rows, [
        ("not_an_object", F.col("doc").isNull()),
        ("unknown_field", F.size(F.array_except(F.map_keys("doc"), known)) > 0),
        ("version_not_one", version.isNotNull() & ~version.rlike(r"^1(\.0+)?$")),
        ("digest_not_hex", digest.isNotNull() & ~F.lower(digest).rlike("^[0-9a-f]{64}$"))], ())


def check_identity(identity: DataFrame, obs: DataFrame) -> DataFrame:
    tracks = obs.select(CLIP, "track_id").distinct().withColumn("seen", F.lit(True))
    label = F.col("player_label")
    return _report(identity.join(tracks, [CLIP, "track_id"], "left"), [
        ("unknown_track", F.col("seen").isNull()),
        ("label_invalid", ~F.coalesce((F.trim(label) != "") & (F.length(label) <= 80) & ~label.rlike("[\\x00-\\x1f]"), F.lit(False))),
        ("side_invalid", F.col("side").isNotNull() & ~F.col("side").isin("near", "far")),
        ("team_blank", F.col("team").isNotNull() & (F.trim("team") == ""))], ("track_id",))


def check_label_agreement(identity: DataFrame) -> DataFrame:
    """Fragments of one athlete agree on side and on team."""
    s = identity.groupBy(CLIP, F.trim("player_label").alias("label")).agg(
        F.min("side").alias("s0"), F.max("side").alias("s1"), F.min("team").alias("t0"), F.max("team").alias("t1"))
    return _report(s, [("sides_differ", F.col("s0") != F.col("s1")), ("teams_differ", F.col("t0") != F.col("t1"))], ("label",))


def check_simultaneous(identity: DataFrame, obs: DataFrame) -> DataFrame:
    """Two tracks in one frame never carry one label."""
    named = obs.select(*FRAME, "track_id").join(
        identity.select(CLIP, "track_id", F.trim("player_label").alias("label")), [CLIP, "track_id"])
    return _duplicates(named, [*FRAME, "label"], "label_twice_in_frame")


def _labels(identity: DataFrame) -> DataFrame:
    return identity.select(CLIP, F.trim("player_label").alias("__label")).distinct().withColumn("__known", F.lit(True))


def _with_label(rows: DataFrame, identity: DataFrame, column: str) -> DataFrame:
    lab = _labels(identity)
    return rows.join(lab, [rows[CLIP] == lab[CLIP], rows[column] == lab["__label"]], "left").drop(lab[CLIP]).drop("__label")


def _with_frame(rows: DataFrame, frames: DataFrame, column: str, into: str) -> DataFrame:
    f = frames.select(CLIP, F.col("frame_index").alias(column)).distinct().withColumn(into, F.lit(True))
    return rows.join(f, [CLIP, column], "left")


def check_rallies(rallies: DataFrame, frames: DataFrame, identity: DataFrame) -> DataFrame:
    """Rallies in list order (``ordinal``): named, existing frames, ordered, apart, known winner."""
    rows = _with_frame(_with_frame(rallies, frames, "start_frame", "__s"), frames, "end_frame", "__e")
    rows = _with_label(rows, identity, "winner_label")
    # A clip's rallies are a short reviewed list; its order is the list order.
    rows = previous_row(rows, [CLIP], "ordinal", ["end_frame"], float(LAYOUT.block_frames))
    return union(
        _duplicates(rallies.where(F.trim("rally_id") != ""), [CLIP, "rally_id"], "rally_id_repeats"),
        _report(rows, [
            ("rally_id_blank", F.coalesce(F.trim("rally_id") == "", F.lit(True))),
            ("frame_unknown", F.col("__s").isNull() | F.col("__e").isNull()),
            ("ends_before_start", F.col("start_frame") > F.col("end_frame")),
            ("overlaps_previous", F.col("start_frame") <= F.coalesce("prev.end_frame", F.lit(-1))),
            ("winner_unknown", F.col("winner_label").isNotNull() & F.col("__known").isNull())], ("ordinal",)))


def check_events(events: DataFrame, frames: DataFrame, identity: DataFrame) -> DataFrame:
    rows = _with_label(_with_frame(events, frames, "frame_index", "__f"), identity, "player_label")
    return _report(rows, [
        ("frame_unknown", F.col("__f").isNull()), ("kind_unknown", ~F.coalesce(F.col("kind").isin(*EVENT_KINDS), F.lit(False))),
        ("label_unknown", F.col("player_label").isNotNull() & F.col("__known").isNull())])


def check_targets(targets: DataFrame, frames: DataFrame, identity: DataFrame) -> DataFrame:
    last = frames.groupBy(CLIP).agg(F.max("frame_index").alias("__last"))
    rows = targets.join(last, CLIP, "left").withColumns({
        "until_frame": F.coalesce("until_frame", "__last"), "radius_m": F.coalesce("radius_m", F.lit(0.5))})
    rows = _with_label(_with_frame(_with_frame(rows, frames, "contact_frame", "__c"), frames, "until_frame", "__u"), identity, "player_label")
    x, y, r = finite(F.col("target_x_m")), finite(F.col("target_y_m")), finite(F.col("radius_m"))
    return _report(rows, [
        ("label_unknown", F.col("__known").isNull()), ("contact_frame_unknown", F.col("__c").isNull()),
        ("until_frame_unknown", F.col("__u").isNull()), ("ends_before_contact", F.col("until_frame") < F.col("contact_frame")),
        ("value_not_finite", x.isNull() | y.isNull() | r.isNull()),
        ("target_off_court", ~(x.between(0, COURT_WIDTH) & y.between(0, COURT_LENGTH))),
        ("radius_invalid", ~((r > 0) & (r <= 3)))], ("ordinal",))


def check_binding(reviews: DataFrame, calibrations: DataFrame, clips: DataFrame) -> DataFrame:
    """Review, calibration and clip name the same source, where they name one."""
    rows = (clips.select(CLIP, F.col("source_digest").alias("c"))
            .join(reviews.select(CLIP, F.lower("source_digest").alias("r")), CLIP, "left")
            .join(calibrations.select(CLIP, F.lower("source_digest").alias("k")), CLIP, "left"))
    return _report(rows, [("review_for_other_source", F.col("r") != F.col("c")), ("calibration_for_other_source", F.col("k") != F.col("c")),
                          ("review_and_calibration_differ", F.col("r") != F.col("k"))], ())


def check_heatmap(cells: DataFrame) -> DataFrame:
    v = finite(F.col("seconds"))
    return _report(cells, [("seconds_invalid", F.coalesce(v < 0, F.lit(True)))], ("track_id", "cell_row", "cell_col"))


def check_pose_export(obs: DataFrame, wide: DataFrame) -> DataFrame:
    """Nested and wide exports agree: same keys once, hidden points without coordinates."""
    key = [*FRAME, "track_id"]
    a = obs.groupBy(*key).agg(F.count(F.lit(1)).alias("a"), F.max(F.exists("keypoints", lambda p: ~p["visible"] & (
        p["x"].isNotNull() | p["y"].isNotNull()))).alias("leak"), F.max(F.size("keypoints") != len(KEYPOINTS)).alias("short"))
    b = wide.groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
    return _report(a.join(b, key, "full"), [
        ("row_counts_differ", ~F.col("a").eqNullSafe(F.col("b"))), ("id_repeats", (F.col("a") > 1) | (F.col("b") > 1)),
        ("hidden_point_with_coordinates", F.col("leak")), ("not_seventeen_points", F.col("short"))], ("frame_index", "track_id"))
