"""Player floor motion: validity, segments, smoothing, intervals, occupancy.

All sequence work runs on ``(clip, track, block)`` with a block of
``Layout.block_s`` seconds and a halo wide enough for the gap cap and the
smoothing window, so a track of any length spreads over tasks.  The one measure
that needs a whole segment, whether the athlete stood still, is settled inside
the block when the segment lies inside it, and by :func:`_still_across_blocks`
for the few segments that cross an edge.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import calibration_confirmed, heatmap_cell, on_court, zone
from ..functions.flags import flag_set, invalidates, merge, or_empty
from ..functions.ordered import block_of, carry_over, fill_forward, long_groups, with_halo
from ..functions.stats import exact_median, finite
from ..policy import COURT_LENGTH, COURT_WIDTH, LAYOUT, POLICY, Layout, Policy
from ..sources.store import materialize
from .timeline import CLIP, with_gap_cap

TRACK = [CLIP, "track_id"]
BLOCK = [*TRACK, "block"]


def player_positions(obs: DataFrame, calibrations: DataFrame | None = None, policy: Policy = POLICY) -> DataFrame:
    """Usable floor positions with every reason against them.

    ``flags`` on the input is the union of frame, court and position flags.
    Without ``calibrations``, or for a clip that has none, no position is usable.
    """
    x, y = finite(F.col("x_m")), finite(F.col("y_m"))
    flags = or_empty(F.col("flags")) if "flags" in obs.columns else F.array().cast("array<string>")
    if calibrations is None:
        confirmed, known = F.lit(False), F.lit(False)
    else:
        c = calibrations.select(CLIP, "method", "manually_reviewed")
        obs = obs.join(c, CLIP, "left")
        known = F.col("method").isNotNull()
        confirmed = calibration_confirmed(F.col("method"), F.col("manually_reviewed"))
    has_xy = x.isNotNull() & y.isNotNull()
    weak = F.coalesce("low_confidence", F.lit(False))
    tainted = F.when(F.size(flags) > 0, invalidates(flags)).otherwise(F.lit(False))
    valid = confirmed & has_xy & ~weak & ~tainted
    m = policy.floor_margin_m
    near = x.between(-m, COURT_WIDTH + m) & y.between(-m, COURT_LENGTH + m)
    usable = F.coalesce(valid & near, F.lit(False))
    own = flag_set((~known, "court_calibration_unavailable"), (~has_xy, "court_position_unavailable"),
                   (weak, "low_confidence_pose"), (valid & ~near, "position_outside_reasonable_floor_bounds"),
                   (known & ~confirmed, "unconfirmed_court_calibration"))
    keep = [c for c in obs.columns if c not in ("x_m", "y_m", "flags", "method", "manually_reviewed")]
    return obs.select(*keep, x.alias("x_m"), y.alias("y_m"), usable.alias("valid_position"),
                      F.when(usable, zone(x, y)).alias("zone"),
                      merge(F.when(F.size(flags) > 1, F.array_sort(flags)).otherwise(flags), own).alias("quality_flags"))


def with_identity(rows: DataFrame, identity: DataFrame) -> DataFrame:
    """Reviewed label, side and team of the track; null when not reviewed."""
    return rows.join(identity.select(*TRACK, "player_label", "side", "team"), TRACK, "left")


def _links(rows: DataFrame, policy: Policy, layout: Layout) -> DataFrame:
    """Rows per block (halo included) with the break reason and a block-local segment number."""
    # Reach: an interval, plus the two nearest neighbours or the window around its start.
    reach = F.col("gap_cap_s") * 3 + policy.smoothing_half_window_s + 1e-6
    rows = with_halo(rows, F.col("timestamp_s"), layout.block_s, reach, reach)
    w = Window.partitionBy(*BLOCK).orderBy("frame_index")
    prev = {f"prev_{c}": F.lag(c).over(w) for c in ("frame_index", "timestamp_s", "x_m", "y_m", "valid_position")}
    dt = F.col("timestamp_s") - F.col("prev_timestamp_s")
    dx, dy = F.col("x_m") - F.col("prev_x_m"), F.col("y_m") - F.col("prev_y_m")
    # A stamp that doesn't advance breaks the motion like a gap.
    gap = (F.col("frame_index") != F.col("prev_frame_index") + 1) | (dt > F.col("gap_cap_s")) | (dt <= 0)
    after_valid = F.coalesce(F.col("valid_position") & F.col("prev_valid_position"), F.lit(False))
    reason = F.when(after_valid, F.when(gap, "observation_gap").when(
        F.try_divide(F.sqrt(dx * dx + dy * dy), dt) > policy.max_player_speed_m_s, "implausible_position_jump"))
    starts = F.col("valid_position") & (~F.col("after_valid") | F.col("reason").isNotNull())
    rows = (rows.withColumns(prev)
                .withColumns({"after_valid": after_valid, "reason": reason, "first_seen": F.col("prev_frame_index").isNull()})
                .withColumn("starts", starts))
    count = F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Unusable rows stand alone, so they never join a segment.
    return (rows.withColumn("seg", F.when(F.col("valid_position"), count).otherwise(-1 - F.col("frame_index")))
                .drop(*prev, "after_valid"))


def _beyond_edges(rows: DataFrame, policy: Policy, layout: Layout) -> DataFrame | None:
    """What lies beyond a block's edges, per (track, block): validity of the row before it and resting points.

    Only tracks with rows outside their first block have any.  Their names are written once, so that no work is
    planned where there are none; ``None`` then.
    """
    pos = F.col("timestamp_s")
    names = materialize(long_groups(rows, TRACK, pos, layout.block_s))
    if names.isEmpty():
        return None
    long_rows = rows.join(names, TRACK, "left_semi")
    earlier = carry_over(long_rows, TRACK, pos, layout.block_s, F.max_by("valid_position", pos))
    return earlier.join(_still_across_blocks(long_rows, policy, layout), BLOCK, "full")


def _still_across_blocks(long_rows: DataFrame, policy: Policy, layout: Layout) -> DataFrame:
    """Resting point of motionless segments that cross a block edge, per (track, block).

    The rows are read many times below, so they are written once (``spark.checkpoint.dir``).
    """
    core = (_links(long_rows, policy, layout).where("is_core and valid_position")
            .select(*TRACK, F.col("block").alias("own_block"), "frame_index", "timestamp_s", "x_m", "y_m", "starts"))
    core = materialize(fill_forward(core, TRACK, "timestamp_s", F.when(F.col("starts"), F.col("frame_index")),
                                    layout.block_s, "segment"))
    key = [*TRACK, "segment"]
    spread = policy.stationary_extent_m + 1e-9
    shape = core.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("own_block").alias("b0"), F.max("own_block").alias("b1"),
        (F.max("x_m") - F.min("x_m")).alias("wx"), (F.max("y_m") - F.min("y_m")).alias("wy"))
    # Twice the largest distance to the median bounds the extent, so wide segments drop out early.
    shape = shape.where((F.col("b1") > F.col("b0")) & (F.col("n") >= 3) & (F.col("wx") <= spread) & (F.col("wy") <= spread))
    pts = core.join(shape, key).select(*key, "b0", "b1", "x_m", "y_m")
    axes = pts.select(*key, F.explode(F.create_map(F.lit("x"), F.col("x_m"), F.lit("y"), F.col("y_m"))).alias("axis", "v"))
    centre = exact_median(axes, [*key, "axis"], "v", 1e-5).groupBy(*key).agg(
        F.max(F.when(F.col("axis") == "x", F.col("median"))).alias("mx"),
        F.max(F.when(F.col("axis") == "y", F.col("median"))).alias("my"))
    dx, dy = F.col("x_m") - F.col("mx"), F.col("y_m") - F.col("my")
    still = (pts.join(centre, key).groupBy(*key, "b0", "b1", "mx", "my").agg(F.max(F.sqrt(dx * dx + dy * dy)).alias("r"))
                .where(F.col("r") * 2 <= policy.stationary_extent_m))
    point = F.struct("mx", "my")
    return still.withColumn("block", F.explode(F.sequence("b0", "b1"))).groupBy(*BLOCK).agg(
        F.max(F.when(F.col("b0") < F.col("block"), point)).alias("still_head"),
        F.max(F.when(F.col("b1") > F.col("block"), point)).alias("still_tail"))


def _neighbours(ws) -> dict:
    """Times of the three rows of the segment on both sides, places of two."""
    at = {"p": F.lag, "n": F.lead}
    return {f"{side}{k}_{short}": at[side](c, k).over(ws) for side in at for k in (1, 2, 3)
            for short, c in (("t", "timestamp_s"), ("x", "x_m"), ("y", "y_m")) if k < 3 or short == "t"}


def _read_off(w, s, ss, x, y, sx, sy) -> tuple:
    """The weighted line's value at offset zero, from its sums."""
    det = w * ss - s * s
    return F.try_divide(ss * x - s * sx, det), F.try_divide(ss * y - s * sy, det)


def _with_close_fit(r: DataFrame, policy: Policy) -> DataFrame:
    """Weighted straight-line fit through the neighbours in time, read off at the row itself (``fit_x``, ``fit_y``).

    For rows whose window holds no row beyond the second on either side: plain arithmetic on five rows, in time order.
    With fewer than three in the window the three nearest count, an earlier row before a later one at the same distance.
    """
    half, t0, names = policy.smoothing_half_window_s, F.col("timestamp_s"), ("p2", "p1", "n1", "n2")
    have = {k: F.col(f"{k}_o").isNotNull() for k in names}
    away = {k: F.abs(F.col(f"{k}_o")) for k in names}
    r = r.withColumns({f"{k}_o": F.col(f"{k}_t") - t0 for k in names})
    r = r.withColumns({f"{k}_in": F.coalesce(away[k] <= half + policy.window_slack_s, F.lit(False)) for k in names})
    held = sum((F.col(f"{k}_in").cast("int") for k in names), F.lit(1))
    r = r.withColumns({
        "few": held < 3,
        "p2_near": have["p2"] & (~have["n1"] | F.coalesce(away["p2"] <= away["n1"], F.lit(False))),
        "n2_near": have["n2"] & (~have["p1"] | F.coalesce(away["n2"] < away["p1"], F.lit(False)))})
    near = {"p2": F.col("p2_near"), "p1": have["p1"] & ~F.col("n2_near"), "n1": have["n1"] & ~F.col("p2_near"), "n2": F.col("n2_near")}
    weight = lambda k: 1.0 / (1.0 + (F.col(f"{k}_o") / half) * (F.col(f"{k}_o") / half))
    r = r.withColumns({f"{k}_w": F.when(F.when(F.col("few"), near[k]).otherwise(F.col(f"{k}_in")), weight(k)).otherwise(0.0) for k in names})
    zero = F.lit(0.0)
    rows = [(F.col(f"{k}_w"), *[F.coalesce(f"{k}_{c}", zero) for c in "oxy"]) for k in names]
    rows.insert(2, (F.lit(1.0), zero, F.col("x_m"), F.col("y_m")))
    made = {"w": lambda w, o, x, y: w, "s": lambda w, o, x, y: w * o, "ss": lambda w, o, x, y: w * o * o, "x": lambda w, o, x, y: w * x,
            "y": lambda w, o, x, y: w * y, "sx": lambda w, o, x, y: w * o * x, "sy": lambda w, o, x, y: w * o * y}
    r = r.withColumns({f"sum_{n}": sum((f(*row) for row in rows), zero) for n, f in made.items()})
    fit = _read_off(*[F.col(f"sum_{n}") for n in made])
    worked = F.col("valid_position") & (F.col("n") >= 3) & ~F.col("dense")
    r = r.withColumns({f"fit_{c}": F.when(worked, v) for c, v in zip("xy", fit)})
    return r.drop(*[f"{k}_{c}" for k in names for c in ("o", "in", "w", "t", "x", "y")], *[f"sum_{n}" for n in made], "few", "p2_near", "n2_near", "p3_t", "n3_t")


def _dense_fit(policy: Policy):
    """The same fit for a row with more neighbours, all of which are in ``neighbours``."""
    half, t0 = policy.smoothing_half_window_s, F.col("timestamp_s")
    near = F.filter("neighbours", lambda p: F.abs(p["t"] - t0) <= half + policy.window_slack_s)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "s", "ss", "x", "y", "sx", "sy")])

    def add(a, p):
        o = p["t"] - t0
        w = 1.0 / (1.0 + (o / half) * (o / half))
        return F.struct((a["w"] + w).alias("w"), (a["s"] + w * o).alias("s"), (a["ss"] + w * o * o).alias("ss"),
                        (a["x"] + w * p["x"]).alias("x"), (a["y"] + w * p["y"]).alias("y"),
                        (a["sx"] + w * o * p["x"]).alias("sx"), (a["sy"] + w * o * p["y"]).alias("sy"))

    def read_off(a):
        x, y = _read_off(*[a[n] for n in ("w", "s", "ss", "x", "y", "sx", "sy")])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.aggregate(near, zero, add, read_off)


def player_motion(positions: DataFrame, timeline: DataFrame, policy: Policy = POLICY, layout: Layout = LAYOUT) -> DataFrame:
    """Smoothed positions and accepted motion intervals, one row per observation."""
    rows = with_gap_cap(positions, timeline, policy, layout)
    core_cols = [*TRACK, "frame_index", "timestamp_s", "x_m", "y_m", "valid_position", "gap_cap_s"]
    pos = F.col("timestamp_s")
    r = _links(rows, policy, layout)
    # What lies beyond a block edge joins on the block keys, where the rows already are; short tracks leave nothing there.
    beyond = _beyond_edges(rows.select(*core_cols), policy, layout)
    if beyond is None:
        r = r.withColumns({c: F.lit(None).cast("struct<mx:double,my:double>") for c in ("still_head", "still_tail")})
    else:
        r = r.join(beyond, BLOCK, "left").withColumn("reason", F.when(
            F.col("is_core") & F.col("first_seen") & F.col("valid_position") & F.coalesce("carried", F.lit(False)),
            "observation_gap").otherwise(F.col("reason"))).drop("carried")

    # One order serves every window below, so the rows are sorted once per segment.
    seg_by = ", ".join([*BLOCK, "seg"])
    ws = Window.partitionBy(*BLOCK, "seg").orderBy("timestamp_s")
    whole = ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = block_of(pos, layout.block_s)
    spread = policy.stationary_extent_m + 1e-9
    r = r.withColumns({
        "n": F.count(F.lit(1)).over(whole),
        "maybe": F.col("valid_position") & (F.count(F.lit(1)).over(whole) >= 3)
        & (F.max("x_m").over(whole) - F.min("x_m").over(whole) <= spread)
        & (F.max("y_m").over(whole) - F.min("y_m").over(whole) <= spread),
        "before": F.max(own < F.col("block")).over(whole),
        "after": F.max(own > F.col("block")).over(whole),
        "inside": F.max("is_core").over(whole), **_neighbours(ws)})
    slack = policy.smoothing_half_window_s + policy.window_slack_s
    beside = [F.coalesce(gap <= slack, F.lit(False)) for gap in (pos - F.col("p3_t"), F.col("n3_t") - pos)]
    r = r.withColumn("dense", F.col("valid_position") & (beside[0] | beside[1]))
    r = _with_close_fit(r, policy)
    r = r.withColumns({m: F.percentile(F.when(F.col("maybe"), F.col(c)), F.lit(0.5)).over(whole)
                       for m, c in (("mx", "x_m"), ("my", "y_m"))} | {"crowded": F.max("dense").over(whole)})
    dx, dy = F.col("x_m") - F.col("mx"), F.col("y_m") - F.col("my")
    radius = F.max(F.sqrt(dx * dx + dy * dy)).over(whole)
    rest = (F.when(F.col("inside") & F.col("before"), F.col("still_head"))
             .when(F.col("inside") & F.col("after"), F.col("still_tail"))
             .when(F.col("radius") * 2 <= policy.stationary_extent_m, F.struct("mx", "my")))
    # Lists are only made in segments with more rows in a window than the plain fit takes.
    point = F.struct(F.col("timestamp_s").alias("t"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    reach = policy.smoothing_half_window_s + 1e-6
    r = r.withColumn("p0", F.when(F.col("crowded"), point)).withColumns({"radius": radius, "neighbours": F.expr(
        f"collect_list(p0) over (partition by {seg_by} order by timestamp_s range between {reach!r}D preceding and {reach!r}D following)")})
    # The fit only counts where the athlete moved.
    r = (r.withColumn("rest", rest)
          .withColumn("fit", F.when(F.col("dense") & F.col("rest").isNull(), _dense_fit(policy)))
          .drop("p0", "neighbours", "crowded", "dense"))
    r = r.withColumns({f"smoothed_{axis}_m": F.when(F.col("valid_position"), F.coalesce(
        F.col(f"rest.{m}"), F.col(f"fit.{axis}"), F.col(f"fit_{axis}"), F.col(f"{axis}_m"))) for axis, m in (("x", "mx"), ("y", "my"))})

    back = {f"back_{c}": F.lag(c).over(ws) for c in ("frame_index", "timestamp_s", "x_m", "y_m", "smoothed_x_m", "smoothed_y_m")}
    r = r.withColumns(back)
    dt = pos - F.col("back_timestamp_s")
    sx, sy = F.col("smoothed_x_m") - F.col("back_smoothed_x_m"), F.col("smoothed_y_m") - F.col("back_smoothed_y_m")
    r = r.where("is_core").withColumns({"dt": F.when(F.col("valid_position"), dt), "moved": F.sqrt(sx * sx + sy * sy)})
    fast = F.try_divide("moved", "dt") > policy.max_player_speed_m_s
    ok = F.col("dt").isNotNull() & ~fast
    flags = merge(F.col("quality_flags"), flag_set(
        (F.col("reason") == "implausible_position_jump", "implausible_position_jump"),
        (F.col("dt").isNotNull() & fast, "implausible_smoothed_speed"),
        (F.col("reason") == "observation_gap", "observation_gap")))
    made = {"flags", "low_confidence", "gap_cap_s", "x_m", "y_m", "valid_position", "zone", "quality_flags", *TRACK,
            "frame_index", "timestamp_s"}
    extra = [c for c in positions.columns if c not in made]
    return r.select(
        *TRACK, "frame_index", "timestamp_s", *extra, "x_m", "y_m", "valid_position", "starts",
        "smoothed_x_m", "smoothed_y_m",
        F.when(ok, F.col("back_frame_index")).alias("interval_start_frame"),
        F.when(ok, F.col("back_timestamp_s")).alias("interval_start_timestamp_s"),
        F.when(ok, F.col("dt")).alias("interval_duration_s"), F.when(ok, F.col("moved")).alias("distance_m"),
        F.when(ok, F.try_divide("moved", "dt")).alias("speed_m_s"),
        F.when(ok, F.struct(F.col("back_x_m").alias("x_m"), F.col("back_y_m").alias("y_m"))).alias("interval_start_point"),
        "zone", flags.alias("quality_flags"))


def occupancy(motion: DataFrame) -> DataFrame:
    """Half of each accepted interval at both of its end points, at raw positions."""
    here = F.struct("x_m", "y_m")
    ends = motion.where("interval_duration_s is not null").select(
        *TRACK, F.explode(F.array("interval_start_point", here)).alias("p"), (F.col("interval_duration_s") / 2).alias("seconds"))
    x, y = F.col("p.x_m"), F.col("p.y_m")
    row, col = heatmap_cell(x, y)
    inside = on_court(x, y)
    return ends.select(*TRACK, zone(x, y).alias("zone"), F.when(inside, row).alias("cell_row"),
                       F.when(inside, col).alias("cell_col"), "seconds")


def zone_seconds(occ: DataFrame) -> DataFrame:
    return occ.groupBy(*TRACK, "zone").agg(F.sum("seconds").alias("seconds"))


def heatmap(occ: DataFrame) -> DataFrame:
    """Seconds per grid cell, filled cells only."""
    return (occ.where("cell_row is not null").groupBy(*TRACK, "cell_row", "cell_col")
               .agg(F.sum("seconds").alias("seconds")))


def heatmap_intensity(cells: DataFrame) -> DataFrame:
    """Logarithmic share of the fullest cell; a grid has at most 1296 cells per track."""
    top = F.max("seconds").over(Window.partitionBy(*TRACK))
    return cells.withColumn("intensity", F.when(top > 0, F.log1p("seconds") / F.log1p(top)).otherwise(0.0))


def grid_place() -> Column:
    """A cell's place in the grid, in row order."""
    return (F.col("cell_row") * POLICY.heatmap_cols + F.col("cell_col")).cast("int")


def dense_grid(filled: Column) -> Column:
    """Seconds of all cells in row order, zeros where nobody was, from a list of ``(place, seconds)`` in order of place; null for none.

    Filled cells stand with as many zeros before each as the grid has empty ones there, so the work goes by the filled
    cells and not by the grid's 1296.  ``filled`` is a column or a field, as it is read for each cell.
    """
    size = POLICY.heatmap_rows * POLICY.heatmap_cols
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    before = lambda i: F.coalesce(F.get(filled, i - 1)["place"], F.lit(-1))
    runs = F.transform(filled, lambda c, i: F.concat(zeros(c["place"] - before(i) - 1), F.array(c["seconds"])))
    tail = zeros(F.lit(size - 1) - F.element_at(filled, -1)["place"])
    return F.when(filled.isNull(), zeros(F.lit(size))).otherwise(F.concat(F.flatten(runs), tail))


def dense_heatmap(cells: DataFrame, tracks: DataFrame) -> DataFrame:
    """The whole grid of each of ``tracks``, and the grid's size."""
    filled = cells.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct(grid_place().alias("place"), "seconds"))).alias("filled"))
    return tracks.select(*TRACK).distinct().join(filled, TRACK, "left").select(
        *TRACK, F.array(F.lit(POLICY.heatmap_rows), F.lit(POLICY.heatmap_cols)).alias("grid_shape"), dense_grid(F.col("filled")).alias("values_s"))


def top_zones(zones: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*TRACK).orderBy(F.desc("seconds"), "zone")
    return zones.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def flag_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return (rows.select(*(by or TRACK), F.explode("quality_flags").alias("flag"))
                .groupBy(*(by or TRACK), "flag").agg(F.count(F.lit(1)).alias("rows")))


def fragment_summary(motion: DataFrame, timeline: DataFrame) -> DataFrame:
    """Totals per track: distances stay null without an interval, time is zero."""
    labels = [c for c in ("player_label", "side", "team") if c in motion.columns]
    # A track has one label, side and team, so they are part of the key and the aggregate stays hash-based.
    s = motion.groupBy(*TRACK, *labels).agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
        F.count(F.lit(1)).alias("observed_frames"), F.count_if("valid_position").alias("valid_position_frames"),
        F.count("distance_m").alias("motion_intervals"), F.sum("distance_m").alias("distance_m"),
        F.coalesce(F.sum("interval_duration_s"), F.lit(0.0)).alias("valid_motion_time_s"),
        F.max("speed_m_s").alias("max_speed_m_s"))
    frames = timeline.groupBy(CLIP).agg(F.count(F.lit(1)).alias("clip_frames"))
    status = (F.when(F.col("player_label").isNotNull(), "manually_mapped_fragment").otherwise("unverified_tracker_fragment")
              if "player_label" in labels else F.lit("unverified_tracker_fragment"))
    return s.join(frames, CLIP, "left").select(
        *TRACK, *labels, "first_frame", "last_frame", "observed_frames", "valid_position_frames", "motion_intervals",
        F.greatest(F.lit(0), F.col("observed_frames") - 1 - F.col("motion_intervals")).cast("long").alias("excluded_motion_intervals"),
        "distance_m", "valid_motion_time_s", F.try_divide("distance_m", "valid_motion_time_s").alias("average_speed_m_s"),
        "max_speed_m_s", (F.col("motion_intervals") / F.greatest(F.lit(1), F.col("clip_frames") - 1)).alias("coverage"),
        status.alias("identity_status"))
