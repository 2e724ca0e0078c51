"""Camera calibration: matrices, projection, floor lines, consistency measures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.court import (calibration_confirmed, homography, project, within_active_court)
from ..functions.flags import flag_set
from ..functions.linalg import centred, centred_values, condition3, row_norms_after_jacobi
from ..policy import (COURT_LENGTH, COURT_WIDTH, DOUBLES_SERVICE_FROM_BASELINE, SERVICE_FROM_NET, SINGLES_MARGIN)
from .timeline import CLIP

CORNERS = ["x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"]
#: The corners' places on the floor, in the same order.
COURT_CORNERS = [(0.0, 0.0), (COURT_WIDTH, 0.0), (COURT_WIDTH, COURT_LENGTH), (0.0, COURT_LENGTH)]
#: Greatest conditions of the fit's equations and of the normalized mapping; least distance of the image origin from the horizon.
DESIGN_LIMIT, MAPPING_LIMIT, HORIZON_LIMIT = 1e8, 1e10, 1e-14
#: Sweeps that make the eight rows of the equations orthogonal to the last digit.
SWEEPS = 8


def fit_homography(calib: DataFrame) -> DataFrame:
    """Add ``to_court`` and ``to_image``, row-major 3x3 matrices with last element one."""
    to_image, to_court = homography([F.col(c).cast("double") for c in CORNERS])
    return calib.withColumns({"to_court": F.array(*to_court), "to_image": F.array(*to_image)})


def _matrix(name: str) -> list[Column]:
    return [F.col(name)[i] for i in range(9)]


def _map_points(points: DataFrame, calib: DataFrame, matrix: str, x: str, y: str, out: tuple[str, str]) -> DataFrame:
    m = calib.select(CLIP, F.col(matrix).alias("__m"))
    px, py, _ = project(_matrix("__m"), F.col(x), F.col(y))
    return points.join(m, CLIP, "left").withColumns({out[0]: px, out[1]: py}).drop("__m")


def image_to_court(points: DataFrame, calib: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Floor metres of image points; null at the horizon."""
    return _map_points(points, calib, "to_court", x, y, ("x_m", "y_m"))


def court_to_image(points: DataFrame, calib: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    return _map_points(points, calib, "to_image", x, y, ("x_px", "y_px"))


def project_players(obs: DataFrame, calib: DataFrame) -> DataFrame:
    """Floor position of the ankle anchor (``ankle_x``, ``ankle_y``) with its flags.

    Nothing is clamped or filled: a missing anchor or a point at the horizon
    gives no position and says why.  ``mode`` selects the active court.
    """
    c = calib.select(CLIP, F.col("to_court").alias("__m"), (~calibration_confirmed(
        F.col("method"), F.col("manually_reviewed"))).alias("__unconfirmed"))
    x, y, _ = project(_matrix("__m"), F.col("ankle_x"), F.col("ankle_y"))
    rows = obs.join(c, CLIP, "left").withColumns({"x_m": x, "y_m": y})
    x, y = F.col("x_m"), F.col("y_m")
    singles, doubles = within_active_court(x, y, True), within_active_court(x, y, False)
    anchored = F.col("ankle_x").isNotNull() & F.col("ankle_y").isNotNull()
    placed = x.isNotNull() & y.isNotNull()
    active = F.when(F.col("mode") == "singles", singles).otherwise(doubles)
    flags = flag_set(
        (~anchored, "ankle_midpoint_unavailable"), (anchored & ~placed, "court_projection_unavailable"),
        (placed, "approximate_floor_projection"), (placed & F.col("low_confidence"), "low_confidence_pose"),
        (placed & F.col("__unconfirmed"), "unconfirmed_court_calibration"), (placed & ~active, "outside_active_court"))
    return rows.withColumns({"in_doubles_court": doubles, "in_singles_court": singles, "court_flags": flags}).drop("__m", "__unconfirmed")


def court_frame_flags(frames: DataFrame, projected: DataFrame, calib: DataFrame) -> DataFrame:
    """Frame-level court flags; frames without players are kept."""
    lost = projected.groupBy(CLIP, "frame_index").agg(F.max(F.col("x_m").isNull()).alias("lost"))
    unconfirmed = calib.select(CLIP, (~calibration_confirmed(F.col("method"), F.col("manually_reviewed"))).alias("u"))
    return (frames.join(lost, [CLIP, "frame_index"], "left").join(unconfirmed, CLIP, "left")
            .select(*frames.columns, flag_set((F.coalesce("lost", F.lit(False)), "court_position_unavailable"),
                                              (F.coalesce("u", F.lit(False)), "unconfirmed_court_calibration"))
                    .alias("court_quality_flags")))


def projection_summary(projected: DataFrame) -> DataFrame:
    """Counts per clip of what could be placed on the floor."""
    has = lambda f: F.array_contains("court_flags", f)
    return projected.groupBy(CLIP).agg(
        F.count(F.lit(1)).alias("player_observations"), F.count("x_m").alias("positions_available"),
        F.count_if(F.col("x_m").isNull()).alias("positions_missing"),
        F.count_if(has("outside_active_court")).alias("positions_outside_active_court"),
        F.count_if(has("low_confidence_pose")).alias("positions_with_low_confidence_pose"))


def court_range(positions: DataFrame) -> DataFrame:
    return positions.groupBy(CLIP).agg(
        F.min("x_m").alias("x_min_m"), F.max("x_m").alias("x_max_m"),
        F.min("y_m").alias("y_min_m"), F.max("y_m").alias("y_max_m"))


def fit_diagnostics(calib: DataFrame) -> DataFrame:
    """Largest corner error in metres, round-trip error in pixels over nine sample points, and conditions of the fit.

    ``acceptable`` applies the limits 1e-7 m, 1e-5 px, and those of ``condition_numbers``.
    """
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    px = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    mid = [((px[i][0] + px[(i + 1) % 4][0]) / 2, (px[i][1] + px[(i + 1) % 4][1]) / 2) for i in range(4)]
    mean = (sum((p[0] for p in px[1:]), px[0][0]) / 4, sum((p[1] for p in px[1:]), px[0][1]) / 4)
    through = lambda name, p: (lambda q: point(q[0], q[1]))(project(_matrix(name), p["x"], p["y"]))
    out = calib.withColumn("__image", F.array(*[point(x, y) for x, y in px + mid + [mean]]))
    out = out.withColumn("__court", F.transform("__image", lambda p: through("to_court", p)))
    out = out.withColumn("__back", F.transform("__court", lambda p: through("to_image", p)))
    away = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])
    truth = F.array(*[point(F.lit(x), F.lit(y)) for x, y in COURT_CORNERS])
    out = out.withColumns({"__fit": F.zip_with(F.slice("__court", 1, 4), truth, away), "__trip": F.zip_with("__image", "__back", away)})
    # A sample point at the horizon leaves a null behind and fails the calibration.
    broken = F.exists(F.concat("__fit", "__trip"), lambda e: e.isNull())
    out = out.withColumns({"max_corner_fit_error_m": F.when(~broken, F.array_max("__fit")), "max_roundtrip_error_px": F.when(~broken, F.array_max("__trip"))})
    out = with_conditions(out.drop("__image", "__court", "__back", "__fit", "__trip"))
    fits = (F.col("max_corner_fit_error_m") <= 1e-7) & (F.col("max_roundtrip_error_px") <= 1e-5)
    return out.withColumn("acceptable", F.col("well_conditioned") & F.coalesce(fits, F.lit(False)))


def with_conditions(calib: DataFrame) -> DataFrame:
    """``calib`` with ``design_condition``, ``mapping_condition`` and ``well_conditioned``.

    Image corners and court corners are moved and scaled to mean distance root two first.  The design condition is that
    of the eight equations that the four corners give for the mapping, the other one that of the mapping between the
    scaled points.  Corners on one line have neither, and a mapping that sends the image origin to
    the horizon counts as ill-conditioned too.
    """
    _, scale, mx, my = centred([(F.col(f"x{i}").cast("double"), F.col(f"y{i}").cast("double")) for i in range(4)])
    floor, floor_scale, cx, cy = centred_values(COURT_CORNERS)
    out = calib.withColumns({"__k": scale, "__mx": mx, "__my": my})
    k, mx, my = F.col("__k"), F.col("__mx"), F.col("__my")
    # Each step's values are columns of their own, so that none is spelled out again in the next.
    out = out.withColumns({f"__p{i}": F.array(k * (F.col(f"x{i}") - mx), k * (F.col(f"y{i}") - my)) for i in range(4)})
    one, zero, rows = F.lit(1.0), F.lit(0.0), []
    for i, (u, v) in enumerate(floor):
        x, y = F.col(f"__p{i}")[0], F.col(f"__p{i}")[1]
        rows += [F.array(-x, -y, -one, zero, zero, zero, u * x, u * y, F.lit(u)), F.array(zero, zero, zero, -x, -y, -one, v * x, v * y, F.lit(v))]
    # Scaled court points -> court -> image -> scaled image points: the mapping's inverse, which has its condition.
    m = _matrix("to_image")
    from_floor = [[m[3 * r] / floor_scale, m[3 * r + 1] / floor_scale, m[3 * r] * cx + m[3 * r + 1] * cy + m[3 * r + 2]] for r in range(3)]
    mapping = [k * (from_floor[0][j] - mx * from_floor[2][j]) for j in range(3)] + [k * (from_floor[1][j] - my * from_floor[2][j]) for j in range(3)] + from_floor[2]
    known = F.col("to_court")[8].isNotNull() & k.isNotNull()
    out = out.withColumns({f"__m{j}": v for j, v in enumerate(mapping)}).withColumn("__s", F.when(known, row_norms_after_jacobi(F.array(*rows), 8, SWEEPS)))
    out = out.withColumns({"design_condition": F.try_divide(F.array_max("__s"), F.array_min("__s")), "mapping_condition": F.when(known, condition3([F.col(f"__m{j}") for j in range(9)]))})
    c = _matrix("to_court")
    size = F.sqrt(sum((v * v for v in c[1:]), c[0] * c[0]))
    sound = (F.col("design_condition") <= DESIGN_LIMIT) & (F.col("mapping_condition") <= MAPPING_LIMIT) & (size * HORIZON_LIMIT < 1)
    return out.withColumn("well_conditioned", F.coalesce(sound, F.lit(False))).drop(*[c for c in out.columns if c.startswith("__")])


def condition_numbers(calib: DataFrame) -> DataFrame:
    """Decimal logarithms of both conditions for each clip, and whether they are within their limits."""
    return with_conditions(calib).select(CLIP, F.round(F.log10("design_condition"), 3).alias("log10_design_condition"),
                                         F.round(F.log10("mapping_condition"), 3).alias("log10_mapping_condition"), "well_conditioned")


def _line_table() -> list[tuple[int, float, float, float, float, str]]:
    w, l, s, net = COURT_WIDTH, COURT_LENGTH, SINGLES_MARGIN, COURT_LENGTH / 2
    short, back = SERVICE_FROM_NET, DOUBLES_SERVICE_FROM_BASELINE
    # The thirteen painted lines, in metres and in output order.
    lines = [(0, 0, w, 0, "boundary"), (w, 0, w, l, "boundary"), (w, l, 0, l, "boundary"), (0, l, 0, 0, "boundary"),
             (s, 0, s, l, "singles"), (w - s, 0, w - s, l, "singles"), (0, net, w, net, "net"),
             (0, net - short, w, net - short, "service"), (0, net + short, w, net + short, "service"),
             (0, back, w, back, "service"), (0, l - back, w, l - back, "service"),
             (w / 2, 0, w / 2, net - short, "service"), (w / 2, net + short, w / 2, l, "service")]
    return [(i, *[float(v) for v in row[:4]], row[4]) for i, row in enumerate(lines)]


def court_lines(calib: DataFrame) -> DataFrame:
    """The painted lines as seen by each camera."""
    lines = F.array(*[F.struct(F.lit(i).cast("long").alias("line"), F.lit(ax).alias("ax_m"), F.lit(ay).alias("ay_m"),
                               F.lit(bx).alias("bx_m"), F.lit(by).alias("by_m"), F.lit(kind).alias("kind"))
                      for i, ax, ay, bx, by, kind in _line_table()])
    rows = calib.select(CLIP, "to_image", F.explode(lines).alias("l")).select(CLIP, "to_image", "l.*")
    ax, ay, _ = project(_matrix("to_image"), F.col("ax_m"), F.col("ay_m"))
    bx, by, _ = project(_matrix("to_image"), F.col("bx_m"), F.col("by_m"))
    return rows.select(CLIP, "line", "kind", "ax_m", "ay_m", "bx_m", "by_m",
                       ax.alias("ax_px"), ay.alias("ay_px"), bx.alias("bx_px"), by.alias("by_px"))


def reprojection_error(projected: DataFrame, calib: DataFrame) -> DataFrame:
    """Largest distance per clip between an anchor and its position mapped back."""
    back = court_to_image(projected.where("x_m is not null"), calib)
    return back.groupBy(CLIP).agg(F.max(F.hypot(F.col("x_px") - F.col("ankle_x"), F.col("y_px") - F.col("ankle_y")))
                                  .alias("max_error_px"), F.count(F.lit(1)).alias("positions"))


def line_checks(points: DataFrame, calib: DataFrame) -> DataFrame:
    """Measured against known points: error in pixels and in metres.

    ``points``: clip_id, name, image_x, image_y, court_x, court_y.
    """
    rows = points.join(calib.select(CLIP, "to_court", "to_image"), CLIP)
    px, py, _ = project(_matrix("to_image"), F.col("court_x"), F.col("court_y"))
    mx, my, _ = project(_matrix("to_court"), F.col("image_x"), F.col("image_y"))
    return rows.select(CLIP, "name", F.hypot(F.col("image_x") - px, F.col("image_y") - py).alias("error_px"),
                       F.hypot(mx - F.col("court_x"), my - F.col("court_y")).alias("error_m"))


def matching_calibrations(clips: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved calibrations usable for clips: bound ones by clip, free ones once for each image size that clips have.

    A free calibration fits every clip of its size, so it is listed by size
    (null ``clip_id``) and never once for each clip.
    """
    s = saved.select("calibration_id", "width", "height", F.col("source_digest").alias("bound_to"))
    size = ["width", "height"]
    c = clips.select(CLIP, *size, "source_digest")
    bound = c.join(s.where("bound_to is not null"), [*[c[k] == s[k] for k in size], c["source_digest"] == s["bound_to"]]).select(CLIP, *[c[k] for k in size], "calibration_id")
    free = s.where("bound_to is null").join(c.select(*size).distinct(), size, "left_semi")
    return bound.unionByName(free.select(F.lit(None).cast(clips.schema[CLIP].dataType).alias(CLIP), *size, "calibration_id"))
