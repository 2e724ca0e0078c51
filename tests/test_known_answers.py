"""Small hand-made series with known results."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallygrid.functions.stats import exact_median
from rallygrid.operators import court, evaluation, motion, pose, review, shuttle, timeline, trails
from rallygrid.policy import KEYPOINTS, Layout, Policy

POS = "clip_id long, frame_index long, timestamp_s double, track_id long, x_m double, y_m double, low_confidence boolean, flags array<string>"


def _players(spark, times, xs, y=3.0, track=1, skip=(), clip=1, flags=None):
    rows = [(clip, k, float(t), track, None if x is None else float(x), y, False, (flags or {}).get(k, [])) for k, (t, x) in enumerate(zip(times, xs)) if k not in skip]
    return spark.createDataFrame(rows, POS)


def _frames(spark, times, clip=1):
    return spark.createDataFrame([(clip, k, float(t)) for k, t in enumerate(times)], "clip_id long, frame_index long, timestamp_s double")


def _manual(spark):
    return spark.createDataFrame([(1, "manual", True)], "clip_id long, method string, manually_reviewed boolean")


def _move(spark, times, xs, policy=Policy(), **kw):
    m = motion.player_motion(motion.player_positions(_players(spark, times, xs, **kw), _manual(spark)), _frames(spark, times), policy)
    return m, motion.fragment_summary(m, _frames(spark, times)).first()


def _every(n, dt):
    return [k * dt for k in range(n)]


def test_constant_velocity_at_uneven_times(spark):
    t = [0, .03, .09, .13, .20]
    m, s = _move(spark, t, [1 + 1.5 * v for v in t])
    assert (round(s.distance_m, 9), round(s.valid_motion_time_s, 9)) == (.3, .2)
    assert round(s.average_speed_m_s, 9) == round(s.max_speed_m_s, 9) == 1.5
    occ = motion.occupancy(m)
    assert round(motion.zone_seconds(occ).agg(F.sum("seconds")).first()[0], 9) == .2
    assert round(motion.heatmap(occ).agg(F.sum("seconds")).first()[0], 9) == .2


def test_standing_still_is_not_movement(spark):
    _, s = _move(spark, _every(30, .02), [3 + .01 * (-1) ** k for k in range(30)])
    assert (s.distance_m, s.motion_intervals) == (0.0, 29)


def test_standing_still_across_block_edges(spark):
    t, x = _every(60, .02), [3 + .01 * (-1) ** k for k in range(60)]
    pos = motion.player_positions(_players(spark, t, x), _manual(spark))
    m = motion.player_motion(pos, _frames(spark, t), layout=Layout(block_s=.3))
    assert m.agg(F.sum("distance_m"), F.count("distance_m")).first() == (0.0, 59)
    assert {r[0] for r in m.select("smoothed_x_m").collect()} == {3.0}


def test_fast_footwork(spark):
    _, s = _move(spark, _every(10, .02), [1 + 8 * .02 * k for k in range(10)])
    assert round(s.distance_m, 6) == 1.44


def test_equal_stamps_are_a_gap(spark):
    _, s = _move(spark, [0, .02, .02, .04], [1, 1.04, 1.08, 1.12])
    assert s.motion_intervals == 2


def test_gap_cap_of_mixed_cadence_is_exact(spark):
    frames = _frames(spark, [0, .08, .16, .28, .40])
    assert round(timeline.gap_caps(frames).first().gap_cap_s, 9) == .3


def test_no_calibration_gives_no_metres(spark):
    assert motion.player_positions(_players(spark, [0, .02], [1, 1.04])).where("valid_position").count() == 0


def test_corners_on_a_line_give_no_mapping(spark):
    flat = spark.createDataFrame([(1, 0., 0., 1., 1., 2., 2., 3., 3.)], "clip_id long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    assert court.fit_homography(flat).first().to_court[0] is None
    assert not court.condition_numbers(court.fit_homography(flat)).first().well_conditioned


def test_absent_row_is_a_gap(spark):
    t = _every(5, .02)
    m, s = _move(spark, t, [1 + .04 * k for k in range(5)], skip=(2,))
    assert round(s.distance_m, 9) == .08
    assert m.where("frame_index = 3").first().quality_flags == ["observation_gap"]


def test_teleport_splits(spark):
    m, s = _move(spark, _every(5, .02), [1, 1.04, 5, 1.12, 1.16])
    assert round(s.distance_m, 9) == .08
    assert [r.speed_m_s is None for r in m.orderBy("frame_index").collect()] == [True, False, True, True, False]


def test_raw_speed_guard_decides_segments(spark):
    # Steps of 6.67 m/s: one segment just below the guard, three just above.
    t, x = _every(3, .3), [1.0, 3.0, 5.0]
    m, s = _move(spark, t, x, Policy(max_player_speed_m_s=6.7, gap_cap_multiplier=10.0))
    ok, _ = _move(spark, t, x, Policy(max_player_speed_m_s=6.6, gap_cap_multiplier=10.0))
    assert m.where("starts").count() == 1 and s.motion_intervals == 2
    assert ok.where("starts").count() == 3


def test_time_jump_is_excluded(spark):
    _, s = _move(spark, [0, .02, .04, 1, 1.02], [1, 1.02, 1.04, 1.06, 1.08])
    assert round(s.valid_motion_time_s, 9) == .06


def test_outside_court_counts_as_time_not_heat(spark):
    m, _ = _move(spark, _every(4, .04), [-.2, -.16, -.12, -.08])
    occ = motion.occupancy(m)
    assert [(r.zone, round(r.seconds, 9)) for r in motion.zone_seconds(occ).collect()] == [("outside_court", .12)]
    assert motion.heatmap(occ).count() == 0


def test_unreviewed_proposal_gives_no_metres(spark):
    obs = _players(spark, _every(4, .02), [1, 1.04, 1.08, 1.12])
    for method, reviewed, valid in (("auto_lines", False, 0), ("auto_lines", True, 4), ("manual", False, 4)):
        c = spark.createDataFrame([(1, method, reviewed)], "clip_id long, method string, manually_reviewed boolean")
        assert motion.player_positions(obs, c).where("valid_position").count() == valid
    none = spark.createDataFrame([], "clip_id long, method string, manually_reviewed boolean")
    assert motion.player_positions(obs, none).first().quality_flags == ["court_calibration_unavailable"]


SH = "clip_id long, frame_index long, timestamp_s double, x double, y double, confidence double, source string, low_confidence boolean, flags array<string>"


def _shuttle(spark, times, xs, missing=(), weak=(), interpolated=(), cut=(), ys=None):
    rows = []
    for k, (t, x) in enumerate(zip(times, xs)):
        src = "missing" if k in missing else "interpolated" if k in interpolated else "detected"
        gone = k in missing
        rows.append((1, k, float(t), None if gone else float(x), None if gone else float((ys or [0] * len(xs))[k]), None if gone else .9, src,
                     gone or k in weak or k in interpolated, ["camera_cut"] if k in cut else []))
    return spark.createDataFrame(rows, SH)


def test_camera_cut_breaks_shuttle_motion(spark):
    m = shuttle.shuttle_motion(_shuttle(spark, _every(5, .02), [0, 2, 4, 6, 8], cut=(2,))).orderBy("frame_index").collect()
    assert [r.image_speed_px_s and round(r.image_speed_px_s, 6) for r in m] == [None, 100.0, None, None, 100.0]


def test_mean_is_weighted_by_time(spark):
    s = shuttle.shuttle_summary(shuttle.shuttle_motion(_shuttle(spark, [0, .02, .10], [0, 10, 30]))).first()
    assert round(s.average_image_speed_px_s, 6) == 300 and round(s.max_image_speed_px_s, 6) == 500


def test_interpolated_and_weak_rows_carry_no_speed(spark):
    m = shuttle.shuttle_motion(_shuttle(spark, _every(7, .02), range(7), interpolated=(2,), weak=(4,)))
    assert {r.frame_index for r in m.where("image_speed_px_s is not null").collect()} == {1, 6}


def test_large_jump_is_kept_and_marked(spark):
    s = _shuttle(spark, [0, .02], [100, 300]).withColumns({"width": F.lit(1000), "height": F.lit(800)})
    r = shuttle.shuttle_motion(s).where("frame_index = 1").first()
    assert round(r.image_speed_px_s, 6) == 10000 and r.quality_flags == ["large_image_jump_review"]


def test_gap_fill_follows_time(spark):
    s = _shuttle(spark, [0, .1, .3, .4], [0, 0, 0, 100], missing=(1, 2), ys=[0, 0, 0, 80])
    r = timeline.interpolate_gaps(s.drop("flags")).orderBy("frame_index").collect()
    assert [(round(v.x, 9), round(v.y, 9), v.confidence, v.source, v.raw_x) for v in r[1:3]] == [
        (25, 20, None, "interpolated", None), (75, 60, None, "interpolated", None)]


@pytest.mark.parametrize("missing, weak, cap", [((1, 2, 3), (), 2), ((0, 1), (), 2), ((3, 4), (), 2), ((1, 2), (0,), 2), ((1,), (), 0)])
def test_long_open_or_weak_gaps_stay(spark, missing, weak, cap):
    s = _shuttle(spark, _every(5, .1), range(5), missing=missing, weak=weak).drop("flags")
    assert timeline.interpolate_gaps(s, cap).where("source = 'interpolated'").count() == 0


def _camera(spark):
    def pt(x, y):
        d = 1 - .035 * y
        return ((80 * x + 140) / d, (35 * y + 90) / d)
    c = [v for p in ((0, 0), (6.1, 0), (6.1, 13.4), (0, 13.4)) for v in pt(*p)]
    df = spark.createDataFrame([(1, 1920, 1080, *c)], "clip_id long, width int, height int, " + ", ".join(f"x{k} double, y{k} double" for k in range(4)))
    return court.fit_homography(df.withColumns({"method": F.lit("manual"), "manually_reviewed": F.lit(False)})), pt


def test_held_out_points_of_a_known_camera(spark):
    cam, pt = _camera(spark)
    truth = [(1.0, 2.0), (3.05, 6.7), (5.9, 13.0), (-.5, 1.0)]
    pts = spark.createDataFrame([(1, k, *map(float, pt(*p))) for k, p in enumerate(truth)], "clip_id long, k long, x double, y double")
    for r in court.image_to_court(pts, cam).collect():
        assert math.dist((r.x_m, r.y_m), truth[r.k]) < 2e-5
    horizon = spark.createDataFrame([(1, 10.0, -1000.0)], "clip_id long, x double, y double")
    assert court.image_to_court(horizon, cam).first().x_m is None


def test_singles_sidelines_and_missing_anchor(spark):
    cam, pt = _camera(spark)
    xs = [.45, .47, 5.63, 5.65]
    rows = [(1, k, 1, *pt(x, 5.0), "singles", False) for k, x in enumerate(xs)] + [(1, 9, 1, None, None, "singles", False)]
    p = court.project_players(spark.createDataFrame(rows, "clip_id long, frame_index long, track_id long, ankle_x double, ankle_y double, mode string, low_confidence boolean"), cam)
    got = p.orderBy("frame_index").collect()
    assert [r.in_singles_court for r in got[:4]] == [False, True, True, False]
    assert got[4].court_flags == ["ankle_midpoint_unavailable"] and got[4].x_m is None


def test_condition_numbers_accept_a_sound_camera(spark):
    cam, _ = _camera(spark)
    assert court.condition_numbers(cam).first().well_conditioned
    assert court.fit_diagnostics(cam).first().acceptable


def test_doubles_spacing(spark):
    rows = [(1, f, f * .04, t, x, y, True, f"P{t}", side, team, []) for f in range(3) for t, x, y, side, team in
            ((1, 1.0, 2.0, "far", "A"), (2, 4.0, 2.0, "far", "A"), (3, 1.0, 10.0, "near", "B"), (4, 4.0, 10.0, "near", "B"))]
    m = spark.createDataFrame(rows, "clip_id long, frame_index long, timestamp_s double, track_id long, x_m double, y_m double, valid_position boolean, "
                                    "player_label string, side string, team string, quality_flags array<string>")
    s = review.pair_spacing(m)
    assert s.count() == 6 and {r.median_spacing_m for r in review.pair_summary(s).collect()} == {3.0}
    assert review.pair_spacing(m.where("not (frame_index = 1 and track_id = 4)")).count() == 4


def test_recovery_reaches_the_target_and_stops_at_gaps(spark):
    t = _every(20, .1)
    frames = _frames(spark, t)
    identity = spark.createDataFrame([(1, 1, "P1", "far", "A")], "clip_id long, track_id long, player_label string, side string, team string")
    target = spark.createDataFrame([(1, "P1", 0, None, 2.0, 3.0, .11)], "clip_id long, player_label string, contact_frame long, until_frame long, "
                                                                       "target_x_m double, target_y_m double, radius_m double")

    def run(skip=()):
        pos = motion.with_identity(motion.player_positions(_players(spark, t, [1 + v for v in t], skip=skip), _manual(spark)), identity)
        return review.recovery(target, motion.player_motion(pos, frames), frames).first()
    r = run()
    assert (r.status, r.reached_frame, round(r.recovery_time_s, 9)) == ("available", 9, .9)
    assert run(skip=(5,)).status == "unavailable" and run(skip=(0,)).status == "unavailable"
    assert run(skip=(15,)).status == "available"


def test_keypoints_hide_uncertain_points(spark):
    raw = [(n, 10.0, 10.0, .9) for n in KEYPOINTS]
    raw[0], raw[1], raw[2], raw[3], raw[4] = ("nose", 0.0, 0.0, .9), ("left_eye", 10.0, 10.0, .29), ("right_eye", 101.0, 10.0, .9), (
        "left_ear", 100.0, 50.0, 1.7), ("right_ear", float("nan"), 10.0, float("nan"))
    df = spark.createDataFrame([(raw,)], "k array<struct<name:string,x:double,y:double,score:double>>")
    p = df.select(pose.format_keypoints(F.col("k"), F.lit(100), F.lit(50)).alias("p")).first().p
    assert [(v.visible, v.x, v.confidence) for v in p[:5]] == [(False, None, .9), (False, None, .29), (False, None, .9), (True, 100.0, 1.0), (False, None, 0.0)]


def test_region_and_duplicate_boxes(spark):
    ring = [(.31, .27), (.69, .27), (.89, .99), (.11, .99)]
    rois = spark.createDataFrame([(1, [dict(x=x, y=y) for x, y in ring])], "clip_id long, points array<struct<x:double,y:double>>")
    clips = spark.createDataFrame([(1, 1000, 1000), (2, 1000, 1000)], "clip_id long, width long, height long")
    boxes = [(1, 0, [0.0, 0.0, 50.0, 100.0], None), (1, 1, [450.0, 300.0, 550.0, 600.0], None), (1, 2, [500.0, 500.0, 400.0, 600.0], None),
             (1, 3, [0.0, 0.0, 50.0, 100.0], [500.0, 270.0]), (2, 4, [0.0, 0.0, 50.0, 100.0], None)]
    obs = spark.createDataFrame(boxes, "clip_id long, i long, bbox array<double>, ankle_midpoint array<double>")
    assert {r.i for r in pose.roi_gate(obs, rois, clips).collect()} == {1, 3, 4}
    three = spark.createDataFrame([(1, 0, 0, [0.0, 0.0, 100.0, 100.0], .9), (1, 0, 1, [0.0, 0.0, 80.0, 80.0], .8), (1, 0, 2, [300.0, 0.0, 400.0, 100.0], .7)],
                                  "clip_id long, frame_index long, ord long, bbox array<double>, confidence double")
    assert (pose.suppress_boxes(three, .7).count(), pose.suppress_boxes(three, .5).count()) == (3, 2)


def test_windows_are_padded_at_the_end(spark):
    w = timeline.sequence_windows(_frames(spark, _every(5, .1)), 4)
    assert w.where("is_padding").count() == 3 and w.where("not is_padding").count() == 5
    assert {r.frame_index for r in w.where("is_padding").collect()} == {4}


def test_source_stamps_become_seconds(spark):
    p = spark.createDataFrame([(1, k, v, 1, 1000, 25.0) for k, v in enumerate((1250, 1290, 1370, 1490))],
                              "clip_id long, frame_index long, pts long, time_base_num long, time_base_den long, fps double")
    assert [round(r.timestamp_s, 9) for r in timeline.normalize_pts(p).orderBy("frame_index").collect()] == [0, .04, .12, .24]


def test_trail_restarts_after_absence(spark):
    pos = _players(spark, _every(6, .1), [1, 2, None, 3, 4, 5])
    got = {r.frame_index: len(r.trail) for r in trails.map_trails(pos).collect()}
    assert got == {0: 1, 1: 2, 3: 1, 4: 2, 5: 3}


def test_wrong_location_is_both_kinds_of_error(spark):
    s = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 10.0, 10.0), (1, 2, None, None), (1, 3, 5.0, 5.0)], "clip_id long, frame_index long, raw_x double, raw_y double")
    t = spark.createDataFrame([(1, 0, True, 13.0, 14.0), (1, 1, True, 90.0, 10.0), (1, 2, False, 0.0, 0.0), (1, 3, False, 0.0, 0.0)],
                              "clip_id long, frame_index long, visible boolean, label_x double, label_y double")
    e = evaluation.evaluate(s, t).first()
    assert (e.matched_detections, e.false_positives, e.false_negatives, e.true_negatives) == (1, 2, 1, 1)
    assert e.median_error_px == (5 + 80) / 2


def test_exact_median_of_a_hot_group(spark):
    rows = spark.range(20001).select(F.when(F.col("id") < 20000, 1).otherwise(2).alias("k"), (F.col("id") * 7919 % 20000 / 3e6).alias("v"))
    got = {r.k: r.median for r in exact_median(rows, ["k"], "v", 1e-3).collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.percentile("v", F.lit(.5)).alias("m")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-15 for k in want)


def test_rally_keeps_its_notes_and_boundary(spark):
    t = _every(10, .04)
    frames = _frames(spark, t)
    m = motion.player_motion(motion.player_positions(_players(spark, t, [1 + .04 * k for k in range(10)]), _manual(spark)), frames)
    rallies = spark.createDataFrame([(1, "r1", 2, 5, "long", None)], "clip_id long, rally_id string, start_frame long, end_frame long, notes string, outcome string")
    r = review.rally_summary(rallies, m, frames).first()
    assert (round(r.duration_s, 9), round(r.distance_m, 9), r.notes, r.outcome) == (.12, .12, "long", None)
    empty = review.rally_spans(rallies.where("false"), frames).first()
    assert (empty.rally_id, empty.start_frame, empty.end_frame, empty.notes) == ("unsegmented_clip", 0, 9, None)


def test_gap_cap_of_a_hot_clip_with_jittered_steps(spark):
    """A third of all rows in one clip, hardly two steps alike and all above the floor: exact, from cells alone."""
    rng = np.random.default_rng(4)
    steps = {1: rng.uniform(.09, .5, 3000), 2: np.where(rng.random(800) < .5, .04, rng.uniform(.09, .2, 800)), 3: rng.uniform(.01, .08, 900), 4: np.array([.2]), 5: np.array([.05, .3]), 6: rng.uniform(60, 3000, 501)}
    rows = [(c, k, float(t)) for c, s in steps.items() for k, t in enumerate(np.concatenate([[0], np.cumsum(s)]))]
    frames = spark.createDataFrame(rows + [(7, 0, 1.0)], "clip_id long, frame_index long, timestamp_s double")
    want = {7: .25}
    for c in steps:
        t = np.array([x for k, _, x in rows if k == c])
        want[c] = max(.25, 3 * float(np.median(np.diff(t))))
    for layout in (Layout(), Layout(block_frames=7)):
        assert {r.clip_id: r.gap_cap_s for r in timeline.gap_caps(frames, layout=layout).collect()} == want
