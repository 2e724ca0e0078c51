"""The smoothing fit on any cadence, and what motion and dense grids leave undone."""
import random

from pyspark.sql import functions as F

from rallygrid.operators import motion
from rallygrid.plans import reports
from rallygrid.plans.catalog import tidy
from rallygrid.policy import POLICY

HALF = POLICY.smoothing_half_window_s


def track(spark, times, seed):
    draw = random.Random(seed)
    rows = [(1, 1, k, t, 3 + draw.random() * 0.3, 5 + draw.random() * 0.3, True, []) for k, t in enumerate(times)]
    cols = "clip_id long, track_id long, frame_index long, timestamp_s double, x_m double, y_m double, valid_position boolean, quality_flags array<string>"
    return rows, spark.createDataFrame(rows, cols).withColumn("zone", F.lit("z"))


def expected(rows, i):
    """The definition, over the whole segment."""
    t0 = rows[i][3]
    picked = [r for r in rows if abs(r[3] - t0) <= HALF + POLICY.window_slack_s]
    if len(picked) < 3:
        picked = sorted(rows, key=lambda r: (abs(r[3] - t0), r[2]))[:3]
    w = [1 / (1 + ((r[3] - t0) / HALF) ** 2) for r in picked]
    o = [r[3] - t0 for r in picked]
    s, ss = sum(a * b for a, b in zip(w, o)), sum(a * b * b for a, b in zip(w, o))
    x, sx = sum(a * r[4] for a, r in zip(w, picked)), sum(a * b * r[4] for a, b, r in zip(w, o, picked))
    return (ss * x - s * sx) / (sum(w) * ss - s * s)


def test_fit_at_any_cadence(spark):
    """Windows of one to dozens of rows: the plain fit takes those with at most two on a side, a list all others."""
    for seed, steps in enumerate(([0.2] * 12, [0.125, 0.125, 0.0625] * 6, [0.004] * 80, [0.03, 0.2, 0.01, 0.01, 0.01, 0.01, 0.2] * 4, [0.05] * 20)):
        times = [float(sum(steps[:k])) for k in range(len(steps) + 1)]
        rows, df = track(spark, times, seed)
        fast = POLICY.__class__(max_player_speed_m_s=1e9)
        got = motion.player_motion(df, df.select("clip_id", "frame_index", "timestamp_s"), fast).orderBy("frame_index").collect()
        assert len(got) == len(rows)
        for i, r in enumerate(got):
            assert abs(r.smoothed_x_m - expected(rows, i)) < 1e-9, (seed, i)


def test_short_tracks_read_positions_once(spark):
    """Edges of blocks are only worked on where tracks have any; before, all rows were laid out for them as well."""
    _, df = track(spark, [k * 0.04 for k in range(30)], 7)
    plan = motion.player_motion(df, df.select("clip_id", "frame_index", "timestamp_s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan.lower()
    assert motion._beyond_edges(df.withColumns({"gap_cap_s": F.lit(0.25), "timestamp_s": F.col("timestamp_s") + 700}), POLICY, motion.LAYOUT) is not None


def test_dense_grid_goes_by_filled_cells(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0.5), (1, 1, 0, 2, 1.5), (1, 1, 53, 23, 2.5), (1, 2, 20, 3, 4.0)], "clip_id long, track_id long, cell_row long, cell_col long, seconds double")
    tracks = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3)], "clip_id long, track_id long")
    grid = motion.dense_heatmap(cells, tracks)
    assert "sequence" not in grid._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.track_id: r.values_s for r in grid.collect()}
    want = {1: {0: 0.5, 2: 1.5, 1295: 2.5}, 2: {483: 4.0}, 3: {}}
    assert got == {k: [v.get(p, 0.0) for p in range(1296)] for k, v in want.items()}


def test_whole_numbers_are_not_rounded(spark):
    """Columns of whole pixels went through two decimals each; the results stay the same for any value."""
    values = [0.0, -0.0, 1.0, -7.0, 1e300, 2.0 ** 53, 0.1234567895, -2.5000005, 1e-10, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    plan = tidy(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rint" in plan
    both = df.join(tidy(df).withColumnRenamed("v", "got"), "k").select(F.round(F.round("v", 9), 6).alias("want"), "got").collect()
    assert all(repr(r.want) == repr(r.got) for r in both), both


def test_document_grid_is_laid_out_once(spark):
    """A document's grid has 54 rows; each of them laid out the track's whole grid again."""
    cells = spark.createDataFrame([(1, 1, 0, 0, 0.5), (1, 1, 53, 23, 2.5)], "clip_id long, track_id long, cell_row long, cell_col long, seconds double")
    grid = motion.dense_heatmap(cells, cells).select(reports.grid_rows(F.col("values_s")).alias("rows"))
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(lambda" in plan, plan
    rows = grid.first().rows
    assert [len(r) for r in rows] == [POLICY.heatmap_cols] * POLICY.heatmap_rows
    assert (rows[0][0], rows[53][23], sum(map(sum, rows))) == (0.5, 2.5, 3.0)
