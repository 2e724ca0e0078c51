"""Every query against its SQL check, and block layouts against each other."""
import pytest
from pyspark.sql import functions as F

import harness
from __spark_entry__ import entry
from rallygrid import fixtures
from rallygrid.operators import checks, motion, shuttle, timeline, trails
from rallygrid.plans.catalog import QUERIES
from rallygrid.plans.oracles import ORACLES
from rallygrid.policy import Layout

SF = "/root/testdata/sf0.001"
CHECKED = sorted(ORACLES)
# Queries that the small tables give no rows.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    found = harness.compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert found is None or (found == "no rows" and name in EMPTY), found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKED)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 15


# Blocks of a fraction of a second put an edge into almost every segment.
TINY = Layout(block_s=0.7, block_frames=7)


def _same(a, b):
    assert harness.multiset(a.columns, a.collect()) == harness.multiset(b.columns, b.collect())


def _flat(df):
    return df.withColumn("quality_flags", F.concat_ws(";", "quality_flags")).drop("interval_start_point")


def test_player_motion_does_not_depend_on_blocks(spark):
    frames = fixtures.table(spark, SF, "fx_frames")
    pos = motion.player_positions(fixtures.table(spark, SF, "fx_positions").withColumn("flags", F.array_compact(F.array("cut_flag"))), fixtures.table(spark, SF, "fx_calibrations"))
    cols = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    _same(cols(_flat(motion.player_motion(pos, frames))), cols(_flat(motion.player_motion(pos, frames, layout=TINY))))


@pytest.mark.parametrize("op", [
    lambda s, l: _flat(shuttle.shuttle_motion(s.withColumn("flags", F.array_compact(F.array("cut_flag"))), layout=l)),
    lambda s, l: timeline.gap_caps(s, layout=l), lambda s, l: timeline.interpolate_gaps(s, layout=l), lambda s, l: timeline.raw_gaps(s, l)])
def test_shuttle_operators_do_not_depend_on_blocks(spark, op):
    s = fixtures.table(spark, SF, "fx_shuttle")
    _same(op(s, Layout()), op(s, TINY))


def test_trails_and_checks_do_not_depend_on_blocks(spark):
    pos = motion.player_positions(fixtures.table(spark, SF, "fx_positions"), fixtures.table(spark, SF, "fx_calibrations")).where("x_m is not null")
    dirty, seen = fixtures.table(spark, SF, "fx_dirty_shuttle"), fixtures.table(spark, SF, "fx_shuttle")
    text = lambda df: df.select(*[F.to_json(c).alias(c) if "<" in t else F.col(c) for c, t in df.dtypes])
    for op, df in ((trails.map_trails, pos), (trails.review_trail, pos), (trails.shuttle_trails, seen), (checks.check_shuttle, dirty), (checks.check_export_timing, dirty)):
        _same(text(op(df, layout=Layout())), text(op(df, layout=TINY)))


def test_track_and_timing_operators_do_not_depend_on_blocks(spark):
    pos, pts = fixtures.table(spark, SF, "fx_positions"), fixtures.table(spark, SF, "fx_pts")
    for op, df in ((timeline.track_gaps, pos), (timeline.contiguous_runs, pos), (timeline.normalize_pts, pts)):
        _same(op(df, Layout()), op(df, TINY))
