"""Frames with their players as lists: no wide row is moved or sorted."""
from pyspark.sql import functions as F

from rallygrid.plans.catalog import QUERIES, Tables
from rallygrid.sources import writers

SF = "/root/testdata/sf0.001"


def _nodes(plan):
    """All nodes of a physical plan, adaptive ones by their first plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    below = plan.children()
    return [plan] + [n for i in range(below.size()) for n in _nodes(below.apply(i))]


def test_points_are_made_after_their_frame_is_in_one_place(spark):
    """The lists were aggregated, so every point was sorted, spilled and shuffled: 5.8 GB for events at 60 times sf0.1."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        nodes = _nodes(QUERIES["players_nested"](spark, SF)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert any("keypoints" in n.simpleString(100000) and n.nodeName() == "Project" for n in nodes)
    moved = [n for n in nodes if n.nodeName() in ("Exchange", "Sort")]
    assert moved and not any(w in n.output().mkString(",") for n in moved for w in ("keypoints", "players"))


def test_nested_players_are_whole(spark):
    """The same lists, points included, as an aggregate over the stored players gives."""
    t = Tables(spark, SF)
    cols = ["track_id", "identity_source", "bbox", "confidence", "keypoints", "ankle_midpoint", "low_confidence"]
    want = t.players.groupBy("clip_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("players"))
    got = writers.players_nested(t.records, t.framed_players)
    text = lambda df: {(r.clip_id, r.frame_index): r.p for r in df.select("clip_id", "frame_index", F.to_json("players").alias("p")).collect()}
    frames, lists = text(got), text(want)
    assert got.columns == [*t.records.columns, "players"] and len(frames) == got.count() == 1000
    assert {k: v for k, v in frames.items() if v != "[]"} == lists and all('"visible"' in v for v in lists.values())


def test_lists_of_odd_frames(spark):
    """Tracks that are null or repeated, frames without players, players without a frame."""
    frames = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "clip_id long, frame_index long")
    obs = spark.createDataFrame([(1, 0, 3, 0.5), (1, 0, None, 0.9), (1, 0, 3, 0.2), (1, 0, 1, None), (2, 0, None, None), (2, 9, 1, 0.1)],
                                "clip_id long, frame_index long, track_id int, confidence double")
    got = {(r.clip_id, r.frame_index): [tuple(p) for p in r.players] for r in writers.players_nested(frames, obs).collect()}
    assert got == {(1, 0): [(None, 0.9), (1, None), (3, 0.2), (3, 0.5)], (1, 1): [], (1, 2): [], (2, 0): [(None, None)]}
