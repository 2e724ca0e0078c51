"""Documents are gathered from many tables: no task holds a sort for each, and odd rows end up where they did."""
import json

from pyspark.sql import functions as F

from rallygrid import fixtures
from rallygrid.operators import motion
from rallygrid.plans import reports
from rallygrid.plans.catalog import QUERIES
from rallygrid.policy import POLICY

SF = "/root/testdata/sf0.001"


def _most_sorts(plan, found):
    """Sorts in the task that runs ``plan``; those of the tasks below go to ``found``. A union's parts run in tasks of their own."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    below = [_most_sorts(plan.children().apply(i), found) for i in range(plan.children().size())]
    if "Exchange" in plan.nodeName():
        found.append(below[0])
        return 0
    return max(below) if plan.nodeName() == "Union" else sum(below) + (plan.nodeName() == "Sort")


def test_no_task_of_a_document_holds_many_sorts(spark):
    """27 sorts stood in the last stage; each keeps a page, of which a task has room for 8 to 16."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        found = []
        found.append(_most_sorts(QUERIES["insight_documents"](spark, SF)._jdf.queryExecution().executedPlan(), found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found[-1] <= 4 and max(found) < 8, found


def test_gathered_tables(spark):
    """Keys that only some tables have, repeated values, and a null key, which stands for itself."""
    many = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (2, 7), (None, 9)], "k long, v long").select("k", F.struct("v").alias("many"))
    few = spark.createDataFrame([(3, 1)], "k long, v long").select("k", F.struct("v").alias("few"))
    one = spark.createDataFrame([(2, 0.5), (2, 1.5), (4, None)], "k long, one double")
    got = {r.k: (sorted(x.v for x in r.many or []) or None, r.few and [x.v for x in r.few], r.one) for r in reports.gathered(["k"], {"many": many, "few": few}, {"one": one}).collect()}
    assert got == {1: ([3, 5, 5], None, None), 2: ([7], None, 1.5), None: ([9], None, None), 3: (None, [1], None), 4: (None, None, None)}


def test_grid_of_a_document(spark):
    """Cells in any order; a document's grid is laid out from filled cells when it is written."""
    cells = spark.createDataFrame([(1, 53, 23, 2.5), (1, 0, 0, 0.5), (1, 0, 2, 1.5), (2, 0, 1, 4.0)], "clip_id long, cell_row long, cell_col long, seconds double")
    filled = cells.withColumn("place", motion.grid_place()).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("place", "seconds"))).alias("f"))
    filled = filled.unionByName(spark.createDataFrame([(3, None)], "clip_id long, f array<struct<place:int,seconds:double>>"))
    got = {r.clip_id: r.v for r in filled.select("clip_id", motion.dense_grid(F.col("f")).alias("v")).collect()}
    want = {1: {0: 0.5, 2: 1.5, 1295: 2.5}, 2: {1: 4.0}, 3: {}}
    assert got == {k: [v.get(p, 0.0) for p in range(1296)] for k, v in want.items()}


def test_documents_of_odd_clips(spark):
    """A clip without any rows has a document with nulls; a track without traits an empty grid, one without a number none."""
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    track = "clip_id long, track_id int, "
    clips = make([(1, "singles"), (2, "doubles"), (None, "singles")], "clip_id long, mode string")
    fragments = make([(1, 2, 0.5), (1, 1, None), (1, None, 0.1), (9, 1, 0.2)], track + "distance_m double")
    zones = make([(1, 2, "near", 1.0), (1, 2, "far", 2.0), (1, None, "far", 9.0)], track + "zone string, seconds double")
    cells = make([(1, 2, 0, 1, 3.0)], track + "cell_row long, cell_col long, seconds double")
    flags = make([(1, 1, "cut", 4)], track + "flag string, rows long")
    none = lambda cols: make([], "clip_id long, " + cols)
    rallies = make([(1, "r2", 20, 30), (1, "r1", 3, 9)], "clip_id long, rally_id string, start_frame long, end_frame long")
    docs = reports.insight_documents(
        clips, make([(1, 10, True)], "clip_id long, frame_count long, calibration_reviewed boolean"), fragments, zones, none("player_label string"), none("jump_count long"), rallies,
        none("side string, first_label string, second_label string"), make([(1, "unavailable", "why")], "clip_id long, status string, reason string"), none("player_label string, contact_frame long"),
        make([(1, ["w"])], "clip_id long, warnings array<string>"), cells, flags, none("frame_index long"), make([(1, 0.25)], "clip_id long, gap_cap_s double"),
        {"identity": none("track_id int"), "rallies": rallies, "events": none("frame_index long"), "targets": none("player_label string, contact_frame long")})
    got = {r.clip_id: json.loads(r.document) for r in docs.collect()}
    assert set(got) == {1, 2, None} and docs.count() == 3
    one, bare = got[1], got[2]
    assert [p["track_id"] for p in one["players"]] == [1, 2, None] or [p["track_id"] for p in one["players"]] == [None, 1, 2]
    of = {p["track_id"]: p for p in one["players"]}
    grid = of[2]["heatmap"]["values_s"]
    assert (len(grid), {len(r) for r in grid}, grid[0][1], sum(map(sum, grid))) == (POLICY.heatmap_rows, {POLICY.heatmap_cols}, 3.0, 3.0)
    assert (of[2]["zones"], of[2]["quality_flags"], of[1]["zones"], of[1]["quality_flags"]) == ({"near": 1.0, "far": 2.0}, {}, {}, {"cut": 4})
    assert sum(map(sum, of[1]["heatmap"]["values_s"])) == 0 and (of[None]["heatmap"], of[None]["zones"]) == (None, {})
    assert [r["rally_id"] for r in one["rallies"]] == [r["rally_id"] for r in one["review"]["rallies"]] == ["r1", "r2"]
    assert one["doubles_pair_spacing"] == {"status": "unavailable", "reason": "why", "pairs": None} and one["quality"]["warnings"] == ["w"] and one["quality"]["maximum_interval_s"] == 0.25
    assert [k for k, v in bare.items() if v is None] == ["players", "identified_players", "rallies", "doubles_pair_spacing", "recovery", "reviewed_events", "shuttle", "quality"]
    assert bare["review"] == {"identity_map": None, "rallies": None, "events": None, "recovery_targets": None}


def test_documents_are_read_few_at_a_time(spark, monkeypatch):
    """A task read 4096 documents at once, 0.7 GB of those of the events repeated with shifted clips, more where clips are longer."""
    rows = {}
    before = fixtures.stored

    def stored(spark, sf_dir, name, build, **more):
        rows[name] = more.get("rows_per_file")
        return before(spark, sf_dir, name, build, **more)

    monkeypatch.setattr(fixtures, "stored", stored)
    assert QUERIES["insight_document_parts"](spark, SF).count() == 15
    assert rows["insight_documents"] and rows["insight_documents"] <= 128
    small = before(spark, SF, "long_rows", lambda: spark.range(300).coalesce(1), rows_per_file=128)
    assert sorted(r["count"] for r in small.groupBy(F.input_file_name()).count().collect()) == [44, 128, 128]
