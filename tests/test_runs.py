"""Runs that are visible as a whole, recomputation under review versions, and versions compared as multisets."""
import json
import os
import shutil

import harness
import pytest
from pyspark.sql import functions as F

from rallygrid.operators import evaluation
from rallygrid.plans.catalog import Tables, edited_identity, edited_rallies
from rallygrid.sources import runs

SF = "/root/testdata/sf0.001"


def rows(df):
    flat = df.select(*[F.to_json(c).alias(c) if "<" in t else F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return harness.multiset(flat.columns, flat.collect())


# Publishing -----------------------------------------------------------------------

def test_a_run_is_visible_as_a_whole(spark, tmp_path):
    a, b = spark.range(10).withColumn("x", F.array(F.lit(1.5))), spark.range(0)
    runs.publish_run({"a": a, "b": b}, str(tmp_path), "r1")
    got = runs.read_run(spark, str(tmp_path), "r1")
    assert got["a"].dtypes == a.dtypes and got["a"].count() == 10 and got["b"].count() == 0
    assert sorted(map(tuple, runs.published_runs(spark, str(tmp_path)).collect())) == [("r1", "a", 10), ("r1", "b", 0)]
    with pytest.raises(FileExistsError):
        runs.publish_run({"a": a}, str(tmp_path), "r1")


def test_a_failure_between_two_tables_leaves_no_run(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("broken on purpose")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken on purpose"):
        runs.publish_run({"a": spark.range(10), "b": bad}, str(tmp_path), "r1")
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, str(tmp_path), "r1")
    assert not [f for _, _, files in os.walk(tmp_path / "r1") for f in files if f.endswith(".parquet")]
    note, = (tmp_path / "_failed").glob("r1-*.json")
    assert "broken on purpose" in json.loads(note.read_text())["error"]
    runs.publish_run({"a": spark.range(10)}, str(tmp_path), "r1")  # the name is free again
    assert runs.read_run(spark, str(tmp_path), "r1")["a"].count() == 10


def test_a_second_writer_is_refused(spark, tmp_path):
    folder = runs.Folder(spark, str(tmp_path))
    assert folder.claim("r2/_claim")
    with pytest.raises(FileExistsError, match="another writer"):
        runs.publish_run({"a": spark.range(3)}, str(tmp_path), "r2")
    folder.put("note.json", "{}")
    with pytest.raises(FileExistsError):
        folder.put("note.json", "[]")
    assert folder.read("note.json") == "{}"


# Review versions --------------------------------------------------------------------

@pytest.fixture(scope="module")
def reviewed(spark, tmp_path_factory):
    t = Tables(spark, SF)
    root = str(tmp_path_factory.mktemp("reviewed"))
    analysis = runs.ReviewedAnalysis(spark, root, buckets=8)
    analysis.observe({"motion": t.stored_motion.drop("player_label", "side", "team"), "frames": t.frames, "clips": t.clips})
    first = {"identity": t.identity, "rallies": t.rallies, "events": t.events, "targets": t.targets}
    assert all(done == list(range(8)) for done in analysis.run(first, "001").values())
    return analysis, root, first


def test_recomputation_equals_a_full_run_and_reads_no_other_bucket(spark, reviewed):
    analysis, root, first = reviewed
    edited = first | {"identity": edited_identity(first["identity"]), "rallies": edited_rallies(first["rallies"])}
    before = {name: rows(analysis.result(name, "001")) for name in runs.RESULTS}
    analysis.run(edited, "full")
    # Observations of all buckets that the edit doesn't reach are taken away for the second version's run.
    reach = analysis.edited(edited, "001")
    touched = {b for part in reach.values() for b in part}
    assert 0 < len(touched) < 8 and reach["events"] == reach["targets"] == []
    moved = []
    for name in runs.OBSERVED:
        for b in set(range(8)) - touched:
            if os.path.isdir(f"{root}/observations/{name}/bucket={b}"):
                shutil.move(f"{root}/observations/{name}/bucket={b}", f"{root}/aside-{name}-{b}")
                moved.append((name, b))
    assert moved
    done = analysis.run(edited, "002", base="001")
    assert done["rally_summary"] == sorted(touched) and done["recovery"] == reach["identity"] and done["events_in_rallies"] == reach["rallies"]
    for name, b in moved:
        shutil.move(f"{root}/aside-{name}-{b}", f"{root}/observations/{name}/bucket={b}")
    for name in runs.RESULTS:
        assert rows(analysis.result(name, "002")) == rows(analysis.result(name, "full")), name
        assert rows(analysis.result(name, "001")) == before[name], name
    assert rows(analysis.result("identified_players", "002")) != before["identified_players"]
    with pytest.raises(FileExistsError):
        analysis.run(edited, "002", base="001")


def test_an_empty_edit_recomputes_nothing(spark, reviewed):
    analysis, _, first = reviewed
    assert not any(analysis.run(first, "same", base="001").values())
    assert rows(analysis.result("recovery", "same")) == rows(analysis.result("recovery", "001"))
    gone = analysis.run(first | {"targets": first["targets"].limit(0)}, "none", base="same")
    assert gone["recovery"] and not gone["rally_summary"] and analysis.result("recovery", "none").count() == 0


# Versions as multisets -----------------------------------------------------------------

def test_repeated_keys_give_their_surplus_once_each(spark):
    table = lambda rs: spark.createDataFrame(rs, "clip_id long, frame_index long, x double")
    old = table([(1, 0, 1.0), (1, 0, 1.0), (1, 0, 2.0), (1, 1, None), (2, 0, 5.0), (3, 0, 1.0), (3, 1, 1.0)])
    new = table([(2, 0, 5.0), (1, 0, 2.0), (1, 0, 3.0), (1, 1, None), (1, 2, 7.0), (1, 2, 7.0), (4, 0, None)])
    got = sorted(map(tuple, evaluation.diff_observations(old, new, ["clip_id", "frame_index"]).collect()))
    assert got == [(1, 0, "changed", 1), (1, 0, "removed", 1), (1, 2, "added", 2), (3, 0, "removed", 1), (3, 1, "removed", 1), (4, 0, "added", 1)]


def test_unchanged_clips_are_read_by_digest_alone(spark):
    old = spark.range(1000).selectExpr("id % 10 AS clip_id", "id AS frame_index", "id * 0.5 AS x")
    digests = evaluation.clip_digests(old)
    # A version whose clip 3 alone differs; opening a row of any other clip fails.
    new = old.withColumn("x", F.when(F.col("clip_id") == 3, F.col("x") + 1).otherwise(F.col("x")))
    only = new.where((F.col("clip_id") == 3) | F.raise_error(F.lit("opened")).isNotNull())
    assert sorted(r.clip_id for r in evaluation.changed_clips(digests, evaluation.clip_digests(new)).collect()) == [3]
    stored = (digests, evaluation.clip_digests(new))
    assert evaluation.diff_observations(old.where("clip_id = 3"), only.where("clip_id = 3"), ["clip_id", "frame_index"], stored).agg(F.sum("n_rows")).first()[0] == 100
    assert evaluation.diff_observations(old, old.orderBy(F.desc("x")), ["clip_id", "frame_index"]).count() == 0
