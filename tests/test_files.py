"""Readers, writers, run registry and reports."""
import json
import os

import pytest
from pyspark.sql import functions as F

from rallygrid import fixtures, schemas
from rallygrid.operators import checks
from rallygrid.plans import reports
from rallygrid.plans.catalog import Tables, _report_parts
from rallygrid.sources import long_json, readers, writers

SF = "/root/testdata/sf0.001"


def _put(root, clip, name, content, bom=False):
    folder = root / clip
    folder.mkdir(exist_ok=True)
    text = content if isinstance(content, str) else json.dumps(content)
    (folder / name).write_text(("﻿" if bom else "") + text, encoding="utf-8")


def test_observation_files(spark, tmp_path):
    row = dict(frame_index=0, timestamp_s=0.0, x=1.0, y=2.0, confidence=.9, source="detected", low_confidence=False)
    _put(tmp_path, "a", "shuttle.json", dict(schema_version="1.0", metadata=dict(fps=25), frames=[row]), bom=True)
    _put(tmp_path, "b", "shuttle.json", dict(schema_version="2.0", frames=[row]))
    _put(tmp_path, "c", "shuttle.json", dict(schema_version="1.0", frames=[]))
    _put(tmp_path, "d", "shuttle.json", "not json")
    path = str(tmp_path / "*/shuttle.json")
    assert [(r.clip_id, r.x) for r in readers.read_shuttle(spark, path).collect()] == [("a", 1.0)]
    assert {(r.clip_id, r.reason) for r in readers.rejected_documents(spark, path).collect()} == {
        ("b", "unsupported_version"), ("c", "no_frames"), ("d", "unreadable")}


def test_player_files_keep_empty_frames(spark, tmp_path):
    player = dict(track_id=4, bbox=[0, 0, 1, 1], confidence=.5, keypoints=[], ankle_midpoint=None, low_confidence=True)
    _put(tmp_path, "a", "players.json", dict(schema_version="1.0", frames=[
        dict(frame_index=0, timestamp_s=0.0, players=[player], flags=[]), dict(frame_index=1, timestamp_s=.1, players=[], flags=["no_players_observed"])]))
    frames, obs = readers.read_players(spark, str(tmp_path / "*/players.json"))
    assert frames.count() == 2 and [r.track_id for r in obs.collect()] == [4]


def test_long_documents_are_read_by_several_tasks(spark, tmp_path):
    """Ranges that cut strings, escapes and names; text that looks like brackets; other lists beside the frames."""
    odd = ['a"b', "\\", "}{", ']"', "é\\\"", "frames\": [", "\u2603"]
    rows = [dict(frame_index=k, timestamp_s=k / 25, x=None if k % 5 else 1.5, y=2.0, confidence=.5, source=odd[k % 7] * (1 + k % 40), low_confidence=False) for k in range(4000)]
    doc = dict(metadata={"note": odd[1] * 9, "list": [{"frames": [{"frame_index": -1}]}]}, warnings=[{"frame_index": -2}], schema_version="1.0", frames=rows, after=[{"frame_index": -3}])
    _put(tmp_path, "a", "shuttle.json", doc)
    _put(tmp_path, "b", "shuttle.json", doc | {"schema_version": "2.0"})
    _put(tmp_path, "c", "shuttle.json", dict(frames=[], schema_version="1.0"))
    player = dict(track_id=4, bbox=[0, 0, 1, 1], confidence=.5, keypoints=[dict(name="nose", x=1.0, y=2.0, confidence=.4, visible=True)], ankle_midpoint=None, low_confidence=True)
    _put(tmp_path, "d", "players.json", dict(schema_version="1.0", frames=[dict(frame_index=k, timestamp_s=k / 10, players=[player] * (k % 3), flags=[]) for k in range(500)]))
    path, count = str(tmp_path / "*/shuttle.json"), lambda df: sorted(map(str, df.collect()))
    whole = readers.read_shuttle(spark, path)
    for size in (997, 40000, 1 << 20):
        assert count(readers.read_shuttle(spark, path, size)) == count(whole)
    pieces = long_json.LongDocuments(spark, str(tmp_path / "a/shuttle.json"), schemas.DETECTION, range_bytes=40000).pieces
    assert pieces.where("text is not null").select(F.spark_partition_id().alias("p")).distinct().count() > 2
    assert all(map(lambda ab: count(ab[0]) == count(ab[1]), zip(readers.read_players(spark, str(tmp_path / "d/players.json")), readers.read_players(spark, str(tmp_path / "d/players.json"), 500))))


def test_faults_of_long_documents_are_reported(spark, tmp_path):
    good = '{"frame_index": %d, "timestamp_s": 0.5}'
    _put(tmp_path, "a", "shuttle.json", '{"schema_version": "1.0", "frames": [' + good % 0 + ', {"frame_index": oops}, ' + good % 2 + "]}")
    _put(tmp_path, "b", "shuttle.json", '{"schema_version": "1.0", "frames": [' + good % 0 + ', {"frame_index": 1, "timest')
    docs = long_json.LongDocuments(spark, str(tmp_path / "*/shuttle.json"), schemas.DETECTION, range_bytes=50)
    got = {(r.path.split("/")[-2], r.problem) for r in docs.faults().collect()}
    assert got == {("a", "malformed"), ("b", "unclosed"), ("b", "unbalanced")}
    assert sorted((r.clip_id, r.frame_index) for r in readers.read_shuttle(spark, str(tmp_path / "*/shuttle.json"), 50).collect()) == [("a", 0), ("a", 2)]
    one = docs.faults().where("problem = 'malformed'").first()
    assert (tmp_path / "a/shuttle.json").read_bytes()[one.start:one.end] == b'{"frame_index": oops}'


def test_annotation_files(spark, tmp_path):
    _put(tmp_path, "a", "review.json", dict(schema_version=1, source_video_sha256="AB" * 32, identity_map={"3": dict(player_label=" Kim ", side="near")},
                                            rallies=[dict(id="r1", start_frame=0, end_frame=5)], events=[], recovery_targets=[]), bom=True)
    _put(tmp_path, "b", "review.json", dict(schema_version=2, surprise=1, source_video_sha256="xyz"))
    t = readers.read_reviews(spark, str(tmp_path / "*/review.json"))
    assert tuple(t["identity"].first()) == ("a", 3, "Kim", "near", None)
    assert t["rallies"].first().rally_id == "r1"
    assert {(r.clip_id, r.rule) for r in checks.check_review_shape(t["raw"]).collect()} == {
        ("b", "unknown_field"), ("b", "version_not_one"), ("b", "digest_not_hex")}


def test_calibration_roi_and_label_files(spark, tmp_path):
    order = ["far_left", "far_right", "near_right", "near_left"]
    corners = [[650, 600], [1250, 600], [1392, 976], [514, 982]]
    _put(tmp_path, "a", "court.json", dict(schema_version=1, source_dimensions=[1920, 1080], corners_px=corners, corner_order=order, method="manual", metadata={}))
    _put(tmp_path, "b", "court.json", dict(schema_version=1, source_dimensions=[1920, 1080], corners_px=corners, corner_order=order[::-1]))
    got = {r.clip_id: (r.x2, r.problem) for r in readers.read_calibrations(spark, str(tmp_path / "*/court.json")).collect()}
    assert got == {"a": (1392.0, None), "b": (1392.0, "corner_order_unsupported")}
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    _put(tmp_path, "a", "roi.json", ring)
    _put(tmp_path, "b", "roi.json", dict(points=ring[:3]))
    assert [len(r.points) for r in readers.read_rois(spark, str(tmp_path / "*/roi.json")).collect()] == [3, 3]
    _put(tmp_path, "a", "labels.csv", "Frame,Ball,x,y\n0,1,0.5,0.25\n1,0,0,0\n")
    assert [(r.clip_id, r.frame_index, r.visible, r.x) for r in readers.read_labels(spark, str(tmp_path / "*/labels.csv")).orderBy("frame_index").collect()] == [
        ("a", 0, True, .5), ("a", 1, False, 0.0)]


def test_digests_and_media(spark, tmp_path):
    for name in ("b.mp4", "Rally_z.MOV", "a.mkv", "note.txt"):
        _put(tmp_path, "media", name, name)
    assert [r.name for r in readers.list_media(spark, str(tmp_path)).collect()] == ["rally_z.mov", "a.mkv", "b.mp4"]
    import hashlib
    want = hashlib.sha256(b"note.txt").hexdigest()
    assert want in {r.sha256 for r in readers.file_digests(spark, str(tmp_path)).collect()}


def test_run_registry(spark):
    runs = spark.createDataFrame([("a", "M1", "complete", 3, False), ("b", "M5", "complete", 1, True), ("c", None, None, 9, False),
                                  ("d", None, None, 8, False), ("e", "M1", "failed", 7, False)], "run string, milestone string, status string, modified_at long, has_insights boolean")
    val = spark.createDataFrame([("c", 2), ("d", 5)], "run string, frames_analyzed long")
    frames = spark.createDataFrame([("c",), ("c",), ("d",)], "run string")
    assert [r.run for r in readers.list_runs(runs, val, frames).collect()] == ["b", "c", "a"]
    one = readers.load_run(runs.where("run = 'a'"), shuttle=spark.createDataFrame([("a", 10)], "run string, rows long"),
                           players=spark.createDataFrame([("z", 10)], "run string, rows long")).first()
    assert one.shuttle.rows == 10 and one.players is None


def test_exports_round_trip_and_never_overwrite(spark, tmp_path):
    t = Tables(spark, SF)
    writers.write_shuttle(t.filled, str(tmp_path / "s"))
    back = spark.read.csv(str(tmp_path / "s/csv"), header=True)
    assert back.count() == 1000 and back.where("source = 'interpolated' and confidence is null").count() == t.filled.where("source = 'interpolated'").count()
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_shuttle(t.filled, str(tmp_path / "s"))
    writers.write_motion(t.stored_motion, str(tmp_path / "m"))
    first = spark.read.csv(str(tmp_path / "m/csv"), header=True).where("quality_flags <> '[]'").first()
    assert json.loads(first.quality_flags)
    nested = writers.players_nested(t.records, t.players)
    assert nested.count() == 1000 and nested.agg(F.sum(F.size("players"))).first()[0] == t.players.count()
    wide = writers.players_wide(t.players, t.records)
    assert checks.check_pose_export(t.players, wide).count() == 0 and {"nose_x", "right_ankle_visible"} <= set(wide.columns)


def test_review_versions_are_appended(spark, tmp_path):
    clips = spark.createDataFrame([(1, "aa")], "clip_id long, source_digest string")
    make = lambda label, digest: spark.createDataFrame([(1, digest, label)], "clip_id long, source_digest string, player_label string")
    path = str(tmp_path / "reviews")
    writers.append_review(make("A", None), clips, path, "001")
    writers.append_review(make("B", "aa"), clips, path, "002")
    assert writers.review_version(spark, path).first().player_label == "B"
    assert writers.review_version(spark, path, "001").first().source_digest == "aa"
    with pytest.raises(ValueError):
        writers.append_review(make("C", "bb"), clips, path, "003")


def test_reports(spark, tmp_path):
    lines, docs = _report_parts(Tables(spark, SF))
    lines = lines.where("clip_id in (0, 1)")
    text = [r.line for r in lines.where("clip_id = 1").orderBy("section", "ord").collect()]
    assert text[0].startswith("| 1 | P1 | ") and any(x.startswith("Whole clip: from frame 0 to") for x in text)
    assert text[-1].startswith("1. These descriptive reports")
    reports.write_report(lines, str(tmp_path / "report"))
    assert os.path.isdir(tmp_path / "report/clip_id=1")
    doc = json.loads(docs.where("clip_id = 1").first().document)
    assert doc["shuttle"]["physical_speed_km_h"] is None and all(isinstance(p["zones"], dict) and len(p["heatmap"]["values_s"]) == 54 and isinstance(p["quality_flags"], dict) for p in doc["players"]) and {p["track_id"] for p in doc["players"]} == {1, 2}


def test_quarantine(spark):
    t = Tables(spark, SF)
    bad = checks.check_source(t.dirty_shuttle)
    good, aside = checks.quarantine(t.dirty_shuttle, bad)
    assert good.count() + aside.count() == 1000 and checks.check_source(good).count() == 0
    with pytest.raises(ValueError):
        checks.fail_on(bad)
    assert fixtures.table(spark, SF, "fx_shuttle").count() == 1000
