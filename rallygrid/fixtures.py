"""Observation tables derived from the ``events`` test table.

One SQL text per table, in the dialect shared by Spark and DuckDB, so a query
and its check read exactly the same rows.  ``cte(...)`` gives the WITH prefix
for the tables asked for and what they depend on.
"""
from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .sources.store import scratch_dir

TABLES: dict[str, str] = {}

TABLES["fx_frames"] = """
SELECT user_id AS clip_id, event_id, event_type, frame_index,
       CAST(frame_index*(CASE WHEN user_id % 7 = 3 THEN 120000 ELSE 40000 END) + (event_id % 3)*5000 + CAST(floor(frame_index/25.0) AS BIGINT)*1000000 AS BIGINT) AS t_us,
       (frame_index*(CASE WHEN user_id % 7 = 3 THEN 120000 ELSE 40000 END) + (event_id % 3)*5000 + CAST(floor(frame_index/25.0) AS BIGINT)*1000000) / 1000000e0 AS timestamp_s,
       CASE WHEN event_id % 97 = 0 THEN 'camera_cut' END AS cut_flag
FROM (SELECT user_id, event_id, event_type,
             ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index
      FROM events) e
"""

TABLES["fx_positions"] = """
SELECT clip_id, frame_index, timestamp_s, cut_flag, track_id, low_confidence,
       CASE WHEN no_anchor THEN NULL ELSE
         (CASE WHEN still = 1 THEN 3000 ELSE 600 + abs((frame_index*3 + track_id*31 + clip_id*13) % 196 - 98)*50 END + jx
          + CASE WHEN (event_id + track_id) % 41 = 0 THEN 2500 ELSE 0 END) / 1000e0 END AS x_m,
       CASE WHEN no_anchor THEN NULL ELSE
         (CASE WHEN still = 1 THEN 3000 ELSE 400 + abs((frame_index*2 + clip_id*7) % 100 - 50)*110 END
          + CASE WHEN track_id % 2 = 1 THEN 6700 ELSE 0 END + jy) / 1000e0 END AS y_m
FROM (SELECT f.clip_id, f.frame_index, f.timestamp_s, f.cut_flag, f.event_id, p.track_id,
             f.event_type = 'error' AND f.event_id % 4 = 0 AS low_confidence,
             (f.event_id * 7 + p.track_id) % 29 = 0 AS no_anchor,
             CASE WHEN f.clip_id % 5 = 0 THEN 1 ELSE 0 END AS still,
             (f.event_id * 37) % 31 - 15 AS jx, (f.event_id * 53) % 31 - 15 AS jy
      FROM fx_frames f CROSS JOIN (SELECT 1 AS track_id UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p
      WHERE (f.event_id * 7 + p.track_id) % 23 <> 0 AND (p.track_id <= 2 OR f.clip_id % 3 = 0)) q
"""

TABLES["fx_shuttle"] = """
SELECT clip_id, frame_index, timestamp_s, cut_flag,
       CASE WHEN missing THEN NULL ELSE (60 + abs((frame_index*11 + clip_id*17) % 200 - 100)*5 + CASE WHEN event_id % 37 = 0 THEN 300 ELSE 0 END)*1e0 END AS x,
       CASE WHEN missing THEN NULL ELSE (40 + abs((frame_index*7 + clip_id*29) % 120 - 60)*6)*1e0 END AS y,
       (30 + event_id % 70) / 100e0 AS confidence,
       CASE WHEN missing THEN 'missing' ELSE 'detected' END AS source,
       missing OR (30 + event_id % 70) < 50 AS low_confidence
FROM (SELECT f.*, event_type = 'error' AS missing FROM fx_frames f) s
"""

TABLES["fx_identity"] = """
SELECT DISTINCT clip_id, track_id, concat('P', CAST(track_id AS STRING)) AS player_label,
       CASE WHEN track_id % 2 = 1 THEN 'near' ELSE 'far' END AS side,
       CASE WHEN track_id % 2 = 1 THEN 'A' ELSE 'B' END AS team
FROM (SELECT user_id AS clip_id FROM events) e
CROSS JOIN (SELECT 1 AS track_id UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p
WHERE (track_id <= 2 OR clip_id % 3 = 0) AND clip_id % 4 <> 3
"""

TABLES["fx_rallies"] = """
SELECT clip_id, concat('r', CAST(r AS STRING)) AS rally_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame
FROM (SELECT clip_id, frame_index, CAST(floor(frame_index/20.0) AS BIGINT) AS r FROM fx_frames f
      WHERE clip_id % 2 = 0 AND frame_index % 20 < 16) g
GROUP BY clip_id, r
"""

TABLES["fx_targets"] = """
SELECT DISTINCT user_id AS clip_id, 'P1' AS player_label, user_id % 20 + 1 AS contact_frame, user_id % 20 + 16 AS until_frame,
       305e-2 AS target_x_m, 85e-1 AS target_y_m, 15e-1 AS radius_m
FROM events WHERE user_id % 4 <> 3
"""

TABLES["fx_calibrations"] = """
SELECT DISTINCT user_id AS clip_id, 1280 AS width, 720 AS height,
       (454 + user_id % 7)*1e0 AS x0, (263 + user_id % 5)*1e0 AS y0, (827 - user_id % 3)*1e0 AS x1, (264 + user_id % 5)*1e0 AS y1,
       (985 - user_id % 11)*1e0 AS x2, (653 + user_id % 4)*1e0 AS y2, (297 + user_id % 13)*1e0 AS x3, (654 + user_id % 4)*1e0 AS y3,
       CASE WHEN user_id % 9 = 0 THEN 'auto_proposal' ELSE 'manual' END AS method, user_id % 18 = 0 AS manually_reviewed
FROM events
"""

TABLES["fx_ankles"] = """
SELECT user_id AS clip_id, event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (300 + (event_id*17) % 690)*1e0 END AS ankle_x,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE (250 + (event_id*29) % 430)*1e0 END AS ankle_y
FROM events
"""

TABLES["fx_labels"] = """
SELECT clip_id, frame_index, frame_index % 13 <> 5 AS visible,
       (60 + abs((frame_index*11 + clip_id*17) % 200 - 100)*5 + event_id % 19 - 9)*1e0 AS lx,
       (40 + abs((frame_index*7 + clip_id*29) % 120 - 60)*6 + event_id % 7 - 3)*1e0 AS ly
FROM fx_frames f
"""
# One camera frame table: expected head count by match format, review flags.
TABLES["fx_clips"] = """
SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN 'doubles' ELSE 'singles' END AS mode,
       CASE WHEN clip_id % 3 = 0 THEN 4 ELSE 2 END AS expected_player_count,
       1280 AS width, 720 AS height,
       CASE WHEN clip_id % 7 = 3 THEN 25e0/3 ELSE 25e0 END AS fps, frame_count,
       concat('clip-', CAST(clip_id AS STRING)) AS source_digest
FROM (SELECT clip_id, count(*) AS frame_count FROM fx_frames f GROUP BY clip_id) c
"""

# Player boxes before floor projection; keypoints follow in fx_keypoints.
TABLES["fx_boxes"] = """
SELECT clip_id, frame_index, timestamp_s, track_id, event_id,
       (event_id*11 + track_id*200) % 1000 * 1e0 AS x1, (event_id*5 + track_id*37) % 400 * 1e0 AS y1,
       ((event_id*11 + track_id*200) % 1000 + CASE WHEN (event_id + track_id) % 43 = 0 THEN -5 ELSE 40 + event_id % 60 END) * 1e0 AS x2,
       ((event_id*5 + track_id*37) % 400 + 100 + event_id % 90) * 1e0 AS y2,
       (10 + (event_id*19 + track_id) % 90) / 100e0 AS confidence
FROM (SELECT f.clip_id, f.frame_index, f.timestamp_s, f.event_id, p.track_id
      FROM fx_frames f CROSS JOIN (SELECT 1 AS track_id UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p
      WHERE (f.event_id * 7 + p.track_id) % 23 <> 0 AND (p.track_id <= 2 OR f.clip_id % 3 = 0)) q
"""

# Raw pose points in long form: k is the place in the fixed order, 0 to 16.
# The score is above one for some points, the pair is zero or off image for others.
TABLES["fx_keypoints"] = """
SELECT b.clip_id, b.frame_index, b.timestamp_s, b.track_id, b.event_id, b.x1, b.y1, b.x2, b.y2, b.confidence AS box_confidence, k.k,
       CASE WHEN (b.event_id*5 + k.k) % 47 = 0 THEN 0 ELSE (b.event_id*13 + k.k*29 + b.track_id*101) % 1300 END * 1e0 AS x,
       CASE WHEN (b.event_id*5 + k.k) % 47 = 0 THEN 0 ELSE (b.event_id*7 + k.k*31 + b.track_id*57) % 740 END * 1e0 AS y,
       CASE WHEN (b.event_id + k.k) % 53 = 0 THEN 125 ELSE (b.event_id*3 + k.k*7 + b.track_id*5) % 100 END / 100e0 AS score
FROM fx_boxes b CROSS JOIN (SELECT CAST(k AS BIGINT) AS k FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16)) v(k)) k
"""

# Selection polygons: a trapezoid in image fractions, absent for some clips.
TABLES["fx_rois"] = """
SELECT DISTINCT user_id AS clip_id, (31 + user_id % 5)/100e0 AS px0, 27/100e0 AS py0, (69 - user_id % 3)/100e0 AS px1, 27/100e0 AS py1,
       (89 + user_id % 7)/100e0 AS px2, 95/100e0 AS py2, (11 - user_id % 4)/100e0 AS px3, 95/100e0 AS py3
FROM events WHERE user_id % 4 <> 1
"""

# Detector candidates: up to three boxes per frame on a 512 x 288 grid.
TABLES["fx_candidates"] = """
SELECT f.clip_id, f.frame_index, f.timestamp_s, c.ord,
       (f.event_id*7 + c.ord*61) % 480 AS x, (f.event_id*3 + c.ord*47) % 260 AS y,
       2 + (f.event_id + c.ord*5) % 9 AS w, 2 + (f.event_id*2 + c.ord*3) % 7 AS h,
       (40 + (f.event_id*11 + c.ord*17) % 60) / 100e0 AS score
FROM fx_frames f CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2) c
WHERE (f.event_id + c.ord) % 4 <> 0
"""

# Presentation stamps in milliseconds, some missing.
TABLES["fx_pts"] = """
SELECT clip_id, frame_index,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1250 + t_us / 1000 * CASE WHEN event_id % 301 = 0 THEN 0 ELSE 1 END END AS pts,
       1 AS time_base_num, 1000 AS time_base_den, CASE WHEN clip_id % 7 = 3 THEN 25e0/3 ELSE 25e0 END AS fps
FROM (SELECT clip_id, frame_index, event_id, t_us - t_us % 1000 AS t_us FROM fx_frames f) p
"""

# Requested clip extractions; the last one of a clip is over-long on purpose.
TABLES["fx_intervals"] = """
SELECT DISTINCT user_id AS clip_id, concat('cut', CAST(i AS STRING)) AS interval_id, (user_id % 4 + i*15)/10e0 AS start_s,
       (user_id % 4 + i*15)/10e0 + CASE WHEN i = 2 THEN 400e0 ELSE 12/10e0 END AS end_s
FROM (SELECT user_id FROM events) e CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n
"""

# Reviewed moments.
TABLES["fx_events"] = """
SELECT clip_id, frame_index, CASE WHEN event_id % 3 = 0 THEN 'contact' WHEN event_id % 3 = 1 THEN 'outcome' ELSE 'note' END AS kind,
       CASE WHEN event_id % 2 = 0 AND clip_id % 4 <> 3 THEN 'P1' END AS player_label
FROM fx_frames f WHERE event_type = 'purchase'
"""

# Frame-rate fields of the containers; zero stands for an unusable rate.
TABLES["fx_rates"] = """
SELECT DISTINCT user_id AS clip_id, CASE WHEN user_id % 4 = 0 THEN 0e0 ELSE 25e0 END AS average_rate,
       CASE WHEN user_id % 8 = 0 THEN NULL ELSE 30e0 END AS guessed_rate,
       CASE WHEN user_id % 16 = 0 THEN -1e0 ELSE 24e0 END AS base_rate,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 25e0 + user_id % 2 END AS fps_hint
FROM events
"""

# A damaged copy of the shuttle table, for the checks.
TABLES["fx_dirty_shuttle"] = """
SELECT clip_id, frame_index + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS frame_index,
       CASE WHEN event_id % 157 = 0 THEN timestamp_s - 2 ELSE timestamp_s END AS timestamp_s,
       CASE WHEN event_id % 131 = 0 THEN NULL ELSE x END AS x, CASE WHEN event_id % 113 = 0 THEN NULL ELSE y END AS y,
       CASE WHEN event_id % 109 = 0 THEN 'guessed' WHEN event_id % 173 = 0 THEN 'missing' ELSE source END AS source,
       confidence, low_confidence, frame_index AS ordinal
FROM (SELECT s.*, f.event_id FROM fx_shuttle s JOIN fx_frames f ON s.clip_id = f.clip_id AND s.frame_index = f.frame_index) d
"""

# A damaged copy of the annotations.
TABLES["fx_dirty_identity"] = """
SELECT DISTINCT clip_id, track_id,
       CASE WHEN clip_id % 11 = 0 THEN '  ' WHEN clip_id % 13 = 0 THEN 'P1' ELSE concat('P', CAST(track_id AS STRING)) END AS player_label,
       CASE WHEN clip_id % 17 = 0 THEN 'left' WHEN track_id % 2 = 1 THEN 'near' ELSE 'far' END AS side,
       CASE WHEN clip_id % 19 = 0 THEN ' ' WHEN track_id % 2 = 1 THEN 'A' ELSE 'B' END AS team
FROM (SELECT user_id AS clip_id FROM events) e
CROSS JOIN (SELECT 1 AS track_id UNION ALL SELECT 2 UNION ALL SELECT 9) p
"""

TABLES["fx_dirty_rallies"] = """
SELECT clip_id, CAST(r AS BIGINT) AS ordinal, CASE WHEN clip_id % 10 = 0 THEN 'r' WHEN clip_id % 14 = 0 THEN ' ' ELSE concat('r', CAST(r AS STRING)) END AS rally_id,
       CASE WHEN clip_id % 6 = 0 AND r = 1 THEN 5 ELSE r*20 END AS start_frame,
       CASE WHEN clip_id % 8 = 0 THEN r*20 - 1 WHEN clip_id % 9 = 0 THEN r*20 + 500 ELSE r*20 + 15 END AS end_frame,
       CASE WHEN clip_id % 12 = 0 THEN 'P9' WHEN r = 0 THEN 'P1' END AS winner_label
FROM (SELECT DISTINCT user_id AS clip_id FROM events) e CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) n
"""

TABLES["fx_dirty_targets"] = """
SELECT clip_id, CAST(0 AS BIGINT) AS ordinal, CASE WHEN clip_id % 10 = 0 THEN 'P9' ELSE 'P1' END AS player_label,
       CASE WHEN clip_id % 9 = 0 THEN 900 ELSE 20 END AS contact_frame,
       CASE WHEN clip_id % 8 = 0 THEN NULL WHEN clip_id % 7 = 0 THEN 3 ELSE 30 END AS until_frame,
       CASE WHEN clip_id % 6 = 0 THEN 61e-1 ELSE 7e0 END AS target_x_m, 67e-1 AS target_y_m,
       CASE WHEN clip_id % 5 = 0 THEN NULL WHEN clip_id % 4 = 0 THEN 31e-1 ELSE 3e0 END AS radius_m
FROM (SELECT DISTINCT user_id AS clip_id FROM events) e
"""

TABLES["fx_dirty_corners"] = """
SELECT clip_id, width, height, CASE WHEN clip_id % 7 = 0 THEN 1280e0 ELSE x0 END AS x0, y0,
       CASE WHEN clip_id % 5 = 0 THEN x3 ELSE x1 END AS x1, y1, CASE WHEN clip_id % 11 = 0 THEN x3 ELSE x2 END AS x2, y2,
       CASE WHEN clip_id % 11 = 0 THEN x2 ELSE x3 END AS x3, CASE WHEN clip_id % 13 = 0 THEN NULL ELSE y3 END AS y3
FROM fx_calibrations c
"""

# Corners that are squeezed to a line, drawn together, or have a third one almost between its neighbours, ever closer.
TABLES["fx_thin_corners"] = """
SELECT clip_id, x0, CASE WHEN kind = 1 THEN 263 + (y0 - 263)/thin ELSE y0 END AS y0, CASE WHEN kind = 2 THEN x0 + (x1 - x0)/thin ELSE x1 END AS x1,
       CASE WHEN kind = 1 THEN 263 + (y1 - 263)/thin WHEN kind = 2 THEN y0 + (y1 - y0)/thin ELSE y1 END AS y1,
       CASE WHEN kind = 3 THEN (x1 + x3)/2 + 1/thin ELSE x2 END AS x2, CASE WHEN kind = 1 THEN 263 + (y2 - 263)/thin WHEN kind = 3 THEN (y1 + y3)/2 + 1/thin ELSE y2 END AS y2,
       x3, CASE WHEN kind = 1 THEN 263 + (y3 - 263)/thin ELSE y3 END AS y3
FROM (SELECT c.*, c.clip_id % 4 AS kind, pow(10e0, c.clip_id % 13) AS thin FROM fx_calibrations c) t
"""

TABLES["fx_dirty_rois"] = """
SELECT DISTINCT user_id AS clip_id, 3/10e0 AS px0, 3/10e0 AS py0,
       CASE WHEN user_id % 5 = 0 THEN 9 ELSE 7 END/10e0 AS px1, CASE WHEN user_id % 5 = 0 THEN 9 WHEN user_id % 7 = 0 THEN 5 ELSE 3 END/10e0 AS py1,
       CASE WHEN user_id % 3 = 0 THEN 3 WHEN user_id % 5 = 0 THEN 9 WHEN user_id % 7 = 0 THEN 11 ELSE 9 END/10e0 AS px2,
       CASE WHEN user_id % 3 = 0 THEN 3 WHEN user_id % 5 = 0 THEN 3 WHEN user_id % 7 = 0 THEN 7 ELSE 9 END/10e0 AS py2,
       CASE WHEN user_id % 5 = 0 THEN 3 WHEN user_id % 7 = 0 THEN 15 ELSE 1 END/10e0 AS px3, 9/10e0 AS py3
FROM events
"""

# Where each table reads from.
_NEEDS = {
    "fx_positions": ("fx_frames",), "fx_shuttle": ("fx_frames",), "fx_rallies": ("fx_frames",),
    "fx_labels": ("fx_frames",), "fx_clips": ("fx_frames",), "fx_boxes": ("fx_frames",),
    "fx_keypoints": ("fx_frames", "fx_boxes"), "fx_candidates": ("fx_frames",), "fx_pts": ("fx_frames",),
    "fx_events": ("fx_frames",), "fx_dirty_shuttle": ("fx_frames", "fx_shuttle"),
    "fx_dirty_corners": ("fx_calibrations",), "fx_thin_corners": ("fx_calibrations",),
}


def cte(*names: str) -> str:
    """WITH prefix defining ``names`` and everything they read."""
    wanted: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in wanted)


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build, rows_per_file: int = 32768) -> DataFrame:
    """``build()`` written as Parquet on first use and read back from there.

    A task reads some thousand rows of a file at a time, so a table of long rows needs few ``rows_per_file``.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{scratch_dir(spark)}/{hashlib.sha1(sf_dir.encode()).hexdigest()[:8]}/{name}"
        # Small files, so that even a small test table is read by several tasks.
        build().write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over ``sf_dir``.

    Operators start from a stored observation table, as they do in production,
    where narrow scans and row-group ranges are available.
    """
    def build() -> DataFrame:
        views = {"events": spark.read.parquet(f"{sf_dir}/events.parquet")}
        # Tables this one reads are stored first and read back.
        text = TABLES[name]
        for need in _NEEDS.get(name, ()):
            views[need] = table(spark, sf_dir, need)
        for view in views:
            text = re.sub(rf"\b(FROM|JOIN) {view}\b", rf"\1 {{{view}}}", text)
        return spark.sql(text, **{v: df for v, df in views.items() if "{" + v + "}" in text})
    return stored(spark, sf_dir, name, build)
