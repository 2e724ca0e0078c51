"""The same queries as plain SQL over the same derived tables, for checking."""
from __future__ import annotations

import itertools
import math

from ..fixtures import TABLES, cte
from ..policy import note

ORACLES: dict[str, str] = {}


def r(expr: str, name: str | None = None) -> str:
    """Round a measure the way the queries do."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 9)), 6) AS DOUBLE) AS {name or expr.split('.')[-1]}"


def i(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr.split('.')[-1]}"


def flags(*pairs: tuple[str, str]) -> str:
    """Words in alphabetical order, joined by ';'."""
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, w in sorted(pairs, key=lambda p: p[1])) + ")"


CAPS = """{name} AS (SELECT clip_id, greatest(0.25, 3*quantile_cont(dt, 0.5)) AS cap FROM
  (SELECT clip_id, timestamp_s - lag(timestamp_s) OVER w AS dt, frame_index - lag(frame_index) OVER w AS df FROM {table}
   WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)) WHERE df = 1 GROUP BY clip_id)"""


def caps(name: str, table: str) -> str:
    return CAPS.format(name=name, table=table)


SHUTTLE = f"""{cte('fx_frames', 'fx_shuttle')}, {caps('scap', 'fx_shuttle')},
sv AS (SELECT *, source = 'detected' AND NOT low_confidence AND confidence >= 0.5 AND x IS NOT NULL AND cut_flag IS NULL
   AND x >= 0 AND x < 1280 AND y >= 0 AND y < 720 AS valid FROM fx_shuttle),
sl AS (SELECT sv.*, lag(valid) OVER w AS pv, lag(frame_index) OVER w AS pf, lag(timestamp_s) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py
   FROM sv WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)),
sj AS (SELECT sl.*, coalesce(valid AND pv AND frame_index = pf + 1 AND timestamp_s - pt <= coalesce(cap, 0.25), false) AS joined,
   coalesce(valid AND pv, false) AS both_ok FROM sl LEFT JOIN scap USING (clip_id)),
sm AS (SELECT *, CASE WHEN joined THEN timestamp_s - pt END AS dt, CASE WHEN joined THEN sqrt((x-px)*(x-px) + (y-py)*(y-py)) END AS moved FROM sj)"""
JUMP = "coalesce(moved / sqrt(1280e0*1280 + 720e0*720) >= 0.1, false)"
_SFLAGS = [("cut_flag IS NOT NULL", "camera_cut"), (JUMP, "large_image_jump_review"), ("low_confidence OR confidence < 0.5", "low_confidence_shuttle"),
           ("both_ok AND NOT joined", "observation_gap"), ("source <> 'detected'", "shuttle_not_observed"), ("x IS NULL", "shuttle_position_unavailable")]
ORACLES["shuttle_motion"] = f"""{SHUTTLE} SELECT clip_id, {i('frame_index')}, {r('timestamp_s')}, {r('x', 'x_px')}, {r('y', 'y_px')}, source,
 valid AS valid_observation, {i('CASE WHEN joined THEN pf END', 'interval_start_frame')}, {r('dt', 'interval_duration_s')},
 {r('moved', 'displacement_px')}, {r('moved/dt', 'image_speed_px_s')}, CAST(NULL AS DOUBLE) AS physical_speed_km_h, {flags(*_SFLAGS)} AS quality_flags FROM sm"""
ORACLES["shuttle_motion_summary"] = f"""{SHUTTLE} SELECT clip_id, {i('count(*) FILTER (valid)', 'observed_frames')}, {i('count(*)', 'total_frames')},
 {i('count(dt)', 'valid_motion_intervals')}, {i('greatest(0, count(*) - 1 - count(dt))', 'excluded_motion_intervals')},
 {r('coalesce(sum(dt), 0)', 'valid_motion_time_s')}, {r('sum(moved)/sum(dt)', 'average_image_speed_px_s')}, {r('max(moved/dt)', 'max_image_speed_px_s')},
 CAST(NULL AS DOUBLE) AS physical_speed_km_h, {i(f'count(*) FILTER ({JUMP})', 'jump_count')} FROM sm GROUP BY clip_id"""
ORACLES["shuttle_flag_counts"] = f"""{SHUTTLE}, f AS (SELECT clip_id, unnest(string_split({flags(*_SFLAGS)}, ';')) AS flag FROM sm)
 SELECT clip_id, flag, {i('count(*)', 'rows')} FROM f WHERE flag <> '' GROUP BY clip_id, flag"""
ORACLES["gap_caps"] = f"""{cte('fx_frames')}, {caps('c', 'fx_frames')} SELECT clip_id, {r('coalesce(cap, 0.25)', 'gap_cap_s')}
 FROM (SELECT DISTINCT clip_id FROM fx_frames) d LEFT JOIN c USING (clip_id)"""

# Runs of missing rows (islands), joined to the rows on either side.
FILLED = f"""{cte('fx_frames', 'fx_shuttle')},
isl AS (SELECT *, frame_index - row_number() OVER (PARTITION BY clip_id, source ORDER BY frame_index) AS g FROM fx_shuttle),
runs AS (SELECT clip_id, g, min(frame_index) AS f0, max(frame_index) AS f1 FROM isl WHERE source = 'missing' GROUP BY clip_id, g HAVING count(*) <= 2),
ends AS (SELECT u.clip_id, u.f0, u.f1, a.timestamp_s AS ta, a.x AS xa, a.y AS ya, b.timestamp_s AS tb, b.x AS xb, b.y AS yb
  FROM runs u JOIN fx_shuttle a ON a.clip_id = u.clip_id AND a.frame_index = u.f0 - 1 JOIN fx_shuttle b ON b.clip_id = u.clip_id AND b.frame_index = u.f1 + 1
  WHERE a.source = 'detected' AND b.source = 'detected' AND NOT a.low_confidence AND NOT b.low_confidence),
filled AS (SELECT s.clip_id, s.frame_index, s.timestamp_s,
  CASE WHEN e.f0 IS NULL THEN s.x ELSE xa + (s.timestamp_s - ta)/(tb - ta)*(xb - xa) END AS x,
  CASE WHEN e.f0 IS NULL THEN s.y ELSE ya + (s.timestamp_s - ta)/(tb - ta)*(yb - ya) END AS y,
  CASE WHEN e.f0 IS NULL THEN s.confidence END AS confidence, CASE WHEN e.f0 IS NULL THEN s.source ELSE 'interpolated' END AS source,
  s.low_confidence OR e.f0 IS NOT NULL AS low_confidence, s.x AS raw_x, s.y AS raw_y, s.confidence AS raw_confidence
  FROM fx_shuttle s LEFT JOIN ends e ON e.clip_id = s.clip_id AND s.frame_index BETWEEN e.f0 AND e.f1)"""
_FILLED_COLS = f"clip_id, {i('frame_index')}, {r('timestamp_s')}, {{xy}}, {r('raw_x')}, {r('raw_y')}, {r('raw_confidence')}"
ORACLES["interpolated_shuttle"] = f"""{FILLED} SELECT {_FILLED_COLS.format(xy=f"{r('x')}, {r('y')}, {r('confidence')}, source, low_confidence")} FROM filled"""
ORACLES["restored_raw_shuttle"] = f"""{FILLED} SELECT {_FILLED_COLS.format(xy=f"{r('raw_x', 'x')}, {r('raw_y', 'y')}, {r('raw_confidence', 'confidence')}, CASE WHEN raw_x IS NULL THEN 'missing' ELSE 'detected' END AS source, raw_x IS NULL OR raw_confidence IS NULL OR raw_confidence < 0.6 AS low_confidence")} FROM filled"""
_GAPS = """gi AS (SELECT clip_id, frame_index - row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS g FROM {t} WHERE source <> 'detected'),
gl AS (SELECT clip_id, g, count(*) AS n FROM gi GROUP BY clip_id, g),
gaps AS (SELECT clip_id, count(g) AS raw_gap_count, coalesce(max(n), 0) AS longest_raw_gap_frames FROM (SELECT DISTINCT clip_id FROM {t}) c LEFT JOIN gl USING (clip_id) GROUP BY clip_id)"""
ORACLES["raw_gaps"] = f"{cte('fx_frames', 'fx_shuttle')}, {_GAPS.format(t='fx_shuttle')} SELECT clip_id, {i('raw_gap_count')}, {i('longest_raw_gap_frames')} FROM gaps"
ORACLES["tracking_summary"] = f"""{FILLED}, {_GAPS.format(t='filled')}, s AS (SELECT clip_id, count(*) AS n, count(*) FILTER (source='detected') AS d,
 count(*) FILTER (source='missing') AS m, count(*) FILTER (source='interpolated') AS p, count(*) FILTER (source='detected' AND NOT low_confidence) AS rel,
 count(*) FILTER (low_confidence) AS low, avg(raw_confidence) AS a, arg_min(timestamp_s, frame_index) AS t0, arg_max(timestamp_s, frame_index) AS t1 FROM filled GROUP BY clip_id)
 SELECT clip_id, {i('n', 'frames_analyzed')}, {i('d', 'detected')}, {i('m', 'missing')}, {i('p', 'interpolated')}, {r('d/n', 'observed_fraction')},
 {r('rel/n', 'reliable_observed_fraction')}, {r('(d+p)/n', 'available_fraction_after_interpolation')}, {i('low', 'low_confidence_frames')},
 {r('a', 'mean_raw_heatmap_score')}, {r('t0', 'time_first_frame_s')}, {r('t1', 'time_last_frame_s')}, {i('raw_gap_count')}, {i('longest_raw_gap_frames')}
 FROM s JOIN gaps USING (clip_id)"""
ORACLES["head_frames"] = f"{cte('fx_frames')} SELECT clip_id, {i('frame_index')}, {r('timestamp_s')} FROM fx_frames WHERE frame_index < 20"
ORACLES["shuttle_source_counts"] = f"{FILLED} SELECT clip_id, source, {i('count(*)', 'frames')} FROM filled GROUP BY clip_id, source"
ORACLES["analyzed_spans"] = f"""{cte('fx_shuttle', 'fx_clips')} SELECT clip_id, {r('max(timestamp_s) - min(timestamp_s) + 1/min(fps)', 'analyzed_span_s')}
 FROM fx_shuttle JOIN fx_clips USING (clip_id) GROUP BY clip_id"""

# Player motion -----------------------------------------------------------------

def zone_sql(x: str, y: str) -> str:
    return f"""CASE WHEN NOT ({x} BETWEEN 0 AND 6.1 AND {y} BETWEEN 0 AND 13.4) THEN 'outside_court' ELSE concat(
 CASE WHEN {y} < 6.7 THEN 'far' ELSE 'near' END, '_',
 CASE WHEN least({y}, 13.4 - {y}) < 13.4/6 THEN 'back' WHEN least({y}, 13.4 - {y}) < 13.4/3 THEN 'mid' ELSE 'front' END, '_',
 CASE WHEN {x} < 6.1/3 THEN 'left' WHEN {x} < 2*6.1/3 THEN 'center' ELSE 'right' END) END"""


ORACLES["court_zones"] = f"{cte('fx_positions')} SELECT clip_id, {i('frame_index')}, {i('track_id')}, {zone_sql('x_m', 'y_m')} AS zone FROM fx_positions WHERE x_m IS NOT NULL"
_CONF = "NOT (method LIKE 'auto%' AND NOT manually_reviewed)"
_NEAR = "x_m BETWEEN -1 AND 6.1e0 + 1 AND y_m BETWEEN -1 AND 13.4e0 + 1"
ORACLES["player_positions"] = f"""{cte('fx_positions', 'fx_calibrations')},
q AS (SELECT p.*, {_CONF} AS conf, {_CONF} AND x_m IS NOT NULL AND NOT low_confidence AND cut_flag IS NULL AS v FROM fx_positions p JOIN fx_calibrations USING (clip_id)),
u AS (SELECT *, coalesce(v AND {_NEAR}, false) AS ok FROM q)
SELECT clip_id, {i('frame_index')}, {i('track_id')}, {r('x_m')}, {r('y_m')}, ok AS valid_position, CASE WHEN ok THEN {zone_sql('x_m', 'y_m')} END AS zone,
 {flags(('cut_flag IS NOT NULL', 'camera_cut'), ('x_m IS NULL', 'court_position_unavailable'), ('low_confidence', 'low_confidence_pose'), ('NOT conf', 'unconfirmed_court_calibration'), (f'v AND NOT ({_NEAR})', 'position_outside_reasonable_floor_bounds'))} AS quality_flags FROM u"""

MOTION = f"""{cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_calibrations')}, {caps('pcap', 'fx_frames')},
pv AS (SELECT p.*, {_CONF} AS conf, coalesce({_CONF} AND x_m IS NOT NULL AND NOT low_confidence AND cut_flag IS NULL AND {_NEAR}, false) AS valid FROM fx_positions p JOIN fx_calibrations USING (clip_id)),
lk AS (SELECT pv.*, lag(valid) OVER w AS bv, lag(frame_index) OVER w AS bf, lag(timestamp_s) OVER w AS bt, lag(x_m) OVER w AS bx, lag(y_m) OVER w AS byy
   FROM pv WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame_index)),
br AS (SELECT lk.*, CASE WHEN valid AND bv THEN CASE WHEN frame_index <> bf + 1 OR timestamp_s - bt > coalesce(cap, 0.25) THEN 'observation_gap'
   WHEN sqrt((x_m-bx)*(x_m-bx) + (y_m-byy)*(y_m-byy)) / (timestamp_s - bt) > 12 THEN 'implausible_position_jump' END END AS reason FROM lk LEFT JOIN pcap USING (clip_id)),
bs AS (SELECT *, valid AND (NOT coalesce(bv, false) OR reason IS NOT NULL) AS starts FROM br),
sg AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, track_id ORDER BY frame_index) AS seg FROM bs),
v AS (SELECT * FROM sg WHERE valid),
md AS (SELECT clip_id, track_id, seg, count(*) AS n, quantile_cont(x_m, 0.5) AS mx, quantile_cont(y_m, 0.5) AS my FROM v GROUP BY clip_id, track_id, seg),
rs AS (SELECT clip_id, track_id, seg, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, max(sqrt((x_m-mx)*(x_m-mx) + (y_m-my)*(y_m-my))) AS radius
   FROM v JOIN md USING (clip_id, track_id, seg) GROUP BY clip_id, track_id, seg),
nb AS (SELECT a.clip_id, a.track_id, a.frame_index, b.timestamp_s - a.timestamp_s AS o, b.x_m AS nx, b.y_m AS ny,
   count(*) FILTER (abs(b.timestamp_s - a.timestamp_s) <= 0.1 + 1e-12) OVER (PARTITION BY a.clip_id, a.track_id, a.frame_index) AS near,
   row_number() OVER (PARTITION BY a.clip_id, a.track_id, a.frame_index ORDER BY abs(b.timestamp_s - a.timestamp_s), b.frame_index) AS rn
   FROM v a JOIN v b ON a.clip_id = b.clip_id AND a.track_id = b.track_id AND a.seg = b.seg),
wt AS (SELECT clip_id, track_id, frame_index, sum(w) AS w, sum(w*o) AS s, sum(w*o*o) AS ss, sum(w*nx) AS x, sum(w*ny) AS y, sum(w*o*nx) AS sx, sum(w*o*ny) AS sy
   FROM (SELECT *, 1/(1 + (o/0.1)*(o/0.1)) AS w FROM nb WHERE (near >= 3 AND abs(o) <= 0.1 + 1e-12) OR (near < 3 AND rn <= 3)) GROUP BY clip_id, track_id, frame_index),
sm AS (SELECT v.*, CASE WHEN n < 3 THEN x_m WHEN 2*radius <= 0.08 THEN mx ELSE (ss*x - s*sx)/(w*ss - s*s) END AS smx,
   CASE WHEN n < 3 THEN y_m WHEN 2*radius <= 0.08 THEN my ELSE (ss*y - s*sy)/(w*ss - s*s) END AS smy
   FROM v JOIN rs USING (clip_id, track_id, seg) JOIN wt USING (clip_id, track_id, frame_index)),
iv AS (SELECT *, lag(frame_index) OVER w AS f0, lag(timestamp_s) OVER w AS t0, lag(x_m) OVER w AS x0, lag(y_m) OVER w AS y0,
   timestamp_s - lag(timestamp_s) OVER w AS dt, sqrt(pow(smx - lag(smx) OVER w, 2) + pow(smy - lag(smy) OVER w, 2)) AS moved
   FROM sm WINDOW w AS (PARTITION BY clip_id, track_id, seg ORDER BY frame_index)),
mo AS (SELECT sg.clip_id, sg.frame_index, sg.timestamp_s, sg.track_id, player_label, side, team, sg.x_m, sg.y_m, sg.valid, sg.conf, sg.starts, sg.reason, sg.cut_flag, sg.low_confidence,
   smx, smy, coalesce(moved/dt > 12, false) AS fast, CASE WHEN moved/dt <= 12 THEN f0 END AS f0, CASE WHEN moved/dt <= 12 THEN t0 END AS t0, x0, y0,
   CASE WHEN moved/dt <= 12 THEN dt END AS dt, CASE WHEN moved/dt <= 12 THEN moved END AS moved, CASE WHEN sg.valid THEN {zone_sql('sg.x_m', 'sg.y_m')} END AS zone
   FROM sg LEFT JOIN iv USING (clip_id, track_id, frame_index) LEFT JOIN fx_identity d ON d.clip_id = sg.clip_id AND d.track_id = sg.track_id)"""
_PFLAGS = flags(("cut_flag IS NOT NULL", "camera_cut"), ("x_m IS NULL", "court_position_unavailable"), ("low_confidence", "low_confidence_pose"),
                ("NOT conf", "unconfirmed_court_calibration"), (f"conf AND x_m IS NOT NULL AND NOT low_confidence AND cut_flag IS NULL AND NOT ({_NEAR})", "position_outside_reasonable_floor_bounds"),
                ("reason = 'observation_gap'", "observation_gap"), ("reason = 'implausible_position_jump'", "implausible_position_jump"), ("fast", "implausible_smoothed_speed"))
_K = f"clip_id, {i('frame_index')}, {i('track_id')}"
ORACLES["player_segments"] = f"{MOTION} SELECT {_K}, valid AS valid_position, starts, {_PFLAGS} AS quality_flags FROM mo"
ORACLES["smoothed_positions"] = f"{MOTION} SELECT {_K}, {r('smx', 'smoothed_x_m')}, {r('smy', 'smoothed_y_m')} FROM mo"
ORACLES["player_motion"] = f"""{MOTION} SELECT {_K}, player_label, side, team, zone, {i('f0', 'interval_start_frame')}, {r('t0', 'interval_start_timestamp_s')},
 {r('dt', 'interval_duration_s')}, {r('moved', 'distance_m')}, {r('moved/dt', 'speed_m_s')}, {_PFLAGS} AS quality_flags FROM mo"""
OCC = f"""{MOTION}, oc AS (SELECT clip_id, track_id, x, y, s, {zone_sql('x', 'y')} AS zone, x BETWEEN 0 AND 6.1 AND y BETWEEN 0 AND 13.4 AS inside FROM
 (SELECT clip_id, track_id, x_m AS x, y_m AS y, dt/2 AS s FROM mo WHERE dt IS NOT NULL UNION ALL SELECT clip_id, track_id, x0, y0, dt/2 FROM mo WHERE dt IS NOT NULL)),
zs AS (SELECT clip_id, track_id, zone, sum(s) AS seconds FROM oc GROUP BY clip_id, track_id, zone),
hm AS (SELECT clip_id, track_id, CAST(least(53, floor(y/13.4*54)) AS BIGINT) AS cell_row, CAST(least(23, floor(x/6.1*24)) AS BIGINT) AS cell_col, sum(s) AS seconds
  FROM oc WHERE inside GROUP BY ALL)"""
ORACLES["zone_seconds"] = f"{OCC} SELECT clip_id, {i('track_id')}, zone, {r('seconds')} FROM zs"
ORACLES["top_zones"] = f"""{OCC}, rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY round(seconds, 9) DESC, zone) AS rank FROM zs)
 SELECT clip_id, {i('track_id')}, zone, {r('seconds')}, {i('rank')} FROM rk WHERE rank <= 3"""
ORACLES["heatmap_seconds"] = f"{OCC} SELECT clip_id, {i('track_id')}, cell_row, cell_col, {r('seconds')} FROM hm"
ORACLES["dense_heatmap"] = f"""{OCC}, tr AS (SELECT DISTINCT clip_id, track_id FROM mo), ce AS (SELECT clip_id, track_id, unnest(range(1296)) AS k FROM tr)
 SELECT ce.clip_id, CAST(ce.track_id AS BIGINT) AS track_id, '54;24' AS grid_shape, string_agg(CAST(CAST(round(coalesce(seconds, 0) * 1000000) AS BIGINT) AS VARCHAR), ';' ORDER BY k) AS values_us
 FROM ce LEFT JOIN hm ON hm.clip_id = ce.clip_id AND hm.track_id = ce.track_id AND hm.cell_row * 24 + hm.cell_col = k GROUP BY 1, 2"""
ORACLES["heatmap_intensity"] = f"""{OCC} SELECT clip_id, {i('track_id')}, cell_row, cell_col, {r('seconds')},
 {r('ln(1+seconds)/ln(1+max(seconds) OVER (PARTITION BY clip_id, track_id))', 'intensity')} FROM hm"""
FRAG = f"""{MOTION}, fs AS (SELECT clip_id, track_id, any_value(player_label) AS player_label, any_value(side) AS side, any_value(team) AS team,
 min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS n, count(*) FILTER (valid) AS nv, count(dt) AS k, sum(moved) AS distance_m,
 coalesce(sum(dt), 0) AS secs, max(moved/dt) AS top FROM mo GROUP BY clip_id, track_id),
cf AS (SELECT clip_id, count(*) AS frames FROM fx_frames GROUP BY clip_id)"""
ORACLES["fragment_summary"] = f"""{FRAG} SELECT clip_id, {i('track_id')}, player_label, side, team, {i('first_frame')}, {i('last_frame')}, {i('n', 'observed_frames')},
 {i('nv', 'valid_position_frames')}, {i('k', 'motion_intervals')}, {i('greatest(0, n - 1 - k)', 'excluded_motion_intervals')}, {r('distance_m')},
 {r('secs', 'valid_motion_time_s')}, {r('distance_m/nullif(secs, 0)', 'average_speed_m_s')}, {r('top', 'max_speed_m_s')}, {r('k/greatest(1, frames - 1)', 'coverage')},
 CASE WHEN player_label IS NULL THEN 'unverified_tracker_fragment' ELSE 'manually_mapped_fragment' END AS identity_status FROM fs JOIN cf USING (clip_id)"""
ORACLES["player_flag_counts"] = f"""{MOTION}, f AS (SELECT clip_id, track_id, unnest(string_split({_PFLAGS}, ';')) AS flag FROM mo)
 SELECT clip_id, {i('track_id')}, flag, {i('count(*)', 'rows')} FROM f WHERE flag <> '' GROUP BY clip_id, track_id, flag"""

# Annotations -------------------------------------------------------------------
ORACLES["identified_players"] = f"""{FRAG} SELECT clip_id, player_label, string_agg(CAST(track_id AS VARCHAR), ';' ORDER BY track_id) AS track_ids, {r('sum(distance_m)', 'distance_m')},
 {r('coalesce(sum(secs) FILTER (distance_m IS NOT NULL), 0)', 'valid_motion_time_s')}, {r('max(top)', 'max_speed_m_s')},
 {r('sum(distance_m)/nullif(sum(secs) FILTER (distance_m IS NOT NULL), 0)', 'average_speed_m_s')} FROM fs WHERE player_label IS NOT NULL GROUP BY clip_id, player_label"""
SPANS = f"""{MOTION.replace(cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_calibrations'), cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_calibrations', 'fx_rallies', 'fx_events', 'fx_targets', 'fx_clips'))},
sp AS (SELECT clip_id, rally_id, start_frame, end_frame, 'manual_review' AS boundary_source FROM fx_rallies UNION ALL
  SELECT clip_id, 'unsegmented_clip', min(frame_index), max(frame_index), 'whole_clip_not_automatically_classified_as_rally' FROM fx_frames
  WHERE clip_id NOT IN (SELECT clip_id FROM fx_rallies) GROUP BY clip_id)"""
ORACLES["rally_summary"] = f"""{SPANS}, st AS (SELECT sp.*, a.timestamp_s AS start_s, b.timestamp_s AS end_s FROM sp
  LEFT JOIN fx_frames a ON a.clip_id = sp.clip_id AND a.frame_index = start_frame LEFT JOIN fx_frames b ON b.clip_id = sp.clip_id AND b.frame_index = end_frame),
 pr AS (SELECT sp.clip_id, rally_id, track_id, any_value(player_label) AS player_label, sum(moved) AS distance_m, sum(dt) AS secs FROM sp JOIN mo ON mo.clip_id = sp.clip_id
  AND f0 >= start_frame AND frame_index <= end_frame GROUP BY sp.clip_id, rally_id, track_id)
 SELECT st.clip_id, st.rally_id, {i('start_frame')}, {i('end_frame')}, {r('start_s')}, {r('end_s')}, boundary_source, {r('end_s - start_s', 'duration_s')}, CASE WHEN end_s - start_s IS NULL THEN 'unknown_frame' ELSE 'timed' END AS boundary_status,
 {i('track_id')}, player_label, {r('distance_m')}, {r('secs', 'valid_motion_time_s')}, {r('distance_m/nullif(secs, 0)', 'average_speed_m_s')}
 FROM st LEFT JOIN pr ON pr.clip_id = st.clip_id AND pr.rally_id = st.rally_id"""
ORACLES["rally_status"] = f"""{cte('fx_frames', 'fx_rallies')}, o AS (SELECT clip_id, rally_id, start_frame, CASE WHEN clip_id % 4 = 0 THEN end_frame + 1000 ELSE end_frame END AS end_frame, 'manual_review' AS boundary_source FROM fx_rallies
  UNION ALL SELECT clip_id, 'unsegmented_clip', min(frame_index), max(frame_index), 'whole_clip_not_automatically_classified_as_rally' FROM fx_frames WHERE clip_id NOT IN (SELECT clip_id FROM fx_rallies) GROUP BY clip_id)
 SELECT o.clip_id, rally_id, {i('start_frame')}, {i('end_frame')}, boundary_source, {r('b.timestamp_s', 'end_s')}, {r('b.timestamp_s - a.timestamp_s', 'duration_s')},
 CASE WHEN b.timestamp_s - a.timestamp_s IS NULL THEN 'unknown_frame' ELSE 'timed' END AS boundary_status FROM o
 LEFT JOIN fx_frames a ON a.clip_id = o.clip_id AND a.frame_index = start_frame LEFT JOIN fx_frames b ON b.clip_id = o.clip_id AND b.frame_index = end_frame"""
ORACLES["events_in_rallies"] = f"""{SPANS} SELECT e.clip_id, {i('e.frame_index')}, kind, player_label, rally_id FROM fx_events e JOIN sp ON sp.clip_id = e.clip_id
 AND e.frame_index BETWEEN start_frame AND end_frame"""
ORACLES["reviewed_events"] = f"""{SPANS} SELECT e.clip_id, {i('e.frame_index')}, kind, e.player_label, {i('m.track_id')}, m.player_label AS position_label, {r('m.x_m')}, {r('m.y_m')},
 m.valid AS valid_position, coalesce(CASE WHEN m.track_id IS NOT NULL THEN {_PFLAGS} END, '') AS position_flags
 FROM fx_events e LEFT JOIN mo m ON m.clip_id = e.clip_id AND m.frame_index = e.frame_index AND (e.player_label IS NULL OR e.player_label = m.player_label)"""
PAIRS = f"""{SPANS}, fr4 AS (SELECT clip_id, frame_index FROM mo JOIN fx_clips c USING (clip_id) WHERE mode = 'doubles' GROUP BY clip_id, frame_index HAVING count(*) = 4
  AND bool_and(valid AND player_label IS NOT NULL AND side IS NOT NULL AND reason IS DISTINCT FROM 'implausible_position_jump' AND NOT fast)
  AND count(*) FILTER (side = 'near') = 2 AND count(*) FILTER (side = 'far') = 2),
 ps AS (SELECT a.clip_id, a.frame_index, a.timestamp_s, a.side, least(a.player_label, b.player_label) AS l1, greatest(a.player_label, b.player_label) AS l2,
  abs(a.x_m - b.x_m) AS dx, abs(a.y_m - b.y_m) AS dy FROM mo a JOIN mo b ON a.clip_id = b.clip_id AND a.frame_index = b.frame_index AND a.side = b.side AND a.track_id < b.track_id
  JOIN fr4 ON fr4.clip_id = a.clip_id AND fr4.frame_index = a.frame_index WHERE a.team IS NULL OR b.team IS NULL OR a.team = b.team)"""
ORACLES["doubles_pair_spacing"] = f"""{PAIRS} SELECT clip_id, {i('frame_index')}, {r('timestamp_s')}, side, l1 AS first_label, l2 AS second_label, {r('sqrt(dx*dx+dy*dy)', 'spacing_m')},
 {r('dx', 'lateral_spacing_m')}, {r('dy', 'depth_spacing_m')} FROM ps"""
ORACLES["doubles_pair_summary"] = f"""{PAIRS} SELECT clip_id, side, l1 AS first_label, l2 AS second_label, {i('count(*)', 'valid_frames')}, {r('min(sqrt(dx*dx+dy*dy))', 'minimum_spacing_m')},
 {r('max(sqrt(dx*dx+dy*dy))', 'maximum_spacing_m')}, {r('quantile_cont(sqrt(dx*dx+dy*dy), 0.5)', 'median_spacing_m')} FROM ps GROUP BY ALL"""
# Here the frames are walked one by one, unlike in the query.
ORACLES["recovery"] = f"""{SPANS}, wk AS (SELECT t.*, g.f, m.track_id, m.timestamp_s, m.f0, lag(m.track_id) OVER w AS ptr,
  coalesce(m.valid AND m.reason IS DISTINCT FROM 'implausible_position_jump' AND NOT m.fast, false) AS ok, sqrt(pow(m.x_m - target_x_m, 2) + pow(m.y_m - target_y_m, 2)) <= radius_m AS hit
  FROM (SELECT *, unnest(generate_series(contact_frame, until_frame)) AS f FROM fx_targets t) t, LATERAL (SELECT t.f) g
  LEFT JOIN mo m ON m.clip_id = t.clip_id AND m.player_label = t.player_label AND m.frame_index = t.f
  WINDOW w AS (PARTITION BY t.clip_id, t.player_label ORDER BY t.f)),
 fb AS (SELECT clip_id, min(f) FILTER (NOT ok OR (f > contact_frame AND (ptr IS DISTINCT FROM track_id OR f0 IS DISTINCT FROM f - 1))) AS bad, min(f) FILTER (ok AND hit) AS hit,
  min(timestamp_s) FILTER (f = contact_frame) AS t0 FROM wk GROUP BY clip_id),
 fh AS (SELECT fb.*, w.timestamp_s AS th FROM fb LEFT JOIN wk w ON w.clip_id = fb.clip_id AND w.f = fb.hit)
 SELECT clip_id, player_label, {i('contact_frame')}, {i('until_frame')}, {r('target_x_m')}, {r('target_y_m')}, {r('radius_m')},
 {r("CASE WHEN hit IS NOT NULL AND (bad IS NULL OR hit < bad) THEN th - t0 END", 'recovery_time_s')},
 {i("CASE WHEN hit IS NOT NULL AND (bad IS NULL OR hit < bad) THEN hit END", 'reached_frame')},
 CASE WHEN hit IS NOT NULL AND (bad IS NULL OR hit < bad) THEN 'available' WHEN bad IS NULL THEN 'not_reached' ELSE 'unavailable' END AS status
 FROM fx_targets JOIN fh USING (clip_id)"""

# Court -------------------------------------------------------------------------
CAM = f"""{cte('fx_frames', 'fx_calibrations', 'fx_ankles', 'fx_clips')},
k1 AS (SELECT *, x1-x2 AS a1, x3-x2 AS a2, x0-x1+x2-x3 AS sx, y1-y2 AS b1, y3-y2 AS b2, y0-y1+y2-y3 AS sy FROM fx_calibrations),
k2 AS (SELECT *, (sx*b2 - a2*sy)/(a1*b2 - a2*b1) AS g, (a1*sy - sx*b1)/(a1*b2 - a2*b1) AS h FROM k1),
k3 AS (SELECT *, (x1-x0+g*x1)/6.1e0 AS i0, (x3-x0+h*x3)/13.4e0 AS i1, x0 AS i2, (y1-y0+g*y1)/6.1e0 AS i3, (y3-y0+h*y3)/13.4e0 AS i4, y0 AS i5, g/6.1e0 AS i6, h/13.4e0 AS i7, 1e0 AS i8 FROM k2),
cam AS (SELECT *, i0*i4 - i1*i3 AS d, NOT ({_CONF}) AS unconf FROM k3),
cm AS (SELECT *, (i4*i8-i5*i7)/d AS c0, (i2*i7-i1*i8)/d AS c1, (i1*i5-i2*i4)/d AS c2, (i5*i6-i3*i8)/d AS c3, (i0*i8-i2*i6)/d AS c4, (i2*i3-i0*i5)/d AS c5,
  (i3*i7-i4*i6)/d AS c6, (i1*i6-i0*i7)/d AS c7, d/d AS c8 FROM cam)"""
ORACLES["homographies"] = f"{CAM} SELECT clip_id, {', '.join(r(f'c{k}', f'to_court_{k}') for k in range(9))}, {', '.join(r(f'i{k}', f'to_image_{k}') for k in range(9))} FROM cm"
PROJ = f"""{CAM}, an AS (SELECT f.clip_id, f.frame_index, ankle_x, ankle_y, mode, event_type = 'click' AS weak FROM fx_ankles a JOIN fx_frames f ON a.clip_id = f.clip_id AND a.event_id = f.event_id
  JOIN fx_clips c ON c.clip_id = f.clip_id),
pj AS (SELECT an.*, unconf, (c0*ankle_x + c1*ankle_y + c2)/(c6*ankle_x + c7*ankle_y + c8) AS x_m, (c3*ankle_x + c4*ankle_y + c5)/(c6*ankle_x + c7*ankle_y + c8) AS y_m FROM an JOIN cm USING (clip_id)),
pk AS (SELECT *, x_m BETWEEN 0.46 - 1e-9 AND 5.64 + 1e-9 AND y_m BETWEEN -1e-9 AND 13.4 + 1e-9 AS s, x_m BETWEEN -1e-9 AND 6.1 + 1e-9 AND y_m BETWEEN -1e-9 AND 13.4 + 1e-9 AS dd FROM pj),
pp AS (SELECT *, x_m IS NOT NULL AND NOT (CASE WHEN mode = 'singles' THEN s ELSE dd END) AS outside FROM pk)"""
ORACLES["projected_players"] = f"""{PROJ} SELECT clip_id, {i('frame_index')}, {r('x_m')}, {r('y_m')}, s AS in_singles_court, dd AS in_doubles_court,
 concat_ws(';', CASE WHEN ankle_x IS NULL THEN 'ankle_midpoint_unavailable' END, CASE WHEN x_m IS NOT NULL THEN 'approximate_floor_projection' END,
 CASE WHEN x_m IS NOT NULL AND weak THEN 'low_confidence_pose' END, CASE WHEN x_m IS NOT NULL AND unconf THEN 'unconfirmed_court_calibration' END, CASE WHEN outside THEN 'outside_active_court' END) AS court_flags FROM pp"""
ORACLES["court_frame_flags"] = f"""{PROJ} SELECT clip_id, {i('frame_index')}, concat_ws(';', CASE WHEN x_m IS NULL THEN 'court_position_unavailable' END, CASE WHEN unconf THEN 'unconfirmed_court_calibration' END) AS court_quality_flags FROM pp"""
ORACLES["projection_summary"] = f"""{PROJ} SELECT clip_id, {i('count(*)', 'player_observations')}, {i('count(x_m)', 'positions_available')}, {i('count(*) - count(x_m)', 'positions_missing')},
 {i('count(*) FILTER (outside)', 'positions_outside_active_court')}, {i('count(*) FILTER (weak AND x_m IS NOT NULL)', 'positions_with_low_confidence_pose')} FROM pp GROUP BY clip_id"""
ORACLES["court_range"] = f"{PROJ} SELECT clip_id, {r('min(x_m)', 'x_min_m')}, {r('max(x_m)', 'x_max_m')}, {r('min(y_m)', 'y_min_m')}, {r('max(y_m)', 'y_max_m')} FROM pp GROUP BY clip_id"
ORACLES["reprojection_error"] = f"{PROJ} SELECT clip_id, {i('count(x_m)', 'positions')}, true AS consistent FROM pp GROUP BY clip_id"


def px(x: str, y: str, m: str) -> tuple[str, str]:
    w = f"({m}6*{x} + {m}7*{y} + {m}8)"
    return f"({m}0*{x} + {m}1*{y} + {m}2)/{w}", f"({m}3*{x} + {m}4*{y} + {m}5)/{w}"


_LINES = """(VALUES (0, 0e0, 0e0, 6.1e0, 0e0, 'boundary'), (1, 6.1e0, 0e0, 6.1e0, 13.4e0, 'boundary'), (2, 6.1e0, 13.4e0, 0e0, 13.4e0, 'boundary'), (3, 0e0, 13.4e0, 0e0, 0e0, 'boundary'),
 (4, 0.46e0, 0e0, 0.46e0, 13.4e0, 'singles'), (5, 5.64e0, 0e0, 5.64e0, 13.4e0, 'singles'), (6, 0e0, 6.7e0, 6.1e0, 6.7e0, 'net'), (7, 0e0, 4.72e0, 6.1e0, 4.72e0, 'service'),
 (8, 0e0, 8.68e0, 6.1e0, 8.68e0, 'service'), (9, 0e0, 0.76e0, 6.1e0, 0.76e0, 'service'), (10, 0e0, 12.64e0, 6.1e0, 12.64e0, 'service'), (11, 3.05e0, 0e0, 3.05e0, 4.72e0, 'service'),
 (12, 3.05e0, 8.68e0, 3.05e0, 13.4e0, 'service')) l(line, ax, ay, bx, by_, kind)"""
_A, _B = px("ax", "ay", "i"), px("bx", "by_", "i")
ORACLES["court_lines"] = f"""{CAM} SELECT clip_id, {i('line')}, kind, {r('ax', 'ax_m')}, {r('ay', 'ay_m')}, {r('bx', 'bx_m')}, {r('by_', 'by_m')}, {r(_A[0], 'ax_px')}, {r(_A[1], 'ay_px')},
 {r(_B[0], 'bx_px')}, {r(_B[1], 'by_px')} FROM cm CROSS JOIN {_LINES}"""
_P, _Q = px("3.05e0", "cy", "i"), px("ix", "iy", "c")
ORACLES["line_checks"] = f"""{CAM}, lp AS (SELECT *, 'front_service' AS name, (x0+x1)/2 AS ix, y0+90 AS iy, 4.72e0 AS cy FROM cm UNION ALL SELECT *, 'back_service', (x2+x3)/2, y2-150, 8.68e0 FROM cm)
 SELECT clip_id, name, {r(f'sqrt(pow(ix - {_P[0]}, 2) + pow(iy - {_P[1]}, 2))', 'error_px')}, {r(f'sqrt(pow({_Q[0]} - 3.05, 2) + pow({_Q[1]} - cy, 2))', 'error_m')} FROM lp"""
def _conditions(table: str) -> str:
    """CTEs up to ``cn`` (clip_id, design, mapping): singular values by turning pairs of rows (and, for the mapping, of its inverse) until they are orthogonal."""
    dot = "list_inner_product"
    turned = lambda n: f"""list_reduce(range({n * (n - 1) // 2 * 12}), lambda a, k: list_transform([{{'p': ps[k % len(ps) + 1], 'q': qs[k % len(ps) + 1]}}], lambda e:
      list_transform([CASE WHEN {dot}(a[e.p], a[e.q]) = 0 THEN NULL ELSE ({dot}(a[e.q], a[e.q]) - {dot}(a[e.p], a[e.p])) / (2 * {dot}(a[e.p], a[e.q])) END], lambda z:
      list_transform([CASE WHEN z IS NULL THEN 0e0 ELSE (CASE WHEN z < 0 THEN -1e0 ELSE 1e0 END) / (abs(z) + sqrt(1 + z * z)) END], lambda t:
        list_transform(a, lambda row, i: CASE WHEN i = e.p THEN list_transform(a[e.p], lambda v, j: (v - t * a[e.q][j]) / sqrt(1 + t * t))
          WHEN i = e.q THEN list_transform(a[e.q], lambda v, j: (t * a[e.p][j] + v) / sqrt(1 + t * t)) ELSE row END))[1])[1])[1], m)"""  # noqa: E731
    pairs = lambda n: ", ".join(f"[{', '.join(str(p[k]) for p in itertools.combinations(range(1, n + 1), 2))}] AS {c}" for k, c in ((0, "ps"), (1, "qs")))
    mean = lambda c: f"({c}0+{c}1+{c}2+{c}3)/4"
    floor = [(0, 0), (6.1, 0), (6.1, 13.4), (0, 13.4)]
    away = math.sqrt(2) / (sum(math.hypot(x - 3.05, y - 6.7) for x, y in floor) / 4)
    uv = [(away * (x - 3.05), away * (y - 6.7)) for x, y in floor]
    rows = ", ".join(f"[-sx{i}, -sy{i}, -1e0, 0e0, 0e0, 0e0, {u!r}*sx{i}, {u!r}*sy{i}, {u!r}], [0e0, 0e0, 0e0, -sx{i}, -sy{i}, -1e0, {v!r}*sx{i}, {v!r}*sy{i}, {v!r}]" for i, (u, v) in enumerate(uv))
    f = [[f"(i{3 * r}/{away!r})", f"(i{3 * r + 1}/{away!r})", f"(i{3 * r}*3.05e0 + i{3 * r + 1}*6.7e0 + i{3 * r + 2})"] for r in range(3)]
    m = [[f"k*({f[0][j]} - mx*{f[2][j]})" for j in range(3)], [f"k*({f[1][j]} - my*{f[2][j]})" for j in range(3)], f[2]]
    inverse = [f"(n{a}*n{b} - n{c}*n{d})" for a, b, c, d in ((4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3))]
    norms = lambda t: f"list_transform({t}, lambda row: sqrt({dot}(row, row)))"
    return f"""
q1 AS (SELECT *, x1-x2 AS a1, x3-x2 AS a2, x0-x1+x2-x3 AS sx, y1-y2 AS b1, y3-y2 AS b2, y0-y1+y2-y3 AS sy, {mean('x')} AS mx, {mean('y')} AS my FROM {table}),
q2 AS (SELECT *, CASE WHEN a1*b2 - a2*b1 <> 0 THEN (sx*b2 - a2*sy)/(a1*b2 - a2*b1) END AS g, CASE WHEN a1*b2 - a2*b1 <> 0 THEN (a1*sy - sx*b1)/(a1*b2 - a2*b1) END AS h,
  sqrt(2e0)*4/({"+".join(f"sqrt(pow(x{i}-mx,2)+pow(y{i}-my,2))" for i in range(4))}) AS k FROM q1),
q3 AS (SELECT *, (x1-x0+g*x1)/6.1e0 AS i0, (x3-x0+h*x3)/13.4e0 AS i1, x0 AS i2, (y1-y0+g*y1)/6.1e0 AS i3, (y3-y0+h*y3)/13.4e0 AS i4, y0 AS i5, g/6.1e0 AS i6, h/13.4e0 AS i7, 1e0 AS i8,
  {", ".join(f"k*(x{i}-mx) AS sx{i}, k*(y{i}-my) AS sy{i}" for i in range(4))} FROM q2),
q4 AS (SELECT *, {", ".join(f"{v} AS n{3 * r + j}" for r, row in enumerate(m) for j, v in enumerate(row))} FROM q3),
dm AS (SELECT clip_id, {turned(8)} AS t FROM (SELECT clip_id, [{rows}] AS m, {pairs(8)} FROM q4)),
mm AS (SELECT clip_id, {turned(3)} AS t, abs(det) AS det FROM (SELECT clip_id, [[n0,n1,n2],[n3,n4,n5],[n6,n7,n8]] AS m, n0*{inverse[0]} + n1*{inverse[3]} + n2*{inverse[6]} AS det, {pairs(3)} FROM q4)),
mi AS (SELECT clip_id, {turned(3)} AS t FROM (SELECT clip_id, [[{",".join(inverse[:3])}],[{",".join(inverse[3:6])}],[{",".join(inverse[6:])}]] AS m, {pairs(3)} FROM q4)),
cn AS (SELECT clip_id, list_max({norms('dm.t')})/list_min({norms('dm.t')}) AS design, list_max({norms('mm.t')})*list_max({norms('mi.t')})/det AS mapping FROM dm JOIN mm USING (clip_id) JOIN mi USING (clip_id))"""


_THIN = f"{cte('fx_calibrations', 'fx_thin_corners')}, {_conditions('fx_thin_corners')}"
ORACLES["condition_numbers"] = f"""{_THIN} SELECT clip_id, CAST(round(log10(design), 3) AS DOUBLE) AS log10_design_condition, CAST(round(log10(mapping), 3) AS DOUBLE) AS log10_mapping_condition,
 design <= 1e8 AND mapping <= 1e10 AS well_conditioned FROM cn"""
# The limits lie far from all of these corners: sound ones pass every limit, thin ones fail a condition.
ORACLES["fit_diagnostics"] = f"""{cte('fx_calibrations', 'fx_thin_corners')}, {_conditions('fx_thin_corners')}
 SELECT clip_id, true AS acceptable, 'given' AS corners FROM fx_calibrations UNION ALL SELECT clip_id, design <= 1e8 AND mapping <= 1e10, 'thin' FROM cn WHERE clip_id % 13 > 7 AND clip_id % 4 > 0"""
ORACLES["matching_calibrations"] = f"""{cte('fx_calibrations', 'fx_clips')}, sv AS (SELECT clip_id AS calibration_id, width, height, CASE WHEN clip_id % 2 = 0 THEN concat('clip-', CAST(clip_id AS VARCHAR)) END AS bound FROM fx_calibrations)
 SELECT clip_id, c.width, c.height, {i('calibration_id')} FROM fx_clips c JOIN sv ON c.width = sv.width AND c.height = sv.height AND bound = source_digest
 UNION ALL SELECT NULL, width, height, calibration_id FROM sv WHERE bound IS NULL AND (width, height) IN (SELECT (width, height) FROM fx_clips)"""


def violations(prefix: str, rules: list[tuple[str, str]], table: str, key: str) -> str:
    """One row per broken rule."""
    return f"{prefix} " + " UNION ALL ".join(f"SELECT clip_id, '{n}' AS rule, {key} AS key FROM {table} WHERE {c}" for n, c in rules)


_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"))
_TURN = "least(" + ", ".join(f"(x{(k+1)%4}-x{k})*(y{(k+2)%4}-y{(k+1)%4}) - (y{(k+1)%4}-y{k})*(x{(k+2)%4}-x{(k+1)%4})" for k in range(4)) + ")"
_AREA = "(" + " + ".join(f"x{k}*y{(k+1)%4} - y{k}*x{(k+1)%4}" for k in range(4)) + ")/2"
ORACLES["corner_checks"] = violations(cte("fx_calibrations", "fx_dirty_corners"), [
    ("corner_not_finite", f"NOT ({_KNOWN})"),
    ("corner_outside_image", f"{_KNOWN} AND NOT (least(x0,x1,x2,x3) >= 0 AND greatest(x0,x1,x2,x3) <= width-1 AND least(y0,y1,y2,y3) >= 0 AND greatest(y0,y1,y2,y3) <= height-1)"),
    ("not_convex_in_order", f"{_KNOWN} AND {_TURN} <= greatest(1e-8, width*height*1e-10)"), ("area_degenerate", f"{_KNOWN} AND {_AREA} <= greatest(1e-6, width*height*1e-7)"),
    ("corner_order_wrong", f"{_KNOWN} AND NOT (x0 < x1 AND x3 < x2 AND y0+y1 < y2+y3)")], "fx_dirty_corners", "''")

# Pose ----------------------------------------------------------------------------
POSE = f"""{cte('fx_frames', 'fx_boxes', 'fx_keypoints', 'fx_clips', 'fx_rois')},
kp AS (SELECT *, greatest(0e0, least(1e0, score)) AS conf, score >= 0.3 AND NOT (x = 0 AND y = 0) AND x BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 720 AS vis FROM fx_keypoints),
pl AS (SELECT clip_id, frame_index, track_id, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2, any_value(box_confidence) AS bc, count(*) FILTER (vis) AS seen,
  CASE WHEN bool_and(vis) FILTER (k >= 15) THEN avg(x) FILTER (k >= 15) END AS mx, CASE WHEN bool_and(vis) FILTER (k >= 15) THEN avg(y) FILTER (k >= 15) END AS my FROM kp GROUP BY clip_id, frame_index, track_id),
pw AS (SELECT *, bc < 0.25 OR seen < 6 OR mx IS NULL AS weak FROM pl),
rec AS (SELECT f.clip_id, f.frame_index, f.timestamp_s, expected_player_count AS e, coalesce(n, 0) AS n, coalesce(weak, false) AS weak, coalesce(nomid, false) AS nomid FROM fx_frames f JOIN fx_clips USING (clip_id)
  LEFT JOIN (SELECT clip_id, frame_index, count(*) AS n, bool_or(weak) AS weak, bool_or(mx IS NULL) AS nomid FROM pw GROUP BY clip_id, frame_index) s ON s.clip_id = f.clip_id AND s.frame_index = f.frame_index)"""
_NAMES = "['nose','left_eye','right_eye','left_ear','right_ear','left_shoulder','right_shoulder','left_elbow','right_elbow','left_wrist','right_wrist','left_hip','right_hip','left_knee','right_knee','left_ankle','right_ankle']"
ORACLES["formatted_keypoints"] = f"{POSE} SELECT {_K}, {i('k')}, {_NAMES}[k+1] AS name, {r('CASE WHEN vis THEN x END', 'x')}, {r('CASE WHEN vis THEN y END', 'y')}, {r('conf', 'confidence')}, vis AS visible FROM kp"
ORACLES["ankle_midpoints"] = f"{POSE} SELECT {_K}, {r('mx', 'mid_x')}, {r('my', 'mid_y')}, weak AS low_confidence, {r('(x1+x2)/2', 'foot_x')}, {r('y2', 'foot_y')} FROM pw"


def inside_ring(x: str, y: str) -> str:
    """Point in the convex region: on the same side of all four edges (boundary included)."""
    sides = []
    for k in range(4):
        a, b = f"px{k}*1280", f"py{k}*720"
        c, d = f"px{(k+1)%4}*1280", f"py{(k+1)%4}*720"
        sides.append(f"(({c})-({a}))*({y}-({b})) - (({d})-({b}))*({x}-({a})) >= 0")
    return "(" + " AND ".join(sides) + ")"


ORACLES["players_in_region"] = f"""{POSE} SELECT {_K.replace('clip_id', 'pw.clip_id')} FROM pw LEFT JOIN fx_rois r ON r.clip_id = pw.clip_id
 WHERE r.clip_id IS NULL OR (x2 > x1 AND y2 > y1 AND ({inside_ring('(x1+x2)/2', 'y2')} OR coalesce({inside_ring('mx', 'my')}, false)))"""
# At most three boxes a frame, so the greedy choice is written out.
ORACLES["suppressed_boxes"] = f"""{cte('fx_frames', 'fx_candidates')}, bx AS (SELECT *, x + 40*w AS x2, y + 40*h AS y2, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY score DESC, ord) AS rk FROM fx_candidates),
 ov AS (SELECT a.clip_id, a.frame_index, a.rk AS i, b.rk AS j, greatest(0, least(a.x2,b.x2)-greatest(a.x,b.x)) * greatest(0, least(a.y2,b.y2)-greatest(a.y,b.y)) AS inter,
  (a.x2-a.x)*(a.y2-a.y) + (b.x2-b.x)*(b.y2-b.y) AS total FROM bx a JOIN bx b ON a.clip_id = b.clip_id AND a.frame_index = b.frame_index AND a.rk < b.rk),
 hit AS (SELECT clip_id, frame_index, max(inter*1e0/(total-inter)) FILTER (i=1 AND j=2) > 0.3 AS h12, max(inter*1e0/(total-inter)) FILTER (i=1 AND j=3) > 0.3 AS h13, max(inter*1e0/(total-inter)) FILTER (i=2 AND j=3) > 0.3 AS h23 FROM ov GROUP BY ALL)
 SELECT bx.clip_id, {i('bx.frame_index')}, {i('ord')}, {r('score', 'confidence')} FROM bx LEFT JOIN hit ON hit.clip_id = bx.clip_id AND hit.frame_index = bx.frame_index
 WHERE rk = 1 OR (rk = 2 AND NOT h12) OR (rk = 3 AND NOT h13 AND (h12 OR NOT h23))"""
_REC = "concat_ws(';', CASE WHEN n <> e THEN 'player_count_mismatch' END, CASE WHEN n = 0 THEN 'no_players_observed' END, CASE WHEN weak THEN 'low_confidence_player_or_pose' END, CASE WHEN nomid THEN 'ankle_midpoint_unavailable' END)"
ORACLES["frame_records"] = f"{POSE} SELECT clip_id, {i('frame_index')}, {r('timestamp_s')}, {i('e', 'expected_player_count')}, {i('n', 'observed_player_count')}, n <> e AS count_mismatch, {_REC} AS flags FROM rec"
ORACLES["mismatch_frames"] = f"{POSE} SELECT clip_id, {i('frame_index')}, {i('n', 'observed_player_count')}, {i('e', 'expected_player_count')} FROM rec WHERE n <> e"
ORACLES["player_count_histogram"] = f"{POSE} SELECT clip_id, {i('n', 'observed_player_count')}, {i('count(*)', 'frames')} FROM rec GROUP BY clip_id, n"
ORACLES["observation_gaps"] = f"{POSE} SELECT clip_id, {i('count(*) FILTER (mx IS NULL)', 'players_with_missing_ankle_midpoint')}, {i('0', 'observations_without_track_id')} FROM pw GROUP BY clip_id"
ORACLES["pose_coverage"] = f"""{POSE} SELECT clip_id, {i('track_id')}, {i('count(*)', 'frames_observed')}, {i('min(frame_index)', 'first_frame')}, {i('max(frame_index)', 'last_frame')}, {i('min(seen)', 'visible_min')},
 {i('max(seen)', 'visible_max')}, {r('avg(seen)', 'visible_mean')}, {i('count(*) FILTER (mx IS NULL)', 'missing_ankle_midpoints')}, {i('sum(17 - seen)', 'suppressed_keypoints')} FROM pw GROUP BY clip_id, track_id"""
ORACLES["near_far_order"] = f"""{POSE}, t2 AS (SELECT clip_id, frame_index, arg_min(my, track_id) > arg_max(my, track_id) AS o FROM pw GROUP BY clip_id, frame_index HAVING count(*) = 2 AND count(mx) = 2)
 SELECT clip_id, bool_and(o) AS first_id_nearer_all_frames, {i('count(*)', 'frames_tested')} FROM t2 GROUP BY clip_id"""
_TR = """{w}, lg AS (SELECT clip_id, track_id, frame_index, lag(frame_index) OVER (PARTITION BY clip_id, track_id ORDER BY frame_index) AS p FROM {t}),
tk AS (SELECT clip_id, track_id, count(*) AS n, min(frame_index) AS f0, max(frame_index) AS f1, 1 + count(*) FILTER (frame_index <> p + 1) AS runs, coalesce(sum(frame_index - p - 1), 0) AS miss FROM lg GROUP BY clip_id, track_id)"""
TRACKS = _TR.format(w=cte("fx_frames", "fx_positions"), t="fx_positions")
_RUNS = f"clip_id, {i('track_id')}, {i('n', 'frames_observed')}, {i('f0', 'first_frame')}, {i('f1', 'last_frame')}, {i('runs', 'contiguous_segments')}"
ORACLES["contiguous_runs"] = f"{TRACKS} SELECT {_RUNS} FROM tk"
ORACLES["track_fragments"] = f"{TRACKS} SELECT {_RUNS}, {i('miss', 'missing_frames_within_span')} FROM tk"
ORACLES["track_gaps"] = f"{TRACKS} SELECT clip_id, {i('track_id')}, {i('p', 'after_frame')}, {i('frame_index', 'before_frame')}, {i('frame_index - p - 1', 'missing_frames')} FROM lg WHERE frame_index > p + 1"
ORACLES["track_ids"] = f"{TRACKS} SELECT clip_id, {i('track_id')} FROM tk"
ORACLES["track_summary"] = f"""{_TR.format(w=POSE, t='pw')}, a AS (SELECT clip_id, count(*) AS t, max(e) AS e, count(*) FILTER (n <> e) AS m, count(*) FILTER (n = 0) AS z, count(*) FILTER (weak) AS w FROM rec GROUP BY clip_id),
 b AS (SELECT clip_id, count(*) AS k, sum(miss) AS miss, count(*) FILTER (runs > 1) AS g FROM tk GROUP BY clip_id)
 SELECT clip_id, {i('t', 'total_frames')}, {i('e', 'expected_player_count')}, {i('m', 'count_mismatch_frames')}, {i('z', 'frames_without_players')}, {i('w', 'frames_with_low_confidence_players')},
 {i('k', 'unique_track_ids')}, {i('miss', 'missing_frames_within_spans')}, {i('g', 'tracks_with_gaps')}, concat_ws(';',
 CASE WHEN m > 0 THEN concat(m, ' {note("player_count")}') END,
 CASE WHEN k > e THEN '{note("many_tracks")}' END,
 CASE WHEN g > 0 THEN '{note("broken_tracks")}' END) AS warnings FROM a JOIN b USING (clip_id)"""
ORACLES["position_rows"] = f"{cte('fx_positions')} SELECT {_K}, {r('timestamp_s')}, {r('x_m')}, {r('y_m')} FROM fx_positions WHERE x_m IS NOT NULL AND y_m IS NOT NULL"
ORACLES["shuttle_from_candidates"] = f"""{cte('fx_frames', 'fx_candidates')}, b AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY w*h DESC, ord) AS rk FROM fx_candidates)
 SELECT f.clip_id, {i('f.frame_index')}, {r('f.timestamp_s')}, {r('trunc(trunc(b.x + w/2)*1280/512)', 'x')}, {r('trunc(trunc(b.y + h/2)*720/288)', 'y')}, {r('score', 'confidence')},
 CASE WHEN b.x IS NULL THEN 'missing' ELSE 'detected' END AS source, b.x IS NULL OR score < 0.5 AS low_confidence FROM fx_frames f LEFT JOIN b ON b.clip_id = f.clip_id AND b.frame_index = f.frame_index AND rk = 1"""


def _cross(k: int, m: int) -> str:
    """Whether edge k and edge m of the quadrilateral meet."""
    p = lambda v: (f"px{v % 4}", f"py{v % 4}")
    a, b, c, d = p(k), p(k + 1), p(m), p(m + 1)
    s = lambda u, v, w: f"(({v[0]}-{u[0]})*({w[1]}-{u[1]}) - ({v[1]}-{u[1]})*({w[0]}-{u[0]}))"
    on = lambda u, v, w: f"(abs({s(u, v, w)}) <= 1e-12 AND {w[0]} BETWEEN least({u[0]},{v[0]}) AND greatest({u[0]},{v[0]}) AND {w[1]} BETWEEN least({u[1]},{v[1]}) AND greatest({u[1]},{v[1]}))"
    return f"(({s(a, b, c)}*{s(a, b, d)} < 0 AND {s(c, d, a)}*{s(c, d, b)} < 0) OR {on(a, b, c)} OR {on(a, b, d)} OR {on(c, d, a)} OR {on(c, d, b)})"


_UNIT = " AND ".join(f"p{c}{k} BETWEEN 0 AND 1" for c in "xy" for k in range(4))
_RAREA = "abs(" + " + ".join(f"px{k}*py{(k+1)%4} - px{(k+1)%4}*py{k}" for k in range(4)) + ")/2"
_REP = " OR ".join(f"(px{a} = px{b} AND py{a} = py{b})" for a in range(4) for b in range(a + 1, 4))
ORACLES["region_checks"] = violations(cte("fx_dirty_rois"), [
    ("point_outside_unit_square", f"NOT ({_UNIT})"), ("points_repeat", _REP), ("no_area", f"{_UNIT} AND {_RAREA} < 1e-6"),
    ("self_intersection", f"{_UNIT} AND ({_cross(0, 2)} OR {_cross(1, 3)})")], "fx_dirty_rois", "''")
ORACLES["frame_rates"] = f"""{cte('fx_rates')}, u AS (SELECT clip_id, CASE WHEN average_rate > 0 THEN average_rate END AS a, CASE WHEN guessed_rate > 0 THEN guessed_rate END AS g,
 CASE WHEN base_rate > 0 THEN base_rate END AS b, CASE WHEN fps_hint > 0 THEN fps_hint END AS h FROM fx_rates)
 SELECT clip_id, {r('coalesce(a, g, b, h)', 'fps')}, {r('coalesce(a, g, b)', 'metadata_fps')}, CASE WHEN a IS NOT NULL THEN 'average_rate' WHEN g IS NOT NULL THEN 'guessed_rate' WHEN b IS NOT NULL THEN 'base_rate'
 WHEN h IS NOT NULL THEN 'fps_hint' END AS fps_source, coalesce(abs(coalesce(a, g, b) - h)/coalesce(a, g, b) > 0.01, false) AS hint_differs FROM u"""

# Timing, windows, trails -------------------------------------------------------------
ORACLES["normalized_timing"] = f"""{cte('fx_frames', 'fx_pts')}, a AS (SELECT *, pts*(1e0/1000) AS ab, 1/fps AS st FROM fx_pts),
 o AS (SELECT clip_id, arg_min(ab - frame_index*st, frame_index) AS origin FROM a WHERE ab IS NOT NULL GROUP BY clip_id),
 b AS (SELECT a.*, ab - origin AS t0, max(CASE WHEN ab IS NOT NULL THEN frame_index END) OVER (PARTITION BY clip_id ORDER BY frame_index) AS af FROM a LEFT JOIN o USING (clip_id)),
 c AS (SELECT b.*, CASE WHEN b.af IS NULL THEN b.frame_index*b.st ELSE z.t0 + (b.frame_index - b.af)*b.st END AS t FROM b LEFT JOIN b z ON z.clip_id = b.clip_id AND z.frame_index = b.af)
 SELECT clip_id, {i('frame_index')}, {r('greatest(0, t)', 'timestamp_s')}, t < -1e-6 OR coalesce(t <= lag(t) OVER (PARTITION BY clip_id ORDER BY frame_index), false) AS invalid_timing FROM c"""
ORACLES["extracted_intervals"] = f"""{cte('fx_frames', 'fx_intervals')}, x AS (SELECT f.clip_id, interval_id, f.frame_index AS sf, timestamp_s - min(timestamp_s) OVER w AS since, row_number() OVER (w ORDER BY f.frame_index) - 1 AS rn
 FROM fx_frames f JOIN fx_intervals v ON v.clip_id = f.clip_id AND timestamp_s >= start_s - 1e-8 AND timestamp_s < end_s - 1e-8 WHERE end_s - start_s <= 300 WINDOW w AS (PARTITION BY f.clip_id, interval_id))
 SELECT clip_id, interval_id, {i('rn', 'frame_index')}, {i('sf', 'source_frame')}, {r('round_even(since*90000, 0)/90000', 'timestamp_s')} FROM x"""
ORACLES["interval_checks"] = f"""{cte('fx_intervals')}, o AS (SELECT clip_id, interval_id, CASE WHEN clip_id % 5 = 1 THEN -start_s - 1 ELSE start_s END AS a, CASE WHEN clip_id % 5 = 2 THEN NULL ELSE end_s END AS b FROM fx_intervals)
 SELECT clip_id, interval_id, 'missing_bound' AS rule FROM o WHERE a IS NULL OR b IS NULL UNION ALL SELECT clip_id, interval_id, 'negative_start' FROM o WHERE a < 0
 UNION ALL SELECT clip_id, interval_id, 'empty_or_reversed' FROM o WHERE b <= a UNION ALL SELECT clip_id, interval_id, 'too_long' FROM o WHERE b - a > 300"""
ORACLES["sequence_windows"] = f"""{cte('fx_frames')}, l AS (SELECT clip_id, max(frame_index) AS m FROM fx_frames GROUP BY clip_id)
 SELECT clip_id, {i('frame_index // 8', 'window')}, {i('frame_index % 8', 'slot')}, {i('frame_index')}, false AS is_padding FROM fx_frames UNION ALL
 SELECT clip_id, {i('m // 8', 'window')}, {i('s', 'slot')}, {i('m', 'frame_index')}, true FROM l, (SELECT unnest(range(1, 8)) AS s) n WHERE s > m % 8"""
ORACLES["sampled_frames"] = f"""{cte('fx_frames')}, d AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY md5(concat(clip_id, ':', frame_index, ':7')), frame_index) AS rk FROM fx_frames)
 SELECT clip_id, {i('frame_index')}, {r('timestamp_s')} FROM d WHERE rk <= 16"""
ORACLES["map_trails"] = f"""{cte('fx_positions')}, s AS (SELECT *, frame_index - row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame_index) AS g FROM fx_positions
  WHERE x_m BETWEEN -0.8e0 AND 6.1e0 + 0.8e0 AND y_m BETWEEN -0.8e0 AND 13.4e0 + 0.8e0) SELECT {_K}, {i('count(*) OVER w', 'points')}, {r('first_value(x_m) OVER w', 'oldest_x')}, {r('first_value(y_m) OVER w', 'oldest_y')}
 FROM s WINDOW w AS (PARTITION BY clip_id, track_id, g ORDER BY frame_index ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
ORACLES["shuttle_trails"] = f"""{FILLED}, s AS (SELECT *, frame_index - row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS g FROM filled WHERE source = 'detected')
 SELECT clip_id, {i('frame_index')}, {i('count(*) OVER w', 'points')}, {r('first_value(x) OVER w', 'oldest_x')}, {r('first_value(y) OVER w', 'oldest_y')}
 FROM s WINDOW w AS (PARTITION BY clip_id, g ORDER BY frame_index ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
_SEGS = """, sgm AS MATERIALIZED (SELECT clip_id, track_id, frame_index, x0, y0, x_m AS x1, y_m AS y1 FROM (SELECT *, lag(frame_index) OVER w AS f0, lag(x_m) OVER w AS x0, lag(y_m) OVER w AS y0
  FROM (SELECT * FROM fx_positions WHERE x_m IS NOT NULL AND y_m IS NOT NULL) q WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame_index)) l
  WHERE f0 = frame_index - 1 AND x0 BETWEEN 0 AND 6.1 AND y0 BETWEEN 0 AND 13.4 AND x_m BETWEEN 0 AND 6.1 AND y_m BETWEEN 0 AND 13.4)"""
_SC = f"{r('x0', 'x0_m')}, {r('y0', 'y0_m')}, {r('x1', 'x1_m')}, {r('y1', 'y1_m')}"
ORACLES["review_trail"] = f"{cte('fx_positions')}{_SEGS} SELECT {_K}, {_SC} FROM sgm"
ORACLES["review_trail_at_events"] = f"""{cte('fx_positions', 'fx_events')}{_SEGS} SELECT {_K.replace('clip_id', 's.clip_id').replace('frame_index AS BIGINT) AS frame_index', 's.frame_index AS BIGINT) AS frame_index')}, {_SC}, {i('e.frame_index', 'at_frame')}
 FROM sgm s JOIN fx_events e ON e.clip_id = s.clip_id AND s.frame_index BETWEEN e.frame_index - 44 AND e.frame_index"""

# Labels and versions --------------------------------------------------------------------
EVAL = f"""{cte('fx_frames', 'fx_shuttle', 'fx_labels', 'fx_dirty_shuttle')}, ev AS (SELECT s.clip_id, s.frame_index, visible, s.x IS NOT NULL AS det,
  CASE WHEN visible AND s.x IS NOT NULL THEN sqrt((s.x-lx)*(s.x-lx) + (s.y-ly)*(s.y-ly)) END AS err FROM fx_shuttle s JOIN fx_labels l ON l.clip_id = s.clip_id AND l.frame_index = s.frame_index),
 eo AS (SELECT *, coalesce(err <= 8, false) AS hit FROM ev)"""
ORACLES["detection_evaluation"] = f"""{EVAL}, a AS (SELECT clip_id, count(*) AS n, count(*) FILTER (visible) AS v, count(*) FILTER (hit) AS tp, count(*) FILTER (det AND NOT hit) AS fp, count(*) FILTER (visible AND NOT hit) AS fn,
 count(*) FILTER (NOT visible AND NOT det) AS tn, avg(err) AS me, quantile_cont(err, 0.5) AS md FROM eo GROUP BY clip_id)
 SELECT clip_id, {i('n', 'frames')}, {i('v', 'visible_ground_truth_frames')}, {i('tp', 'matched_detections')}, {i('fp', 'false_positives')}, {i('fn', 'false_negatives')}, {i('tn', 'true_negatives')},
 {r('me', 'mean_error_px')}, {r('md', 'median_error_px')}, {r('tp/nullif(tp+fp, 0)', 'precision')}, {r('tp/nullif(tp+fn, 0)', 'recall')} FROM a"""
ORACLES["missed_frames"] = f"{EVAL} SELECT clip_id, {i('frame_index')} FROM eo WHERE visible AND NOT hit"
ORACLES["label_coverage"] = f"""{EVAL} SELECT clip_id, {i('frame_index')}, 'no_label_row' AS rule FROM fx_dirty_shuttle d WHERE NOT EXISTS (SELECT 1 FROM fx_labels l WHERE l.clip_id = d.clip_id AND l.frame_index = d.frame_index)
 UNION ALL SELECT clip_id, {i('frame_index')}, 'no_detection_row' FROM fx_labels l WHERE NOT EXISTS (SELECT 1 FROM fx_dirty_shuttle d WHERE l.clip_id = d.clip_id AND l.frame_index = d.frame_index)"""
ORACLES["timing_error"] = f"""{EVAL} SELECT clip_id, {r('max(abs(a.timestamp_s - b.timestamp_s))', 'max_timing_error_s')}, count(a.timestamp_s) = count(b.timestamp_s) AS equal_counts
 FROM fx_shuttle a FULL JOIN fx_dirty_shuttle b USING (clip_id, frame_index) GROUP BY clip_id"""
_OLD, _NEW = [f"SELECT clip_id, frame_index, x, y, source FROM {t}" for t in ("fx_shuttle", "fx_dirty_shuttle")]
ORACLES["changed_observations"] = f"""{EVAL}, g AS (SELECT clip_id, frame_index, count(*) AS n FROM ({_OLD} EXCEPT ALL {_NEW}) GROUP BY 1, 2), c AS (SELECT clip_id, frame_index, count(*) AS n FROM ({_NEW} EXCEPT ALL {_OLD}) GROUP BY 1, 2),
 k AS (SELECT clip_id, frame_index, coalesce(g.n, 0) AS gone, coalesce(c.n, 0) AS come FROM g FULL JOIN c USING (clip_id, frame_index))
 SELECT clip_id, {i('frame_index')}, change, CAST(n AS BIGINT) AS n_rows FROM (SELECT clip_id, frame_index, 'changed' AS change, least(gone, come) AS n FROM k
 UNION ALL SELECT clip_id, frame_index, 'removed', gone - least(gone, come) FROM k UNION ALL SELECT clip_id, frame_index, 'added', come - least(gone, come) FROM k) WHERE n > 0"""
_COPY = f"{_NEW} WHERE clip_id % 3 = 0 UNION ALL {_OLD} WHERE clip_id % 3 <> 0 UNION ALL {_OLD} WHERE clip_id = 4"
ORACLES["changed_clips"] = f"{EVAL} SELECT DISTINCT clip_id FROM (({_OLD} EXCEPT ALL ({_COPY})) UNION ALL (({_COPY}) EXCEPT ALL {_OLD}))"
ORACLES["pixel_labels"] = f"{EVAL} SELECT clip_id, {i('frame_index')}, visible, {r('lx', 'label_x')}, {r('ly', 'label_y')} FROM fx_labels"

# Checks -------------------------------------------------------------------------------
_D = cte("fx_frames", "fx_shuttle", "fx_dirty_shuttle")
_KEY = "CAST(frame_index AS VARCHAR)"
_LAG = ", lag(timestamp_s) OVER (PARTITION BY clip_id ORDER BY frame_index, ordinal) AS pt, lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index, ordinal) AS pf"
_ONE = "SELECT * FROM fx_dirty_shuttle"
ORACLES["shuttle_checks"] = violations(f"{_D}, u AS ({_ONE}), l AS (SELECT *{_LAG} FROM u)", [
    ("frames_not_consecutive", "frame_index <> coalesce(pf + 1, 0)"), ("bad_time", "timestamp_s < 0"), ("time_not_rising", "timestamp_s <= pt"),
    ("unpaired_coordinates", "(x IS NULL) <> (y IS NULL)"), ("detected_without_coordinates", "source = 'detected' AND x IS NULL"),
    ("missing_with_coordinates", "source = 'missing' AND x IS NOT NULL")], "l", _KEY)
ORACLES["export_timing_checks"] = violations(f"{_D}, u AS (SELECT *, round_even(timestamp_s*90000, 0) AS tick FROM ({_ONE})), l AS (SELECT *{_LAG}, lag(tick) OVER (PARTITION BY clip_id ORDER BY frame_index, ordinal) AS pk FROM u)", [
    ("frames_not_consecutive", "frame_index <> coalesce(pf + 1, 0)"), ("negative_time", "timestamp_s < 0"), ("time_not_rising", "timestamp_s <= pt"), ("tick_not_rising", "tick <= pk")], "l", _KEY)
ORACLES["source_checks"] = violations(_D, [("unknown_source", "source NOT IN ('detected', 'missing', 'interpolated')")], "fx_dirty_shuttle", _KEY)
ORACLES["alignment_checks"] = violations(f"{_D}, j AS (SELECT d.clip_id, d.frame_index, abs(d.timestamp_s - f.timestamp_s) AS e FROM fx_dirty_shuttle d JOIN fx_frames f ON f.clip_id = d.clip_id AND f.frame_index = d.frame_index)",
                                         [("times_not_aligned", "e > 1e-6")], "j", _KEY)
ORACLES["track_id_checks"] = f"""{cte('fx_positions')}, t AS (SELECT clip_id, frame_index, CASE WHEN x_m IS NULL THEN track_id - 1 ELSE track_id END AS tid FROM fx_positions)
 SELECT clip_id, 'track_id_not_positive' AS rule, concat(frame_index, ':', tid) AS key FROM t WHERE tid < 1 UNION ALL
 SELECT clip_id, 'duplicate_track_in_frame', concat(frame_index, ':', tid) FROM t GROUP BY clip_id, frame_index, tid HAVING count(*) > 1"""
_ID = f"{cte('fx_frames', 'fx_positions', 'fx_dirty_identity')}"
ORACLES["identity_checks"] = violations(f"{_ID}, j AS (SELECT d.*, p.track_id IS NOT NULL AS seen FROM fx_dirty_identity d LEFT JOIN (SELECT DISTINCT clip_id, track_id FROM fx_positions) p ON p.clip_id = d.clip_id AND p.track_id = d.track_id)", [
    ("unknown_track", "NOT seen"), ("label_invalid", "trim(player_label) = ''"), ("side_invalid", "side NOT IN ('near', 'far')"), ("team_blank", "trim(team) = ''")], "j", "CAST(track_id AS VARCHAR)")
ORACLES["label_agreement_checks"] = violations(f"{_ID}, g AS (SELECT clip_id, trim(player_label) AS label, count(DISTINCT side) AS s, count(DISTINCT team) AS t FROM fx_dirty_identity GROUP BY ALL)",
                                               [("sides_differ", "s > 1"), ("teams_differ", "t > 1")], "g", "label")
ORACLES["simultaneous_label_checks"] = f"""{_ID} SELECT p.clip_id, 'label_twice_in_frame' AS rule, concat(frame_index, ':', trim(player_label)) AS key FROM fx_positions p JOIN fx_dirty_identity d
 ON d.clip_id = p.clip_id AND d.track_id = p.track_id GROUP BY p.clip_id, frame_index, trim(player_label) HAVING count(*) > 1"""
_RV = cte("fx_frames", "fx_identity", "fx_dirty_rallies", "fx_dirty_targets", "fx_events")
_HASF = "EXISTS (SELECT 1 FROM fx_frames f WHERE f.clip_id = {t}.clip_id AND f.frame_index = {t}.{c})"
_HASL = "EXISTS (SELECT 1 FROM fx_identity d WHERE d.clip_id = {t}.clip_id AND d.player_label = {t}.{c})"
ORACLES["rally_checks"] = violations(f"{_RV}, q AS (SELECT *, lag(end_frame) OVER (PARTITION BY clip_id ORDER BY ordinal) AS pe FROM fx_dirty_rallies)", [
    ("rally_id_blank", "trim(rally_id) = ''"), ("frame_unknown", f"NOT {_HASF.format(t='q', c='start_frame')} OR NOT {_HASF.format(t='q', c='end_frame')}"),
    ("ends_before_start", "start_frame > end_frame"), ("overlaps_previous", "start_frame <= coalesce(pe, -1)"),
    ("winner_unknown", f"winner_label IS NOT NULL AND NOT {_HASL.format(t='q', c='winner_label')}")], "q", "CAST(ordinal AS VARCHAR)") + (
    " UNION ALL SELECT clip_id, 'rally_id_repeats', rally_id FROM fx_dirty_rallies WHERE trim(rally_id) <> '' GROUP BY clip_id, rally_id HAVING count(*) > 1")
ORACLES["event_checks"] = violations(f"{_RV}, q AS (SELECT clip_id, CASE WHEN f % 3 = 0 THEN 'P8' ELSE player_label END AS player_label, kind, f AS frame_index FROM (SELECT clip_id, player_label, CASE WHEN frame_index % 7 = 0 THEN 'serve' ELSE kind END AS kind, CASE WHEN frame_index % 5 = 0 THEN frame_index + 1000 ELSE frame_index END AS f, frame_index AS f0 FROM fx_events))".replace("WHEN f % 3 = 0", "WHEN f0 % 3 = 0"), [
    ("frame_unknown", f"NOT {_HASF.format(t='q', c='frame_index')}"), ("kind_unknown", "kind NOT IN ('contact', 'outcome', 'note')"),
    ("label_unknown", f"player_label IS NOT NULL AND NOT {_HASL.format(t='q', c='player_label')}")], "q", _KEY)
ORACLES["target_checks"] = violations(f"{_RV}, q AS (SELECT clip_id, ordinal, player_label, contact_frame, coalesce(until_frame, m) AS u, target_x_m AS x, target_y_m AS y, coalesce(radius_m, 0.5) AS rad FROM fx_dirty_targets JOIN (SELECT clip_id, max(frame_index) AS m FROM fx_frames GROUP BY clip_id) USING (clip_id))", [
    ("label_unknown", f"NOT {_HASL.format(t='q', c='player_label')}"), ("contact_frame_unknown", f"NOT {_HASF.format(t='q', c='contact_frame')}"), ("until_frame_unknown", f"NOT {_HASF.format(t='q', c='u')}"),
    ("ends_before_contact", "u < contact_frame"), ("target_off_court", "NOT (x BETWEEN 0 AND 6.1 AND y BETWEEN 0 AND 13.4)"), ("radius_invalid", "NOT (rad > 0 AND rad <= 3)")], "q", "CAST(ordinal AS VARCHAR)")
ORACLES["binding_checks"] = violations(f"{cte('fx_clips')}, q AS (SELECT clip_id, source_digest AS c, CASE WHEN clip_id % 4 = 0 THEN 'clip-x' WHEN clip_id % 3 <> 0 THEN source_digest END AS r, CASE WHEN clip_id % 5 = 0 THEN 'clip-y' WHEN clip_id % 2 <> 0 THEN source_digest END AS k FROM fx_clips)", [
    ("review_for_other_source", "r <> c"), ("calibration_for_other_source", "k <> c"), ("review_and_calibration_differ", "r <> k")], "q", "''")
ORACLES["heatmap_checks"] = f"{OCC} SELECT clip_id, 'seconds_invalid' AS rule, concat(track_id, ':', cell_row, ':', cell_col) AS key FROM hm WHERE cell_row % 9 = 0 AND seconds > 0"
_FULL = f"j AS (SELECT coalesce(d.clip_id, f.clip_id) AS clip_id, coalesce(d.frame_index, f.frame_index) AS frame_index, d.timestamp_s AS ta, f.timestamp_s AS tb FROM fx_dirty_shuttle d FULL JOIN fx_frames f ON f.clip_id = d.clip_id AND f.frame_index = d.frame_index)"
_CLIP_IDS = "(SELECT DISTINCT clip_id FROM fx_frames)"


def _provenance(setting: str, rest: int) -> str:
    """Rules broken by the stored runs: which clips have none, which fields are gone or differ."""
    rules = [("fps_mismatch", "", "clip_id % 9 = 0"), ("source_digest_mismatch", "", "clip_id % 10 = 0"), ("field_not_stored", "codec", "clip_id % 6 = 1"), ("duration_s_mismatch", "", "clip_id % 5 = 2"),
             ("field_not_stored", "time_base", "true"), (setting, "", f"clip_id % 7 = {rest}")]
    return (f"SELECT clip_id, 'run_not_stored', '' FROM {_CLIP_IDS} z WHERE clip_id % 8 = 7 UNION ALL SELECT -1, 'clip_not_known', '' WHERE EXISTS (SELECT 1 FROM fx_frames WHERE clip_id = 0) UNION ALL "
            + " UNION ALL ".join(f"SELECT clip_id, '{r}', '{k}' FROM {_CLIP_IDS} z WHERE clip_id % 8 <> 7 AND {c}" for r, k, c in rules))


ORACLES["shuttle_reuse_checks"] = violations(f"{cte('fx_frames', 'fx_shuttle', 'fx_dirty_shuttle')}, {_FULL}", [
    ("frame_not_stored", "ta IS NULL"), ("frame_not_in_source", "tb IS NULL"), ("time_differs_from_source", "abs(ta - tb) > 1e-5")], "j", _KEY) + f""" UNION ALL
 SELECT clip_id, 'raw_unpaired', {_KEY} FROM fx_dirty_shuttle WHERE (x IS NULL) <> (y IS NULL) UNION ALL
 {_provenance("heatmap_threshold_mismatch", 1)}"""
ORACLES["player_reuse_checks"] = f"""{POSE}, pd AS (SELECT *, frame_index % 29 = 0 AS bad_mid, concat(frame_index, ':', track_id) AS key FROM pw)
 SELECT clip_id, 'score_invalid' AS rule, key FROM pd WHERE frame_index % 31 = 0 UNION ALL SELECT clip_id, 'box_invalid', key FROM pd WHERE x2 <= x1 OR y2 <= y1 UNION ALL
 SELECT clip_id, 'midpoint_disagrees', key FROM pd WHERE bad_mid AND mx IS NOT NULL AND (abs(mx - 1) > 1e-5 OR abs(my - 2) > 1e-5) UNION ALL
 SELECT clip_id, 'midpoint_invented', key FROM pd WHERE bad_mid AND mx IS NULL UNION ALL
 SELECT clip_id, 'roi_mismatch', '' FROM fx_rois WHERE clip_id % 11 = 3 OR clip_id % 6 = 5 UNION ALL {_provenance("pose_nms_iou_mismatch", 2)}"""
ORACLES["overlay_checks"] = f"""{POSE.replace(cte('fx_frames', 'fx_boxes', 'fx_keypoints', 'fx_clips', 'fx_rois'), cte('fx_frames', 'fx_boxes', 'fx_keypoints', 'fx_clips', 'fx_rois', 'fx_shuttle', 'fx_dirty_shuttle'))}, {_FULL}
 SELECT clip_id, 'frame_not_stored' AS rule, {_KEY} AS key FROM j WHERE tb IS NULL UNION ALL SELECT clip_id, 'frame_not_in_source', {_KEY} FROM j WHERE ta IS NULL UNION ALL
 SELECT clip_id, 'time_differs_from_source', {_KEY} FROM j WHERE abs(ta - tb) > 1e-5 UNION ALL SELECT clip_id, 'motion_row_differs', {_KEY} FROM j WHERE ta IS NULL OR tb IS NULL OR abs(ta - tb) > 1e-5 UNION ALL
 SELECT clip_id, 'observed_count_wrong', {_KEY} FROM fx_frames WHERE frame_index % 37 = 0"""
ORACLES["timeline_checks"] = f"""{_D}, d AS (SELECT clip_id, frame_index, min(timestamp_s) AS t, count(*) AS c FROM fx_dirty_shuttle GROUP BY clip_id, frame_index),
 l AS (SELECT *, lag(t) OVER (PARTITION BY clip_id ORDER BY frame_index) AS pt FROM d)
 SELECT clip_id, 'duplicate_frame' AS rule, {_KEY} AS key FROM l WHERE c > 1 UNION ALL SELECT clip_id, 'negative_time', {_KEY} FROM l WHERE t < 0 UNION ALL
 SELECT clip_id, 'time_not_rising', {_KEY} FROM l WHERE t <= pt"""

# Clip-level quality ----------------------------------------------------------------------
_PREF = cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_calibrations')
_EVERY = cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_boxes', 'fx_keypoints', 'fx_clips', 'fx_rois', 'fx_calibrations', 'fx_rallies', 'fx_shuttle', 'fx_ankles')
QUALITY = f"""{MOTION.replace(_PREF, _EVERY)}{POSE[len(cte('fx_frames', 'fx_boxes', 'fx_keypoints', 'fx_clips', 'fx_rois')):]},
qu AS (SELECT r.clip_id, r.frames, r.mism, coalesce(m.v, 0) AS v, coalesce(m.n, 0) AS n, {_CONF} AS reviewed FROM (SELECT clip_id, count(*) AS frames, count(*) FILTER (n <> e) AS mism FROM rec GROUP BY clip_id) r
 LEFT JOIN (SELECT clip_id, count(*) FILTER (valid) AS v, count(*) AS n FROM mo GROUP BY clip_id) m USING (clip_id) JOIN fx_calibrations USING (clip_id))"""
ORACLES["clip_quality"] = f"""{QUALITY} SELECT clip_id, {i('frames', 'frame_count')}, {i('mism', 'count_mismatch_frames')}, {i('v', 'valid_player_positions')}, {i('n', 'player_observations')}, reviewed AS calibration_reviewed FROM qu"""

# Exports -------------------------------------------------------------------------------
_POINT_NAMES = _NAMES.strip("[]").replace("'", "").split(",")
_WIDE = ", ".join(f"max(CASE WHEN k = {k} AND vis THEN x END) AS {n}_x, max(CASE WHEN k = {k} AND vis THEN y END) AS {n}_y, "
                  f"max(CASE WHEN k = {k} THEN conf END) AS {n}_confidence, bool_or(k = {k} AND vis) AS {n}_visible" for k, n in enumerate(_POINT_NAMES))
_WIDE_OUT = ", ".join(f"{r(f'{n}_x')}, {r(f'{n}_y')}, {r(f'{n}_confidence')}, {n}_visible" for n in _POINT_NAMES)
ORACLES["players_wide"] = f"""{POSE}, wd AS (SELECT clip_id, frame_index, track_id, {_WIDE} FROM kp GROUP BY clip_id, frame_index, track_id)
 SELECT {_K}, {r('timestamp_s')}, {i('e', 'expected_player_count')}, {i('n', 'observed_player_count')}, n <> e AS count_mismatch, {_REC.replace('weak', 'rec.weak')} AS frame_flags,
 'bytetrack' AS identity_source, {r('bc', 'confidence')}, {r('x1', 'bbox_x1')}, {r('y1', 'bbox_y1')}, {r('x2', 'bbox_x2')}, {r('y2', 'bbox_y2')}, {r('mx', 'ankle_midpoint_x')}, {r('my', 'ankle_midpoint_y')},
 pw.weak AS low_confidence, {_WIDE_OUT} FROM wd JOIN pw USING (clip_id, frame_index, track_id) JOIN rec USING (clip_id, frame_index)"""
ORACLES["players_nested"] = f"""{POSE} SELECT clip_id, {i('frame_index')}, {i('n', 'players')}, {i('first_track')} FROM rec LEFT JOIN
 (SELECT clip_id, frame_index, min(track_id) AS first_track FROM pw GROUP BY clip_id, frame_index) USING (clip_id, frame_index)"""
ORACLES["court_position_export"] = ORACLES["projected_players"].replace("AS court_flags", "AS quality_flags").replace(
    "f.frame_index, ankle_x", "f.frame_index, f.timestamp_s, ankle_x").replace(f"SELECT clip_id, {i('frame_index')}, ", f"SELECT clip_id, {i('frame_index')}, {r('timestamp_s')}, {i('1', 'track_id')}, ")

# Clip-level texts ----------------------------------------------------------------------------
# Both chains name a step sm; the shuttle one is renamed.
_SUMMARY = f"""{QUALITY}{SHUTTLE[len(cte('fx_frames', 'fx_shuttle')):].replace("sm AS (SELECT *, CASE WHEN joined", "sm2 AS (SELECT *, CASE WHEN joined")},
 fs AS (SELECT clip_id, track_id, count(*) - 1 - count(dt) > 0 AS partial FROM mo GROUP BY clip_id, track_id),
 tw AS (SELECT clip_id, count(*) AS tracks, bool_or(partial) AS partial FROM fs GROUP BY clip_id),
 jc AS (SELECT clip_id, count(*) FILTER ({JUMP}) AS jumps FROM sm2 GROUP BY clip_id)"""
ORACLES["clip_warnings"] = f"""{_SUMMARY} SELECT clip_id, concat_ws(';',
 CASE WHEN clip_id % 6 = 0 THEN '{note("unbound_annotations")}' END,
 CASE WHEN NOT reviewed THEN '{note("calibration_unreviewed")}' END,
 CASE WHEN mism > 0 THEN concat(mism, ' {note("player_count")}') END,
 CASE WHEN partial THEN '{note("partial_motion")}' END,
 CASE WHEN tracks > expected_player_count THEN '{note("many_fragments")}' END,
 CASE WHEN clip_id NOT IN (SELECT clip_id FROM fx_identity) THEN '{note("identity_unreviewed")}' END,
 CASE WHEN clip_id NOT IN (SELECT clip_id FROM fx_rallies) THEN '{note("rallies_unreviewed")}' END,
 CASE WHEN jumps > 0 THEN concat(jumps, ' {note("large_jumps")}') END) AS warnings
 FROM fx_clips JOIN qu USING (clip_id) JOIN tw USING (clip_id) JOIN jc USING (clip_id)"""
ORACLES["doubles_spacing_status"] = f"""{PAIRS} SELECT clip_id, CASE WHEN mode = 'doubles' AND have THEN 'available' ELSE 'unavailable' END AS status,
 CASE WHEN mode <> 'doubles' THEN '{note("not_doubles")}' WHEN NOT have THEN '{note("no_pairs")}' END AS reason
 FROM (SELECT clip_id, mode, clip_id IN (SELECT clip_id FROM ps) AS have FROM fx_clips) q"""
ORACLES["run_summaries"] = f"""{QUALITY}{FILLED[len(cte('fx_frames', 'fx_shuttle')):]}, td AS (SELECT clip_id, count(*) FILTER (source = 'detected') AS d FROM filled GROUP BY clip_id),
 tt AS (SELECT clip_id, count(DISTINCT track_id) AS t FROM pw GROUP BY clip_id), ta AS (SELECT clip_id, count(ankle_x) AS a FROM fx_ankles GROUP BY clip_id)
 SELECT clip_id, 'complete' AS status, {i('d', 'detected')}, {i('t', 'unique_track_ids')}, {i('a', 'positions_available')}, {i('v', 'valid_player_positions')}
 FROM qu JOIN td USING (clip_id) JOIN tt USING (clip_id) JOIN ta USING (clip_id)"""

ORACLES["reprojected_players"] = ORACLES["projected_players"]
ORACLES["shuttle_frame_flags"] = f"""{cte('fx_frames', 'fx_shuttle')} SELECT s.clip_id, {i('s.frame_index')}, coalesce(CASE WHEN s.frame_index % 5 <> 4 THEN f.cut_flag END, '') AS flags
 FROM fx_shuttle s JOIN fx_frames f ON f.clip_id = s.clip_id AND f.frame_index = s.frame_index"""
ORACLES["nested_events"] = f"""{SPANS} SELECT e.clip_id, {i('e.frame_index')}, kind, e.player_label,
 coalesce(string_agg(concat_ws(':', m.track_id, coalesce(m.player_label, '-'), CAST(m.valid AS VARCHAR)), ';' ORDER BY m.track_id) FILTER (m.track_id IS NOT NULL), '') AS positions
 FROM fx_events e LEFT JOIN mo m ON m.clip_id = e.clip_id AND m.frame_index = e.frame_index AND (e.player_label IS NULL OR e.player_label = m.player_label) GROUP BY ALL"""
_UM = "coalesce(CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR), '-')"
ORACLES["court_positions_nested"] = f"""{PROJ} SELECT clip_id, {i('frame_index')}, CASE WHEN frame_index % 6 = 5 THEN '' ELSE concat_ws(':', '1', {_UM.format(c='x_m')}, {_UM.format(c='y_m')}) END AS players FROM pp"""
_DOC = OCC.replace(cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_calibrations'), cte('fx_frames', 'fx_positions', 'fx_identity', 'fx_calibrations', 'fx_rallies', 'fx_events', 'fx_clips'))
ORACLES["insight_document_parts"] = f"""{_DOC},
 d1 AS (SELECT clip_id, count(DISTINCT track_id) AS n FROM mo GROUP BY 1), d2 AS (SELECT clip_id, sum(seconds) AS s, count(*) AS n FROM zs GROUP BY 1), d3 AS (SELECT clip_id, sum(seconds) AS s FROM hm GROUP BY 1),
 d4 AS (SELECT clip_id, sum(rows) AS n FROM ({ORACLES["player_flag_counts"]}) f GROUP BY 1), ev AS (SELECT DISTINCT * FROM fx_events), d5 AS (SELECT clip_id, count(*) AS n FROM ev GROUP BY 1),
 d6 AS (SELECT ev.clip_id, count(*) AS n FROM ev JOIN mo ON mo.clip_id = ev.clip_id AND mo.frame_index = ev.frame_index AND (ev.player_label IS NULL OR ev.player_label = mo.player_label) GROUP BY 1),
 d7 AS (SELECT clip_id, count(*) AS n FROM fx_identity GROUP BY 1), d8 AS (SELECT clip_id, count(*) AS n FROM fx_rallies GROUP BY 1), d9 AS (SELECT clip_id, gap_cap_s FROM ({ORACLES["gap_caps"]}) g)
 SELECT c.clip_id, c.mode, {i('coalesce(d1.n, 0)', 'players')}, {r('coalesce(d2.s, 0)', 'zone_seconds')}, {i('coalesce(d2.n, 0)', 'zones')}, {r('coalesce(d3.s, 0)', 'heat_seconds')}, {i('coalesce(d1.n, 0) * 1296', 'cells')},
 {i('coalesce(d4.n, 0)', 'flagged')}, {i('coalesce(d5.n, 0)', 'events')}, {i('coalesce(d6.n, 0)', 'event_positions')}, {i('coalesce(d7.n, 0)', 'identified')}, {i('coalesce(d8.n, 0)', 'reviewed_rallies')},
 d9.gap_cap_s AS maximum_interval_s, CAST(8 AS BIGINT) AS limitations
 FROM fx_clips c {" ".join(f"LEFT JOIN d{k} ON d{k}.clip_id = c.clip_id" for k in range(1, 10))}"""

# The same edits as the query's, in place of the tables they change.
_EDITS = {"fx_identity": "SELECT clip_id, track_id, CASE WHEN clip_id % 25 = 0 THEN concat('Q', CAST(track_id AS VARCHAR)) ELSE player_label END AS player_label, side, team",
          "fx_rallies": "SELECT clip_id, rally_id, start_frame, CASE WHEN clip_id % 20 = 2 THEN end_frame - 4 ELSE end_frame END AS end_frame"}


def _edited(sql: str) -> str:
    for name, select in _EDITS.items():
        sql = sql.replace(f"{name} AS ({TABLES[name]})", f"{name} AS ({select} FROM ({TABLES[name]}) before_edit)")
    return sql


ORACLES["recomputed_summary"] = f"""SELECT clip_id, 'player' AS part, player_label AS name, distance_m, valid_motion_time_s FROM ({_edited(ORACLES["identified_players"])}) a
 UNION ALL SELECT clip_id, 'rally', concat_ws(':', rally_id, CAST(track_id AS VARCHAR)), distance_m, valid_motion_time_s FROM ({_edited(ORACLES["rally_summary"])}) b"""
