"""Fixed measurement policy.

The numbers and word lists below are fixed values of the measurement
definition; results are only comparable between runs that share them.
"""
from __future__ import annotations

from dataclasses import dataclass

# Court, metres. Origin: far-left outer corner, x across, y towards the near baseline.
COURT_WIDTH = 6.1
COURT_LENGTH = 13.4
SINGLES_WIDTH = 5.18
SINGLES_MARGIN = (COURT_WIDTH - SINGLES_WIDTH) / 2
SERVICE_FROM_NET = 1.98
DOUBLES_SERVICE_FROM_BASELINE = 0.76
CORNER_ORDER = ("far_left", "far_right", "near_right", "near_left")

# Fixed order of the seventeen pose points.
KEYPOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear",
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle",
)

# Flags that mark a change of view, and those that make a floor position unusable.
CUT_FLAGS = ("camera_cut", "scene_cut", "cut", "camera_motion", "calibration_invalid")
INVALID_POSITION_FLAGS = CUT_FLAGS + (
    "low_confidence_pose", "unconfirmed_court_calibration",
    "court_projection_unavailable", "ankle_midpoint_unavailable",
    "player_selection_unverified",
)
IMPLAUSIBLE_FLAGS = ("implausible_position_jump", "implausible_smoothed_speed")
SHUTTLE_SOURCES = ("detected", "missing", "interpolated")
EVENT_KINDS = ("contact", "outcome", "note")
MEDIA_SUFFIXES = ("mp4", "mov", "mkv", "avi")

# Ticks of the export clock.
TICKS_PER_SECOND = 90000


@dataclass(frozen=True)
class Policy:
    """Thresholds used by the motion measures."""

    smoothing_half_window_s: float = 0.10
    window_slack_s: float = 1e-12
    max_player_speed_m_s: float = 12.0
    min_shuttle_confidence: float = 0.5
    stationary_extent_m: float = 0.08
    min_gap_cap_s: float = 0.25
    gap_cap_multiplier: float = 3.0
    heatmap_rows: int = 54
    heatmap_cols: int = 24
    floor_margin_m: float = 1.0
    jump_fraction_of_diagonal: float = 0.10
    max_fill_frames: int = 2
    keypoint_threshold: float = 0.3
    player_confidence: float = 0.25
    min_visible_keypoints: int = 6
    court_tolerance_m: float = 1e-9


@dataclass(frozen=True)
class Layout:
    """How ordered data is cut into blocks; affects speed, never results."""

    block_s: float = 600.0
    block_frames: int = 32768


POLICY = Policy()
LAYOUT = Layout()


#: Notes that reports and summaries give, by a stable code; the wording is ours and may change.
NOTES = {
    "unbound_annotations": "annotations are not tied to this recording",
    "calibration_unreviewed": "no reviewed calibration, so no measures in metres",
    "player_count": "frames with another number of players than expected",
    "partial_motion": "motion is incomplete, some intervals are left out",
    "many_fragments": "more fragments than athletes",
    "identity_unreviewed": "fragments are not assigned to athletes",
    "rallies_unreviewed": "totals cover the whole clip, rallies are not marked",
    "large_jumps": "shuttle intervals with a large jump in the image",
    "many_tracks": "more track ids than expected players",
    "broken_tracks": "tracks have holes, which stay unfilled",
    "not_doubles": "spacing is for doubles",
    "no_pairs": "no frame with four placed players of known side",
    "recovery_broken": "the path to the target is broken",
    "recovery_not_reached": "the target is not reached in the span",
}


def note(code: str) -> str:
    return f"{code}: {NOTES[code]}"
