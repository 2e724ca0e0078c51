"""Short trails behind moving points, as data for any display.

Each trail is at most ``n`` points, so one halo of that width per block is
exact and the list on a row is bounded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import on_court
from ..functions.ordered import match_ranges, with_halo
from ..policy import COURT_LENGTH, COURT_WIDTH, LAYOUT, Layout
from .timeline import CLIP


def _runs(rows: DataFrame, keys: list[str], n: int, layout: Layout):
    """Halo layout and a window inside each run of consecutive frames."""
    rows = with_halo(rows, F.col("frame_index"), layout.block_frames, before=n)
    w = Window.partitionBy(*keys, "block").orderBy("frame_index")
    rows = rows.withColumn("run", F.col("frame_index") - F.row_number().over(w))
    return rows, Window.partitionBy(*keys, "block", "run").orderBy("frame_index")


def map_trails(positions: DataFrame, n: int = 60, apron_m: float = 0.8, layout: Layout = LAYOUT) -> DataFrame:
    """Last ``n`` points of each track on the map panel, restarted by any absence."""
    x, y = F.col("x_m"), F.col("y_m")
    shown = positions.where(x.between(-apron_m, COURT_WIDTH + apron_m) & y.between(-apron_m, COURT_LENGTH + apron_m))
    rows, w = _runs(shown.select(CLIP, "track_id", "frame_index", "x_m", "y_m"), [CLIP, "track_id"], n, layout)
    return (rows.withColumn("trail", F.collect_list(F.struct("x_m", "y_m")).over(w.rowsBetween(-(n - 1), 0)))
                .where("is_core").select(CLIP, "track_id", "frame_index", "trail"))


def shuttle_trails(shuttle: DataFrame, n: int = 12, layout: Layout = LAYOUT) -> DataFrame:
    """Last ``n`` detected points; an estimate or a missing row empties the trail."""
    rows, w = _runs(shuttle.where("source = 'detected' and x is not null and y is not null")
                    .select(CLIP, "frame_index", "x", "y"), [CLIP], n, layout)
    return (rows.withColumn("trail", F.collect_list(F.struct("x", "y")).over(w.rowsBetween(-(n - 1), 0)))
                .where("is_core").select(CLIP, "frame_index", "trail"))


def review_trail(positions: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Line segments between consecutive on-court frames of a track."""
    rows = with_halo(positions.select(CLIP, "track_id", "frame_index", "x_m", "y_m")
                     .where("x_m is not null and y_m is not null"), F.col("frame_index"), layout.block_frames, before=1)
    w = Window.partitionBy(CLIP, "track_id", "block").orderBy("frame_index")
    rows = rows.withColumn("p", F.lag(F.struct("frame_index", "x_m", "y_m")).over(w)).where("is_core")
    return rows.where(on_court(F.col("x_m"), F.col("y_m")) & on_court(F.col("p.x_m"), F.col("p.y_m"))
                      & (F.col("frame_index") == F.col("p.frame_index") + 1)).select(
        CLIP, "track_id", "frame_index", F.col("p.x_m").alias("x0_m"), F.col("p.y_m").alias("y0_m"),
        F.col("x_m").alias("x1_m"), F.col("y_m").alias("y1_m"))


def review_trail_at(positions: DataFrame, moments: DataFrame, n: int = 45) -> DataFrame:
    """The segments visible at chosen ``(clip, frame)`` moments: the last ``n`` frames.

    A segment is drawn when both of its points are within the span.
    """
    at = moments.select(CLIP, F.col("frame_index").alias("at_frame"),
                        (F.col("frame_index") - n + 1).alias("lo"), F.col("frame_index").alias("hi"))
    return match_ranges(review_trail(positions), at, [CLIP], "frame_index", "lo", "hi", 1024.0).drop("lo", "hi")
