"""Measures that need a person's annotations: rallies, spacing, recovery, events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import words
from ..functions.ordered import match_ranges
from ..functions.stats import exact_median
from ..policy import IMPLAUSIBLE_FLAGS, note
from .timeline import CLIP

# Width, in frames, of the cells that range joins are cut into.
CELL = 1024.0


def _plausible() -> Column:
    return ~F.arrays_overlap("quality_flags", words(IMPLAUSIBLE_FLAGS))


def rally_spans(rallies: DataFrame, frames: DataFrame) -> DataFrame:
    """Reviewed rallies with their times; a clip without any becomes one whole-clip span.

    A rally with an unknown end frame stays, without that time, and says so in ``boundary_status``.
    """
    notes = [c for c in ("notes", "outcome", "winner_label") if c in rallies.columns]
    ends = frames.groupBy(CLIP).agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"),
                                    F.min_by("timestamp_s", "frame_index").alias("start_s"),
                                    F.max_by("timestamp_s", "frame_index").alias("end_s"))
    whole = ends.join(rallies.select(CLIP).distinct(), CLIP, "left_anti").select(
        CLIP, F.lit("unsegmented_clip").alias("rally_id"), "start_frame", "end_frame", "start_s", "end_s",
        F.lit("whole_clip_not_automatically_classified_as_rally").alias("boundary_source"),
        *[F.lit(None).cast("string").alias(c) for c in notes])
    times = frames.select(CLIP, "frame_index", "timestamp_s")
    reviewed = (rallies.select(CLIP, "rally_id", "start_frame", "end_frame", *notes)
                .join(times.select(CLIP, F.col("frame_index").alias("start_frame"), F.col("timestamp_s").alias("start_s")), [CLIP, "start_frame"], "left")
                .join(times.select(CLIP, F.col("frame_index").alias("end_frame"), F.col("timestamp_s").alias("end_s")), [CLIP, "end_frame"], "left")
                .select(CLIP, "rally_id", "start_frame", "end_frame", "start_s", "end_s", F.lit("manual_review").alias("boundary_source"), *notes))
    status = F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), "unknown_frame").otherwise("timed")
    return reviewed.unionByName(whole).withColumns({"duration_s": F.col("end_s") - F.col("start_s"), "boundary_status": status})


def rally_summary(rallies: DataFrame, motion: DataFrame, frames: DataFrame) -> DataFrame:
    """Distance and time per rally and track; rallies without motion keep one row with nulls.

    An interval counts when it lies inside the rally, both ends included.
    """
    spans = rally_spans(rallies, frames)
    moves = motion.where("interval_start_frame is not null").select(
        CLIP, "track_id", *[c for c in ("player_label",) if c in motion.columns],
        "frame_index", "interval_start_frame", "interval_duration_s", "distance_m")
    inside = match_ranges(moves, spans.select(CLIP, "rally_id", "start_frame", "end_frame"), [CLIP],
                          "frame_index", "start_frame", "end_frame", CELL).where("interval_start_frame >= start_frame")
    # The label belongs to the track; as part of the key it keeps the aggregate hash-based.
    label = ["player_label"] if "player_label" in motion.columns else []
    per = inside.groupBy(CLIP, "rally_id", "track_id", *label).agg(
        F.sum("distance_m").alias("distance_m"), F.sum("interval_duration_s").alias("valid_motion_time_s"))
    return (spans.join(per, [CLIP, "rally_id"], "left")
                 .withColumn("average_speed_m_s", F.try_divide("distance_m", "valid_motion_time_s")))


def events_in_rallies(events: DataFrame, spans: DataFrame) -> DataFrame:
    return match_ranges(events, spans.select(CLIP, "rally_id", "start_frame", "end_frame"), [CLIP],
                        "frame_index", "start_frame", "end_frame", CELL).drop("start_frame", "end_frame")


def reviewed_events(events: DataFrame, motion: DataFrame) -> DataFrame:
    """Each event with the positions of its frame, of the named player only when one is named."""
    pos = motion.select(CLIP, "frame_index", "track_id", F.col("player_label").alias("position_label"), "x_m", "y_m",
                        "valid_position", F.col("quality_flags").alias("position_flags"))
    e, p = events.alias("e"), pos.alias("p")
    on = ((F.col(f"e.{CLIP}") == F.col(f"p.{CLIP}")) & (F.col("e.frame_index") == F.col("p.frame_index"))
          & (F.col("e.player_label").isNull() | (F.col("e.player_label") == F.col("p.position_label"))))
    return e.join(p, on, "left").select("e.*", *[f"p.{c}" for c in pos.columns if c not in (CLIP, "frame_index")])


def nested_events(enriched: DataFrame) -> DataFrame:
    """One row per event with its positions as a list: the players of one frame.

    An event is told from others by all its own columns, its place in the list and note among them.
    """
    places = ["track_id", "position_label", "x_m", "y_m", "valid_position", "position_flags"]
    item = F.struct(*places)
    return enriched.groupBy(*[c for c in enriched.columns if c not in places]).agg(
        F.array_sort(F.collect_list(F.when(F.col("track_id").isNotNull(), item))).alias("positions"))


def pair_spacing(motion: DataFrame) -> DataFrame:
    """Partner distance per side in frames where all four athletes are usable.

    A frame holds a handful of rows, so the group is small; sides and partners
    come out of two partial aggregates, without a self join.
    """
    ok = F.col("valid_position") & F.col("player_label").isNotNull() & F.col("side").isNotNull() & _plausible()
    sided = motion.groupBy(CLIP, "frame_index", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("usable"), F.first("timestamp_s").alias("timestamp_s"),
        F.min_by(F.struct("player_label", "team", "x_m", "y_m"), "track_id").alias("a"),
        F.max_by(F.struct("player_label", "team", "x_m", "y_m"), "track_id").alias("b"))
    side = F.struct("side", "n", "a", "b")
    frame = sided.groupBy(CLIP, "frame_index").agg(
        F.sum("n").alias("total"), F.sum("usable").alias("usable"), F.first("timestamp_s").alias("timestamp_s"),
        F.max(F.when(F.col("side") == "near", side)).alias("near"), F.max(F.when(F.col("side") == "far", side)).alias("far"))
    full = frame.where("total = 4 and usable = 4 and near.n = 2 and far.n = 2")
    rows = full.select(CLIP, "frame_index", "timestamp_s", F.explode(F.array("near", "far")).alias("s")).select(
        CLIP, "frame_index", "timestamp_s", "s.side", "s.a", "s.b")
    rows = rows.where(F.coalesce(F.col("a.team") == F.col("b.team"), F.lit(True)))
    dx, dy = F.abs(F.col("a.x_m") - F.col("b.x_m")), F.abs(F.col("a.y_m") - F.col("b.y_m"))
    return rows.select(CLIP, "frame_index", "timestamp_s", "side",
                       F.least("a.player_label", "b.player_label").alias("first_label"),
                       F.greatest("a.player_label", "b.player_label").alias("second_label"),
                       F.sqrt(dx * dx + dy * dy).alias("spacing_m"), dx.alias("lateral_spacing_m"), dy.alias("depth_spacing_m"))


def pair_summary(spacing: DataFrame) -> DataFrame:
    key = [CLIP, "side", "first_label", "second_label"]
    totals = spacing.groupBy(*key).agg(F.count(F.lit(1)).alias("valid_frames"), F.min("spacing_m").alias("minimum_spacing_m"),
                                       F.max("spacing_m").alias("maximum_spacing_m"))
    return totals.join(exact_median(spacing, key, "spacing_m", 1e-4, "median_spacing_m"), key)


def spacing_status(clips: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether spacing could be measured, and why not."""
    have = pairs.select(CLIP).distinct().withColumn("have", F.lit(True))
    doubles, got = F.col("mode") == "doubles", F.coalesce("have", F.lit(False))
    return clips.join(have, CLIP, "left").select(
        CLIP, F.when(doubles & got, "available").otherwise("unavailable").alias("status"),
        F.when(~doubles, note("not_doubles")).when(~got, note("no_pairs")).alias("reason"))


def recovery(targets: DataFrame, motion: DataFrame, frames: DataFrame) -> DataFrame:
    """Time from a contact until the player is within the target radius, without a break.

    Walking the frames one by one is not needed.  After a hole the next row of
    the label has no interval from the frame before, so the first bad row and
    the first hit, both plain minima, decide; only holes at either end need the
    row count.
    """
    last = frames.groupBy(CLIP).agg(F.max("frame_index").alias("__last"))
    t = (targets.join(last, CLIP, "left")
                .withColumns({"until_frame": F.coalesce("until_frame", "__last"), "radius_m": F.coalesce("radius_m", F.lit(0.5))})
                .drop("__last"))
    key = [CLIP, "player_label", "contact_frame", "until_frame", "target_x_m", "target_y_m", "radius_m"]
    rows = motion.where("player_label is not null").select(
        CLIP, F.col("player_label"), "frame_index", "timestamp_s", "x_m", "y_m", "interval_start_frame",
        (F.col("valid_position") & _plausible()).alias("ok"))
    r = match_ranges(rows, t.select(*key), [CLIP, "player_label"], "frame_index", "contact_frame", "until_frame", CELL)
    linked = (F.col("frame_index") == F.col("contact_frame")) | F.coalesce(
        F.col("interval_start_frame") == F.col("frame_index") - 1, F.lit(False))
    bad = ~(F.col("ok") & linked)
    dx, dy = F.col("x_m") - F.col("target_x_m"), F.col("y_m") - F.col("target_y_m")
    hit = ~bad & (F.sqrt(dx * dx + dy * dy) <= F.col("radius_m"))
    w = r.groupBy(*key).agg(
        F.min(F.when(bad, F.col("frame_index"))).alias("first_bad"),
        F.min(F.when(hit, F.struct("frame_index", "timestamp_s"))).alias("first_hit"),
        F.min(F.when(F.col("frame_index") == F.col("contact_frame"), F.col("timestamp_s"))).alias("contact_s"),
        F.count(F.lit(1)).alias("n"))
    out = t.select(*key).join(w, key, "left")
    reached = (F.col("contact_s").isNotNull() & F.col("first_hit").isNotNull()
               & (F.col("first_bad").isNull() | (F.col("first_hit.frame_index") < F.col("first_bad"))))
    reached = F.coalesce(reached, F.lit(False))
    whole = F.coalesce(F.col("first_bad").isNull() & (F.col("n") == F.col("until_frame") - F.col("contact_frame") + 1), F.lit(False))
    status = F.when(reached, "available").when(whole, "not_reached").otherwise("unavailable")
    return out.select(
        *key, F.when(reached, F.col("first_hit.timestamp_s") - F.col("contact_s")).alias("recovery_time_s"),
        F.when(reached, F.col("first_hit.frame_index")).alias("reached_frame"), status.alias("status"),
        F.when(status == "unavailable", note("recovery_broken")).when(status == "not_reached", note("recovery_not_reached")).alias("reason"))


def identified_players(fragments: DataFrame) -> DataFrame:
    """Totals per reviewed label, summed over fragments and never bridged between them.

    ``track_ids`` lists the fragments of one label in one clip.
    """
    have = F.col("distance_m").isNotNull()
    s = fragments.where("player_label is not null").groupBy(CLIP, "player_label").agg(
        F.array_sort(F.collect_set("track_id")).alias("track_ids"), F.sum("distance_m").alias("distance_m"),
        F.coalesce(F.sum(F.when(have, F.col("valid_motion_time_s"))), F.lit(0.0)).alias("valid_motion_time_s"),
        F.max(F.when(have, F.col("max_speed_m_s"))).alias("max_speed_m_s"))
    return s.withColumn("average_speed_m_s", F.try_divide("distance_m", "valid_motion_time_s"))
