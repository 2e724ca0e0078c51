"""Per-clip documents, report lines and run summaries, built from the measures."""
from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.motion import dense_grid, grid_place
from ..operators.timeline import CLIP
from ..policy import COURT_LENGTH, COURT_WIDTH, POLICY

# Fixed texts.
COORDINATES = "metres from far-left outer doubles corner; x across court, y toward near baseline"
LIMITATIONS = (
    "Player positions and distances are approximate floor projections of ankle midpoint, not independently validated athlete measurements.",
    "Local linear smoothing and a stationary noise guard reduce jitter but can attenuate brief accelerations and undercount short movements.",
    "Distances and time averages use only consecutive accepted observations; gaps, camera cuts, low confidence and fragment boundaries are never bridged.",
    "Fixed camera and correct court corners are required. Unflagged cuts, zooms or camera motion invalidate estimates and require a separate clip/calibration.",
    "Shuttle image speed is pixels per second and depends on perspective, camera framing and detection noise; it is not comparable to measured smash speed.",
    "Physical shuttle speed in km/h is unavailable because a single camera and floor homography do not identify airborne height and depth.",
    "Zones are observed occupancy, not judgments about correct tactical positioning. Contact, outcome, partnerships and recovery targets require explicit review.",
    "These descriptive reports support coach video review; improved player performance has not been established.",
)


def number(value: Column, unit: str = "", digits: int = 2) -> Column:
    return F.when(value.isNull(), F.lit("unavailable")).otherwise(F.format_string(f"%.{digits}f{unit}", value))


def _lines(df: DataFrame, section: int, order: list, line: Column) -> DataFrame:
    return df.select(CLIP, F.lit(section).cast("long").alias("section"),
                     F.concat_ws("/", *[F.format_string("%012d", c) if isinstance(c, Column) else F.col(c) for c in order]).alias("ord"),
                     line.alias("line"))


def report_lines(clips: DataFrame, fragments: DataFrame, zones: DataFrame, shuttle: DataFrame, rallies: DataFrame,
                 pairs: DataFrame, spacing: DataFrame, recovery: DataFrame, warnings: DataFrame) -> DataFrame:
    """Report text as rows ``(clip_id, section, ord, line)``.

    ``zones`` are the top zones with their ``rank``; ``rallies`` are rally spans.
    Written per clip in this order, the rows form the report.
    """
    label = F.replace(F.replace(F.coalesce("player_label", F.lit("no label")), F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" "))
    movement = _lines(fragments, 1, [F.col("track_id")], F.concat(
        F.lit("| "), F.col("track_id").cast("string"), F.lit(" | "), label, F.lit(" | "), number(F.col("distance_m"), " m"), F.lit(" | "),
        number(F.col("valid_motion_time_s"), " s"), F.lit(" | "), number(F.col("average_speed_m_s"), " m/s"), F.lit(" | "),
        number(F.col("max_speed_m_s"), " m/s"), F.lit(" |")))
    nobody = _lines(clips.join(fragments.select(CLIP).distinct(), CLIP, "left_anti"), 1, [F.lit(0)],
                    F.lit("| - | nobody | unavailable | 0 s | unavailable | unavailable |"))
    image = _lines(shuttle, 2, [F.lit(0)], F.concat(
        F.lit("Shuttle in the image, on average: "), number(F.col("average_image_speed_px_s"), " px/s", 1),
        F.lit("; at most: "), number(F.col("max_image_speed_px_s"), " px/s", 1), F.lit(".")))
    part = F.format_string("%s (%.2f s)", F.replace("zone", F.lit("_"), F.lit(" ")), "seconds")
    # At most three zones per track.
    best = zones.groupBy(CLIP, "track_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))), lambda s: s["text"]), ", ").alias("text"))
    place = _lines(fragments.select(CLIP, "track_id").join(best, [CLIP, "track_id"], "left"), 3, [F.col("track_id")], F.concat(
        F.lit("Fragment "), F.col("track_id").cast("string"), F.lit(": "), F.coalesce("text", F.lit("no usable time")),
        F.lit(". Cells of the heat map hold usable seconds; row 0 is the far end.")))
    manual = F.col("boundary_source") == "manual_review"
    span = F.format_string("from frame %d to %d, %.2f s.", "start_frame", "end_frame", "duration_s")
    rally = _lines(rallies, 4, [F.col("start_frame"), F.lit(0)], F.when(manual, F.concat(F.lit("Rally "), "rally_id", F.lit(": "), span))
                   .otherwise(F.concat(F.lit("Whole clip: "), span, F.lit(" Rallies are not marked."))))
    extra = [_lines(rallies.where(f"coalesce({c}, '') <> ''"), 4, [F.col("start_frame"), F.lit(k)], F.concat(F.lit(f"Its {word}: "), c))
             for k, (c, word) in enumerate((("notes", "note"), ("outcome", "outcome")), 1) if c in rallies.columns]
    pair = _lines(pairs, 5, ["side", "first_label"], F.format_string(
        "Pair at the %s side, %s and %s: %.2f m apart in the median of %d frames.", "side", "first_label", "second_label",
        "median_spacing_m", "valid_frames"))
    spread = _lines(spacing.withColumn("last", F.lit("~")), 5, ["last"], F.coalesce(
        "reason", F.lit("Distances alone; formations are not told apart.")))
    back = _lines(recovery, 6, ["player_label", F.col("contact_frame")], F.concat(
        "player_label", F.lit(" after contact at frame "), F.col("contact_frame").cast("string"), F.lit(": "),
        number(F.col("recovery_time_s"), " s"), F.lit(" ("), "status", F.lit("). "), F.coalesce("reason", F.lit(""))))
    no_target = _lines(clips.join(recovery.select(CLIP).distinct(), CLIP, "left_anti"), 6, [F.lit(0)],
                       F.lit("No targets are given, so recovery is not timed."))
    texts = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in LIMITATIONS]))
    limits = clips.select(CLIP).join(warnings, CLIP, "left").select(CLIP, F.posexplode(texts).alias("k", "text"))
    caution = _lines(limits, 7, [F.col("k")], F.concat(F.lit("1. "), "text"))
    return reduce(DataFrame.unionByName, [movement, nobody, image, place, rally, *extra, pair, spread, back, no_target, caution])


def write_report(lines: DataFrame, path: str) -> None:
    """One folder of ordered text per clip.

    Rows are range-partitioned in report order, so a long report may span files
    whose names sort in that order.
    """
    (lines.repartitionByRange(CLIP, "section", "ord").sortWithinPartitions(CLIP, "section", "ord")
          .select(CLIP, "line").write.mode("errorifexists").partitionBy(CLIP).text(path))


#: Tables that hold the row-level motion of all clips; documents name them and don't repeat their rows.
MOTION_TABLES = {"player_motion": "player_motion", "shuttle_motion": "shuttle_motion"}


def grid_rows(values: Column) -> Column:
    """A dense heat map's values as one list for each row of the grid.

    The values pass through a lambda, so that they are worked out once: named in the inner one, the planner may put
    their whole expression there, to be run for each row of the grid.
    """
    height, width = POLICY.heatmap_rows, POLICY.heatmap_cols
    rows = lambda v: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda k: F.slice(v, k * width + 1, F.lit(width)))
    return F.get(F.transform(F.array(values), rows), F.lit(0))


def gathered(keys: list[str], lists: dict[str, DataFrame], ones: dict[str, DataFrame] | None = None) -> DataFrame:
    """What many tables hold for a key: a column for each, of ``lists`` as a list, null where there is none, of ``ones`` as it is.

    A table holds the keys and one column of its name; of more rows for a key in ``ones`` the largest stays.
    The rows of all tables are dealt by key and sorted together.  Joined one after the other, each table has a sort of its
    own; all of them stand in one task, where every one keeps a page of memory.
    """
    ones = ones or {}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (lists | ones).values())
    found = rows.repartition(*keys).groupBy(*keys).agg(*[F.collect_list(n).alias(n) for n in lists], *[F.max(n).alias(n) for n in ones])
    return found.withColumns({n: F.when(F.size(n) > 0, F.col(n)) for n in lists})


def insight_documents(clips: DataFrame, quality: DataFrame, fragments: DataFrame, zones: DataFrame, identified: DataFrame,
                      shuttle: DataFrame, rallies: DataFrame, pairs: DataFrame, spacing: DataFrame, recovery: DataFrame, warnings: DataFrame,
                      heat: DataFrame, flags: DataFrame, events: DataFrame, caps: DataFrame, review: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per clip with the summary measures, the review they rest on and the policy.

    ``heat`` holds filled cells, which become whole grids when their document is written, ``flags`` counts per track, ``events``
    reviewed events with their positions, ``caps`` gap caps, ``review`` the tables ``identity``, ``rallies``, ``events`` and ``targets``.
    Lists hold what a clip has few of: tracks, labels, rallies, pairs, targets, events.
    The row-level motion stays in its own table and is named, not folded in.
    """
    track = [CLIP, "track_id"]
    entry = lambda df, name, *cols: df.select(*track, F.struct(*cols).alias(name))
    traits = gathered(track, {"zones": entry(zones, "zones", "zone", "seconds"), "heatmap": entry(heat.withColumn("place", grid_place()), "heatmap", "place", "seconds"),
                              "quality_flags": entry(flags, "quality_flags", "flag", "rows")})
    pairs_of = lambda c, t: F.coalesce(F.map_from_entries(F.array_sort(c)), F.create_map().cast(t))
    players = fragments.join(traits, track, "left").withColumns(
        {"zones": pairs_of("zones", "map<string,double>"), "heatmap": F.array_sort("heatmap"), "quality_flags": pairs_of("quality_flags", "map<string,bigint>")})

    def keyed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in (CLIP, *order)]
        # Sorted by text, as maps have no order of their own.
        k = F.to_json(F.struct(*[F.format_string("%012d", c) if t in ("int", "bigint") else F.col(c) for c, t in df.select(*order).dtypes]))
        return df.select(CLIP, F.struct(k.alias("k"), F.struct(*order, *rest).alias("v")).alias(name))

    def listed(name: str, made=lambda v: v) -> Column:
        ordered = F.array_sort(F.col(name), lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
        return F.transform(ordered, lambda x: made(x["v"]))

    def with_grid(v: Column) -> Column:
        grid = F.struct(grid_rows(dense_grid(v["heatmap"])).alias("values_s"), F.array(F.lit(POLICY.heatmap_rows), F.lit(POLICY.heatmap_cols)).alias("grid_shape"),
                        F.array(*[F.lit(float(x)) for x in (0, 0, COURT_WIDTH, COURT_LENGTH)]).alias("bounds_m"), F.lit("observed seconds").alias("unit"))
        return v.withField("heatmap", F.when(v["track_id"].isNotNull(), grid))

    whole = lambda df, name: df.select(CLIP, F.struct(*[c for c in df.columns if c != CLIP]).alias(name))
    given = {"identity_map": (review["identity"], ["track_id"]), "rallies": (review["rallies"], ["start_frame", "rally_id"]),
             "events": (review["events"], ["frame_index"]), "recovery_targets": (review["targets"], ["player_label", "contact_frame"])}
    lists = {"players": (players, ["track_id"]), "identified_players": (identified, ["player_label"]), "rallies": (rallies, ["start_frame", "rally_id"]),
             "pairs": (pairs, ["side", "first_label", "second_label"]), "recovery": (recovery, ["player_label", "contact_frame"]),
             "reviewed_events": (events, ["frame_index"])} | {f"review_{n}": v for n, v in given.items()}
    ones = {"spacing": whole(spacing, "spacing"), "shuttle": whole(shuttle, "shuttle"), "known": whole(quality, "known"),
            "warnings": warnings.select(CLIP, "warnings"), "maximum_interval_s": caps.select(CLIP, F.col("gap_cap_s").alias("maximum_interval_s"))}
    out = clips.select(CLIP, "mode").join(gathered([CLIP], {n: keyed(df, n, order) for n, (df, order) in lists.items()}, ones), CLIP, "left")
    policy = F.struct(*[F.lit(v).alias(n) for n, v in asdict(POLICY).items()])
    block = F.struct(*[F.col(f"known.{c}") for c in quality.columns if c != CLIP], "warnings", "maximum_interval_s", policy.alias("policy"))
    apart = F.struct("spacing.status", "spacing.reason", listed("pairs").alias("pairs"))
    body = F.struct(F.lit("1.0").alias("schema_version"), CLIP, "mode", listed("players", with_grid).alias("players"), listed("identified_players").alias("identified_players"),
                    listed("rallies").alias("rallies"), F.when(F.col("spacing").isNotNull(), apart).alias("doubles_pair_spacing"), listed("recovery").alias("recovery"),
                    listed("reviewed_events").alias("reviewed_events"), F.struct(*[listed(f"review_{n}").alias(n) for n in given]).alias("review"), "shuttle",
                    F.when(F.col("known").isNotNull(), block).alias("quality"), F.lit(COORDINATES).alias("coordinate_convention"),
                    F.struct(*[F.lit(t).alias(n) for n, t in MOTION_TABLES.items()]).alias("tables"), F.array(*[F.lit(x) for x in LIMITATIONS]).alias("limitations"))
    return out.select(CLIP, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def run_summaries(clips: DataFrame, tracking: DataFrame, players: DataFrame, projection: DataFrame, quality: DataFrame,
                  settings: dict[str, str], outputs: list[str], elapsed_s: float) -> DataFrame:
    """One row per clip: status, settings, quality blocks, output names, elapsed time."""
    out = clips.select(CLIP, F.lit("complete").alias("status"), F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]).alias("settings"))
    for name, table in (("tracking_quality", tracking), ("player_tracking_quality", players), ("court_tracking_quality", projection), ("insights", quality)):
        out = out.join(table.select(CLIP, F.struct(*[c for c in table.columns if c != CLIP]).alias(name)), CLIP, "left")
    return out.withColumns({"outputs": F.array(*[F.lit(o) for o in outputs]), "processing_seconds": F.lit(float(elapsed_s))})
