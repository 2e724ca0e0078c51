"""Detections against human labels, and versions against each other."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_median
from .timeline import CLIP

KEY = [CLIP, "frame_index"]


def denormalize(labels: DataFrame, clips: DataFrame) -> DataFrame:
    """Label positions in source pixels from image fractions."""
    return labels.join(clips.select(CLIP, "width", "height"), CLIP).withColumns(
        {"label_x": F.col("x") * F.col("width"), "label_y": F.col("y") * F.col("height")}).drop("x", "y", "width", "height")


def coverage_problems(shuttle: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames present on one side only; evaluation needs none."""
    s = shuttle.select(*KEY, F.lit(True).alias("s"))
    t = labels.select(*KEY, F.lit(True).alias("t"))
    return s.join(t, KEY, "full").where("s is null or t is null").select(
        *KEY, F.when(F.col("s").isNull(), "no_detection_row").otherwise("no_label_row").alias("rule"))


def matches(shuttle: DataFrame, labels: DataFrame, tolerance_px: float = 8.0) -> DataFrame:
    """Outcome of every labelled frame; estimates never count as detections.

    A detection beyond the tolerance is both a false positive and a false negative.
    """
    rows = shuttle.select(*KEY, "raw_x", "raw_y").join(labels.select(*KEY, "visible", "label_x", "label_y"), KEY)
    seen = F.col("raw_x").isNotNull() & F.col("raw_y").isNotNull()
    dx, dy = F.col("raw_x") - F.col("label_x"), F.col("raw_y") - F.col("label_y")
    err = F.when(F.col("visible") & seen, F.sqrt(dx * dx + dy * dy))
    hit = F.coalesce(err <= tolerance_px, F.lit(False))
    return rows.select(*KEY, "visible", err.alias("error_px"), hit.alias("matched"),
                       (seen & ~hit).alias("false_positive"), (F.col("visible") & ~hit).alias("false_negative"),
                       (~F.col("visible") & ~seen).alias("true_negative"))


def evaluate(shuttle: DataFrame, labels: DataFrame, tolerance_px: float = 8.0) -> DataFrame:
    m = matches(shuttle, labels, tolerance_px)
    s = m.groupBy(CLIP).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("visible").alias("visible_ground_truth_frames"),
        F.count_if("matched").alias("matched_detections"), F.count_if("false_positive").alias("false_positives"),
        F.count_if("false_negative").alias("false_negatives"), F.count_if("true_negative").alias("true_negatives"),
        F.avg("error_px").alias("mean_error_px"))
    tp = F.col("matched_detections")
    return (s.join(exact_median(m, [CLIP], "error_px", 1e-2, "median_error_px"), CLIP, "left")
             .withColumns({"precision": F.try_divide(tp, tp + F.col("false_positives")),
                           "recall": F.try_divide(tp, tp + F.col("false_negatives"))}))


def missed_frames(shuttle: DataFrame, labels: DataFrame, tolerance_px: float = 8.0) -> DataFrame:
    return matches(shuttle, labels, tolerance_px).where("false_negative").select(*KEY)


def timing_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest time difference between two versions, and whether both have the same frames."""
    left = a.select(*KEY, F.col("timestamp_s").alias("ta"))
    right = b.select(*KEY, F.col("timestamp_s").alias("tb"))
    return left.join(right, KEY, "full").groupBy(CLIP).agg(
        F.max(F.abs(F.col("ta") - F.col("tb"))).alias("max_timing_error_s"),
        (F.count("ta") == F.count("tb")).alias("equal_counts"))


def clip_digests(rows: DataFrame, clip: str = CLIP) -> DataFrame:
    """One row per clip: number of rows and two sums of row hashes, whatever the rows' order.

    A version's digests can be stored with it; comparing versions then reads no rows of clips that didn't change.
    """
    cols = sorted(rows.columns)
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *cols).cast("decimal(20,0)"))
    return rows.groupBy(clip).agg(F.count(F.lit(1)).alias("n_rows"), total(0).alias("sum_a"), total(1).alias("sum_b"))


def changed_clips(old: DataFrame, new: DataFrame, clip: str = CLIP) -> DataFrame:
    """Clips whose digests (from ``clip_digests``) differ, or that one side lacks."""
    a = old.select(clip, F.struct("n_rows", "sum_a", "sum_b").alias("a"))
    b = new.select(clip, F.struct("n_rows", "sum_a", "sum_b").alias("b"))
    return a.join(b, clip, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(clip)


def diff_observations(a: DataFrame, b: DataFrame, keys: list[str], digests: tuple[DataFrame, DataFrame] | None = None, clip: str = CLIP) -> DataFrame:
    """What differs between two versions of a table as multisets of rows: ``keys, change, n_rows``.

    Digests tell the clips that differ, and only their rows are opened.  A key's surplus on either side is
    counted: as many rows as both sides have in surplus are ``changed``, the rest ``removed`` or ``added``.
    """
    b = b.select(*a.columns)
    old, new = digests or (clip_digests(a, clip), clip_digests(b, clip))
    open_clips = changed_clips(old, new, clip)
    side = lambda df, k: df.join(open_clips, clip, "left_semi").withColumn("__side", F.lit(k))
    surplus = side(a, 1).unionByName(side(b, -1)).groupBy(*a.columns).agg(F.sum("__side").alias("k")).where("k <> 0")
    each = surplus.groupBy(*keys).agg(F.sum(F.greatest(F.col("k"), F.lit(0))).alias("gone"), F.sum(F.greatest(-F.col("k"), F.lit(0))).alias("come"))
    both = F.least("gone", "come")
    kinds = F.array(*[F.struct(F.lit(name).alias("change"), n.cast("long").alias("n_rows"))
                      for name, n in (("changed", both), ("removed", F.col("gone") - both), ("added", F.col("come") - both))])
    return each.select(*keys, F.explode(F.filter(kinds, lambda x: x["n_rows"] > 0)).alias("x")).select(*keys, "x.change", "x.n_rows")
