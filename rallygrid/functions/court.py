"""Court zones and the image/floor mapping as plain column arithmetic."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import COURT_LENGTH, COURT_WIDTH, POLICY, SINGLES_MARGIN


def on_court(x: Column, y: Column) -> Column:
    return x.between(0.0, COURT_WIDTH) & y.between(0.0, COURT_LENGTH)


def zone(x: Column, y: Column) -> Column:
    """Side, depth band and lateral third of a floor point."""
    far = y < COURT_LENGTH / 2
    depth = F.when(far, y).otherwise(F.lit(COURT_LENGTH) - y)
    name = F.concat_ws(
        "_",
        F.when(far, "far").otherwise("near"),
        F.when(depth < COURT_LENGTH / 6, "back").when(depth < COURT_LENGTH / 3, "mid").otherwise("front"),
        F.when(x < COURT_WIDTH / 3, "left").when(x < 2 * COURT_WIDTH / 3, "center").otherwise("right"))
    return F.when(on_court(x, y), name).when(x.isNotNull() & y.isNotNull(), "outside_court")


def heatmap_cell(x: Column, y: Column) -> tuple[Column, Column]:
    """Grid row and column; the far edges fall into the last cell."""
    row = F.least(F.lit(POLICY.heatmap_rows - 1), (y / COURT_LENGTH * POLICY.heatmap_rows).cast("int"))
    col = F.least(F.lit(POLICY.heatmap_cols - 1), (x / COURT_WIDTH * POLICY.heatmap_cols).cast("int"))
    return row.cast("long"), col.cast("long")


def within_active_court(x: Column, y: Column, singles: bool) -> Column:
    tol, margin = POLICY.court_tolerance_m, SINGLES_MARGIN if singles else 0.0
    return x.between(margin - tol, COURT_WIDTH - margin + tol) & y.between(-tol, COURT_LENGTH + tol)


def calibration_confirmed(method: Column, reviewed: Column) -> Column:
    """An automatic proposal counts only after a person has looked at it."""
    return method.isNotNull() & ~(method.startswith("auto") & ~F.coalesce(reviewed, F.lit(False)))


def homography(c: list[Column]) -> tuple[list[Column], list[Column]]:
    """Row-major (image->court, court->image) matrices from the corners x0,y0..x3,y3.

    The unit square maps onto a quadrilateral in closed form; scaling the square
    to the court gives court->image and its adjugate gives image->court, each
    divided by its last element.
    """
    x0, y0, x1, y1, x2, y2, x3, y3 = c
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = dx1 * dy2 - dx2 * dy1
    # Corners on one line have no mapping: all elements are null.
    g, h = F.try_divide(sx * dy2 - dx2 * sy, det), F.try_divide(dx1 * sy - sx * dy1, det)
    w, l = F.lit(COURT_WIDTH), F.lit(COURT_LENGTH)
    inv = [(x1 - x0 + g * x1) / w, (x3 - x0 + h * x3) / l, x0,
           (y1 - y0 + g * y1) / w, (y3 - y0 + h * y3) / l, y0,
           g / w, h / l, F.lit(1.0)]
    return inv, adjugate(inv)


def adjugate(m: list[Column]) -> list[Column]:
    """Inverse of a 3x3 matrix up to scale, last element one."""
    a, b, c, d, e, f, g, h, i = m
    adj = [e * i - f * h, c * h - b * i, b * f - c * e,
           f * g - d * i, a * i - c * g, c * d - a * f,
           d * h - e * g, b * g - a * h, a * e - b * d]
    return [F.try_divide(v, adj[8]) for v in adj]


def project(m: list[Column], x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(x', y', usable): mapped point, null at or too close to the horizon."""
    w = m[6] * x + m[7] * y + m[8]
    row_norm = F.sqrt(m[6] * m[6] + m[7] * m[7] + m[8] * m[8])
    scale = F.greatest(F.lit(1.0), F.sqrt(x * x + y * y + 1) * row_norm)
    ok = F.coalesce(F.abs(w) > 1e-12 * scale, F.lit(False))
    return (F.when(ok, (m[0] * x + m[1] * y + m[2]) / w),
            F.when(ok, (m[3] * x + m[4] * y + m[5]) / w), ok)
