"""Singular values of small matrices as column arithmetic, one matrix for each row."""
from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, inside an expression."""
    return F.transform(F.array(value), body)[0]


def largest_singular(m: list[Column]) -> Column:
    """2-norm of a row-major 3x3 matrix: root of the largest eigenvalue of its Gram matrix, by the trigonometric form of the cubic's roots."""
    column = lambda k: [m[k], m[3 + k], m[6 + k]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    pairs = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))
    gram = F.struct(*[dot(column(i), column(j)).alias(n) for n, (i, j) in zip(names, pairs)])

    def root(g: Column) -> Column:
        mean = (g["xx"] + g["yy"] + g["zz"]) / 3
        spread = F.struct(mean.alias("mean"), F.sqrt(((g["xx"] - mean) ** 2 + (g["yy"] - mean) ** 2 + (g["zz"] - mean) ** 2 + 2 * (g["xy"] ** 2 + g["xz"] ** 2 + g["yz"] ** 2)) / 6).alias("size"))

        def largest(s: Column) -> Column:
            a, b, c = [F.try_divide(g[n] - s["mean"], s["size"]) for n in ("xx", "yy", "zz")]
            d, e, f = [F.try_divide(g[n], s["size"]) for n in ("xy", "xz", "yz")]
            half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
            angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
            return s["mean"] + F.coalesce(2 * s["size"] * F.cos(angle), F.lit(0.0))  # all eigenvalues are equal where nothing spreads
        return let(spread, largest)
    return F.sqrt(let(gram, root))


def condition3(m: list[Column]) -> Column:
    """2-norm condition of a 3x3 matrix; null if it is singular.

    The smallest singular value comes from the adjugate's largest, so it isn't lost in the square of the largest.
    """
    a, b, c, d, e, f, g, h, i = m
    adjugate = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    det = F.abs(a * adjugate[0] + b * adjugate[3] + c * adjugate[6])
    return F.try_divide(largest_singular(m) * largest_singular(adjugate), det)


def row_norms_after_jacobi(rows: Column, n: int, sweeps: int) -> Column:
    """Singular values of a matrix (array of ``n`` rows): rows are turned in pairs until they stand at right angles.

    One-sided Jacobi in a fixed number of sweeps; small singular values keep their leading digits.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    pairs = ", ".join(f"named_struct('p', {p}, 'q', {q})" for p, q in itertools.combinations(range(n), 2))
    turns = F.expr(f"flatten(array_repeat(array({pairs}), {sweeps}))")

    def turned(matrix: Column, at: Column) -> Column:
        x, y = F.get(matrix, at["p"]), F.get(matrix, at["q"])

        def by(k: Column) -> Column:
            zeta = (k["yy"] - k["xx"]) / (2 * k["xy"])
            tangent = F.when(k["xy"] == 0, 0.0).otherwise(F.when(zeta < 0, -1.0).otherwise(1.0) / (F.abs(zeta) + F.sqrt(1 + zeta * zeta)))

            def apply(t: Column) -> Column:
                cosine = 1 / F.sqrt(1 + t * t)
                return let(F.struct(cosine.alias("c"), (cosine * t).alias("s")), lambda r: F.transform(matrix, lambda row, i: (
                    F.when(i == at["p"], F.zip_with(x, y, lambda u, v: r["c"] * u - r["s"] * v))
                    .when(i == at["q"], F.zip_with(x, y, lambda u, v: r["s"] * u + r["c"] * v)).otherwise(row))))
            return let(tangent, apply)
        return let(F.struct(dot(x, x).alias("xx"), dot(y, y).alias("yy"), dot(x, y).alias("xy")), by)
    done = F.aggregate(turns, rows, turned)
    return F.transform(done, lambda row: F.sqrt(dot(row, row)))


def centred(points: list[tuple[Column, Column]]) -> tuple[list[tuple[Column, Column]], Column, Column, Column]:
    """Points moved and scaled to mean zero and mean distance root two; the scale (null if all are one point) and the mean."""
    n = len(points)
    mx, my = [sum((p[k] for p in points[1:]), points[0][k]) / n for k in (0, 1)]
    away = [F.hypot(x - mx, y - my) for x, y in points]
    mean = sum(away[1:], away[0]) / n
    scale = F.when(mean > 1e-12, F.lit(math.sqrt(2.0)) / mean)
    return [(scale * (x - mx), scale * (y - my)) for x, y in points], scale, mx, my


def centred_values(points: list[tuple[float, float]]) -> tuple[list[tuple[float, float]], float, float, float]:
    """The same of points that are known beforehand."""
    mx, my = [sum(p[k] for p in points) / len(points) for k in (0, 1)]
    scale = math.sqrt(2.0) * len(points) / sum(math.hypot(x - mx, y - my) for x, y in points)
    return [(scale * (x - mx), scale * (y - my)) for x, y in points], scale, mx, my
