"""Conditions of calibrations against a linear algebra library."""
import math

import numpy as np
import pytest

from rallygrid.operators import court
from rallygrid.sources.store import materialize

FLOOR = np.array(court.COURT_CORNERS)


def scaled(points):
    away = points - points.mean(0)
    return away * math.sqrt(2) / np.linalg.norm(away, axis=1).mean()


def library(corners):
    """Conditions of the fit's equations and of the normalized mapping."""
    rows = []
    for (x, y), (u, v) in zip(scaled(corners), scaled(FLOOR)):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    _, values, vectors = np.linalg.svd(np.array(rows))
    return values[0] / values[-1], np.linalg.cond(vectors[-1].reshape(3, 3))


def squeezed(k):
    """Corners that come closer to a degenerate place with ``k``: on a line, together, or a third one between its neighbours."""
    p = np.array([[454, 263], [827, 264], [985, 653], [297, 654]], float) + np.random.default_rng(k).normal(0, 3, (4, 2))
    if k % 4 == 1:
        p[:, 1] = 263 + (p[:, 1] - 263) * 10.0 ** (-k / 4)
    if k % 4 == 2:
        p[1] = p[0] + (p[1] - p[0]) * 10.0 ** (-k / 4)
    if k % 4 == 3:
        p[2] = (p[1] + p[3]) / 2 + 10.0 ** (-k / 4)
    return p


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, *map(float, squeezed(k).ravel())) for k in range(44)]
    rows += [(100, *[5.0] * 8), (101, 0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0), (102, None, *[1.0] * 7)]
    table = spark.createDataFrame(rows, "clip_id long, " + ", ".join(f"{c} double" for c in court.CORNERS))
    return {r.clip_id: r for r in court.fit_diagnostics(materialize(court.fit_homography(table))).collect()}


def test_conditions_equal_the_library(judged):
    for k in range(44):
        design, mapping = library(squeezed(k))
        for got, want in ((judged[k].design_condition, design), (judged[k].mapping_condition, mapping)):
            if want < 1e12:  # beyond it the library has no digits left either
                assert math.log10(got) == pytest.approx(math.log10(want), abs=1e-3)
        assert judged[k].well_conditioned == (design <= court.DESIGN_LIMIT and mapping <= court.MAPPING_LIMIT)


def test_near_singular_corners_are_refused(judged):
    refused = {k for k in range(44) if not judged[k].well_conditioned}
    assert {41, 43} <= refused and 0 not in refused
    assert not any(judged[k].acceptable for k in refused)
    assert all(judged[k].acceptable for k in range(0, 44, 4))


def test_degenerate_corners_have_no_condition(judged):
    for k in (100, 101, 102):
        assert judged[k].design_condition is None and not judged[k].well_conditioned and not judged[k].acceptable
