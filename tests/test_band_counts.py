"""Counts and least keys of a band join, without its pairs."""

import numpy as np
import pytest

from strandweave.operators import joins


@pytest.mark.parametrize("rows", [(1 << 18, 1 << 20), (16, 24)])
def test_counts_equal_pairs(spark, monkeypatch, rows):
    """Values in multiples of the width, next to them by one rounding, repeated, null and infinite; keys repeated and null; cells dealt out in parts."""
    monkeypatch.setattr(joins, "LEFT_ROWS", rows[0])
    monkeypatch.setattr(joins, "RIGHT_ROWS", rows[1])
    rnd = np.random.default_rng(5)
    values = np.append(rnd.integers(0, 30, 150) / 10, rnd.random(150) * 3 - 1)
    values = [*values, *np.nextafter(values, 9.0), *np.nextafter(values, -9.0), None, float("inf"), float("nan"), float("-inf")]
    left = [(k % 700, None if v is None else float(v)) for k, v in enumerate(values)]
    right = [(None if k % 5 == 0 else f"k{k * 7919 % 1000:03}", None if v is None else float(v)) for k, v in enumerate(reversed(values))]
    got = joins.band_counts(spark.createDataFrame(left, "uid long, g double"), spark.createDataFrame(right, "other string, h double"), "g", "h", 0.1, "uid", "other").collect()
    want: dict[int, list] = {}
    for uid, g in left:
        for other, h in right:
            if g is not None and h is not None and abs(g - h) <= 0.1:
                want.setdefault(uid, []).append(other)
    assert {r.key: (r.n, r.first) for r in got} == {k: (len(v), min((x for x in v if x is not None), default=None)) for k, v in want.items()}


def test_a_crowded_band_makes_no_pairs(spark):
    """Two times 200,000 equal values: 4 x 10^10 pairs."""
    rows = spark.range(200_000).selectExpr("id", "0.5D AS x")
    got = joins.band_counts(rows, rows.selectExpr("id AS other", "x AS h"), "x", "h", 0.25, "id", "other")
    assert got.selectExpr("count(*)", "min(n)", "max(n)", "max(first)").first()[:] == (200_000, 200_000, 200_000, 0)
