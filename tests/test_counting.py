"""Counting without pairs, exact quantiles and blocked similarities against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import joins, stats


@pytest.mark.parametrize("seed", range(3))
def test_ranks_below(seed):
    rnd = np.random.default_rng(seed)
    ranks = rnd.integers(0, 40, 300)
    low, high, most = rnd.integers(0, 301, 200), rnd.integers(0, 301, 200), rnd.integers(0, 42, 200)
    assert joins.ranks_below(ranks, low, high, most).tolist() == [int((ranks[a:b] < m).sum()) for a, b, m in zip(low, high, most)]


@pytest.mark.parametrize("cell_rows", [1 << 18, 5])
def test_containment_counts(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(joins, "CELL_ROWS", cell_rows)
    rnd = random.Random(3)
    rows = []
    for k in range(700):
        a = rnd.choice([rnd.uniform(-50, 150), float(rnd.randrange(-5, 15) * 10)])
        rows.append((k, rnd.choice("uvw"), a, a + rnd.choice([0.0, 5.0, 9.999, 10.0, 20.0, rnd.uniform(0, 90), 10.0 * rnd.randrange(7)])))
    got = {r["id"]: r["density"] for r in joins.containment_counts(spark.createDataFrame(rows, "id bigint, video_uid string, cs double, ce double")).collect()}
    short = [r for r in rows if r[3] - r[2] < 10]
    assert got == {k: sum(s[1] == v and s[2] >= a and s[3] <= b for s in short) if b - a >= 10 else 0 for k, v, a, b in rows}


CASES = [[], [1.0], [2.0, 1.0], [1.0] * 5000 + [2.0] * 5000, list(range(9000)), [0.0, -0.0, 1e300, -1e300, 5e-324] * 500, [float(k % 7) ** 40 for k in range(4000)], [-(1.5 ** (k % 900)) for k in range(5000)]]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_quantiles(spark, monkeypatch, case):
    monkeypatch.setattr(stats, "FEW", 50)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    rows = spark.createDataFrame([(None,)] + [(float(x),) for x in CASES[case]], "v double").repartition(3)
    fractions = [0.0, 0.25, 0.5, 0.751, 1.0]
    got = stats.quantiles(rows, "v", fractions)
    if not CASES[case]:
        assert got == [None] * 5
        return
    values = sorted(float(x) for x in CASES[case])
    for g, f in zip(got, fractions):
        at = f * (len(values) - 1)
        low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
        assert g == pytest.approx(low if low == high else low + (high - low) * (at - np.floor(at)), rel=1e-12)


def test_infinite_values_have_quantiles(spark):
    rows = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "v double")
    assert stats.quantiles(rows, "v", [0.0, 0.5, 1.0]) == [float("-inf"), 1.0, float("inf")]


def test_nearest_prototypes(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    protos = rnd.normal(size=(40, 8))
    protos[7] = protos[3]
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    items = rnd.normal(size=(300, 8))
    monkeypatch.setattr(joins, "ITEMS", 37)
    p = spark.createDataFrame([(f"p{k:02}", v.tolist()) for k, v in enumerate(protos)], "name string, embedding array<double>")
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(items)] + [(999, None)], "id bigint, v array<double>")
    want = {}
    for k, v in enumerate(items):
        s = np.round(v / np.linalg.norm(v) @ protos.T, 9)
        want[k] = [f"p{j:02}" for j in np.lexsort((np.arange(40), -s))[:6]]
    for most in (10_000, 9):
        got = joins.nearest_prototypes(i, "id", "v", p, "name", 6, most).collect()
        assert {k: [r["name"] for r in sorted((r for r in got if r["id"] == k), key=lambda r: r["rank"])] for k in want} == want
        assert all(r["id"] != 999 for r in got)
    assert joins.nearest_prototypes(i, "id", "v", p.limit(0), "name", 3).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        joins.nearest_prototypes(spark.createDataFrame([(1, [1.0])], "id bigint, v array<double>"), "id", "v", p, "name", 3).collect()
