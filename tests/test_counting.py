"""Counts in boxes without the pairs, and what stands on them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselix.operators import counting, skyline as sky


def test_weights_inside_against_comparison():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        u, v, w = rng.integers(0, 9, 70).astype(float), rng.normal(size=70).round(1), rng.integers(1, 5, 70)
        a, b, c, d = rng.integers(-1, 10, 40), rng.integers(-1, 10, 40), rng.normal(size=40).round(1), rng.normal(size=40).round(1)
        lo, hi, low, high = np.minimum(a, b), np.maximum(a, b), np.minimum(c, d), np.maximum(c, d)
        want = [w[(u >= p) & (u <= q) & (v >= r) & (v <= s)].sum() for p, q, r, s in zip(lo, hi, low, high, strict=True)]
        assert counting.weight_inside(u, v, w, lo, hi, low, high).tolist() == want


@pytest.mark.parametrize("kind", ["spread", "one x", "one y", "one place"])
def test_box_counts_by_slabs(spark, kind, monkeypatch):
    """Many small slabs and strips, and places that many share."""
    monkeypatch.setattr(counting, "PARTS", 20)
    rng = random.Random(5)
    rows = [(i, 0.0 if kind in ("one x", "one place") else float(rng.randrange(12)), -0.0 if kind in ("one y", "one place") else float(rng.randrange(12))) for i in range(120)]
    boxes = [(i, *(float(s) for c in (0, 1) for s in sorted(rng.randrange(-2, 14) for _ in range(2)))) for i in range(60)] + [(60, 5.0, 4.0, 0.0, 9.0), (61, -math.inf, math.inf, -math.inf, math.inf)]
    got = counting.box_counts(spark.createDataFrame(rows, "id bigint, x double, y double"), spark.createDataFrame(boxes, "b bigint, q_x_min double, q_x_max double, q_y_min double, q_y_max double"), ("b",), slab=7)
    want = {b: n for b, x0, x1, y0, y1 in boxes if (n := sum(x0 <= x <= x1 and y0 <= y <= y1 for _, x, y in rows))}
    assert {r["b"]: r["hits"] for r in got.collect()} == want


def test_dominance_is_counted_not_paired(spark):
    """60,000 points: all pairs would be 3.6 billion."""
    df = spark.range(60_000).select("id", (F.col("id") % 300).cast("double").alias("x"), F.floor(F.col("id") / 300).cast("double").alias("y"))
    got = sky.dominance_counts(df)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter(F.col("dominated") != (300 - F.col("id") % 300) * (200 - F.floor(F.col("id") / 300)) - 1).count() == 0 and got.count() == 59_999
