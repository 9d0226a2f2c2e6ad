"""Thresholds from merged sketches stay within the stated rank error, however they were merged."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics, sketches


def _rank(values, t):
    return sum(v < t for v in values) / len(values), sum(v <= t for v in values) / len(values)


@pytest.mark.parametrize("k", [200, 2048])
def test_merges_in_any_order_and_depth(spark, k):
    r = random.Random(4)
    values = [r.lognormvariate(0, 2) for _ in range(30_000)] + [1.0] * 10_000  # a third of ties
    r.shuffle(values)
    rows = [(f"run{i % 3}", i % 7, v, "Normal") for i, v in enumerate(values)] + [("run0", 1, None, "Normal"), ("run0", 1, float("nan"), "benign"), ("run0", 1, 1e9, "DDoS")]
    df = spark.createDataFrame(rows, "run_id string, day int, score double, label string")
    daily = sketches.normal_sketches(df, k=k)
    assert daily.count() == 21
    ways = [daily, daily.orderBy(F.desc("day")).coalesce(1), sketches.merged(daily, ["run_id"]), sketches.merged(sketches.merged(daily, ["day"]))]
    for q in (0.5, 0.95, 0.99):
        for way in ways:
            out = sketches.threshold_from_sketches(way, 1 - q, k=k).first()
            lo, hi = _rank(values, out.threshold)
            assert out.n == len(values) and lo - out.rank_error <= q <= hi + out.rank_error, (q, lo, hi)
    low = sketches.threshold_from_sketches(daily, 0.05, metrics.LOWER, k=k).first()
    lo, hi = _rank(values, low.threshold)
    assert lo - low.rank_error <= 0.05 <= hi + low.rank_error


def test_small_and_empty(spark):
    df = spark.createDataFrame([("a", 0, float(i), "Normal") for i in range(100)], "run_id string, ts_us long, score double, label string")
    one = sketches.summary_from_sketches(sketches.normal_sketches(df)).first()
    assert one.n == 100 and one.score_mean == 49.5 and abs(one.score_p95 - 95) <= 1
    none = sketches.threshold_from_sketches(sketches.normal_sketches(df.limit(0))).first()
    assert none.threshold is None and none.n == 0
    norm = sketches.normalizer_from_sketches(sketches.normal_sketches(df), ["run_id"]).first()
    assert norm.cdf_scores == sorted(norm.cdf_scores) and len(norm.cdf_scores) == 200 and abs(norm.normal_std - 28.866) < 0.01
