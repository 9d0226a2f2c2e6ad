"""The parallel keep-if-changed fold equals a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import emission
from flowlens.operators.emission import keep_changed

SEC = 1_000_000


def loop(rows, force, min_p=1, min_b=1):
    kept, state = set(), {}
    for key, ts, rid, p, b, fresh in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.get(key)
        if (
            s is None or fresh or p < s[1] or b < s[2] or p - s[1] >= min_p or b - s[2] >= min_b or ts - s[0] >= force
        ):
            kept.add(rid)
            state[key] = (ts, p, b)
    return kept


@pytest.mark.parametrize("limit", [1024, 4])
@pytest.mark.parametrize("seed,min_p", [(1, 1), (2, 3), (3, 5)])
def test_fold(spark, monkeypatch, seed, min_p, limit):
    monkeypatch.setattr(emission, "LIMIT", limit)
    rnd = random.Random(seed)
    rows, count = [], {}
    for i in range(1500):
        key = "hot" if rnd.random() < 0.35 else f"k{rnd.randrange(40)}"
        c = count.get(key, 0) + (rnd.random() < 0.3) * rnd.randrange(3)
        if rnd.random() < 0.02:
            c = 0
        count[key] = c
        rows.append((key, i * SEC // 3, i, c, c * 10, rnd.random() < 0.02))
    df = spark.createDataFrame(rows, "key string, ts_us long, row_id long, p long, b long, fresh boolean")
    out = keep_changed(
        df, ["key"], 5 * SEC, F.col("p"), F.col("b"), F.col("fresh"), min_p, 10 * min_p, block_us=21 * SEC
    )
    assert {r.row_id for r in out.select("row_id").collect()} == loop(rows, 5 * SEC, min_p, 10 * min_p)


@pytest.mark.parametrize("gap", [1, 3, 5])
def test_cooldown_dense_key(spark, monkeypatch, gap):
    """A key that never falls silent, longer than an array: ranked by pointer doubling."""
    monkeypatch.setattr(emission, "LIMIT", 16)
    rows = [("a", i * gap * SEC // 2, i, 1, 0, False) for i in range(800)]
    df = spark.createDataFrame(rows, "key string, ts_us long, row_id long, p long, b long, fresh boolean")
    out = {r.row_id for r in keep_changed(df, ["key"], 5 * SEC, block_us=20 * SEC).collect()}
    assert out == loop(rows, 5 * SEC)


def test_ranked_lists_of_uneven_rows(spark, monkeypatch):
    monkeypatch.setattr(emission, "LIMIT", 3)
    rnd = random.Random(6)
    rows, at = [], {"a": 0, "b": 7}
    for i in range(600):
        key = rnd.choice("ab")
        at[key] += rnd.choice([0, 0, 1, 3, 99, 100, 101, 40, 250])
        rows.append((key, at[key], i, 1, 0, rnd.random() < 0.005))
    df = spark.createDataFrame(rows, "key string, ts_us long, row_id long, p long, b long, fresh boolean")
    out = keep_changed(df, ["key"], 100, fresh=F.col("fresh"), block_us=1000)
    assert {r.row_id for r in out.collect()} == loop(rows, 100)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_cooldown_exactly_elapsed(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 5 * SEC, 2), ("a", 10 * SEC - 1, 3)], "key string, ts_us long, row_id long")
    assert {r.row_id for r in keep_changed(df, ["key"], 5 * SEC).collect()} == {1, 2}


def test_keys_with_nulls_are_apart_and_timeless_rows_stay(spark):
    rows = [("a", None, 1, 1), (None, "a", 2, 2), ("a", None, 3, 3), ("a", "a", None, 4), ("a", "a", 5, 5), ("a", "a", None, 6)]
    df = spark.createDataFrame(rows, "k string, l string, ts_us long, row_id long")
    kept = emission.keep_changed(df, ["k", "l"], 100, block_us=1000)
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_dense_key(spark):
    """A million rows of one key within one cool-down, and the next one after it."""
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("ts_us"), F.col("id").alias("row_id"))
    df = df.unionByName(spark.createDataFrame([("k", 2_000_000, 2_000_000)], "k string, ts_us long, row_id long"))
    kept = emission.keep_changed(df, ["k"], 1_500_000, block_us=10_000_000)
    assert sorted(r["row_id"] for r in kept.collect()) == [0, 2_000_000]
