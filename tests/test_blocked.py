"""Blocked windows against plain loops, with a key that holds a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import blocked

SEC = 1_000_000
BLOCK = 7 * SEC  # many blocks per key
ORDER = ["ts_us", "row_id"]


def make_rows(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(12)}"
        rows.append((key, rnd.randrange(0, 120 * 4) * SEC // 4, i, rnd.randrange(5), rnd.random() < 0.2))
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def data(spark, request):
    rows = make_rows(request.param)
    df = spark.createDataFrame(rows, "key string, ts_us long, row_id long, v long, r boolean").repartition(5)
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    return df.cache(), by_key


def got(df, *cols):
    return {r["row_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_ranked(data):
    df, by_key = data
    out = got(blocked.ranked(df, ["key"], ORDER, blocked.time_block(BLOCK)), "rn", "n")
    want = {r[2]: (i + 1, len(rs)) for rs in by_key.values() for i, r in enumerate(rs)}
    assert out == want


def test_running_sums(data):
    df, by_key = data
    out = got(blocked.running_sums(df, ["key"], ORDER, {"s": F.col("v")}, blocked.time_block(BLOCK)), "s")
    want = {}
    for rs in by_key.values():
        s = 0
        for r in rs:
            s += r[3]
            want[r[2]] = (s,)
    assert out == want


def test_running_since_reset(data):
    df, by_key = data
    c = {"s": (F.col("v"), F.col("r")), "c": (F.lit(1), F.col("v") == 4)}
    out = got(blocked.running_since_reset(df, ["key"], ORDER, c, blocked.time_block(BLOCK)), "s", "c")
    want = {}
    for rs in by_key.values():
        s = k = 0
        for r in rs:
            s = r[3] if r[4] else s + r[3]
            k = 1 if r[3] == 4 else k + 1
            want[r[2]] = (s, k)
    assert out == want


def test_previous_next_recent(data):
    df, by_key = data
    b = blocked.time_block(BLOCK)
    prev = got(blocked.with_previous(df, ["key"], ORDER, {"p": "row_id"}, b), "p")
    nxt = got(blocked.with_next(df, ["key"], ORDER, {"x": "row_id"}, b), "x")
    rec = got(blocked.with_recent(df, ["key"], ORDER, F.col("row_id"), 4, b, number="rn", first=F.col("row_id")), "recent", "rn", "first")
    for rs in by_key.values():
        ids = [r[2] for r in rs]
        for i, k in enumerate(ids):
            assert prev[k] == (ids[i - 1] if i else None,)
            assert nxt[k] == (ids[i + 1] if i + 1 < len(ids) else None,)
            assert rec[k] == (ids[max(0, i - 3) : i + 1], i + 1, ids[0])


@pytest.mark.parametrize("window", [2 * SEC, 30 * SEC])
def test_sliding(data, window):
    df, by_key = data
    tot = got(blocked.sliding_totals(df, ["key"], window, {"n": F.lit(1), "s": F.col("v")}, BLOCK), "n", "s")
    before = got(
        blocked.sliding_totals(df, ["key"], window, {"n": F.lit(1)}, BLOCK, include_current=False).fillna(0, ["n"]), "n"
    )
    dis = got(blocked.sliding_distinct(df, ["key"], "v", window, BLOCK, "d", when=~F.col("r")), "d")
    top = got(blocked.sliding_max(df, ["key"], {"m": F.struct("v", "row_id")}, window), "m")
    for rs in by_key.values():
        for i, r in enumerate(rs):
            w = [x for x in rs[: i + 1] if x[1] >= r[1] - window]
            assert tot[r[2]] == (len(w), sum(x[3] for x in w))
            assert before[r[2]] == (len(w) - 1,)
            assert dis[r[2]] == (len({x[3] for x in w if not x[4]}),)
            assert tuple(top[r[2]][0]) == max((x[3], x[2]) for x in w)


# --- NULL keys and times -------------------------------------------------------------


@pytest.fixture(scope="module")
def holes(spark):
    """Rows of which some have no key, some no time, some neither."""
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        key = rnd.choice([None, "a", "b"])
        at = None if rnd.random() < 0.15 else rnd.randrange(0, 240) * SEC // 4
        rows.append((key, at, i, rnd.randrange(5)))
    return spark.createDataFrame(rows, "key string, ts_us long, row_id long, v long").repartition(3), rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_carried_windows_keep_rows_without_key_or_time(holes):
    df, rows = holes
    w = blocked.time_block(BLOCK)
    want = {r[2]: (i + 1, len(rs)) for rs in by_key(rows).values() for i, r in enumerate(rs)}
    assert got(blocked.ranked(df, ["key"], ORDER, w), "rn", "n") == want
    sums = {r[2]: (sum(x[3] for x in rs[: i + 1]),) for rs in by_key(rows).values() for i, r in enumerate(rs)}
    assert got(blocked.running_sums(df, ["key"], ORDER, {"s": F.col("v")}, w), "s") == sums
    assert got(blocked.running_since_reset(df, ["key"], ORDER, {"s": (F.col("v"), F.lit(False))}, w), "s") == sums
    before = {r[2]: (rs[i - 1][2] if i else None,) for rs in by_key(rows).values() for i, r in enumerate(rs)}
    assert got(blocked.with_previous(df, ["key"], ORDER, {"p": "row_id"}, w), "p") == before
    after = {r[2]: (rs[i + 1][2] if i + 1 < len(rs) else None,) for rs in by_key(rows).values() for i, r in enumerate(rs)}
    assert got(blocked.with_next(df, ["key"], ORDER, {"p": "row_id"}, w), "p") == after
    recent = {r[2]: ([x[3] for x in rs[max(0, i - 2) : i + 1]],) for rs in by_key(rows).values() for i, r in enumerate(rs)}
    assert got(blocked.with_recent(df, ["key"], ORDER, F.col("v"), 3, w), "recent") == recent


def test_sliding_windows_keep_rows_without_key_or_time(holes):
    df, rows = holes
    width = 5 * SEC

    def seen(rs, i):
        return [x for x in rs[: i + 1] if (x[1] is None) == (rs[i][1] is None) and (x[1] is None or x[1] >= rs[i][1] - width)]

    each = {r[2]: seen(rs, i) for rs in by_key(rows).values() for i, r in enumerate(rs)}
    out = got(blocked.sliding_totals(df, ["key"], width, {"s": F.col("v")}, BLOCK), "s")
    assert out == {k: (sum(x[3] for x in xs),) for k, xs in each.items()}
    out = got(blocked.sliding_distinct(df, ["key"], "v", width, BLOCK, "n"), "n")
    assert out == {k: (len({x[3] for x in xs}),) for k, xs in each.items()}
    out = got(blocked.sliding_max(df, ["key"], {"m": F.col("v")}, width), "m")
    assert out == {k: (max(x[3] for x in xs),) for k, xs in each.items()}


def test_keys_of_few_rows_need_one_shuffle(spark):
    from flowlens.operators import windows

    rows = [(f"k{i % 7}" if i % 7 else None, i, 3 * i, [float(i)], "Normal" if i % 3 else "DDoS", int(i % 3 == 0), f"f{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, row_id long, ts_us long, feature_vector array<double>, label string, is_attack long, flow_id string")
    blocks = windows.sequence_windows(df, keys=["k"], block_us=10)
    one = windows.sequence_windows(df, keys=["k"], block_us=None)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(repr, one.collect())) == sorted(map(repr, blocks.collect())) and one.columns == blocks.columns


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_keys_take_one_shuffle(data):
    """No summaries of blocks where every key fits a task; windows of one key and order share the shuffle."""
    df, _ = data
    df = df.select("*")
    block = blocked.time_block(BLOCK)
    out = blocked.with_previous(df, ["key"], ORDER, {"p": "v"}, block)
    out = blocked.running_since_reset(out, ["key"], ORDER, {"c": (F.lit(1), F.col("r"))}, block)
    assert plans(out).count("Exchange hashpartitioning") == 1 and "Join" not in plans(out)


def test_large_keys_are_cut(data, monkeypatch):
    """Keys over the limit in blocks and the others whole give what all keys whole give; NULL keys and times are values."""
    df, _ = data
    nulls = df.limit(90).select(F.lit(None).cast("string").alias("key"), F.when(F.col("row_id") % 9 > 0, F.col("ts_us")).alias("ts_us"), (F.col("row_id") + 10_000).alias("row_id"), "v", "r")
    df = df.unionByName(nulls)
    block = blocked.time_block(BLOCK)

    def results():
        keys = ["key"]
        frames = [
            (blocked.ranked(df, keys, ORDER, block), ["rn", "n"]),
            (blocked.running_sums(df, keys, ORDER, {"s": F.col("v")}, block, {"low": F.col("v"), "start": F.col("ts_us")}), ["s", "low", "start"]),
            (blocked.running_since_reset(df, keys, ORDER, {"c": (F.col("v"), F.col("r"))}, block), ["c"]),
            (blocked.with_previous(df, keys, ORDER, {"p": "v", "pt": "ts_us"}, block), ["p", "pt"]),
            (blocked.with_next(df, keys, ORDER, {"p": "v", "pt": "ts_us"}, block), ["p", "pt"]),
            (blocked.with_recent(df, keys, ORDER, F.col("row_id"), 4, block, number="k", first=F.col("row_id")), ["recent", "k", "first"]),
        ]
        return [got(f, *cols) for f, cols in frames], ["Join" in plans(f) for f, _ in frames]

    whole, joined = results()
    assert not any(joined)
    monkeypatch.setattr(blocked, "KEY_ROWS", 60)
    cut, joined = results()
    assert all(joined)
    assert cut == whole
