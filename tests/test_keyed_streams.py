"""Streams on keyed state against the batch operators, over micro-batches of any cut."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import alerts, polls, rules
from flowlens.policy import Policy
from flowlens.session import new_path, stage
from flowlens.sources import exports
from flowlens.streaming import keyed, meters, streams


def _parts(spark, df, cuts, closing):
    """Files of ``df`` cut at times, in order, then a row far behind the end."""
    path = new_path(spark, "cut-stream")
    df = stage(df, "cut-input")
    bounds = [-(2**62), *cuts, 2**62]
    for lo, hi in zip(bounds, bounds[1:]):
        df.filter((F.col("ts_us") >= lo) & (F.col("ts_us") < hi)).coalesce(1).write.mode("append").parquet(path)
    end = df.agg(F.max("ts_us")).first()[0] + 10**12
    cols = closing | {"ts_us": F.lit(end)}
    df.limit(1).select(*[(cols[c].cast(t) if c in cols else F.col(c)).alias(c) for c, t in df.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return path


def _run(spark, df, name):
    path = new_path(spark, name)
    streams.run_to_end(exports.stream_rows(df, path, new_path(spark, "cut-check")))
    return spark.read.schema(df.schema).parquet(path)


def _decisions(n, seed, step):
    r = random.Random(seed)
    at, out = 1_000_000_000, []
    for i in range(n):
        at += r.choice([0, 1, step, 3 * step, 20 * step])
        score = r.choice([None, round(r.random(), 3)])
        out.append((f"r{r.randrange(2)}", i, at, r.choice(["NORMAL", "attack", "SUSPECT", "odd"]), f"why {i}", score, r.choice(["DDoS", "", None])))
    return out


@pytest.mark.parametrize(("hold", "idle"), [(8.0, 20.0), (20.0, 8.0), (8.0, 8.0)])
def test_run_status_stream_is_the_batch(spark, hold, idle):
    schema = "run_id string, row_id long, ts_us long, status string, reason string, score double, category string"
    df = spark.createDataFrame(_decisions(120, 5, 2_000_000), schema)
    policy = Policy.from_dict({"threshold": 0.7, "alert_hold_seconds": hold, "runtime_idle_reset_s": idle})
    want = sorted(map(tuple, alerts.run_status(df, policy).collect()), key=repr)
    times = sorted(r.ts_us for r in df.collect())
    for cuts in ([], [times[40]], [times[i] for i in (10, 11, 60, 90)]):
        path = _parts(spark, df, cuts, {"run_id": F.lit("closing"), "row_id": F.lit(-1)})
        out = _run(spark, keyed.run_status_stream(streams.table_stream(spark, path, 1), policy, late="1 second"), "status")
        assert sorted(map(tuple, out.filter("run_id <> 'closing'").collect()), key=repr) == want


def test_sequences_restart_after_idle_and_removal(spark):
    r = random.Random(3)
    rows = [(f"k{i % 3}", i, 1_000_000 * (i + 1 + (200 if i > 40 else 0)), [float(i), 0.5], r.random() < 0.1) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, row_id long, ts_us long, feature_vector array<double>, gone boolean")
    show = lambda d: sorted((x.row_id, x.buffered, x.phase, x.window) for x in d.filter("row_id >= 0").collect())
    want = show(polls.rolling_sequences(df, 3, keys=["k"], idle_timeout_s=100.0, removed="gone"))
    for cuts in ([21_000_000], [6_000_000, 7_000_000, 46_000_000, 251_000_000]):
        path = _parts(spark, df, cuts, {"k": F.lit("closing"), "row_id": F.lit(-1)})
        out = keyed.rolling_sequences_stream(streams.table_stream(spark, path, 1), 3, keys=["k"], idle_timeout_s=100.0, removed="gone", late="1 second")
        assert show(_run(spark, out, "sequences")) == want


def _observations(n, seed):
    r = random.Random(seed)
    at, out = 10_000_000_000, []
    for i in range(n):
        at += r.choice([0, 1, 500_000, 7_000_000, 40_000_000])
        proto = r.choice([6, 6, 17])
        out.append((i, at, 1, f"1.1.1.{r.randrange(2)}", "2.2.2.2", r.choice([2000, 2001]), r.choice([22, 80, 443, 23, 8080]), proto, float(r.randrange(0, 90)) / 7,
                    float(r.randrange(0, 900)) / 3, float(r.randrange(0, 5)), float(r.randrange(0, 500)), r.random() < 0.8, r.choice([None, r.random()]), 100.0, 10.0, 1000.0))
    return out


def test_rules_stream_is_the_batch_over_overlapping_slices(spark):
    schema = ("row_id long, ts_us long, dpid long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, packet_rate double, byte_rate double, "
              "packet_delta double, byte_delta double, has_history boolean, score double, avg_packet_size double, packet_count double, byte_count double")  # fmt: skip
    policy = Policy.from_dict({"threshold": 0.5, "scan_window_s": 30, "scan_unique_ports": 2, "scan_attack_unique_ports": 3, "bfa_window_s": 25, "bfa_attempt_threshold": 2, "bfa_attack_threshold": 4,
                               "baseline_window_s": 60, "baseline_min_samples": 2, "rate_multiplier_warn": 1.1, "rate_multiplier_attack": 1.6, "entity_idle_timeout_s": 30, "udp_flood_packet_rate": 9,
                               "allowlisted_services": {"2.2.2.2": [80]}})
    df = polls.blocked.with_previous(spark.createDataFrame(_observations(160, 9), schema), polls.FLOW_KEY, polls.ORDER, {"_p": "ts_us"}, polls.blocked.time_block(10**9))
    df = stage(df.withColumn("gap_us", F.col("ts_us") - F.col("_p")).drop("_p"), "rule-rows")
    cols = ["row_id", "status", "reason", "severity", "hit_count", "emit_key", "decision_source", "category", "support_sources", "support_reasons"]
    want = sorted(map(repr, rules.decide(df, policy).select(*cols).collect()))
    times = sorted(r.ts_us for r in df.select("ts_us").collect())
    path, windows, out = (new_path(spark, n) for n in ("observations", "windows", "decided"))
    checks = [new_path(spark, "check") for _ in range(2)]
    bounds = [0, times[30], times[31], times[100], 2**62]
    closing = df.limit(1).withColumns({"src_ip": F.lit("closing"), "row_id": F.lit(-1).cast("long"), "ts_us": F.lit(times[-1] + 10**12)})
    # both queries go on from their state after each slice
    for part in [df.filter((F.col("ts_us") >= lo) & (F.col("ts_us") < hi)) for lo, hi in zip(bounds, bounds[1:])] + [closing]:
        part.repartition(3).write.mode("append").parquet(path)
        q = keyed.rule_windows_stream(streams.table_stream(spark, path), policy, windows, checks[0], late="1 second")
        streams.run_to_end(q)
        found = streams.table_stream(spark, windows).drop("batch")
        q2 = keyed.rule_decisions_stream(found, policy, out, checks[1], late="1 second")
        streams.run_to_end(q2)
    assert sorted(map(repr, spark.read.parquet(out).filter("row_id >= 0").select(*cols).collect())) == want
    # cells and streaks behind the closing row's watermark are gone; the two numbers of an entity stay
    left, counters = (x.lastProgress["stateOperators"][0]["numRowsTotal"] for x in (q, q2))
    assert left <= 6 and counters < 40, (left, counters)


def test_a_repeated_run_or_batch_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    path = str(tmp_path / "alerts")
    assert exports.write_alerts(df, path, "run/1 b") and not exports.write_alerts(df, path, "run/1 b")
    assert exports.write_alerts(df, path, "run 2")
    assert sorted((r.x, r.run) for r in spark.read.parquet(path).collect()) == [(1, "run 2"), (1, "run/1 b"), (2, "run 2"), (2, "run/1 b")]
    (tmp_path / "alerts" / "_run=3-part").mkdir()  # a job that was lost on the way leaves a hidden folder
    assert spark.read.parquet(path).count() == 4


def test_listener_adds_up_all_queries(spark):
    counters = meters.Counters()
    spark.streams.addListener(counters)
    try:
        path = new_path(spark, "metered")
        spark.range(30).write.parquet(path)
        df = meters.counted(streams.table_stream(spark, path), "seen", even=F.count_if(F.col("id") % 2 == 0))
        q = df.writeStream.queryName("metered").format("noop").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "check")).start()
        streams.run_to_end(q)
        for _ in range(100):
            if counters.read("metered").rows_in:
                break
            spark.range(1000).count()
        total = counters.read("metered")
        assert (total.rows_in, total.rows_late, total.observed["seen.rows"], total.observed["seen.even"]) == (30, 0, 30, 15)
        assert meters.of_query(q).rows_in == 30
    finally:
        spark.streams.removeListener(counters)


class _State:
    """List or value state of one key in memory."""

    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return [] if self.rows is None else self.rows

    def put(self, rows):
        self.rows = rows

    update = put


class _Handle:
    def __init__(self):
        self.states = {}

    def getListState(self, name, _schema):
        return self.states.setdefault(name, _State())

    getValueState = getListState

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


def _statuses(batches, policy):
    handle = _Handle()
    out = []
    for rows in batches:
        processor = keyed.RunStatus(policy, ["run_id"])
        processor.init(handle)
        frame = pd.DataFrame(rows, columns=["row_id", "ts_us", "status", "reason", "score", "category"]).astype({"score": "float64"})
        half = len(frame) // 2
        for got in processor.handleInputRows(("r",), iter([frame[:half], frame[half:]]), handle):
            out += got.itertuples(index=False, name=None)
    return out, handle.states["evidence"].rows


def test_a_run_with_many_rows_in_its_hold():
    """Each row used to look through the evidence of the whole hold."""
    n = 40_000
    rows = [(i, 1_000 * i, ["NORMAL", "SUSPECT", "NORMAL"][i % 3], "why", (n - i) / n, "DDoS") for i in range(n)]
    policy = Policy.from_dict({"threshold": 2.0, "alert_hold_seconds": 30.0, "runtime_idle_reset_s": 10**6})
    began = time.process_time()
    out, evidence = _statuses([rows], policy)
    assert time.process_time() - began < 20
    assert len(out) == n and len(evidence) == 30_001
    assert out[-1][5:] == ("active", sum(i % 3 == 1 for i in range(n - 30_001, n)), 30_001 / n)


def test_evidence_expires_around_late_rows():
    r = random.Random(8)
    late = [r.randrange(0, 400) for _ in range(300)]
    entries = [(t, r.randrange(3), r.choice([None, 0.0, r.random()]), r.choice([None, "", "a", "b"])) for t in late]
    fast, plain = keyed._Evidence([]), []
    for e in entries:
        fast.expire(e[0] - 40)
        fast.add(e)
        plain = [x for x in plain if x[0] >= e[0] - 40] + [e]
        worst = max(plain, key=lambda e: (e[1], e[2] is not None, e[2] or 0.0, e[3] is not None, e[3] or ""))
        assert list(fast.entries.values()) == plain and fast.signals == sum(x[1] > 0 for x in plain)
        assert (fast.worst()[1], fast.worst()[3]) == (worst[1], worst[3])
        assert fast.peak() == max((x[2] for x in plain if x[2] is not None), default=None)


def test_flows_share_a_bounded_number_of_states(spark):
    """Each flow used to cost a call and frames of its own; NULL keys are keys."""
    r = random.Random(4)
    rows = [(r.choice([None, *range(120)]), i, 10_000_000 * (i + 1), float(r.randrange(6)), 0.0, 1.0, i % 11 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, row_id long, ts_us long, packet_count double, byte_count double, duration_s double, removed boolean")
    df = df.withColumns({c: F.lit(6).cast("long") for c in ("src_port", "dst_port", "protocol")})
    policy = Policy.from_dict({"idle_timeout_s": 900, "force_emit_after_s": 300})
    show = lambda d: sorted(map(repr, d.filter("row_id >= 0").select("k", "row_id", "has_history", "packet_delta", "packet_rate_delta").collect()))
    want = show(polls.track_flows(df, policy, ["k"], removed="removed"))
    path = _parts(spark, df, [1_000_000_000, 3_500_000_000], {"row_id": F.lit(-1)})
    sink = new_path(spark, "tracked")
    out = streams.track_flows_stream(streams.table_stream(spark, path, 1), policy, ["k"], "1 second", "removed", buckets=8)
    q = exports.stream_rows(out, sink, new_path(spark, "check"))
    streams.run_to_end(q)
    assert show(spark.read.parquet(sink)) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8


def test_alerts_share_a_bounded_number_of_states(spark):
    r = random.Random(5)
    rows = [(f"e{r.randrange(90)}", i, 1_000_000 * (1 + i // 2), "ATTACK") for i in range(500)]
    df = spark.createDataFrame(rows, "entity_key string, row_id long, ts_us long, status string").withColumn("emit_key", F.lit(""))
    want = sorted(x.row_id for x in alerts.emit_alerts(df, 60.0).collect())
    path = _parts(spark, df, [90_000_000, 200_000_000], {"row_id": F.lit(-1)})
    sink = new_path(spark, "alerts")
    q = exports.stream_rows(streams.alerts_stream(streams.table_stream(spark, path, 1), 60.0, "1 second", buckets=8), sink, new_path(spark, "check"))
    streams.run_to_end(q)
    assert sorted(x.row_id for x in spark.read.parquet(sink).filter("row_id >= 0").collect()) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8


class _Cells(_State):
    """Map state of one key in memory."""

    def __init__(self):
        self.cells = {}

    def containsKey(self, c):
        return c in self.cells

    def getValue(self, c):
        return self.cells[c]

    def updateValue(self, c, value):
        self.cells[c] = value


def test_rows_of_a_scope_look_into_two_cells(monkeypatch):
    """Each row used to look into all cells of its window."""
    r = random.Random(6)
    at = sorted(r.randrange(0, 400) for _ in range(300))
    rows = [(t, i, r.randrange(5), r.random() < 0.7, str(r.randrange(9)), "1") for i, t in enumerate(at)]
    looks = [0]
    for cls in (keyed._Sums, keyed._Ports):
        plain = cls.between
        monkeypatch.setattr(cls, "between", lambda self, lo, hi, plain=plain: (looks.__setitem__(0, looks[0] + 1), plain(self, lo, hi))[1])
    for kind in ("scan", "bfa", "service"):
        handle = _Handle()
        handle.getMapState = lambda name, *_, h=handle: h.states.setdefault(name, _Cells())
        looks[0], got = 0, []
        for part in (rows[:110], rows[110:]):
            processor = keyed.ScopeWindows({kind: 160})
            processor.init(handle)
            frame = pd.DataFrame(part, columns=["ts_us", "row_id", "port", "seen", "p", "b"])
            for f in processor.handleInputRows((kind, "x"), iter([frame]), handle):
                got += [next(v for v in (x.ports, x.tries, x.n) if not pd.isna(v)) for x in f.itertuples()]
        inside = lambda t: [x for x in rows if x[0] >= t[0] - 160 and x[:2] <= t[:2]]
        want = {"scan": lambda t: len({x[2] for x in inside(t)}), "bfa": lambda t: len(inside(t)), "service": lambda t: sum(x[3] for x in inside(t) if x[:2] < t[:2])}[kind]
        assert got == [want(t) for t in rows]
        assert looks[0] <= 2 * len(rows)


def test_sequences_share_a_bounded_number_of_states(spark):
    """Each flow used to cost calls, frames and a timer of its own; NULL keys are keys."""
    r = random.Random(5)
    rows = [(r.choice([None, *range(120)]), r.choice(["a", None]), i, 10_000_000 * (i + 1), [float(i), 0.5], i % 11 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, s string, row_id long, ts_us long, feature_vector array<double>, gone boolean")
    show = lambda d: sorted(map(repr, d.filter("row_id >= 0").select("k", "s", "row_id", "buffered", "phase", "window").collect()))
    want = show(polls.rolling_sequences(df, 3, keys=["k", "s"], idle_timeout_s=900.0, removed="gone"))
    path = _parts(spark, df, [1_000_000_000, 3_500_000_000], {"row_id": F.lit(-1)})
    sink = new_path(spark, "sequences")
    out = keyed.rolling_sequences_stream(streams.table_stream(spark, path, 1), 3, keys=["k", "s"], idle_timeout_s=900.0, removed="gone", late="1 second", buckets=8)
    q = exports.stream_rows(out, sink, new_path(spark, "check"))
    streams.run_to_end(q)
    assert show(spark.read.parquet(sink)) == want
    # one list and its length a bucket
    calls = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
    assert max(m["numRegisteredTimers"] for m in calls) <= 3 * 8
