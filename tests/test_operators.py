"""Edge cases of the operators on small literal frames."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import alerts, features, metrics, polls, quantiles, rules, scaling, snapshots, windows
from flowlens.plans import queries
from flowlens.policy import BUNDLE_POLICY, DEPLOYMENT_POLICY, Policy, feature_names, feature_weights
from flowlens.session import stage

SEC = 1_000_000


def one(spark, value, ddl, col):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, "Normal"), ("", "Normal"), ("NaN", "Normal"), ("BENIGN", "Normal"), (" background ", "Normal"),
        ("DDoS-LOIT", "DDoS"), ("DoS Hulk", "DoS"), ("Port_Scan", "Probe"), ("SSH-Patator", "BFA"), ("Web Attack - XSS", "Web-Attack"),
        ("Bot", "BOTNET"), ("u2r", "U2R"), ("Infiltration", "U2R"), (" Heartbleed ", "Heartbleed"), ("Slow-dos", "Slow-dos"),
    ],
)
def test_labels(spark, raw, want):
    assert one(spark, raw, "v string", S.normalise_label("v")) == want


@pytest.mark.parametrize(
    "raw,want",
    [("12", 12.0), (" 1.5 ", 1.5), ("1e3", 1000.0), ("inf", -1.0), ("nan", -1.0), ("x", -1.0), (None, -1.0), ("12d", -1.0), ("-.5", -0.5)],
)
def test_num(spark, raw, want):
    assert one(spark, raw, "v string", S.num("v", -1.0)) == want


def test_parse_meta(spark):
    assert one(spark, "a=1, b = x=y ,bad,a=2", "v string", S.parse_meta("v")) == {"a": "2", "b": "x=y"}


def test_label_index_unknown(spark):
    df = features.with_label_columns(spark.createDataFrame([("Heartbleed",), ("bot",)], "label_raw string"))
    assert [(r.label_index, r.is_attack) for r in df.collect()] == [(0, 1), (6, 1)]


def test_zero_duration_and_no_packets(spark):
    df = spark.createDataFrame(
        [(3, 2, 300, 200, 0, 80, 70000, 6), (0, 0, 0, 0, 2_000_000, -1, 443, 17)],
        "fwd_pkts long, bwd_pkts long, fwd_bytes long, bwd_bytes long, duration_us long, src_port long, dst_port long, protocol long",
    )
    a, b = features.with_flow_features(df).collect()
    assert math.isclose(a.packet_rate, 5 / 1e-6) and a.avg_packet_size == 100.0 and a.dst_port_norm == 1.0
    assert (b.packet_rate, b.avg_packet_size, b.flow_duration_s, b.src_port_norm) == (0.0, 0.0, 2.0, 0.0)


def test_match_extraction(spark):
    js = '[{"OXMTlv": {"field": "ipv4_src", "value": " 1.1.1.1 "}}, {"field": "udp_dst", "value": "53"}, {"OXMTlv": {"field": "ip_proto", "value": "17"}}]'
    r = features.extract_match(spark.createDataFrame([(js,)], "match string")).first()
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol) == ("1.1.1.1", "", -1, 53, 17)


def poll(spark, rows):
    data = [(i, t * SEC, 1, "a", "b", 1000, 80, 6, p, b, float(d)) for i, (t, p, b, d) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "row_id long, ts_us long, dpid long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, "
        "packet_count long, byte_count long, duration_s double",
    )


def test_counter_reset(spark):
    out = polls.with_poll_deltas(poll(spark, [(0, 10, 100, 1), (1, 4, 40, 2)])).orderBy("row_id").collect()
    assert not out[0].has_history and out[1].has_history
    assert (out[1].packet_delta, out[1].byte_delta) == (0.0, 0.0) and out[1].packet_rate_delta == 4 / 2 - 10


def test_idle_restarts_history(spark):
    out = polls.with_poll_deltas(poll(spark, [(0, 1, 1, 1), (120, 2, 2, 1), (241, 3, 3, 1)]), idle_timeout_s=120).orderBy("row_id")
    assert [r.has_history for r in out.collect()] == [False, True, False]


def test_track_flows_reset_and_force(spark):
    rows = [(0, 0, 0, 0), (1, 5, 50, 1), (2, 5, 50, 2), (3, 3, 30, 1), (10, 3, 30, 5), (18, 3, 30, 6)]
    out = polls.track_flows(poll(spark, rows), Policy(force_emit_after_s=15.0)).orderBy("row_id").collect()
    assert [r.row_id for r in out] == [1, 3, 5]
    assert out[0].has_history is False and out[1].packet_delta == 0.0


def test_votes(spark):
    df = spark.createDataFrame(
        [("k", i, i, l) for i, l in enumerate(["DoS", "BFA", "Normal", "Normal", "Normal"])], "k string, ts_us long, row_id long, label string"
    )
    pick = lambda mode: snapshots.vote_label(df, ["k"], mode).first()["label"]
    assert (pick("any_attack_priority"), pick("majority"), pick("last_step")) == ("DoS", "Normal", "BFA")
    arr = df.agg(F.array_agg("label").alias("a"))
    got = arr.select(*[snapshots.vote_array(F.col("a"), m).alias(m) for m in ("any_attack_priority", "majority", "last_step")]).first()
    assert tuple(got) == ("DoS", "Normal", "BFA")


def _flow(spark, start_us, dur, packets=100.0):
    return spark.createDataFrame(
        [(1, "f", "f1", "a", "b", 1, 2, 6, start_us, dur, packets, 1000.0, "Normal", 0, 0)],
        "row_id long, source_file string, flow_id string, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, "
        "ts_us long, flow_duration_s double, packet_count double, byte_count double, label string, label_index long, is_attack long",
    )


def test_poll_at_flow_start(spark):
    """An aligned long flow gives max_polls + 1 snapshots; the first is empty."""
    out = snapshots.expand_snapshots(_flow(spark, 4 * SEC, 100.0), 2.0, 6, anchor_s=0.0).orderBy("poll_index").collect()
    assert len(out) == 7 and out[0].packet_count == 0.0 and out[1].packet_count == pytest.approx(2.0)


def test_short_flow_gives_one_snapshot(spark):
    out = snapshots.expand_snapshots(_flow(spark, 4 * SEC + 1, 0.1), 2.0, 6, anchor_s=0.0).collect()
    assert len(out) == 1 and out[0].snapshot_frac == 1.0 and out[0].packet_count == 100.0


def test_split_group_counts(spark):
    for n, want in [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (20, (14, 3, 3))]:
        g = spark.createDataFrame(
            [("f", f"k{i:03d}", "DoS", 1, i * SEC, i * SEC) for i in range(n)],
            "source_file string, conversation_key string, label string, n_windows long, start_us long, end_us long",
        )
        got = {r["split"]: r["count"] for r in windows.split_groups(g).groupBy("split").count().collect()}
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_windows_never_cross_a_split(spark):
    rnd = random.Random(3)
    rows = [("f", rnd.choice("ab"), i, i, rnd.choice(["Normal", "DoS"]), 0, float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "source_file string, conversation_key string, ts_us long, row_id long, label string, is_attack long, packet_count double")
    split = windows.split_chronological(df, gap=1).cache()
    where = {r.row_id: r.split for r in split.collect()}
    w = windows.sequence_windows(split, keys=["source_file", "conversation_key", "split"]).collect()
    assert w
    for r in w:
        ids = [int(v[0]) for v in r.window]
        assert {where[i] for i in ids} == {r.split}


def test_quantiles_exact_with_heavy_ties(spark):
    rnd = random.Random(5)
    for n, ties in [(1, 0.0), (7, 0.0), (500, 0.4), (2000, 0.9)]:
        xs = [0.5 if rnd.random() < ties else rnd.random() for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "v double")
        at = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
        out = {r.q: r.value for r in quantiles.exact_quantiles(df, F.col("v"), at, ranges=16).collect()}
        import numpy as np

        assert all(out[q] == pytest.approx(float(np.quantile(xs, q)), abs=1e-12) for q in at)


def test_curve_metrics_against_loops(spark):
    rnd = random.Random(8)
    rows = [(round(rnd.random() * 0.7 + 0.3 * y, 2), "DoS" if y else "Normal") for y in (rnd.random() < 0.3 for _ in range(400))]
    df = spark.createDataFrame(rows, "score double, label string").cache()
    pos = [s for s, l in rows if l == "DoS"]
    neg = [s for s, l in rows if l != "DoS"]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    assert metrics.roc_auc(df, metrics.LOWER).first()[0] == pytest.approx(1 - auc)
    best = 0.0
    for t in sorted({s for s, _ in rows}):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        best = max(best, 2 * tp / (tp + fp + len(pos)))
    assert metrics.best_f1_threshold(df).first()["best_f1"] == pytest.approx(best)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0.1, "Normal"), (0.2, "Normal")], "score double, label string")
    assert metrics.roc_auc(df).first()[0] is None
    m = metrics.binary_metrics(df, 0.5).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    assert metrics.threshold_at_fpr(df.filter("score > 9"), 0.01).first()["threshold"] == 0.0


def test_quantile_transform_edges(spark):
    st = scaling.QuantileStats(("x",), (0.0, 0.5, 1.0), ((0.0, 10.0, 20.0),), (0.0,), (1.0,))
    df = spark.createDataFrame([(-5.0,), (5.0,), (25.0,), (float("nan"),)], "x double")
    assert [r.x for r in scaling.apply_quantile(df, st).collect()] == [0.0, 0.25, 1.0, 0.0]


def test_weights_and_policies():
    w = feature_weights(feature_names())
    assert sum(w) / len(w) == pytest.approx(1.0)
    assert BUNDLE_POLICY.scan_unique_ports == 10 and DEPLOYMENT_POLICY.alert_cooldown_seconds == 2.0
    assert Policy.from_dict({"alert_hold_seconds": 40}).entity_idle_timeout_s == 40
    with pytest.raises(ValueError):
        feature_names("nope")


def obs_row(i, t, src="10.0.0.1", dst="10.0.1.0", sport=2000, dport=22, proto=6, **kw):
    base = dict(row_id=i, ts_us=int(t * SEC), dpid=1, src_ip=src, dst_ip=dst, src_port=sport, dst_port=dport, protocol=proto,
                packet_count=1.0, byte_count=60.0, packet_rate=1.0, byte_rate=60.0, avg_packet_size=60.0, packet_delta=0.0,
                byte_delta=0.0, has_history=False, score=None)
    return {**base, **kw}


OBS = (
    "row_id long, ts_us long, dpid long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, packet_count double, "
    "byte_count double, packet_rate double, byte_rate double, avg_packet_size double, packet_delta double, byte_delta double, "
    "has_history boolean, score double"
)


def obs(spark, rows):
    names = [c.split()[0] for c in OBS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBS)


def test_scan_window_edge(spark):
    """A row exactly at the window edge still counts."""
    p = Policy(scan_window_s=6, scan_unique_ports=2, scan_attack_unique_ports=3)
    rows = [obs_row(1, 0, dport=20), obs_row(2, 6, dport=21), obs_row(3, 6.000001, dport=22)]
    out = {r.row_id: r.scan for r in rules.scan_support(obs(spark, rows), p).collect()}
    assert out[1] is None and out[2]["hit_count"] == 2 and out[3]["hit_count"] == 2


def test_decisions(spark):
    p = Policy(bfa_attempt_threshold=2, bfa_attack_threshold=9, threshold=0.5, min_alert_hits=2)
    rows = [
        obs_row(1, 0, dport=8080, score=0.6),
        obs_row(2, 1, dport=8080, score=0.7),
        obs_row(3, 2, dport=8080, score=0.1),
        obs_row(4, 3, dport=8080, score=0.9),
        obs_row(5, 4, src="10.0.0.2"),
        obs_row(6, 5, src="10.0.0.2"),
    ]
    out = {r.row_id: r for r in rules.decide(obs(spark, rows), p).collect()}
    assert [out[i].status for i in range(1, 7)] == ["SUSPECT", "ATTACK", "NORMAL", "SUSPECT", "NORMAL", "ATTACK"]
    assert out[2].reason.startswith("model threshold hit 2 times (margin=0.20000)")
    assert out[6].reason.startswith("rule-confirmed attack | bfa support: 2 short TCP attempts")
    assert out[6].emit_key == "bfa:10.0.0.2->10.0.1.0:22" and not out[6].block
    assert len(alerts.alert_rows(spark.createDataFrame([], rules.decide(obs(spark, rows), p).schema)).columns) == 25


def test_emergency(spark):
    p = Policy(emergency_rules_enabled=True, rules_only_attack_enabled=True, hard_packet_rate=10, udp_flood_packet_rate=10)
    rows = [obs_row(1, 0, dport=5000, proto=17, has_history=True, packet_delta=5.0, packet_rate=50.0)]
    r = rules.decide(obs(spark, rows), p).first()
    assert r.status == "ATTACK" and r.reason.startswith("emergency rules-only attack | udp flood") and r.category == "UDP-Flood"


def test_repeated_and_parted_replies_are_one_reply(spark):
    asked = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 0)], "dpid long, poll_cycle_id long, request_us long")
    replies = [(1, 1, 10, 5, 1), (1, 1, 20, 7, 1), (1, 1, 20, 7, 1), (1, 2, 3_000_000, 1, 1)]
    got = spark.createDataFrame(replies, "dpid long, poll_cycle_id long, reply_us long, flows long, parts long")
    rows = {(r.dpid, r.poll_cycle_id): r for r in polls.correlate_polls(asked, got, 1.0).collect()}
    assert len(rows) == 3
    r = rows[1, 1]
    assert (r.reply_us, r.flows, r.parts, r.timed_out, r.reply_delay_ms) == (20, 12, 2, False, 0.02)
    assert rows[1, 2].timed_out and rows[2, 1].timed_out


def test_unscored_rows_are_left_out_of_binary_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, 0.1)], "is_attack int, score double")
    r = metrics.binary_metrics(df, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.recall) == (1, 0, 0, 1.0)


def test_decisions_stage_and_sort_numbers_only(spark, monkeypatch):
    staged = {}

    def record(df, name="stage", partition_by=None):
        staged[name] = df.columns
        return stage(df, name, partition_by)

    monkeypatch.setattr(rules, "stage", record)
    p = Policy(bfa_attempt_threshold=1, scan_unique_ports=1, threshold=0.5, min_alert_hits=2)
    rows = [obs_row(i, i, src="10.0.0.1", score=0.6 if i < 3 else None) for i in range(1, 5)]
    wide = obs(spark, rows).withColumns({"gap_us": F.lit(None).cast("long"), "note": F.concat(F.lit("n"), F.col("row_id"))})
    kept = rules.decide(wide, p)
    assert {r.row_id: r.note for r in kept.collect()} == {i: f"n{i}" for i in range(1, 5)}
    out = rules.decide(wide.select(*rules.DECISION_COLUMNS), p)
    assert set(staged["observations"]) == set(rules.DECISION_COLUMNS)
    assert not {"scan", "bfa", "supports", "note"} & set(staged["rule-windows"])
    assert sorted(map(str, out.collect())) == sorted(map(str, kept.select(*out.columns).collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # texts of supports are made above the last window, not below it
    assert plan.index("scan support: ") < plan.index("Window ")


@pytest.mark.parametrize("name", ["r10_alert_rows", "r11_block_candidates"])
def test_filters_on_decisions_read_a_table(spark, tmp_path, name):
    """A filter by status or block is not worked out anew, nested, below the decision."""
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 5, i % 24), i % 7, "click", float(i % 90), '{"k": 5}') for i in range(120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet")
    )
    out = queries.QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "support" not in plan.replace("support_sources", "")
    assert out.count()
