"""Queries: incidents, searches, runs, rankings, timelines, health, models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import alerts, features, models, polls, rules, runs, scaling, sketches, snapshots, windows
from flowlens.plans import window_queries  # noqa: F401  its SQL pieces
from flowlens.plans.registry import FLOW_COLS, TEST_POLICY as P, piece, query, r6, with_pieces
from flowlens.plans.rule_queries import ENTITY, FLOOD
from flowlens.policy import feature_names
from flowlens.session import stage
from flowlens.sources import exports

R10 = feature_names()

# Alert records without a model: flood and volumetric supports of the poll readings, as
# in the warm-up path.  This is the flagship slice: deltas, windows, rules, roll-up.
ATTACK_NAME = """CASE category WHEN 'UDP-Flood' THEN 'UDP Flood' WHEN 'TCP-Flood' THEN 'TCP Flood' WHEN 'ICMP-Flood' THEN 'ICMP Flood' ELSE 'Traffic Flood' END"""
piece("flood_alerts", ("o_vol",), f"""SELECT row_id, ts_us, dpid, src_ip, dst_ip, src_port, dst_port, protocol, coalesce(f, 'v') AS f, CASE f WHEN 'udp' THEN 'UDP-Flood' WHEN 'icmp' THEN 'ICMP-Flood' WHEN 'tcpflood' THEN 'TCP-Flood' ELSE 'Traffic-Flood' END AS category,
 CASE WHEN f IS NOT NULL OR hard OR attackish THEN 'high' ELSE 'medium' END AS severity, CASE WHEN f IS NOT NULL AND (hard OR warn) THEN greatest(1, volumetric_hits) WHEN f IS NOT NULL THEN 1 ELSE volumetric_hits END AS hit_count,
 round(packet_delta / (packet_delta + 5.0::DOUBLE), 6) AS anomaly_score, 'hits ' || row_id AS reason FROM (SELECT *, {FLOOD} AS f FROM o_vol) t WHERE f IS NOT NULL OR hard OR warn""")


def _flood_alerts(t):
    df = rules.volumetric_support(rules.flood_support(t.obs(), P), P)
    none = F.lit(None).cast(df.schema["flood"].dataType)
    df = rules.support_summary(df.withColumns({"scan": none, "bfa": none, "service": none}))
    d = F.col("packet_delta")
    most = F.array_max(F.transform("supports", lambda x: x["hit_count"]))
    return df.filter(F.col("support_count") > 0).select(
        "row_id", "ts_us", "dpid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.col("support_category").alias("category"),
        F.col("support_severity").alias("severity"), most.alias("hit_count"), F.round(d / (d + 5.0), 6).alias("anomaly_score"),
        F.concat(F.lit("hits "), F.col("row_id").cast("string")).alias("reason"),
    )


piece("incidents", ("flood_alerts",), f"""SELECT {ATTACK_NAME} AS type, src_ip AS src, dst_ip || ':' || dst_port AS dst, max(anomaly_score) AS score, max(hit_count)::BIGINT AS hits, max(ts_us) AS last_us, count(*) AS n_alerts,
 max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)::BIGINT AS severity_rank, arg_max(reason, (ts_us, row_id)) AS reason, arg_min(category, (ts_us, row_id)) AS category,
 CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM flood_alerts GROUP BY 1, 2, 3""")


@query("a19_incidents", with_pieces("incidents", "SELECT * FROM incidents"))
def _(t):
    return runs.incidents(_flood_alerts(t))


@query("a20_attack_sources", with_pieces("incidents", "SELECT src, sum(n_alerts)::BIGINT AS n_alerts, max(last_us) AS last_us FROM incidents GROUP BY src ORDER BY 2 DESC, 1 LIMIT 8"))
def _(t):
    return runs.attack_sources(runs.incidents(_flood_alerts(t)), 8)


@query("f4_search_incidents", with_pieces("incidents", "SELECT type, src, dst, n_alerts FROM incidents WHERE severity = 'high' AND contains(lower(type), 'flood') AND contains(lower(src || ' ' || dst || ' ' || type || ' ' || reason || ' ' || category), '10.0.0.1')"))
def _(t):
    return runs.search_incidents(runs.incidents(_flood_alerts(t)), "10.0.0.1", "High", "flood").select("type", "src", "dst", "n_alerts")


@query("f5_search_flows", with_pieces("latest_flows", """SELECT src_ip, dst_ip, src_port, dst_port FROM latest_flows WHERE protocol = 17
 AND contains(lower(src_ip || ' ' || dst_ip || ' ' || 'dp' || dpid || '|src=' || src_ip || '|dst=' || dst_ip || '|proto=' || protocol || '|sport=' || src_port || '|dport=' || dst_port || ' ' || dst_port || ' UDP'), '10.0.0.1')"""))
def _(t):
    flows = features.with_key(polls.active_flows(t.obs(), None), "runtime", "entity_key")
    return runs.search_flows(flows, "10.0.0.1", 17).select("src_ip", "dst_ip", "src_port", "dst_port")


@query("p15_display_names", """SELECT event_id AS row_id, CASE event_id % 8 WHEN 0 THEN 'Anomaly' WHEN 1 THEN 'Brute Force' WHEN 2 THEN 'Probe / Scan' WHEN 3 THEN 'DDoS' WHEN 4 THEN 'DoS' WHEN 5 THEN 'Traffic Flood' WHEN 6 THEN 'Web Attack' ELSE 'Other' END AS label,
 CASE event_id % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP' ELSE '47' END AS proto FROM events""")
def _(t):
    from flowlens.plans.fixtures import events

    r = F.col("event_id")
    cats = F.array(*[F.lit(x) for x in ["Normal", "BFA", "port-scan", "DDoS", "DoS Hulk", "Traffic-Flood", "Web-Attack", "Other"]])
    protos = F.array(*[F.lit(x) for x in [6, 17, 1, 47]])
    return events(t.spark, t.sf_dir).select(r.alias("row_id"), S.attack_label(F.get(cats, (r % 8).cast("int"))).alias("label"), S.proto_name(F.get(protos, (r % 4).cast("int"))).alias("proto"))


@query("p18_norm_status", "SELECT event_id AS row_id, CASE event_id % 5 WHEN 0 THEN 'ATTACK' WHEN 1 THEN 'SUSPECT' ELSE 'NORMAL' END AS status FROM events")
def _(t):
    from flowlens.plans.fixtures import events

    raw = F.array(*[F.lit(x) for x in [" attack ", "Suspect", "NORMAL", "context", None]])
    return events(t.spark, t.sf_dir).select(F.col("event_id").alias("row_id"), S.norm_status(F.get(raw, (F.col("event_id") % 5).cast("int"))).alias("status"))


@query("p19_parse_meta", with_pieces("run_metrics", "SELECT run_id, 3::BIGINT AS n, regexp_extract(meta, 'poll_interval_s=([^,]*)', 1) AS poll, regexp_extract(meta, 'hosts=([^,]*)', 1) AS hosts, regexp_extract(meta, 'scenario=([^,]*)', 1) AS scenario FROM run_metrics"))
def _(t):
    m = S.parse_meta(F.concat(F.lit(" bad , "), "meta", F.lit(" ")))
    return t.get("run_metrics").select("run_id", F.size(m).alias("n"), m["poll_interval_s"].alias("poll"), m["hosts"].alias("hosts"), m["scenario"].alias("scenario"))


@query("p20_score_band", with_pieces("scored", "SELECT row_id, CASE WHEN score >= 0.5 THEN 'alert' WHEN score >= 0.5::DOUBLE * 0.82::DOUBLE THEN 'high' ELSE 'normal' END AS band, CASE WHEN status = 'ATTACK' OR row_id % 6 > 4 THEN 'attack' ELSE 'normal' END AS banner FROM scored"))
def _(t):
    active = F.greatest(F.col("row_id") % 6 - 4, F.lit(0))
    return t.get("scored").select("row_id", S.score_band("score", 0.5).alias("band"), S.banner("status", active).alias("banner"))


# --- topology overlay ------------------------------------------------------------------------

piece("top_sources", ("incidents",), "SELECT src FROM incidents GROUP BY src ORDER BY sum(n_alerts) DESC, src LIMIT 3")
piece("links", ("obs",), "SELECT DISTINCT dpid, src_ip, dst_ip, dst_port, protocol FROM obs")


def _links(t):
    return t.obs().select("dpid", "src_ip", "dst_ip", "dst_port", "protocol").distinct()


@query("j5_attack_links", with_pieces("top_sources links", "SELECT * FROM links WHERE src_ip IN (SELECT src FROM top_sources) OR dst_ip IN (SELECT src FROM top_sources)"))
def _(t):
    return runs.attack_links(_links(t), runs.attack_sources(runs.incidents(_flood_alerts(t)), 3))[0]


@query("j5_attack_switches", with_pieces("top_sources links", "SELECT DISTINCT dpid FROM links WHERE src_ip IN (SELECT src FROM top_sources) OR dst_ip IN (SELECT src FROM top_sources)"))
def _(t):
    return runs.attack_links(_links(t), runs.attack_sources(runs.incidents(_flood_alerts(t)), 3))[1]


@query("u2_all_hosts", with_pieces("flood_alerts flow_export", "SELECT src_ip AS ip FROM flood_alerts UNION SELECT dst_ip FROM flood_alerts UNION SELECT src_ip FROM flow_export UNION SELECT dst_ip FROM flow_export"))
def _(t):
    return polls.hosts_of(_flood_alerts(t), t.get("flow_export"))


# --- runs --------------------------------------------------------------------------------------

_TOTALS = """SELECT run_id, count(*) AS total_rows, count(score) AS scored_rows, round(count(*) / greatest((max(ts_us) - min(ts_us)) / 1e6, 1e-6), 6) AS throughput_obs_s, round(max(score), 6) AS max_score,
 count(*) FILTER (status = 'ATTACK') AS alerts_attack, count(*) FILTER (status = 'SUSPECT') AS alerts_suspect FROM scored_runs GROUP BY run_id"""


@query("a7_run_totals", with_pieces("scored_runs", _TOTALS))
def _(t):
    return runs.run_totals(t.scored_runs())


@query("a30_list_runs", with_pieces("scored_runs", "SELECT DISTINCT run_id FROM scored_runs"))
def _(t):
    return runs.list_runs(t.scored_runs())


@query("j4_with_run_meta", with_pieces("run_metrics", "SELECT run_id, CASE WHEN run_id LIKE '%1' THEN NULL ELSE regexp_extract(meta, 'hosts=([^,]*)', 1) END AS hosts, timeout_total::BIGINT AS timeout_total FROM run_metrics"))
def _(t):
    df = t.get("run_metrics")
    meta = df.filter(~F.col("run_id").endswith("1")).select("run_id", "meta")
    return runs.with_run_meta(df.drop("meta"), meta).select("run_id", F.col("meta_map")["hosts"].alias("hosts"), "timeout_total")


# scores per run: one run per day, as in run_metrics
piece("day_scores", ("scored",), "SELECT *, 'run' || (ts_us // 86400000000 % 1000) AS run_id FROM scored")


def _day_scores(t):
    day = F.floor(F.col("ts_us") / 86_400_000_000) % 1000
    return t.get("scored").withColumn("run_id", F.concat(F.lit("run"), day.cast("string")))


piece("summary", ("run_metrics", "day_scores"), """SELECT r.run_id, regexp_extract(meta, 'poll_interval_s=([^,]*)', 1)::DOUBLE AS poll_interval_s, r.avg_total_e2e_ms, r.max_reply_delay_ms, r.timeout_total::BIGINT AS timeout_total,
 r.trimmed_flows_total::BIGINT AS trimmed_flows_total, r.throughput_obs_s::DOUBLE AS throughput_obs_s, r.dropped_rows::BIGINT AS dropped_rows, a.alerts_total, a.alerts_total AS alerts_attack, 0::BIGINT AS alerts_suspect, s.peak_score,
 (f.first_alert - s.first_attack) / 1e6 AS attack_to_alert_s, meta FROM run_metrics r LEFT JOIN (SELECT run_id, count(*) AS alerts_total FROM day_scores WHERE status = 'ATTACK' GROUP BY 1) a USING (run_id)
 LEFT JOIN (SELECT run_id, max(score) AS peak_score, min(ts_us) FILTER (label <> 'Normal') AS first_attack FROM day_scores GROUP BY 1) s USING (run_id)
 LEFT JOIN (SELECT d.run_id, min(d.ts_us) AS first_alert FROM day_scores d JOIN (SELECT run_id, min(ts_us) AS first_attack FROM day_scores WHERE label <> 'Normal' GROUP BY 1) z USING (run_id)
  WHERE d.status = 'ATTACK' AND d.ts_us >= z.first_attack GROUP BY 1) f USING (run_id)""")
_SUM = ["run_id", "poll_interval_s", "avg_total_e2e_ms", "max_reply_delay_ms", "timeout_total", "trimmed_flows_total", "throughput_obs_s", "dropped_rows",
        "alerts_total", "alerts_attack", "alerts_suspect", "peak_score", "attack_to_alert_s"]


def _summary(t):
    scores = _day_scores(t)
    return runs.summarize_run(t.get("run_metrics"), scores, scores.filter(F.col("status") == "ATTACK"))


@query("a21_summarize_run", with_pieces("summary", f"SELECT {', '.join(_SUM[:2])}, {r6('avg_total_e2e_ms', 'max_reply_delay_ms')}, timeout_total, trimmed_flows_total, {r6('throughput_obs_s')}, dropped_rows, alerts_total, alerts_attack, alerts_suspect, {r6('peak_score', 'attack_to_alert_s')}, 0.0::DOUBLE AS avg_inference_ms, '' AS phase FROM summary"))
def _(t):
    return _summary(t).select(*_SUM, "avg_inference_ms", "phase")


# means of a few rounded numbers sit on rounding ties; the factor moves them off
@query(
    "a22_compare_runs",
    with_pieces(
        "summary",
        """SELECT regexp_extract(meta, 'scenario=([^,]*)', 1) AS "group", count(*) AS n_runs,
 round(avg(avg_total_e2e_ms) * 0.7310585786::DOUBLE, 4) AS e2e_scaled, round(avg(throughput_obs_s) * 0.7310585786::DOUBLE, 4) AS throughput_scaled,
 sum(timeout_total)::BIGINT AS timeout_total, sum(trimmed_flows_total)::BIGINT AS trimmed_flows_total, 0.0::DOUBLE AS avg_reply_delay_ms FROM summary GROUP BY 1""",
    ),
    digits=4,
)
def _(t):
    df = runs.compare_runs(_summary(t), "scenario")
    return df.select("group", "n_runs", (F.col("avg_total_e2e_ms") * 0.7310585786).alias("e2e_scaled"),
                     (F.col("avg_throughput_obs_s") * 0.7310585786).alias("throughput_scaled"), "timeout_total", "trimmed_flows_total",
                     "avg_reply_delay_ms")


@query("a22_run_groups", with_pieces("summary", """SELECT regexp_extract(meta, 'scenario=([^,]*)', 1) AS "group", run_id FROM summary"""))
def _(t):
    return runs.run_groups(_summary(t), "scenario")


@query("t4_rank_runs", with_pieces("summary", "SELECT run_id, round(avg_total_e2e_ms + timeout_total * 150 + dropped_rows * 2 + trimmed_flows_total * 0.05::DOUBLE - throughput_obs_s * 0.3::DOUBLE, 6) AS rank_score FROM summary"))
def _(t):
    return runs.rank_runs(_summary(t)).select("run_id", "rank_score")


@query("t3_latest_alerts", with_pieces("scored_runs", "SELECT row_id, ts_us, round(score, 6) AS score FROM scored_runs WHERE run_id = 'run1' AND status = 'ATTACK' ORDER BY ts_us DESC, row_id DESC LIMIT 20"))
def _(t):
    df = t.scored_runs().filter(F.col("status") == "ATTACK")
    return alerts.latest_alerts(df, 20, "run1").select("row_id", "ts_us", "score")


_POINTS = """cand AS (SELECT run_id, row_id, ts_us, round(score, 1) AS score, status, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, row_id) AS rn FROM scored_runs),
points AS (SELECT run_id, rn, row_id, ts_us AS pt, score AS sc, status AS st, true AS kept FROM cand WHERE rn = 1
 UNION ALL SELECT run_id, rn, row_id, CASE WHEN k THEN ts_us ELSE pt END, CASE WHEN k THEN score ELSE sc END, CASE WHEN k THEN status ELSE st END, k FROM (
 SELECT c.*, p.pt, p.sc, p.st, c.ts_us - p.pt >= 12960000000 OR c.score <> p.sc OR c.status <> p.st AS k FROM points p JOIN cand c ON c.run_id = p.run_id AND c.rn = p.rn + 1) x)"""


@query(
    "t5_score_timeline",
    with_pieces(
        "scored_runs",
        """SELECT run_id, row_id, ts_us, score, status FROM (SELECT c.*, row_number() OVER (PARTITION BY c.run_id ORDER BY c.ts_us DESC, c.row_id DESC) AS r
 FROM cand c JOIN points p USING (run_id, rn) WHERE kept) t WHERE r <= 400""",
        _POINTS,
    ),
)
def _(t):
    """Scores to one digit, so that many rows repeat the last point."""
    df = t.scored_runs().withColumn("score", F.round("score", 1))
    return runs.score_timeline(df, 14400.0, 400)


@query("t6_replay_order", with_pieces("flows", "SELECT row_id, ts_us, source_file FROM flows"))
def _(t):
    return exports.replay_order(t.flows().select("row_id", "ts_us", "source_file"))


@query("x8_latest_state", with_pieces("scored_runs", "SELECT run_id, row_id, ts_us, status, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us DESC, row_id DESC) AS r FROM scored_runs) t WHERE r = 1"))
def _(t):
    return alerts.latest_by_run(t.scored_runs())[0].select("run_id", "row_id", "ts_us", "status", "score")


@query("x8_latest_alerts", with_pieces("scored_runs", "SELECT run_id, row_id, alert_rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us DESC, row_id DESC) AS alert_rank FROM scored_runs WHERE status = 'ATTACK') t WHERE alert_rank <= 20"))
def _(t):
    return alerts.latest_by_run(t.scored_runs(), 20)[1].select("run_id", "row_id", "alert_rank")


_HEALTH = """SELECT ts_us // {w} * {w} AS start_us, ts_us // {w} * {w} + {w} AS end_us, count(*) AS n_rows, count(*) FILTER (status = 'ATTACK') AS n_attack, round(avg(row_id % 90), 6) AS avg_total_e2e_ms FROM scored GROUP BY 1, 2"""


def _with_latency(df):
    return df.withColumn("total_e2e_ms", (F.col("row_id") % 90).cast("double"))


@query("x9_health_windows", with_pieces("scored", _HEALTH.format(w=3_600_000_000)))
def _(t):
    return runs.health_windows(_with_latency(t.get("scored")), "1 hour")


@query("x9_health_sliding", with_pieces("scored", """SELECT s AS start_us, s + 7200000000 AS end_us, count(*) AS n_rows, count(*) FILTER (status = 'ATTACK') AS n_attack, round(avg(row_id % 90), 6) AS avg_total_e2e_ms
 FROM (SELECT *, unnest([ts_us // 3600000000 * 3600000000 - 3600000000, ts_us // 3600000000 * 3600000000]) AS s FROM scored) t GROUP BY 1, 2"""))
def _(t):
    return runs.health_windows(_with_latency(t.get("scored")), "2 hours", slide="1 hour")


# --- models --------------------------------------------------------------------------------------


def _model_windows(t):
    """Replay windows with a row id and their hash split, staged for the fits."""
    replay = snapshots.expand_replay(t.flows(), 1.0, 6).withColumn("row_id", F.col("poll_step"))
    w = windows.sequence_windows(replay, keys=["flow_key"], order=["ts_us", "poll_step"], block_us=None)
    side = F.conv(F.substring(F.md5("flow_key"), 1, 2), 16, 10).cast("int")
    return stage(w.withColumn("split", F.when(side < 178, "train").otherwise("test")), "model-windows")


def _stats(w):
    vectors = w.filter(F.col("split") == "train").select(F.explode("window").alias("v"))
    return scaling.robust_stats(vectors.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(R10)]), R10)


@query("m4_classifier")
def _(t):
    """Fit on the train windows, score the test windows."""
    w = _model_windows(t)
    stats = _stats(w)
    model = models.fit_classifier(w.filter(F.col("split") == "train"), stats=stats, maxIter=20)
    return models.score_classifier(w.filter(F.col("split") == "test"), model, stats=stats).select("flow_key", "window_start", "is_attack", "score")


@query("m5_reconstruction")
def _(t):
    w = _model_windows(t)
    stats = _stats(w)
    model = models.fit_reconstructor(w.filter(F.col("split") == "train"), stats=stats, k=8, names=R10)
    return models.score_reconstruction(w.filter(F.col("split") == "test"), model, stats=stats).select("flow_key", "window_start", "is_attack", "score")


@query("m7_calibrate_replay")
def _(t):
    """Replay expansion, features, windows, classifier score, threshold, quality."""
    w = _model_windows(t)
    stats = _stats(w)
    model = models.fit_classifier(w.filter(F.col("split") == "train"), stats=stats, maxIter=20)
    return models.calibrate_replay(w.filter(F.col("split") == "test"), lambda d: models.score_classifier(d, model, stats=stats), 0.05)


# --- given models: scoring as arithmetic that SQL repeats

_N = 4 * len(R10)
_GIVEN_STATS = scaling.RobustStats(tuple(R10), tuple(0.5 * (j % 3) for j in range(len(R10))), tuple(1.0 + 0.5 * (j % 4) for j in range(len(R10))))
_GIVEN = models.LinearModel(tuple(((7 * i) % 11 - 5) / 20.0 for i in range(_N)), -0.5)
_MEAN = [0.1 * (i % 5) for i in range(_N)]
_PARTS = [[((3 * i + 5 * k) % 7 - 3) / 20.0 for k in range(2)] for i in range(_N)]

_x = [f"(sign({c}) * ln(1 + abs({c})) - {z!r}) / {s!r}::DOUBLE" for c, z, s in zip(R10, _GIVEN_STATS.center, _GIVEN_STATS.scale)]
_dot = [" + ".join(f"{_GIVEN.coefficients[10 * k + j]!r}::DOUBLE * x[{j + 1}]" for j in range(len(R10))) for k in range(4)]
_key = "'replay::' || source_file || '::' || row_id"
piece("scaled_replay", ("replay",), f"SELECT {_key} AS flow_key, label, flow_us + poll_step * 1000000 AS ts_us, poll_step, [{', '.join(_x)}] AS x FROM replay")
piece("given_windows", ("scaled_replay",), f"""SELECT flow_key, rn - 3 AS window_start, (label <> 'Normal')::BIGINT AS is_attack, label, 1 / (1 + exp(-({_GIVEN.intercept!r}::DOUBLE + d0 + d1 + d2 + c3))) AS score, x0 || x1 || x2 || x AS w,
 ('0x' || substr(md5(flow_key), 1, 2))::INT >= 178 AS test FROM (SELECT *, {', '.join(f'lag(c{k}, {3 - k}) OVER o AS d{k}, lag(x, {3 - k}) OVER o AS x{k}' for k in range(3))}, row_number() OVER o AS rn
 FROM (SELECT *, {', '.join(f'{d} AS c{k}' for k, d in enumerate(_dot))} FROM scaled_replay) a WINDOW o AS (PARTITION BY flow_key ORDER BY ts_us, poll_step)) b WHERE rn >= 4""")


def _score_given(df):
    return models.score_linear(df, _GIVEN, stats=_GIVEN_STATS)


_SCORED_SQL = "SELECT flow_key, window_start, is_attack, round(score, 6) AS score FROM given_windows WHERE test"


@query("m4_score_given", with_pieces("given_windows", _SCORED_SQL))
def _(t):
    """Test windows scored by given coefficients."""
    return _score_given(_model_windows(t).filter("split = 'test'")).select("flow_key", "window_start", "is_attack", "score")


_part = lambda k: "[" + ", ".join(repr(r[k]) for r in _PARTS) + "]"
_left = [f"list_sum(list_transform(range(1, {_N + 1}), lambda i: d[i] * ({_part(k)})[i]))" for k in range(2)]


@query("m5_reconstruction_given", with_pieces("given_windows", f"""SELECT flow_key, window_start, is_attack, round(list_sum(list_transform(range(1, {_N + 1}), lambda i: pow(d[i] - a * ({_part(0)})[i] - b * ({_part(1)})[i], 2))) / {_N}, 6) AS score
 FROM (SELECT *, {_left[0]} AS a, {_left[1]} AS b FROM (SELECT *, list_transform(range(1, {_N + 1}), lambda i: w[i] - ({_MEAN!r})[i]) AS d FROM given_windows WHERE test) x) y"""))
def _(t):
    """Reconstruction error of test windows by given components."""
    model = models.Reconstructor(_MEAN, np.array(_PARTS), None)
    return models.score_reconstruction(_model_windows(t).filter("split = 'test'"), model, stats=_GIVEN_STATS).select("flow_key", "window_start", "is_attack", "score")


@query("m7_calibrate_given", with_pieces("given_windows", """SELECT count(*) AS n_rows, count(*) FILTER (label = 'Normal') AS n_normal, count(*) FILTER (label <> 'Normal') AS n_attack,
 round(avg(score) FILTER (label = 'Normal'), 6) AS normal_mean, round(avg(score) FILTER (label <> 'Normal'), 6) AS attack_mean, round(avg((score >= t)::INT) FILTER (label = 'Normal'), 6) AS estimated_fpr,
 round(avg((score >= t)::INT) FILTER (label <> 'Normal'), 6) AS estimated_tpr, round(any_value(t), 6) AS recommended_threshold
 FROM (SELECT *, (SELECT quantile_cont(score, 0.95) FROM given_windows WHERE test AND label = 'Normal') AS t FROM given_windows WHERE test) x"""))
def _(t):
    """Threshold and quality of a labelled replay scored by given coefficients."""
    return models.calibrate_replay(_model_windows(t).filter("split = 'test'"), _score_given, 0.05)


# --- thresholds from stored sketches

_RUN_KEYS = ["run_id", "day"]


def _stored_sketches(t):
    """Sketches per run and day, written once and read back."""
    return stage(sketches.normal_sketches(t.scored_runs(), _RUN_KEYS), "score-sketches")


def _within(t, thresholds, q):
    """Whether the rank of each run's threshold is within the stated error of ``q``."""
    rows = t.scored_runs().filter("label = 'Normal'").join(thresholds.withColumnRenamed("n", "n_sketch"), "run_id")
    share = lambda c: F.avg(c.cast("int"))
    ranks = rows.groupBy("run_id", "n_sketch", "rank_error").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("score") < F.col("threshold")).alias("lo"), share(F.col("score") <= F.col("threshold")).alias("hi")
    )
    slack = F.col("rank_error") + 1.0 / F.col("n")
    return ranks.select("run_id", "n", ((F.col("n_sketch") == F.col("n")) & (F.col("lo") <= q + slack) & (F.col("hi") >= q - slack)).alias("within"))


_WITHIN_SQL = "SELECT run_id, count(*) AS n, true AS within FROM scored_runs WHERE label = 'Normal' GROUP BY run_id"


@query("a10_threshold_sketches", with_pieces("scored_runs", _WITHIN_SQL))
def _(t):
    """Threshold per run at 1 % false positives from merged daily sketches."""
    return _within(t, sketches.threshold_from_sketches(_stored_sketches(t), 0.01, keys=["run_id"]), 0.99)


@query("a12_summary_sketches", with_pieces("scored_runs", _WITHIN_SQL))
def _(t):
    """p95 of the summary of each run from merged daily sketches."""
    out = sketches.summary_from_sketches(_stored_sketches(t), ["run_id"])
    return _within(t, out.select("run_id", "n", F.col("score_p95").alias("threshold"), F.lit(sketches.rank_error()).alias("rank_error")), 0.95)


@query("a24_normalizer_sketches", with_pieces("scored_runs", """SELECT run_id, count(*) AS n, round(avg(score), 6) AS normal_mean, round(stddev_pop(score) + 1e-9, 6) AS normal_std, 6 AS n_percentiles, 200 AS n_cdf, true AS rising
 FROM scored_runs WHERE label = 'Normal' GROUP BY run_id"""))
def _(t):
    """Normaliser of each run from merged daily sketches."""
    out = sketches.normalizer_from_sketches(_stored_sketches(t), ["run_id"])
    rising = F.col("cdf_scores") == F.array_sort("cdf_scores")
    return out.select("run_id", "n", "normal_mean", "normal_std", F.size("percentiles").alias("n_percentiles"), F.size("cdf_scores").alias("n_cdf"), rising.alias("rising"))
