"""Queries: snapshots, votes, windows, splits, scalers, thresholds, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import alerts, metrics, scaling, snapshots, windows
from flowlens.operators.quantiles import exact_quantiles
from flowlens.plans.registry import HOUR, piece, query, r6, with_pieces
from flowlens.policy import feature_names, feature_weights
from flowlens.session import new_path
from flowlens.sources import exports

R10 = feature_names()
STEP = 2.0
# the reference grid of seconds suits flows of seconds; the fixture flows last 0..20 s

_SNAP = ["packet_count", "byte_count", "flow_duration_s", "packet_rate", "byte_rate", "avg_packet_size", "snapshot_frac"]
_KEEP = "flow_id, src_ip, dst_ip, src_port, dst_port, protocol, label, label_index, is_attack, dst_port_norm, protocol_tcp, protocol_udp, protocol_icmp"

piece(
    "snapshots",
    ("flows",),
    f"""SELECT *, packet_count / greatest(flow_duration_s, 1e-6) AS packet_rate, byte_count / greatest(flow_duration_s, 1e-6) AS byte_rate,
 byte_count / greatest(packet_count, 1::DOUBLE) AS avg_packet_size
FROM (SELECT row_id, source_file, {_KEEP}, concat_ws('__', src_ip, dst_ip, src_port, dst_port, protocol) AS conversation_key, poll_index, ts_us AS start_us,
  round(poll_ts * 1e6)::BIGINT AS ts_us, least(greatest(elapsed / dur, 0), 1) AS snapshot_frac, elapsed AS flow_duration_s,
  pc * least(greatest(elapsed / dur, 0), 1) AS packet_count, bc * least(greatest(elapsed / dur, 0), 1) AS byte_count
 FROM (SELECT *, least(greatest(poll_ts - start_s, 0), dur) AS elapsed FROM (SELECT *, anchor + poll_index * 2.0::DOUBLE AS poll_ts
  FROM (SELECT *, unnest(generate_series(p0, greatest(p0, p1))) AS poll_index
   FROM (SELECT *, ceil((start_s - anchor) / 2.0::DOUBLE)::BIGINT AS p0,
     floor((least(start_s + dur, start_s + 12.0::DOUBLE) - anchor) / 2.0::DOUBLE + 1e-9)::BIGINT AS p1
    FROM (SELECT row_id, source_file, {_KEEP}, ts_us, packet_count AS pc, byte_count AS bc, ts_us / 1e6 AS start_s, greatest(flow_duration_s, 1e-6) AS dur,
      floor(min(ts_us / 1e6) OVER () / 2.0::DOUBLE) * 2.0::DOUBLE AS anchor FROM flows) a) b) c) d) e) f""",
)


def _snapshots(t):
    return snapshots.expand_snapshots(t.flows(), STEP, 6)


@query("e1_expand_snapshots", with_pieces("snapshots", f"SELECT row_id, poll_index, ts_us, {r6(*_SNAP, digits=3)} FROM snapshots"), digits=3)
def _(t):
    return _snapshots(t).select("row_id", "poll_index", "ts_us", *_SNAP)


def _merged_sql(key: str) -> str:
    vote = "CASE WHEN label <> 'Normal' THEN 1 ELSE 0 END"
    return f"""SELECT source_file, ckey AS conversation_key, poll_index, first(flow_id ORDER BY start_us, row_id) AS flow_id,
 first(src_ip ORDER BY start_us, row_id) AS src_ip, first(dst_ip ORDER BY start_us, row_id) AS dst_ip,
 CASE WHEN count(DISTINCT src_port) = 1 THEN min(src_port) ELSE -1 END AS src_port, first(dst_port ORDER BY start_us, row_id) AS dst_port,
 first(protocol ORDER BY start_us, row_id) AS protocol, max(ts_us) AS ts_us, max(is_attack) AS is_attack,
 sum(packet_count) AS packet_count, sum(byte_count) AS byte_count, max(flow_duration_s) AS flow_duration_s,
 sum(packet_count) / greatest(max(flow_duration_s), 1e-6) AS packet_rate, sum(byte_count) / greatest(max(flow_duration_s), 1e-6) AS byte_rate,
 sum(byte_count) / greatest(sum(packet_count), 1) AS avg_packet_size, first(dst_port_norm) AS dst_port_norm, first(protocol_tcp) AS protocol_tcp,
 first(protocol_udp) AS protocol_udp, first(protocol_icmp) AS protocol_icmp,
 count(*)::DOUBLE AS subflow_count_same_key, (count(DISTINCT src_port) FILTER (src_port <> -1))::DOUBLE AS unique_src_ports_same_key,
 poll_index AS row_id, max(label_votes) AS label_votes, arg_max(label, (label_votes, label)) AS label, arg_max(label_index, (label_votes, label)) AS label_index
FROM (SELECT *, CASE WHEN label <> 'Normal' THEN count(*) OVER (PARTITION BY source_file, ckey, poll_index, label) ELSE 0 END AS label_votes
 FROM (SELECT *, {key} AS ckey FROM snapshots) s) v GROUP BY source_file, ckey, poll_index"""


piece("merged_flow", ("snapshots",), _merged_sql("conversation_key"))
piece("merged_service", ("snapshots",), _merged_sql("concat_ws('__', src_ip, dst_ip, dst_port, protocol)"))
_MERGED = ["source_file", "conversation_key", "poll_index", "flow_id", "src_ip", "src_port", "dst_port", "protocol", "ts_us", "is_attack",
           "label", "label_index"]
_MERGED_F = ["packet_count", "byte_count", "flow_duration_s", "packet_rate", "byte_rate", "avg_packet_size", "subflow_count_same_key",
             "unique_src_ports_same_key"]


@query("a2_aggregate_snapshots_flow", with_pieces("merged_flow", f"SELECT {', '.join(_MERGED)}, {r6(*_MERGED_F, digits=3)} FROM merged_flow"), digits=3)
def _(t):
    return snapshots.aggregate_snapshots(_snapshots(t), "flow").select(*_MERGED, *_MERGED_F)


@query(
    "a2_aggregate_snapshots_service",
    with_pieces("merged_service", f"SELECT {', '.join(_MERGED)}, {r6(*_MERGED_F, digits=3)} FROM merged_service"),
    digits=3,
)
def _(t):
    return snapshots.aggregate_snapshots(_snapshots(t), "service").select(*_MERGED, *_MERGED_F)


def _vote_query(name, mode, body):
    @query(name, with_pieces("flows", body))
    def _(t):
        return snapshots.vote_label(t.flows(), ["conversation_key"], mode)


_vote_query(
    "a3_vote_any_attack",
    "any_attack_priority",
    """SELECT conversation_key, coalesce(arg_max(label, (n, label)) FILTER (label <> 'Normal'), 'Normal') AS label
 FROM (SELECT conversation_key, label, count(*) AS n FROM flows GROUP BY 1, 2) t GROUP BY 1""",
)
_vote_query(
    "a3_vote_majority",
    "majority",
    """SELECT conversation_key, arg_max(label, (n, label)) AS label FROM (SELECT conversation_key, label, count(*) AS n FROM flows GROUP BY 1, 2) t GROUP BY 1""",
)
_vote_query(
    "a3_vote_last_step",
    "last_step",
    """SELECT conversation_key, coalesce(last(label ORDER BY ts_us, row_id) FILTER (label <> 'Normal'), last(label ORDER BY ts_us, row_id)) AS label
 FROM flows GROUP BY 1""",
)

piece(
    "replay",
    ("flows",),
    """SELECT *, packet_count / flow_duration_s AS packet_rate, byte_count / flow_duration_s AS byte_rate,
 CASE WHEN packet_count > 0 THEN byte_count / greatest(packet_count, 1::DOUBLE) ELSE 0 END AS avg_packet_size,
 packet_count - CASE WHEN poll_step > 1 THEN pc * (poll_step - 1)::DOUBLE / n_polls ELSE 0 END AS packet_delta,
 byte_count - CASE WHEN poll_step > 1 THEN bc * (poll_step - 1)::DOUBLE / n_polls ELSE 0 END AS byte_delta
FROM (SELECT *, pc * poll_step::DOUBLE / n_polls AS packet_count, bc * poll_step::DOUBLE / n_polls AS byte_count,
  greatest(dur * poll_step::DOUBLE / n_polls, 1e-6) AS flow_duration_s, poll_step > 1 AS has_history
 FROM (SELECT *, unnest(generate_series(1, n_polls)) AS poll_step
  FROM (SELECT row_id, source_file, conversation_key, src_ip, dst_ip, src_port, dst_port, protocol, label, ts_us AS flow_us, packet_count AS pc, byte_count AS bc,
    greatest(flow_duration_s, 1.0::DOUBLE) AS dur, src_port_norm, dst_port_norm, protocol_tcp, protocol_udp, protocol_icmp,
    greatest(2, least(6, ceil(greatest(flow_duration_s, 1.0::DOUBLE))))::BIGINT AS n_polls FROM flows) a) b) c""",
)
_RP = ["packet_count", "byte_count", "flow_duration_s", "packet_rate", "byte_rate", "avg_packet_size", "packet_delta", "byte_delta"]


# Parts of round numbers sit exactly on rounding ties, where the last bit decides; a
# factor without structure moves every value off them.
_OFF = 0.7310585786


@query(
    "e2_expand_replay",
    with_pieces(
        "replay",
        f"""SELECT 'replay::' || source_file || '::' || row_id AS flow_key, poll_step, n_polls, has_history, flow_us + poll_step * 1000000 AS ts_us,
 {', '.join(f'round({c} * {_OFF}::DOUBLE, 4) AS {c}_scaled' for c in _RP)} FROM replay""",
    ),
    digits=4,
)
def _(t):
    df = snapshots.expand_replay(t.flows(), 1.0, 6)
    return df.select("flow_key", "poll_step", "n_polls", "has_history", "ts_us", *[(F.col(c) * _OFF).alias(f"{c}_scaled") for c in _RP])


@query(
    "a27_replay_summary",
    with_pieces(
        "replay",
        "SELECT CASE WHEN grouping(label) = 1 THEN 'TOTAL' ELSE label END AS label, count(*) AS n_rows FROM replay GROUP BY ROLLUP (label)",
    ),
)
def _(t):
    return snapshots.replay_summary(snapshots.expand_replay(t.flows(), 1.0, 6))


# --- windows ----------------------------------------------------------------------------


def _win_sql(source: str, keys: str, n: int, stride: int, mode: str = "any", extra: str = "") -> str:
    """Windows of n rows; the vote counts labels of the n rows."""
    rel = " UNION ALL ".join(f"SELECT {keys}, rn - {i} AS w, label, ts_us, is_attack, packet_count, {i} AS pos{extra} FROM ranked_rows WHERE rn > {i}" for i in range(n))
    pick = {
        "any": "coalesce(arg_max(label, (n, label)) FILTER (label <> 'Normal'), 'Normal')",
        "majority": "arg_max(label, (n, label))",
        "last_step": "coalesce(arg_max(label, pos) FILTER (label <> 'Normal'), arg_max(label, pos))",
    }[mode]
    return f"""SELECT {keys}, w AS window_start, {pick} AS label, max(is_attack) AS is_attack, min(ts_us) AS start_us, max(ts_us) AS end_us,
  round(arg_min(packet_count, pos), 3) AS first_packets, round(arg_max(packet_count, pos), 3) AS last_packets
 FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, w, label) AS n, count(*) OVER (PARTITION BY {keys}, w) AS size FROM ({rel}) r) x
 WHERE size = {n} AND (w - 1) % {stride} = 0 GROUP BY {keys}, w"""


def _ranked_sql(source: str, keys: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, row_id) AS rn FROM {source}"


_K = "source_file, conversation_key"
piece("ranked_rows", ("merged_service",), _ranked_sql("merged_service", _K))
piece("seq", ("ranked_rows",), _win_sql("ranked_rows", _K, 4, 1))
_WCOLS = ["source_file", "conversation_key", "window_start", "label", "is_attack", "start_us", "end_us"]


def _merged(t):
    return snapshots.aggregate_snapshots(_snapshots(t), "service")


def _show_windows(df, keys=("source_file", "conversation_key")):
    at = lambda i: F.get(F.get("window", F.lit(i)), F.lit(0))
    return df.select(*keys, "window_start", "label", "is_attack", "start_us", "end_us", at(0).alias("first_packets"), at(3).alias("last_packets"))


@query("w2_sequence_windows", with_pieces("seq", "SELECT * FROM seq"), digits=3)
def _(t):
    return _show_windows(windows.sequence_windows(_merged(t)))


@query("w2_sequence_windows_stride", with_pieces("ranked_rows", _win_sql("ranked_rows", _K, 4, 3, "majority")), digits=3)
def _(t):
    return _show_windows(windows.sequence_windows(_merged(t), 4, 3, "majority"))


@query("w2_sequence_windows_last_step", with_pieces("ranked_rows", _win_sql("ranked_rows", _K, 4, 2, "last_step")), digits=3)
def _(t):
    return _show_windows(windows.sequence_windows(_merged(t), 4, 2, "last_step"))


piece(
    "chrono",
    ("flows",),
    f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {_K}, split) AS seg FROM (SELECT *, CASE WHEN i < e1 THEN 'train' WHEN i >= least(e1 + 1, n) AND i < e2 THEN 'val'
  WHEN i >= least(e2 + 1, n) THEN 'test' END AS split
 FROM (SELECT *, least(greatest(e1 + 1, floor(n * 0.85::DOUBLE)::BIGINT), n) AS e2 FROM (SELECT *, least(greatest(1, floor(n * 0.7::DOUBLE)::BIGINT), n) AS e1
  FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY ts_us, row_id) - 1 AS i, count(*) OVER (PARTITION BY {_K}) AS n FROM flows) a) b) c) d) e
 WHERE split IS NOT NULL AND n >= 4 AND seg >= 4""",
)


@query("w3_split_chronological", with_pieces("chrono", f"SELECT row_id, {_K}, split FROM chrono"))
def _(t):
    return windows.split_chronological(t.flows()).select("row_id", "source_file", "conversation_key", "split")


_KS = "source_file, conversation_key, split"


@query(
    "w3_windows_within_splits",
    with_pieces("chrono", _win_sql("x", _KS, 4, 1).replace("FROM ranked_rows", f"FROM (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY {_KS} ORDER BY ts_us, row_id) AS rn FROM chrono) q")),
    digits=3,
)
def _(t):
    keys = ["source_file", "conversation_key", "split"]
    rows = windows.split_chronological(t.flows())
    return _show_windows(windows.sequence_windows(rows, keys=keys), keys)


# groups: windows per service key; split per label
piece(
    "win_groups",
    ("seq",),
    f"""SELECT {_K}, coalesce(arg_max(label, (n, label)) FILTER (label <> 'Normal'), 'Normal') AS label, sum(n)::BIGINT AS n_windows,
 min(s) AS start_us, max(e) AS end_us FROM (SELECT {_K}, label, count(*) AS n, min(start_us) AS s, max(end_us) AS e FROM seq GROUP BY ALL) t GROUP BY {_K}""",
)


def _split_sql(first_order: str, held: str) -> str:
    return f"""SELECT {_K}, label, n_windows, start_us, end_us, CASE WHEN is_test THEN 'test' WHEN rr <= nv AND NOT (m <= nv AND rr = m) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label, is_test ORDER BY h, {_K}) AS rr, count(*) OVER (PARTITION BY label, is_test) AS m
 FROM (SELECT *, {held} AS is_test FROM (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE v0 - least(lack, v0 - 1) END AS nv,
   CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE t0 - least(lack - least(lack, v0 - 1), t0 - 1) END AS nt
  FROM (SELECT *, greatest(0, 1 - (n - v0 - t0)) AS lack FROM (SELECT *, greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS v0,
    greatest(1, round_even(n * (1::DOUBLE - 0.7::DOUBLE - 0.15::DOUBLE), 0)::BIGINT) AS t0
   FROM (SELECT *, md5('42|' || source_file || '|' || conversation_key) AS h, count(*) OVER (PARTITION BY label) AS n,
     row_number() OVER (PARTITION BY label ORDER BY {first_order}) AS rn
    FROM (SELECT *, md5('test|' || md5('42|' || source_file || '|' || conversation_key)) AS h0 FROM win_groups) z) a) b) c) d) e) f"""


piece("split_temporal", ("win_groups",), _split_sql("start_us, end_us, conversation_key, source_file", "rn > n - nt"))
piece("split_stratified", ("win_groups",), _split_sql(f"h0, {_K}", "rn <= nt"))


def _groups(t):
    return windows.window_groups(windows.sequence_windows(_merged(t)).select(*_WCOLS).withColumns(
        {"ts_us": F.col("end_us"), "row_id": F.col("window_start")}))


@query("w4_split_groups_temporal", with_pieces("split_temporal", f"SELECT {_K}, label, n_windows, split FROM split_temporal"))
def _(t):
    return windows.split_groups(_groups(t)).select("source_file", "conversation_key", "label", "n_windows", "split")


@query("w4_split_groups_stratified", with_pieces("split_stratified", f"SELECT {_K}, label, n_windows, split FROM split_stratified"))
def _(t):
    return windows.split_groups(_groups(t), mode="stratified").select("source_file", "conversation_key", "label", "n_windows", "split")


piece("report", ("split_temporal",), "SELECT split, label, count(*) AS n_groups, sum(n_windows)::BIGINT AS n_windows FROM split_temporal GROUP BY 1, 2")


@query("a8_split_report", with_pieces("report", "SELECT * FROM report"))
def _(t):
    return windows.split_report(windows.split_groups(_groups(t)))


@query("a8_split_files", with_pieces("split_temporal", "SELECT split, source_file, count(*) AS n_groups FROM split_temporal GROUP BY 1, 2"))
def _(t):
    return windows.split_files(windows.split_groups(_groups(t)))


@query(
    "a9_coverage_warnings",
    with_pieces(
        "report",
        """SELECT label, split, n_groups, target FROM (SELECT label, unnest(['val', 'test']) AS split, unnest([va, te]) AS n_groups, unnest([40, 10])::BIGINT AS target
 FROM (SELECT label, sum(CASE WHEN split = 'train' THEN n_groups ELSE 0 END)::BIGINT AS tr, sum(CASE WHEN split = 'val' THEN n_groups ELSE 0 END)::BIGINT AS va,
  sum(CASE WHEN split = 'test' THEN n_groups ELSE 0 END)::BIGINT AS te FROM report GROUP BY label) a WHERE label <> 'Normal' AND tr > 0) b WHERE n_groups < target""",
    ),
)
def _(t):
    return windows.coverage_warnings(windows.split_report(windows.split_groups(_groups(t))), 40, 10)


@query("s4_prepared_splits", with_pieces("chrono", f"SELECT row_id, {_K}, split FROM chrono WHERE split = 'train'"))
def _(t):
    """Write the split rows by split, bucketed by key, read one split back."""
    path = new_path(t.spark, "prepared")
    rows = windows.split_chronological(t.flows()).select("row_id", "ts_us", "source_file", "conversation_key", "split")
    exports.write_prepared(rows, path, ["conversation_key"], ["ts_us", "row_id"], scheme="runtime10")
    return exports.read_prepared(t.spark, path, "train", "runtime10").drop("ts_us")


@query(
    "w5_tail_ratio",
    with_pieces(
        "flows",
        """SELECT row_id, source_file FROM (SELECT row_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY ts_us DESC, row_id DESC) AS rd,
 count(*) OVER (PARTITION BY source_file) AS n FROM flows) t WHERE rd <= greatest(1, ceil(n * 0.2::DOUBLE))""",
    ),
)
def _(t):
    return windows.tail_ratio(t.flows(), 0.2).select("row_id", "source_file")


@query(
    "w11_cap_train_normals",
    with_pieces("flows", "SELECT row_id FROM flows WHERE label = 'Normal' ORDER BY md5('42|' || row_id), row_id LIMIT 700"),
)
def _(t):
    return windows.cap_train_normals(t.flows(), 700).select("row_id")


# --- scalers -----------------------------------------------------------------------------

_SL = lambda c: f"sign({c}) * ln(1 + abs({c}))"
piece(
    "robust_fit",
    ("flows",),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, quantile_cont({_SL(c)}, 0.5) AS center, CASE WHEN abs(quantile_cont({_SL(c)}, 0.75) - quantile_cont({_SL(c)}, 0.25)) < 1e-12
 THEN 1.0 ELSE quantile_cont({_SL(c)}, 0.75) - quantile_cont({_SL(c)}, 0.25) END AS scale FROM flows"""
        for c in R10
    ),
)


@query("a25_fit_robust", with_pieces("robust_fit", f"SELECT feature, {r6('center', 'scale')} FROM robust_fit"))
def _(t):
    return scaling.fit_robust(t.flows(), R10)


@query("s4_prepared_metadata", with_pieces("robust_fit", f"SELECT 'runtime10' AS scheme, feature, {r6('center', 'scale')} FROM robust_fit"))
def _(t):
    """Scaler statistics and scheme out of the sidecar of a prepared table."""
    path = new_path(t.spark, "prepared")
    stats = scaling.robust_stats(t.flows(), R10)
    rows = windows.split_chronological(t.flows()).select("row_id", "conversation_key", "split", *R10)
    numbers = {c: {"center": z, "scale": s} for c, z, s in zip(stats.names, stats.center, stats.scale)}
    exports.write_prepared(rows, path, ["conversation_key"], stats=numbers, scheme="runtime10", settings={"seq_len": 4})
    about = exports.prepared_metadata(t.spark, path)
    data = [(about["scheme"], c, v["center"], v["scale"]) for c, v in about["stats"].items()]
    return t.spark.createDataFrame(data, "scheme string, feature string, center double, scale double")


def _robust_expr(c):
    return f"""(({_SL(c)}) - (SELECT center FROM robust_fit WHERE feature = '{c}')) / (SELECT scale FROM robust_fit WHERE feature = '{c}') AS {c}"""


@query(
    "m1_apply_robust",
    with_pieces("flows robust_fit", f"SELECT row_id, {r6(*R10)} FROM (SELECT row_id, {', '.join(_robust_expr(c) for c in R10)} FROM flows) t"),
)
def _(t):
    df = t.flows().select("row_id", *R10)
    return scaling.apply_robust(df, scaling.robust_stats(df, R10))


_QC = ["packet_count", "flow_duration_s", "avg_packet_size"]


@query(
    "a26_fit_quantiles",
    with_pieces(
        "flows",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, i AS q_index, round(i / 100.0::DOUBLE, 6) AS q, round(v, 6) AS value FROM
 (SELECT unnest(generate_series(0, 100)) AS i, unnest(quantile_cont({c}, [x / 100.0::DOUBLE for x in generate_series(0, 100)])) AS v FROM flows) t"""
            for c in _QC
        ),
    ),
)
def _(t):
    return scaling.fit_quantiles(t.flows(), _QC, 101)


_REFS = "[x / 999.0::DOUBLE for x in generate_series(0, 999)]"


def _unit_sql(c):
    """Piecewise linear place of ``c`` among its thousand quantiles ``q_c``."""
    k, q = f"k_{c}", f"q_{c}"
    return f"""CASE WHEN {k} = 0 THEN 0 WHEN {c} > {q}[1000] THEN 1 WHEN {k} = 1000 THEN 1
 ELSE ({k} / 999.0::DOUBLE - ({k} - 1) / 999.0::DOUBLE) / ({q}[{k} + 1] - {q}[{k}]) * ({c} - {q}[{k}]) + ({k} - 1) / 999.0::DOUBLE END AS u_{c}"""


@query(
    "m2_apply_quantile",
    with_pieces(
        "flows",
        f"""SELECT row_id, {', '.join(f'round((u_{c} - avg(u_{c}) OVER ()) / stddev_pop(u_{c}) OVER (), 6) AS {c}' for c in _QC)} FROM (SELECT row_id, {', '.join(map(_unit_sql, _QC))}
 FROM (SELECT *, {', '.join(f'len(list_filter(q_{c}, lambda v: v <= {c})) AS k_{c}' for c in _QC)} FROM flows, (SELECT {', '.join(f'quantile_cont({c}, {_REFS}) AS q_{c}' for c in _QC)} FROM flows) q) t) u""",
    ),
)
def _(t):
    df = t.flows().select("row_id", *_QC)
    return scaling.apply_quantile(df, scaling.fit_quantile(df, _QC, 1000))


_FP = scaling.STORED_FPRS


@query(
    "a24_score_normalizer",
    with_pieces(
        "scored",
        "SELECT round(avg(score), 6) AS normal_mean, round(stddev_pop(score) + 1e-9, 6) AS normal_std, "
        + ", ".join(f"round(quantile_cont(score, {1.0 - f!r}), 6) AS p{i}" for i, f in enumerate(_FP))
        + ", round(quantile_cont(score, 0.0), 6) AS c0, round(quantile_cont(score, 50.0::DOUBLE / 199), 6) AS c50, round(quantile_cont(score, 1.0), 6) AS c199"
        + " FROM scored WHERE label = 'Normal'",
    ),
)
def _(t):
    fit = scaling.fit_score_normalizer(t.get("scored"))
    at = lambda i: F.get("cdf_scores", F.lit(i)).alias(f"c{i}")
    return fit.select("normal_mean", "normal_std", *[F.get("percentiles", F.lit(i)).alias(f"p{i}") for i in range(6)], at(0), at(50), at(199))


@query(
    "m3_normalize_scores",
    with_pieces(
        "scored",
        """SELECT row_id, round((score - (SELECT avg(score) FROM scored WHERE label = 'Normal')) / (SELECT stddev_pop(score) + 1e-9 FROM scored WHERE label = 'Normal'), 5)
 + 0.0::DOUBLE AS z_score FROM scored""",
    ),
    digits=5,
)
def _(t):
    df = t.get("scored")
    return scaling.normalize_scores(df, scaling.fit_score_normalizer(df)).select("row_id", "z_score")


@query(
    "m3_threshold_from_cdf",
    with_pieces(
        "scored",
        """SELECT round(a + (b - a) * (199 * 0.97::DOUBLE - 193), 6) AS threshold FROM (SELECT quantile_cont(score, 193::DOUBLE / 199) AS a, quantile_cont(score, 194::DOUBLE / 199) AS b
 FROM scored WHERE label = 'Normal') t""",
    ),
)
def _(t):
    return scaling.threshold_from_cdf(scaling.fit_score_normalizer(t.get("scored")), 0.03)


_W10 = feature_weights(R10)


@query(
    "m6_weighted_error",
    with_pieces(
        "flows",
        "SELECT row_id, round(("
        + " + ".join(f"{w!r}::DOUBLE * pow({c} - {i}, 2)" for i, (c, w) in enumerate(zip(["src_port_norm"] * 6 + R10[6:], _W10)))
        + ") / 10, 6) AS error FROM flows",
    ),
)
def _(t):
    cols = ["src_port_norm"] * 6 + R10[6:]
    x = F.array(*[F.col(c) for c in cols])
    y = F.array(*[F.lit(float(i)) for i in range(10)])
    return t.flows().select("row_id", scaling.weighted_error(x, y, R10).alias("error"))


# --- thresholds and quality ------------------------------------------------------------------


@query("a10_threshold_at_fpr", with_pieces("scored", "SELECT round(quantile_cont(score, 0.99), 6) AS threshold FROM scored WHERE label = 'Normal'"))
def _(t):
    return metrics.threshold_at_fpr(t.get("scored"), 0.01)


@query("a10_threshold_lower", with_pieces("scored", "SELECT round(quantile_cont(score, 0.05), 6) AS threshold FROM scored WHERE label = 'Normal'"))
def _(t):
    return metrics.threshold_at_fpr(t.get("scored"), 0.05, metrics.LOWER)


@query("a10_threshold_fallback", with_pieces("scored", "SELECT round(quantile_cont(score, 0.995), 6) AS threshold FROM scored"))
def _(t):
    """No normal rows to calibrate on: the training scores decide."""
    df = t.get("scored")
    return metrics.threshold_at_fpr(df.filter(F.col("label") != "Normal"), 0.01, train=df)


@query(
    "a10_live_threshold",
    with_pieces(
        "scored",
        "SELECT round(quantile_cont(score, 0.995), 6) AS threshold, count(*) AS n_rows_used FROM scored WHERE status = 'NORMAL' AND support_sources = ''",
    ),
)
def _(t):
    return metrics.live_threshold(t.get("scored"), 0.995)


_T = 0.55


@query(
    "a11_score_summary",
    with_pieces(
        "scored",
        f"""SELECT count(*) AS n_rows, count(*) FILTER (label = 'Normal') AS n_normal, count(*) FILTER (label <> 'Normal') AS n_attack,
 round(avg(score) FILTER (label = 'Normal'), 6) AS normal_mean, round(avg(score) FILTER (label <> 'Normal'), 6) AS attack_mean,
 round(avg((score >= {_T}::DOUBLE)::INT) FILTER (label = 'Normal'), 6) AS estimated_fpr, round(avg((score >= {_T}::DOUBLE)::INT) FILTER (label <> 'Normal'), 6) AS estimated_tpr FROM scored""",
    ),
)
def _(t):
    return metrics.score_summary(t.get("scored"), _T)


piece("truth", ("scored",), f"SELECT *, (label <> 'Normal')::BIGINT AS y, (score >= {_T}::DOUBLE) AS hit FROM scored")


@query(
    "a13_binary_metrics",
    with_pieces(
        "truth",
        f"""SELECT tp, fp, fn, {r6('precision', 'recall')}, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall
 FROM (SELECT count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn FROM truth) a) b""",
    ),
)
def _(t):
    return metrics.binary_metrics(t.get("scored"), _T)


piece(
    "roc",
    ("truth",),
    """SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg, p, n
 FROM (SELECT score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM truth GROUP BY score) t WINDOW w AS (ORDER BY score DESC)""",
)


@query("a14_roc_auc", with_pieces("roc", "SELECT round(sum(n * (tp + tp - p) / 2) / max(pos * neg), 6) AS roc_auc FROM roc"))
def _(t):
    return metrics.roc_auc(t.get("scored"))


@query("a15_average_precision", with_pieces("roc", "SELECT round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision FROM roc"))
def _(t):
    return metrics.average_precision(t.get("scored"))


@query("a16_recall_at_fpr", with_pieces("roc", "SELECT round(max(tp / pos) FILTER (fp <= 0.05::DOUBLE * neg), 6) AS recall_at_fpr FROM roc"))
def _(t):
    return metrics.recall_at_fpr(t.get("scored"), 0.05)


@query(
    "a17_best_f1_threshold",
    with_pieces(
        "roc",
        """SELECT round(arg_max(score, (f1, score)), 6) AS threshold, round(max(f1), 6) AS best_f1 FROM
 (SELECT score, 2 * (tp / (tp + fp)) * (tp / pos) / greatest(tp / (tp + fp) + tp / pos, 1e-12) AS f1 FROM roc) t""",
    ),
)
def _(t):
    return metrics.best_f1_threshold(t.get("scored"))


@query(
    "a17_best_f1_lower",
    with_pieces(
        "truth",
        """SELECT round(-arg_max(s, (f1, s)), 6) AS threshold, round(max(f1), 6) AS best_f1 FROM (SELECT s, 2 * (tp / (tp + fp)) * (tp / pos) / greatest(tp / (tp + fp) + tp / pos, 1e-12) AS f1
 FROM (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos FROM (SELECT -score AS s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM truth GROUP BY 1) a
 WINDOW w AS (ORDER BY s DESC)) b) c""",
    ),
)
def _(t):
    return metrics.best_f1_threshold(t.get("scored"), metrics.LOWER)


@query(
    "a18_attack_breakdown",
    with_pieces(
        "truth",
        "SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(hit::INT), 6) AS recall FROM truth WHERE label <> 'Normal' GROUP BY label",
    ),
)
def _(t):
    return metrics.attack_breakdown(t.get("scored"), _T)


@query(
    "a23_class_balance",
    with_pieces(
        "flows",
        """SELECT p AS pos_count, n AS neg_count, round(p / (p + n), 6) AS pos_ratio, round(n / p, 6) AS pos_weight,
 CASE WHEN p / (p + n) < 0.1 THEN 'both' WHEN p / (p + n) < 0.25 THEN 'pos_weight' ELSE 'none' END AS balance_mode
 FROM (SELECT greatest(sum(is_attack), 1)::BIGINT AS p, greatest(sum(1 - is_attack), 1)::BIGINT AS n FROM flows) t""",
    ),
)
def _(t):
    return metrics.class_balance(t.flows())


@query(
    "a23_class_weights",
    with_pieces(
        "flows",
        """SELECT row_id, round(1000 / CASE WHEN is_attack = 1 THEN (SELECT sum(is_attack) FROM flows) ELSE (SELECT sum(1 - is_attack) FROM flows) END, 6) AS weight FROM flows""",
    ),
)
def _(t):
    return metrics.with_class_weights(t.flows()).select("row_id", (F.col("sample_weight") * 1000).alias("weight"))


@query(
    "select_threshold_best_f1",
    with_pieces("roc", """SELECT round(arg_max(score, (f1, score)), 6) AS threshold FROM
 (SELECT score, 2 * (tp / (tp + fp)) * (tp / pos) / greatest(tp / (tp + fp) + tp / pos, 1e-12) AS f1 FROM roc) t"""),
)
def _(t):
    return metrics.select_threshold(t.get("scored"), strategy="best_f1")
