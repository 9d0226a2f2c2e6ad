"""Queries: sources, scalar functions, filters, expansion, windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import alerts, blocked, features, polls, snapshots, windows
from flowlens.plans.registry import FLOW_COLS, HOUR, TEST_POLICY, piece, query, r6, with_pieces
from flowlens.policy import feature_names
from flowlens.session import new_path
from flowlens.sources import exports

R10 = feature_names()
_EXPORT = {v: k for k, v in exports.EXPORT_COLUMNS.items()}


def _as_text_export(t):
    """The flow export as the all-text rows a CSV read gives."""
    df = t.get("flow_export").withColumn("timestamp", F.date_format(F.timestamp_micros("ts_us"), "d/M/yyyy HH:mm:ss"))
    return df.select("row_id", "source_file", *[F.col(c).cast("string").alias(c) for c in exports.EXPORT_COLUMNS.values()])


_TYPED = f"""SELECT row_id, source_file, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, label, is_attack, label_index,
 conversation_key, ts_us // 1000000 * 1000000 AS ts_us, {r6('packet_count', 'byte_count', 'flow_duration_s', 'packet_rate', 'byte_rate')} FROM flows"""
_TYPED_COLS = ["row_id", "source_file", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label", "is_attack",
               "label_index", "conversation_key", "ts_us", "packet_count", "byte_count", "flow_duration_s", "packet_rate", "byte_rate"]


@query("s1_read_flow_export", with_pieces("flows", _TYPED.replace("row_id, ", "", 1)))
def _(t):
    """Write the export as CSV files with the reference headers, read them back."""
    path = new_path(t.spark, "export")
    raw = _as_text_export(t)
    for name in exports.DEFAULT_FILES:
        part = raw.filter(F.col("source_file") == name)
        # padded header cells, as in real exports
        part.select(*[F.col(c).alias(f" {h} ") for c, h in _EXPORT.items()]).write.option("header", True).option(
            "ignoreLeadingWhiteSpace", False
        ).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}")
    return exports.read_flow_export(t.spark, path).select(*_TYPED_COLS[1:])


piece(
    "alternate",
    ("labelled",),
    """SELECT row_id, source_file, src_port, dst_port, protocol, duration_us, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes, label,
 CASE row_id % 4 WHEN 0 THEN 'inf' WHEN 1 THEN '-1' WHEN 2 THEN cast(row_id % 97 + 1 AS VARCHAR) ELSE 'bad' END AS pps FROM labelled""",
)


def _alternate_source(t):
    """Same flows under the alternate header spellings, without addresses."""
    rid = F.col("row_id")
    pps = F.when(rid % 4 == 0, "inf").when(rid % 4 == 1, "-1").when(rid % 4 == 2, (rid % 97 + 1).cast("string")).otherwise("bad")
    names = {
        "src_port": "source_port", "dst_port": "Destination-Port", "protocol": "Protocol", "duration_us": "FLOW DURATION",
        "fwd_pkts": "Total Fwd Packets", "bwd_pkts": "Total Backward Packets", "fwd_bytes": "TotLen Fwd Pkts",
        "bwd_bytes": "Total Length of Bwd Packets", "label_raw": "Class",
    }
    return t.get("flow_export").select(
        "row_id", "source_file", pps.alias("Flow Pkts/s"), *[F.col(c).cast("string").alias(a) for c, a in names.items()]
    )


@query(
    "s2_resolve_aliases",
    with_pieces(
        "alternate flow_export",
        """SELECT a.row_id, a.source_file, a.src_port::VARCHAR AS src_port, a.dst_port::VARCHAR AS dst_port,
 a.duration_us::VARCHAR AS duration_us, a.pps AS packet_rate_raw, '0.0' AS byte_rate_raw, '0.0' AS bwd_packet_rate,
 f.label_raw FROM alternate a JOIN flow_export f USING (row_id)""",
    ),
)
def _(t):
    df = exports.resolve_aliases(_alternate_source(t))
    return df.select("row_id", "source_file", "src_port", "dst_port", "duration_us", "packet_rate_raw", "byte_rate_raw",
                     "bwd_packet_rate", "label_raw")


@query(
    "s3_read_replay",
    with_pieces(
        "flows",
        f"""SELECT row_id, ts_us, conversation_key AS flow_key, 0::BIGINT AS dpid, src_ip, dst_ip, src_port, dst_port,
 CASE WHEN protocol = 1 THEN 0 ELSE protocol END AS protocol, true AS has_history, label, 'unknown' AS source_file,
 {r6('packet_count', 'byte_count')}, 0.0::DOUBLE AS packet_delta FROM flows""",
    ),
)
def _(t):
    """A replay table with absent columns; a zero protocol stays zero."""
    src = t.flows().select(
        "row_id", "ts_us", "conversation_key", "src_ip", "dst_ip", "src_port", "dst_port", "label", "packet_count", "byte_count",
        F.when(F.col("protocol") == 1, 0).otherwise(F.col("protocol")).alias("protocol"),
    )
    df = exports.replay_order(exports.replay_rows(src))
    return df.select("row_id", "ts_us", "flow_key", "dpid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "has_history",
                     "label", "source_file", "packet_count", "byte_count", "packet_delta")


@query(
    "s2_read_alternate_folder",
    with_pieces("flow_export labelled", """SELECT f.src_port, f.dst_port, f.protocol, f.fwd_pkts::DOUBLE AS fwd_pkts, f.bwd_bytes::DOUBLE AS bwd_bytes, l.label
 FROM flow_export f JOIN labelled l USING (row_id)"""),
)
def _(t):
    """A folder of two alternate exports with other header order and spelling."""
    path = new_path(t.spark, "alternate")
    src = _alternate_source(t).drop("source_file")
    first = src.filter("row_id % 2 = 0").drop("row_id")
    other = src.filter("row_id % 2 = 1").select(*[F.col(f"`{c}`").alias(c.upper().replace("_", " ")) for c in reversed(src.columns) if c != "row_id"])
    first.write.option("header", True).csv(f"{path}/a")
    other.write.option("header", True).csv(f"{path}/b")
    df = exports.read_alternate_export(t.spark, path)
    return df.select("src_port", "dst_port", "protocol", "fwd_pkts", "bwd_bytes", "label")


@query(
    "s3_read_replay_csv",
    with_pieces(
        "flows",
        f"""SELECT ts_us, conversation_key AS flow_key, src_ip, dst_ip, src_port, dst_port, protocol, label, {r6('packet_count', 'byte_count')} FROM flows""",
    ),
)
def _(t):
    """A replay table written as CSV and read back in time order."""
    path = new_path(t.spark, "replay")
    cols = ["ts_us", "conversation_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label", "packet_count", "byte_count"]
    t.flows().select(*cols).write.option("header", True).csv(path)
    df = exports.read_replay(t.spark, path)
    return df.select("ts_us", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label", "packet_count", "byte_count")


@query(
    "w1_poll_deltas_null_keys",
    with_pieces(
        "poll_stats",
        """SELECT row_id, lag(row_id) OVER w IS NOT NULL AS has_history, coalesce(greatest(packet_count - lag(packet_count) OVER w, 0), 0)::DOUBLE AS packet_delta
 FROM (SELECT * REPLACE (CASE WHEN src_port % 5 = 0 THEN NULL ELSE dst_ip END AS dst_ip, CASE WHEN src_port % 7 = 0 THEN NULL ELSE src_port END AS src_port) FROM poll_stats)
 WINDOW w AS (PARTITION BY dpid, src_ip, dst_ip, src_port, dst_port, protocol ORDER BY ts_us, row_id)""",
    ),
)
def _(t):
    """Readings without a destination or a source port are flows like any other."""
    port = F.col("src_port")
    src = t.get("poll_stats").withColumns({"dst_ip": F.when(port % 5 != 0, F.col("dst_ip")), "src_port": F.when(port % 7 != 0, port)})
    return polls.with_poll_deltas(src).select("row_id", "has_history", "packet_delta")


@query(
    "s6_sample_telemetry",
    with_pieces("obs", f"SELECT row_id, ts_us, {r6('packet_delta', 'byte_delta')} FROM obs WHERE row_id % 5 = 0"),
)
def _(t):
    return exports.sample_telemetry(t.obs(), 5).select("row_id", "ts_us", "packet_delta", "byte_delta")


@query(
    "s7_conversion_manifest",
    with_pieces(
        "flows",
        """SELECT CASE WHEN grouping(source_file) = 1 THEN 'TOTAL' ELSE source_file END AS file, count(*) AS n_rows,
 sum(is_attack)::BIGINT AS attack_rows, (count(*) - sum(is_attack))::BIGINT AS normal_rows FROM flows GROUP BY ROLLUP (source_file)""",
    ),
)
def _(t):
    return exports.conversion_manifest(t.flows())


@query(
    "u1_union_files",
    with_pieces(
        "flow_export",
        """SELECT row_id, source_file, CASE WHEN source_file = 'OVS.csv' THEN NULL ELSE flow_id END AS flow_id, fwd_pkts FROM flow_export""",
    ),
)
def _(t):
    df = t.get("flow_export").select("row_id", "source_file", "flow_id", "fwd_pkts")
    ovs = F.col("source_file") == "OVS.csv"
    return df.filter(~ovs).unionByName(df.filter(ovs).drop("flow_id"), allowMissingColumns=True)


# --- scalars --------------------------------------------------------------------------

_DIRTY = """CASE event_id % 8 WHEN 0 THEN 'inf' WHEN 1 THEN 'NaN' WHEN 2 THEN ' ' || event_id || ' ' WHEN 3 THEN '-Infinity'
 WHEN 4 THEN 'x' || event_id WHEN 5 THEN value::{s} WHEN 6 THEN NULL ELSE '1e3' END"""


@query(
    "p1_num",
    f"""SELECT event_id AS row_id, CASE event_id % 8 WHEN 2 THEN event_id::DOUBLE WHEN 5 THEN round(value, 6) WHEN 7 THEN 1000.0
 ELSE -1.0 END::DOUBLE AS x FROM events""",
)
def _(t):
    from flowlens.plans.fixtures import events

    df = events(t.spark, t.sf_dir).withColumn("raw", F.expr(_DIRTY.format(s="string")))
    return df.select(F.col("event_id").alias("row_id"), S.num("raw", -1.0).alias("x"))


@query("p2_normalise_label", with_pieces("labelled", "SELECT label_raw, label, count(*) AS n FROM labelled GROUP BY ALL"))
def _(t):
    df = t.get("flow_export").withColumn("label", S.normalise_label("label_raw"))
    return df.groupBy("label_raw", "label").agg(F.count(F.lit(1)).alias("n"))


@query("p3_label_columns", with_pieces("flows", "SELECT row_id, label, is_attack, label_index FROM flows"))
def _(t):
    return features.with_label_columns(t.get("flow_export")).select("row_id", "label", "is_attack", "label_index")


@query(
    "p4_parse_ts",
    with_pieces(
        "flow_export",
        """SELECT row_id, CASE row_id % 5 WHEN 4 THEN row_id * 1000
 WHEN 2 THEN ts_us // 60000000 * 60000000 ELSE ts_us // 1000000 * 1000000 END AS ts_us FROM flow_export""",
    ),
)
def _(t):
    at, rid = F.timestamp_micros("ts_us"), F.col("row_id") % 5
    text = (
        F.when(rid == 0, F.date_format(at, "dd/MM/yyyy hh:mm:ss a"))
        .when(rid == 1, F.date_format(at, "d/M/yyyy HH:mm:ss"))
        .when(rid == 2, F.date_format(at, "d/M/yyyy H:mm"))
        .when(rid == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("31/31/2024 nonsense")
    )
    df = t.get("flow_export").withColumn("raw", text)
    return df.select("row_id", F.unix_micros(S.parse_ts("raw", "row_id")).alias("ts_us"))


_F10 = ["packet_count", "byte_count", "flow_duration_s", "packet_rate", "byte_rate", "avg_packet_size", "src_port_norm",
        "dst_port_norm", "protocol_tcp", "protocol_udp", "protocol_icmp"]


@query("p5_flow_features", with_pieces("flows", f"SELECT row_id, {r6(*_F10)} FROM flows"))
def _(t):
    return features.with_flow_features(t.get("flow_export")).select("row_id", *_F10)


_ALT = ["flow_duration_s", "packet_count", "byte_count", "packet_rate", "byte_rate", "avg_packet_size", "dst_port_norm",
        "fwd_pkt_fraction", "fwd_byte_fraction", "protocol_norm", "inter_poll_gap_s"]


@query(
    "p6_alt_flow_features",
    with_pieces(
        "alternate",
        f"""SELECT row_id, replace(source_file, '.csv', '') || '__proto_' || protocol || '__dstport_' || dst_port AS conversation_key,
 label, {r6(*_ALT)} FROM (SELECT *,
 CASE WHEN row_id % 4 = 2 THEN (row_id % 97 + 1)::DOUBLE ELSE packet_count / greatest(flow_duration_s, 1e-6) END AS packet_rate,
 byte_count / greatest(flow_duration_s, 1e-6) AS byte_rate, byte_count / greatest(packet_count, 1::DOUBLE) AS avg_packet_size,
 least(greatest(dst_port, 0), 65535)::DOUBLE / 65535::DOUBLE AS dst_port_norm,
 least(greatest(fwd_pkts::DOUBLE / greatest(packet_count, 1::DOUBLE), 0::DOUBLE), 1::DOUBLE) AS fwd_pkt_fraction,
 least(greatest(fwd_bytes::DOUBLE / greatest(byte_count, 1::DOUBLE), 0::DOUBLE), 1::DOUBLE) AS fwd_byte_fraction,
 protocol::DOUBLE / 255::DOUBLE AS protocol_norm, flow_duration_s AS inter_poll_gap_s
 FROM (SELECT *, CASE WHEN duration_us > 0 THEN duration_us::DOUBLE / 1e6 ELSE 0.001 END::DOUBLE AS flow_duration_s,
  (fwd_pkts + bwd_pkts)::DOUBLE AS packet_count, (fwd_bytes + bwd_bytes)::DOUBLE AS byte_count FROM alternate) a) b""",
    ),
)
def _(t):
    df = exports.alternate_rows(exports.resolve_aliases(_alternate_source(t)))
    return df.select("row_id", "conversation_key", "label", *_ALT)


@query(
    "p7_port_norm",
    """SELECT event_id AS row_id, round(least(greatest(event_id * 37 - 5000, 0), 65535)::DOUBLE / 65535::DOUBLE, 6) AS x FROM events""",
)
def _(t):
    from flowlens.plans.fixtures import events

    return events(t.spark, t.sf_dir).select(
        F.col("event_id").alias("row_id"), S.port_norm(F.col("event_id") * 37 - 5000).alias("x")
    )


@query(
    "p8_protocol_onehot",
    with_pieces(
        "flow_export",
        """SELECT row_id, (protocol = 6)::INT::DOUBLE AS protocol_tcp, (protocol = 17)::INT::DOUBLE AS protocol_udp,
 (protocol = 1)::INT::DOUBLE AS protocol_icmp FROM flow_export""",
    ),
)
def _(t):
    return features.with_protocol_onehot(t.get("flow_export")).select("row_id", "protocol_tcp", "protocol_udp", "protocol_icmp")


@query(
    "p9_entity_keys",
    with_pieces(
        "flow_export",
        """SELECT row_id, concat_ws('__', src_ip, dst_ip, src_port, dst_port, protocol) AS flow,
 concat_ws('__', src_ip, dst_ip, dst_port, protocol) AS service,
 source_file || '__proto_' || protocol || '__dstport_' || dst_port AS file_service,
 'dp' || (row_id % 3) || '|src=' || src_ip || '|dst=' || dst_ip || '|proto=' || protocol || '|sport=' || src_port || '|dport=' || dst_port AS runtime,
 'dp' || (row_id % 3) || '|src=' || src_ip || '|dst=' || dst_ip || '|proto=' || protocol || '|dport=' || dst_port AS runtime_service
 FROM flow_export""",
    ),
)
def _(t):
    df = t.get("flow_export").withColumn("dpid", F.col("row_id") % 3)
    modes = ["flow", "service", "file_service", "runtime", "runtime_service"]
    return df.select("row_id", *[features.key_column(m).alias(m) for m in modes])


def _with_match(t):
    """Match fields as nested JSON; UDP rows use udp_*, ICMP rows have no ports."""
    item = lambda f, v: F.concat(F.lit('{"OXMTlv": {"field": "%s", "value": "' % f), v.cast("string"), F.lit('"}}'))
    p = F.col("protocol")
    ports = (
        F.when(p == 6, F.array(item("tcp_src", F.col("src_port")), item("tcp_dst", F.col("dst_port"))))
        .when(p == 17, F.array(item("udp_src", F.col("src_port")), item("udp_dst", F.col("dst_port"))))
        .otherwise(F.array().cast("array<string>"))
    )
    base = F.array(item("eth_type", F.lit(2048)), item("ipv4_src", F.col("src_ip")), item("ipv4_dst", F.col("dst_ip")), item("ip_proto", p))
    text = F.concat(F.lit("["), F.array_join(F.concat(base, ports), ", "), F.lit("]"))
    return t.get("flow_export").select("row_id", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration_us", text.alias("match"))


@query(
    "p10_extract_match",
    with_pieces(
        "flow_export",
        """SELECT row_id, src_ip, dst_ip, CASE WHEN protocol = 1 THEN -1 ELSE src_port END AS src_port,
 CASE WHEN protocol = 1 THEN -1 ELSE dst_port END AS dst_port, protocol, -1::BIGINT AS in_port FROM flow_export""",
    ),
)
def _(t):
    df = features.extract_match(_with_match(t))
    return df.select("row_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "in_port")


@query(
    "p11_feature_vector",
    with_pieces(
        "flows",
        "SELECT row_id, 10::BIGINT AS n, " + ", ".join(f"round({c}, 6) AS v{i}" for i, c in enumerate(R10)) + " FROM flows",
    ),
)
def _(t):
    df = features.with_feature_vector(t.flows())
    return df.select("row_id", F.size("feature_vector").alias("n"), *[F.get("feature_vector", F.lit(i)).alias(f"v{i}") for i in range(10)])


@query(
    "p12_signed_log1p",
    """SELECT event_id AS row_id, round(sign(value - 20) * ln(1 + abs(value - 20)), 6) + 0.0::DOUBLE AS x FROM events""",
)
def _(t):
    from flowlens.plans.fixtures import events

    return events(t.spark, t.sf_dir).select(F.col("event_id").alias("row_id"), S.signed_log1p(F.col("value") - 20).alias("x"))


@query(
    "p13_finite_or",
    """SELECT event_id AS row_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1e6 WHEN 2 THEN -1e6 ELSE round(value, 6) END::DOUBLE AS x FROM events""",
)
def _(t):
    from flowlens.plans.fixtures import events

    r = F.col("event_id") % 5
    x = F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r == 2, float("-inf")).otherwise(F.col("value"))
    return events(t.spark, t.sf_dir).select(F.col("event_id").alias("row_id"), S.finite_or(x).alias("x"))


def _staged_obs(t):
    """Poll readings with the nullable stage stamps of the live path."""
    rid, at = F.col("row_id"), F.col("poll_reply_us")
    return t.get("poll_stats").withColumns(
        {
            "poll_request_us": F.when(rid % 9 != 0, F.col("poll_request_us")),
            "feature_enqueue_us": at + rid % 700 - 20,
            "inference_enqueue_us": F.when(rid % 4 != 0, at + 1000),
            "inference_start_us": F.when(rid % 4 != 0, at + 1000 + rid % 5000),
            "inference_end_us": F.when(rid % 4 != 0, at + 9000 + rid % 800),
            "alert_emit_us": at + 12000,
        }
    )


piece(
    "latency",
    ("poll_stats",),
    """SELECT row_id, ts_us, CASE WHEN req IS NOT NULL THEN greatest((rep - req) / 1000.0::DOUBLE, 0::DOUBLE) END AS switch_latency_ms,
 greatest((feat - rep) / 1000.0::DOUBLE, 0::DOUBLE) AS feature_build_ms,
 CASE WHEN st IS NOT NULL THEN greatest((st - enq) / 1000.0::DOUBLE, 0::DOUBLE) END AS inference_queue_wait_ms,
 CASE WHEN st IS NOT NULL THEN greatest((en - st) / 1000.0::DOUBLE, 0::DOUBLE) END AS inference_ms,
 CASE WHEN en IS NOT NULL THEN greatest((emit - en) / 1000.0::DOUBLE, 0::DOUBLE) END AS postprocess_ms,
 greatest((emit - coalesce(req, feat)) / 1000.0::DOUBLE, 0::DOUBLE) AS total_e2e_ms
 FROM (SELECT row_id, ts_us, poll_reply_us AS rep, CASE WHEN row_id % 9 <> 0 THEN poll_request_us END AS req, poll_reply_us + row_id % 700 - 20 AS feat,
  CASE WHEN row_id % 4 <> 0 THEN poll_reply_us + 1000 END AS enq, CASE WHEN row_id % 4 <> 0 THEN poll_reply_us + 1000 + row_id % 5000 END AS st,
  CASE WHEN row_id % 4 <> 0 THEN poll_reply_us + 9000 + row_id % 800 END AS en, poll_reply_us + 12000 AS emit FROM poll_stats) t""",
)


@query("p14_latency_breakdown", with_pieces("latency", f"SELECT row_id, {r6(*features.LATENCY_COLUMNS)} FROM latency"))
def _(t):
    return features.with_latency_breakdown(_staged_obs(t)).select("row_id", *features.LATENCY_COLUMNS)


@query(
    "a6_avg_latency",
    with_pieces("latency", "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in features.LATENCY_COLUMNS) + " FROM latency"),
)
def _(t):
    return features.avg_latency(features.with_latency_breakdown(_staged_obs(t)))


# --- filters ---------------------------------------------------------------------------


def _stats(t):
    """Match entries with counters: some invalid, some without traffic."""
    df = features.extract_match(_with_match(t))
    rid = F.col("row_id")
    return df.withColumns(
        {
            "priority": (rid % 6).cast("int"),
            "eth_type": F.when(rid % 13 == 0, 2054).otherwise(F.col("eth_type")),
            "packet_count": F.when(rid % 11 == 0, 0).otherwise(F.col("fwd_pkts")),
            "byte_count": F.when(rid % 11 == 0, 0).otherwise(F.col("fwd_bytes")),
            "duration_sec": F.floor(F.col("duration_us") / 1e6).cast("long"),
            "duration_nsec": (F.col("duration_us") % 1000000) * 1000,
            "dpid": rid % 3 + 1,
            "poll_cycle_id": F.floor(rid / 200).cast("long"),
        }
    )


_VALID = "row_id % 6 > 0 AND row_id % 13 <> 0 AND row_id % 11 <> 0"


@query("f1_valid_flow_stats", with_pieces("flow_export", f"SELECT row_id, src_ip, dst_ip FROM flow_export WHERE {_VALID}"))
def _(t):
    return features.valid_flow_stats(_stats(t)).select("row_id", "src_ip", "dst_ip")


@query(
    "a1_aggregate_reply",
    with_pieces(
        "flow_export",
        f"""SELECT row_id % 3 + 1 AS dpid, row_id // 200 AS poll_cycle_id, src_ip || '>' || dst_ip AS flow_key,
 sum(fwd_pkts)::DOUBLE AS packet_count, sum(fwd_bytes)::DOUBLE AS byte_count,
 round(max(duration_us // 1000000 + (duration_us % 1000000) * 1000 / 1e9), 6) AS duration_s
 FROM flow_export WHERE {_VALID} GROUP BY 1, 2, 3""",
    ),
)
def _(t):
    df = features.valid_flow_stats(_stats(t)).withColumn("flow_key", F.concat("src_ip", F.lit(">"), "dst_ip"))
    return polls.aggregate_reply(df)


@query(
    "f2_flow_predicates",
    with_pieces(
        "flow_export",
        """SELECT row_id, (src_port > 0 AND src_port <= 1024 AND dst_port >= 1024) AS response, dst_port >= 1024 AS ephemeral FROM flow_export""",
    ),
)
def _(t):
    return t.get("flow_export").select("row_id", S.is_response().alias("response"), S.is_ephemeral().alias("ephemeral"))


@query(
    "f2_activity_predicates",
    with_pieces(
        "obs",
        """SELECT row_id, (has_history AND (packet_delta > 0 OR byte_delta > 0)) AS activity,
 ((has_history AND (packet_delta > 0 OR byte_delta > 0)) OR packet_count > 0 OR byte_count > 0) AS observed FROM obs""",
    ),
)
def _(t):
    return t.obs().select("row_id", S.has_activity().alias("activity"), S.has_observed().alias("observed"))


@query(
    "f6_drop_low_information",
    with_pieces("obs", "SELECT row_id, ts_us FROM obs WHERE has_history AND (packet_delta > 0 OR byte_delta > 0)"),
)
def _(t):
    return features.drop_low_information(t.obs()).select("row_id", "ts_us")


@query(
    "f7_threshold_predicates",
    with_pieces(
        "scored",
        """SELECT row_id, score >= 0.5::DOUBLE AS hit, score <= 0.5::DOUBLE AS hit_low, score >= 0.5::DOUBLE * 0.92::DOUBLE AS near,
 score <= 0.5::DOUBLE / 0.92::DOUBLE AS near_low FROM scored""",
    ),
)
def _(t):
    return t.get("scored").select(
        "row_id", S.is_hit("score", 0.5).alias("hit"), S.is_hit("score", 0.5, True).alias("hit_low"),
        S.near_threshold("score", 0.5).alias("near"), S.near_threshold("score", 0.5, True).alias("near_low"),
    )


# --- polls ---------------------------------------------------------------------------------

_DELTAS = ["packet_rate", "byte_rate", "avg_packet_size", "packet_delta", "byte_delta", "packet_rate_delta", "byte_rate_delta"]
from flowlens.plans.registry import obs_sql  # noqa: E402

piece("plain_obs", ("poll_stats",), obs_sql("poll_stats", None))


@query("w1_poll_deltas", with_pieces("plain_obs", f"SELECT row_id, has_history, {r6(*_DELTAS, digits=3)} FROM plain_obs"), digits=3)
def _(t):
    return polls.with_poll_deltas(t.get("poll_stats")).select("row_id", "has_history", *_DELTAS)


@query(
    "t1_trim_reply",
    with_pieces(
        "obs",
        """SELECT row_id, reply_rank FROM (SELECT row_id, row_number() OVER (PARTITION BY dpid, row_id // 500 ORDER BY has_history::INT DESC,
 CASE WHEN has_history THEN packet_delta ELSE packet_count END DESC, CASE WHEN has_history THEN byte_delta ELSE byte_count END DESC,
 CASE WHEN has_history THEN packet_count ELSE 0 END DESC, row_id) AS reply_rank FROM obs) t WHERE reply_rank <= 20""",
    ),
)
def _(t):
    df = t.obs().withColumn("poll_cycle_id", F.floor(F.col("row_id") / 500).cast("long"))
    return polls.trim_reply(df, 20).select("row_id", "reply_rank")


@query(
    "t1_trim_under_pressure",
    with_pieces(
        "obs",
        """SELECT row_id, reply_rank FROM (SELECT row_id, dpid, row_id // 500 AS cycle, count(*) OVER (PARTITION BY dpid, row_id // 500) AS items,
 row_number() OVER (PARTITION BY dpid, row_id // 500 ORDER BY has_history::INT DESC,
 CASE WHEN has_history THEN packet_delta ELSE packet_count END DESC, CASE WHEN has_history THEN byte_delta ELSE byte_count END DESC,
 CASE WHEN has_history THEN packet_count ELSE 0 END DESC, row_id) AS reply_rank FROM obs) t
 WHERE CASE WHEN cycle % 4 = 0 THEN CASE WHEN dpid = 1 THEN reply_rank <= 10 ELSE reply_rank <= 40 END WHEN cycle % 4 = 1 AND items > 80 THEN reply_rank <= 40 ELSE true END""",
    ),
)
def _(t):
    """Pressure and time-outs of the switch decide how much of a reply stays."""
    cycle = F.floor(F.col("row_id") / 500).cast("long")
    pressure = F.when(cycle % 4 == 0, "high").when(cycle % 4 == 1, "medium").otherwise("low")
    df = t.obs().withColumn("poll_cycle_id", cycle)
    return polls.trim_under_pressure(df, pressure, F.when(F.col("dpid") == 1, 1).otherwise(0), 40, 10).select("row_id", "reply_rank")


_LATEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FLOW_COLS} ORDER BY ts_us DESC, row_id DESC) AS rr,
 count(*) OVER (PARTITION BY {FLOW_COLS}) AS seen_polls, min(ts_us) OVER (PARTITION BY {FLOW_COLS}) AS first_us FROM obs) t WHERE rr = 1"""
piece("latest_flows", ("obs",), _LATEST)


@query(
    "t2_active_flows",
    with_pieces(
        "latest_flows",
        f"""SELECT {FLOW_COLS}, packet_count::DOUBLE AS last_packet_count, byte_count::DOUBLE AS last_byte_count,
 round(packet_rate, 3) AS last_packet_rate, round(byte_rate, 3) AS last_byte_rate,
 round((ts_us - first_us) / 1e6, 3) AS flow_age_s, seen_polls, ts_us AS last_seen_us FROM latest_flows
 ORDER BY ts_us DESC, packet_rate DESC, byte_rate DESC, {FLOW_COLS} LIMIT 120""",
    ),
    digits=3,
)
def _(t):
    return polls.active_flows(t.obs(), 120)


@query(
    "a28_topology_hosts",
    with_pieces(
        "obs",
        """SELECT ip, (SELECT count(*) FROM (SELECT src_ip FROM obs UNION SELECT dst_ip FROM obs) c) AS host_count
 FROM (SELECT src_ip AS ip FROM obs UNION SELECT dst_ip FROM obs) h WHERE ip <> '' ORDER BY ip LIMIT 60""",
    ),
)
def _(t):
    return polls.topology(t.obs())[1]


@query(
    "a28_topology_links",
    with_pieces(
        "latest_flows",
        f"""SELECT dpid, src_ip, dst_ip, dst_port, protocol, round(packet_rate, 3) AS packet_rate, round(byte_rate, 3) AS byte_rate
 FROM latest_flows ORDER BY ts_us DESC, latest_flows.packet_rate DESC, latest_flows.byte_rate DESC, {FLOW_COLS} LIMIT 60""",
    ),
    digits=3,
)
def _(t):
    return polls.topology(t.obs())[2]


piece(
    "correlated",
    ("poll_log",),
    """SELECT poll_cycle_id, dpid, request_us, ok_us AS reply_us, CASE WHEN ok_us IS NOT NULL THEN flows END AS flows,
 CASE WHEN ok_us IS NOT NULL THEN parts END AS parts, CASE WHEN ok_us IS NOT NULL THEN trimmed END AS trimmed, ok_us IS NULL AS timed_out,
 (ok_us - request_us) / 1000.0::DOUBLE AS reply_delay_ms
 FROM (SELECT *, CASE WHEN reply_us <= request_us + 600000 THEN reply_us END AS ok_us FROM poll_log) t""",
)


def _correlated(t):
    log = t.get("poll_log")
    replies = log.filter(F.col("reply_us").isNotNull()).select("dpid", "poll_cycle_id", "reply_us", "flows", "parts", "trimmed")
    return polls.correlate_polls(log.select("dpid", "poll_cycle_id", "request_us"), replies, 0.6)


@query("j3_correlate_polls", with_pieces("correlated", "SELECT * REPLACE (round(reply_delay_ms, 6) AS reply_delay_ms) FROM correlated"))
def _(t):
    return _correlated(t)


_METRICS = """SELECT dpid, count(*) AS polls_sent, count(reply_us) AS replies_received, sum(timed_out::INT)::BIGINT AS timeouts,
 coalesce(avg(reply_delay_ms), 0) AS avg_reply_delay_ms, coalesce(max(reply_delay_ms), 0) AS max_reply_delay_ms,
 arg_max(reply_delay_ms, (reply_us, poll_cycle_id)) FILTER (NOT timed_out) AS last_reply_delay_ms, avg(flows) AS avg_flows_per_reply,
 sum(flows)::BIGINT AS total_flows_observed, arg_max(flows, (reply_us, poll_cycle_id)) FILTER (NOT timed_out) AS last_flows_per_reply,
 (arg_max(parts, (reply_us, poll_cycle_id)) FILTER (NOT timed_out))::BIGINT AS last_reply_parts,
 coalesce(sum((trimmed > 0)::INT), 0)::BIGINT AS trimmed_replies, sum(trimmed)::BIGINT AS trimmed_flows FROM correlated GROUP BY dpid"""
piece("switch_metrics", ("correlated",), _METRICS)
_MS = "avg_reply_delay_ms max_reply_delay_ms last_reply_delay_ms avg_flows_per_reply".split()


@query(
    "a4_switch_poll_metrics",
    with_pieces("switch_metrics", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _MS)}) FROM switch_metrics"),
)
def _(t):
    return polls.switch_poll_metrics(_correlated(t))


@query(
    "a5_polling_summary",
    with_pieces(
        "switch_metrics",
        """SELECT count(*) AS switch_count, sum(timeouts)::BIGINT AS timeout_total, round(avg(avg_reply_delay_ms), 6) AS avg_reply_delay_ms,
 round(max(max_reply_delay_ms), 6) AS max_reply_delay_ms, round(avg(avg_flows_per_reply), 6) AS avg_flows_per_reply,
 sum(trimmed_flows)::BIGINT AS trimmed_flows_total FROM switch_metrics""",
    ),
)
def _(t):
    return polls.polling_summary(polls.switch_poll_metrics(_correlated(t)))


@query(
    "p16_pressure_state",
    with_pieces(
        "correlated",
        """SELECT poll_cycle_id, CASE WHEN (timed_out AND poll_cycle_id % 2 = 0) OR rq >= 90 OR raw >= 60 OR d >= 550 THEN 'high'
 WHEN rq >= 30 OR raw >= 20 OR d >= 330 THEN 'medium' ELSE 'normal' END AS pressure
 FROM (SELECT *, poll_cycle_id % 97 AS rq, poll_cycle_id % 61 AS raw, coalesce(reply_delay_ms, 0) AS d FROM correlated) t""",
    ),
)
def _(t):
    df = _correlated(t)
    pid = F.col("poll_cycle_id")
    return df.select(
        "poll_cycle_id",
        S.pressure_state(
            pid % 97, pid % 61, F.when(F.col("timed_out") & (pid % 2 == 0), 1).otherwise(0),
            F.coalesce("reply_delay_ms", F.lit(0.0)), 90, 60, 550.0,
        ).alias("pressure"),
    )


@query(
    "p17_recommended_interval",
    with_pieces(
        "correlated",
        """SELECT poll_cycle_id, round(greatest(lo, least(hi, x4)), 6) AS recommended FROM (
 SELECT *, CASE WHEN raw >= 60 THEN greatest(x3, least(hi, x3 * 1.10::DOUBLE + 0.05::DOUBLE)) ELSE x3 END AS x4 FROM (
 SELECT *, CASE WHEN rq >= 90 THEN greatest(x2, least(hi, x2 * 1.15::DOUBLE + 0.10::DOUBLE))
  WHEN rq <= 16 AND raw <= 8 AND d <= 220 AND tm = 0 AND thr > 0 THEN least(x2, greatest(lo, x2 * 0.95::DOUBLE)) ELSE x2 END AS x3 FROM (
 SELECT *, CASE WHEN d >= 550 THEN greatest(x1, least(hi, x1 * 1.10::DOUBLE + 0.05::DOUBLE)) ELSE x1 END AS x2 FROM (
 SELECT *, CASE WHEN tm > 0 THEN greatest(cur, least(hi, cur * 1.20::DOUBLE + 0.10::DOUBLE)) ELSE cur END AS x1 FROM (
 SELECT poll_cycle_id, poll_cycle_id % 97 AS rq, poll_cycle_id % 61 AS raw, coalesce(reply_delay_ms, 0) AS d, (timed_out AND poll_cycle_id % 2 = 0)::INT AS tm,
  poll_cycle_id % 5 AS thr, 1.0::DOUBLE + (poll_cycle_id % 4)::DOUBLE / 4 AS cur, 0.5::DOUBLE AS lo, 2.0::DOUBLE AS hi FROM correlated) a) b) c) d) e""",
    ),
)
def _(t):
    pid = F.col("poll_cycle_id")
    return _correlated(t).select(
        "poll_cycle_id",
        S.recommended_interval(
            F.lit(1.0) + (pid % 4) / 4, F.lit(0.5), F.lit(2.0), pid % 97, pid % 61, F.coalesce("reply_delay_ms", F.lit(0.0)),
            F.when(F.col("timed_out") & (pid % 2 == 0), 1).otherwise(0), pid % 5, 90, 60, 550.0,
        ).alias("recommended"),
    )
