"""Row-wise feature derivation: labels, rates, keys, vectors, latencies."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.policy import DEFAULT_SCHEME, feature_names


def with_label_columns(df: DataFrame, raw: str = "label_raw") -> DataFrame:
    df = df.withColumns({"_low": S.fold_text(raw), "_text": S.strip(raw)})
    return (
        df.withColumn("label", S.label_of(F.col("_low"), F.col("_text")))
        .withColumns({"is_attack": S.is_attack("label"), "label_index": S.label_index("label")})
        .drop("_low", "_text")
    )


def with_protocol_onehot(df: DataFrame, protocol: str = "protocol") -> DataFrame:
    p = F.col(protocol)
    return df.withColumns(
        {
            "protocol_tcp": (p == 6).cast("double"),
            "protocol_udp": (p == 17).cast("double"),
            "protocol_icmp": (p == 1).cast("double"),
        }
    )


def with_flow_features(df: DataFrame) -> DataFrame:
    """Counts, duration, rates and norms of a completed flow.

    Needs ``fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes, duration_us`` and the
    identity columns.  A duration of exactly 0 counts as 1e-6 s in the rates.
    """
    zero = F.lit(0.0)
    packets = F.greatest(S.clean("fwd_pkts") + S.clean("bwd_pkts"), zero)
    octets = F.greatest(S.clean("fwd_bytes") + S.clean("bwd_bytes"), zero)
    df = df.withColumns(
        {
            "packet_count": packets,
            "byte_count": octets,
            "flow_duration_s": F.greatest(S.clean("duration_us") / 1e6, zero),
        }
    )
    safe = F.when(F.col("flow_duration_s") == 0, S.EPS).otherwise(F.col("flow_duration_s"))
    df = df.withColumns(
        {
            "packet_rate": F.col("packet_count") / safe,
            "byte_rate": F.col("byte_count") / safe,
            "avg_packet_size": F.when(
                F.col("packet_count") > 0, S.ratio(F.col("byte_count"), F.col("packet_count"), 1.0)
            ).otherwise(zero),
            "src_port_norm": S.port_norm("src_port"),
            "dst_port_norm": S.port_norm("dst_port"),
        }
    )
    return with_protocol_onehot(df)


def with_alt_flow_features(
    df: DataFrame, scheme: str = "telemetry_v2", poll_interval_s: float = 2.0
) -> DataFrame:
    """Features of an export that already carries rate columns.

    ``packet_rate_raw`` / ``byte_rate_raw`` win when they are finite and
    positive; a non-positive duration becomes a millisecond.  Deltas are placeholders.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    duration = F.greatest(S.clean("duration_us"), zero) / 1e6
    df = df.withColumns(
        {
            "flow_duration_s": F.when(duration > 0, duration).otherwise(F.lit(0.001)),
            "packet_count": S.clean("fwd_pkts") + S.clean("bwd_pkts"),
            "byte_count": S.clean("fwd_bytes") + S.clean("bwd_bytes"),
        }
    )

    def rate(raw: str, count: str) -> Column:
        given = S.clean(raw)
        return F.when(given > 0, given).otherwise(S.ratio(F.col(count), F.col("flow_duration_s"), S.EPS))

    cols = {
        "packet_rate": rate("packet_rate_raw", "packet_count"),
        "byte_rate": rate("byte_rate_raw", "byte_count"),
        "avg_packet_size": S.ratio(F.col("byte_count"), F.col("packet_count"), 1.0),
        "packet_delta": zero,
        "byte_delta": zero,
        "packet_rate_delta": zero,
        "byte_rate_delta": zero,
        "dst_port_norm": S.port_norm("dst_port"),
    }
    if scheme == "telemetry_v2":
        share = lambda part, whole: F.least(
            F.greatest(S.ratio(S.clean(part), F.col(whole), 1.0), zero), one
        )
        cols["fwd_pkt_fraction"] = share("fwd_pkts", "packet_count")
        cols["fwd_byte_fraction"] = share("fwd_bytes", "byte_count")
        cols["protocol_norm"] = F.least(F.greatest(S.clean("protocol") / 255.0, zero), one)
        cols["inter_poll_gap_s"] = F.greatest(F.col("flow_duration_s"), F.lit(0.001))
    else:
        cols["flow_age_s"] = F.col("flow_duration_s")
        cols["inter_poll_gap_s"] = F.lit(float(poll_interval_s))
    return df.withColumns(cols)


def _whole(c: str, default: int = -1) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(default)).cast("string")


def key_column(mode: str = "flow") -> Column:
    """Entity keys.

    ``flow`` and ``service`` name completed flows, ``file_service`` an export
    without addresses, ``runtime`` / ``runtime_service`` live switch flows;
    ``entity``, ``scan``, ``bfa`` and ``service_scope`` are the rule scopes.
    """
    src, dst = F.coalesce(S.strip("src_ip"), F.lit("")), F.coalesce(S.strip("dst_ip"), F.lit(""))
    sport, dport, proto = _whole("src_port"), _whole("dst_port"), _whole("protocol")
    lit = F.lit
    if mode == "flow":
        return F.concat_ws("__", src, dst, sport, dport, proto)
    if mode == "service":
        return F.concat_ws("__", src, dst, dport, proto)
    if mode == "file_service":
        return F.concat(F.col("source_file"), lit("__proto_"), proto, lit("__dstport_"), dport)
    if mode in ("runtime", "runtime_service"):
        base = [lit("dp"), _whole("dpid"), lit("|src="), src, lit("|dst="), dst, lit("|proto="), proto]
        if mode == "runtime":
            base += [lit("|sport="), sport]
        return F.concat(*base, lit("|dport="), dport)
    if mode == "entity":
        return F.concat(src, lit("->"), dst, lit(":"), dport, lit(":"), proto)
    if mode == "scan":
        return F.concat(src, lit("->"), dst, lit(":"), proto)
    if mode == "bfa":
        return F.concat(src, lit("->"), dst, lit(":"), dport)
    if mode == "service_scope":
        return F.concat(dst, lit(":"), dport, lit(":"), proto)
    raise ValueError(f"unknown key mode {mode!r}")


def with_key(df: DataFrame, mode: str = "flow", name: str = "conversation_key") -> DataFrame:
    return df.withColumn(name, key_column(mode))


def extract_match(df: DataFrame, json_col: str = "match") -> DataFrame:
    """Match fields from a JSON list ``[{"OXMTlv": {"field": .., "value": ..}}]``.

    Also reads bare ``{"field": .., "value": ..}`` items.  TCP ports win over
    UDP ports; missing numbers are -1, missing text is empty.
    """
    # an object value of a string map is kept as its JSON text
    maps = F.from_json(F.col(json_col), "array<map<string,string>>")
    items = F.transform(
        maps,
        lambda m: F.when(
            m["field"].isNotNull(), F.struct(m["field"].alias("field"), m["value"].alias("value"))
        ).otherwise(F.from_json(F.get(F.map_values(m), F.lit(0)), "field string, value string")),
    )
    # names are folded and empty values dropped once, not once per field
    named = F.transform(items, lambda x: F.struct(F.lower(F.trim(x["field"])).alias("field"), x["value"].alias("value")))
    df = df.withColumn("_items", F.filter(named, lambda x: x["value"].isNotNull() & (x["value"] != "")))

    def last_of(name: str) -> Column:
        return F.try_element_at(F.filter("_items", lambda x: x["field"] == name), F.lit(-1))["value"]

    def field(*names: str) -> Column:
        return F.coalesce(*[last_of(n) for n in names])

    whole = lambda *names: F.coalesce(F.trim(field(*names)).try_cast("long"), F.lit(-1))
    text = lambda name: F.coalesce(S.strip(field(name)), F.lit(""))
    return df.withColumns(
        {
            "src_ip": text("ipv4_src"),
            "dst_ip": text("ipv4_dst"),
            "src_port": whole("tcp_src", "udp_src"),
            "dst_port": whole("tcp_dst", "udp_dst"),
            "protocol": whole("ip_proto"),
            "in_port": whole("in_port"),
            "eth_type": whole("eth_type"),
        }
    ).drop("_items")


def with_feature_vector(df: DataFrame, scheme: str = DEFAULT_SCHEME, name: str = "feature_vector") -> DataFrame:
    """Ordered array of the scheme's features; absent or non-finite ones are 0."""
    have = set(df.columns)
    items = [S.clean(f) if f in have else F.lit(0.0) for f in feature_names(scheme)]
    return df.withColumn(name, F.array(*items))


LATENCY_COLUMNS = [
    "switch_latency_ms",
    "feature_build_ms",
    "inference_queue_wait_ms",
    "inference_ms",
    "postprocess_ms",
    "total_e2e_ms",
]


def with_latency_breakdown(df: DataFrame, stages: Mapping[str, str] | None = None) -> DataFrame:
    """Stage latencies in ms from nullable microsecond stamps; null when an end is null."""
    names = {
        "request": "poll_request_us",
        "reply": "poll_reply_us",
        "feature": "feature_enqueue_us",
        "enqueue": "inference_enqueue_us",
        "start": "inference_start_us",
        "end": "inference_end_us",
        "emit": "alert_emit_us",
    }
    names.update(stages or {})
    at = {k: F.col(v) for k, v in names.items()}

    def span(a: Column, b: Column) -> Column:
        # greatest() skips nulls, so guard it
        d = (b - a) / 1000.0
        return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))

    return df.withColumns(
        {
            "switch_latency_ms": span(at["request"], at["reply"]),
            "feature_build_ms": span(at["reply"], at["feature"]),
            "inference_queue_wait_ms": span(at["enqueue"], at["start"]),
            "inference_ms": span(at["start"], at["end"]),
            "postprocess_ms": span(at["end"], at["emit"]),
            "total_e2e_ms": span(F.coalesce(at["request"], at["feature"]), at["emit"]),
        }
    )


def avg_latency(df: DataFrame, columns: Sequence[str] = LATENCY_COLUMNS) -> DataFrame:
    """Mean of each latency column over its finite values."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.agg(*[F.avg(ok(c)).alias(c) for c in columns])


def valid_flow_stats(df: DataFrame) -> DataFrame:
    """IPv4 table entries with both addresses and some traffic."""
    return df.filter(
        (F.col("priority") > 0)
        & (F.col("eth_type") == 0x0800)
        & (F.coalesce("src_ip", F.lit("")) != "")
        & (F.coalesce("dst_ip", F.lit("")) != "")
        & ((F.col("packet_count") > 0) | (F.col("byte_count") > 0))
    )


def drop_low_information(df: DataFrame) -> DataFrame:
    """Shed rows without history or without a positive delta."""
    return df.filter(S.has_activity())
