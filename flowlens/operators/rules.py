"""Sliding-window detection rules and decision fusion on event time.

Rows are taken in ``(ts_us, row_id)`` order.  Every rule adds one nullable
struct column (a *support*); ``decide`` fuses them with the model score.

Fixed values: texts of reasons, names of sources and categories, and prefixes of emit keys
are read by others and must not change.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import blocked
from flowlens.operators.features import key_column
from flowlens.policy import Policy
from flowlens.session import stage

ORDER = ["ts_us", "row_id"]
SCAN = ["src_ip", "dst_ip", "protocol"]
BFA = ["src_ip", "dst_ip", "dst_port"]
SERVICE = ["dst_ip", "dst_port", "protocol"]
ENTITY = ["src_ip", "dst_ip", "dst_port", "protocol"]
FLOW = ["dpid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
_SUPPORT = "struct<reason:string,severity:string,hit_count:bigint,emit_key:string,source:string,category:string>"


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _support(reason: Column, severity: Column, hits: Column, emit_key: Column, source: Column | str, category: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        reason.alias("reason"),
        severity.alias("severity"),
        hits.cast("long").alias("hit_count"),
        emit_key.alias("emit_key"),
        text(source).alias("source"),
        text(category).alias("category"),
    ).cast(_SUPPORT)


def _seconds(s: float) -> str:
    return f"{s:.0f}s"


# --- window state -------------------------------------------------------------------


#: A window's rows are worked on in blocks of this many window lengths.
WINDOWS_PER_BLOCK = 16


def _block_us(window_us: int, block_us: int | None) -> int:
    return int(block_us or WINDOWS_PER_BLOCK * window_us)


def _attach(df: DataFrame, *found: DataFrame) -> DataFrame:
    """Window results back on their rows; all joins share the partitioning by ``row_id``."""
    for f in found:
        df = df.join(f, "row_id", "left")
    return df


def service_baseline(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """(row_id, base_packet_rate, base_byte_rate) of every row, from narrow rows.

    Rates are summed as decimals, so that leaving the window takes out exactly what
    entering it put in.
    """
    seen = F.col("has_history")
    exact = lambda c: F.when(seen, F.col(c)).otherwise(F.lit(0.0)).cast("decimal(28,9)").alias(c)
    window = _us(policy.baseline_window_s)
    rows = df.select(*SERVICE, "ts_us", "row_id", seen.cast("long").alias("seen"), exact("packet_rate"), exact("byte_rate"))
    sums = blocked.sliding_totals(
        rows,
        SERVICE,
        window,
        {"_n": F.col("seen"), "_p": F.col("packet_rate"), "_b": F.col("byte_rate")},
        _block_us(window, block_us),
        include_current=False,
    )
    return sums.select("row_id", *_base_rates(policy, "_n", "_p", "_b"))


def _base_rates(policy: Policy, n: str, packets: str, octets: str) -> list[Column]:
    """Mean rates from a count and two exact sums; null with too few rows, never below 1."""
    enough = (F.col(n) >= policy.baseline_min_samples) & (F.col(n) > 0)
    mean = lambda c: F.when(enough, F.greatest(F.col(c).cast("decimal(38,9)").cast("double") / F.col(n), F.lit(1.0)))
    return [mean(packets).alias("base_packet_rate"), mean(octets).alias("base_byte_rate")]


def with_service_baseline(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """``base_packet_rate`` / ``base_byte_rate``: mean rates of the service before this row.

    Only rows with history within the window count; null with too few of them,
    never below 1.
    """
    return _attach(df, service_baseline(df, policy, block_us))


def with_hit_streak(
    df: DataFrame, policy: Policy, keys: Sequence[str] = FLOW, block_us: int = blocked.DAY_US
) -> DataFrame:
    """``hit_streak``: consecutive model hits of the flow; a miss or a long silence ends it.

    Rows without a score neither count nor reset.
    """
    scored = F.col("score").isNotNull()
    hit = scored & S.is_hit("score", policy.threshold, policy.lower_is_attack)
    drop = []
    if "gap_us" not in df.columns:
        df = blocked.with_previous(df, keys, ORDER, {"_pts": "ts_us"}, blocked.time_block(block_us))
        df = df.withColumn("gap_us", F.col("ts_us") - F.col("_pts")).drop("_pts")
        drop = ["gap_us"]
    idle = F.coalesce(F.col("gap_us") > _us(policy.entity_idle_timeout_s), F.lit(False))
    df = blocked.running_since_reset(
        df, keys, ORDER, {"hit_streak": (hit.cast("long"), idle | (scored & ~hit))}, blocked.time_block(block_us)
    )
    return df.drop(*drop)


def _volume_flags(policy: Policy) -> dict[str, Column]:
    pr, br, base_p, base_b = (F.col(c) for c in ("packet_rate", "byte_rate", "base_packet_rate", "base_byte_rate"))
    hard = (
        (pr >= policy.hard_packet_rate)
        | (br >= policy.hard_byte_rate)
        | (F.col("packet_delta") >= policy.hard_packet_delta)
        | (F.col("byte_delta") >= policy.hard_byte_delta)
    )
    above = lambda m: F.coalesce((pr >= base_p * m) | (br >= base_b * m), F.lit(False))
    active = S.has_activity()
    return {
        "hard": active & hard,
        "warn": active & (above(policy.rate_multiplier_warn) | above(policy.rate_multiplier_attack)),
        "attackish": active & above(policy.rate_multiplier_attack),
        "calm": active & ~hard & base_p.isNotNull()
        & ~(above(policy.rate_multiplier_warn) | above(policy.rate_multiplier_attack)),
    }


def _volumetric_counter(policy: Policy) -> tuple[Column, Column]:
    f = _volume_flags(policy)
    return (f["hard"] | f["warn"]).cast("long"), f["calm"]


def _violation(policy_ports: Column) -> tuple[Column, Column]:
    """(violation, within the allowlist) of a privileged request."""
    judged = (
        (F.col("protocol") != 1)
        & (F.col("dst_port") >= 0)
        & S.has_observed()
        & ~S.is_response()
        & ~S.is_ephemeral()
        & F.coalesce(F.size(policy_ports) > 0, F.lit(False))
    )
    inside = F.coalesce(F.array_contains(policy_ports, F.col("dst_port").cast("int")), F.lit(False))
    return judged & ~inside, judged & inside


def allowed_ports(policy: Policy) -> Column:
    """Allowed ports of the row's destination, null when it has no allowlist."""
    out = F.lit(None).cast("array<int>")
    for ip, ports in policy.allowlisted_services.items():
        out = F.when(F.col("dst_ip") == ip, F.array(*[F.lit(int(p)) for p in ports])).otherwise(out)
    return out


def with_allowlist(obs: DataFrame, allow: DataFrame) -> DataFrame:
    """Look up ``(dst_ip, ports)`` rows; adds ``allowed_ports`` and ``port_allowed``.

    A plain left join: Spark broadcasts the list only when its measured size
    allows, and AQE splits a busy destination otherwise.
    """
    lists = allow.select("dst_ip", F.col("ports").alias("allowed_ports"))
    return obs.join(lists, "dst_ip", "left").withColumn(
        "port_allowed",
        F.when(F.size("allowed_ports") > 0, F.array_contains("allowed_ports", F.col("dst_port").cast("int"))),
    )


def with_volumetric_hits(df: DataFrame, policy: Policy, block_us: int = blocked.DAY_US) -> DataFrame:
    """``volumetric_hits`` per entity scope: grows on hard or warn rows, back to 0 on calm ones."""
    return blocked.running_since_reset(
        df, ENTITY, ORDER, {"volumetric_hits": _volumetric_counter(policy)}, blocked.time_block(block_us)
    )


def with_violation_hits(
    df: DataFrame, policy: Policy, ports: Column | None = None, block_us: int = blocked.DAY_US
) -> DataFrame:
    """``violation_hits``: running count of allowlist violations per entity scope."""
    bad, good = _violation(allowed_ports(policy) if ports is None else ports)
    return blocked.running_since_reset(
        df, ENTITY, ORDER, {"violation_hits": (bad.cast("long"), good)}, blocked.time_block(block_us)
    )


# --- supports -----------------------------------------------------------------------


def countable_scan(policy: Policy) -> Column:
    """Rows that can be part of a port scan."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        F.lit(not policy.disable_scan_rule)
        & (F.col("protocol") != 1)
        & text("src_ip")
        & text("dst_ip")
        & (F.col("src_ip") != "0.0.0.0")
        & (F.col("dst_port") >= 0)
        & S.has_observed()
        & ~S.is_response()
        & ~S.is_ephemeral()
    )


def scan_ports(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """(row_id, _ports) of the rows that can count for a scan; the others aren't shuffled."""
    window = _us(policy.scan_window_s)
    rows = df.filter(countable_scan(policy)).select(*SCAN, "dst_port", "ts_us", "row_id")
    return blocked.sliding_distinct(rows, SCAN, "dst_port", window, _block_us(window, block_us), "_ports").select("row_id", "_ports")


def _scan_column(policy: Policy) -> Column:
    n = F.col("_ports")
    severity = F.when(n >= policy.scan_attack_unique_ports, "high").otherwise("medium")
    reason = F.concat(
        F.lit("scan support: "), n.cast("string"), F.lit(" low dst ports to "), F.col("dst_ip"),
        F.lit(f" in {_seconds(policy.scan_window_s)}"),
    )
    emit = F.concat(F.lit("scan:"), key_column("scan"))
    hit = n >= min(policy.scan_unique_ports, policy.scan_attack_unique_ports)
    return F.when(hit, _support(reason, severity, n, emit, "scan_rule", "Probe"))


def scan_support(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """Port scan: distinct privileged ports from one source to one destination."""
    return _attach(df, scan_ports(df, policy, block_us)).withColumn("scan", _scan_column(policy)).drop("_ports")


def countable_attempt(policy: Policy) -> Column:
    """Rows that are attempts on a login port."""
    return F.col("dst_port").isin(*policy.bfa_ports) & (F.col("protocol") == 6) & S.has_observed() & ~S.is_response()


def login_attempts(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """(row_id, _tries) of the rows that are attempts on a login port; the others aren't shuffled."""
    window = _us(policy.bfa_window_s)
    rows = df.filter(countable_attempt(policy)).select(*BFA, "ts_us", "row_id")
    return blocked.sliding_totals(rows, BFA, window, {"_tries": F.lit(1).cast("long")}, _block_us(window, block_us)).select("row_id", "_tries")


def _bfa_column(policy: Policy) -> Column:
    n = F.col("_tries")
    severity = F.when(n >= policy.bfa_attack_threshold, "high").otherwise("medium")
    reason = F.concat(
        F.lit("bfa support: "), n.cast("string"), F.lit(" short TCP attempts to "), F.col("dst_ip"), F.lit(":"),
        F.col("dst_port").cast("string"), F.lit(f" in {_seconds(policy.bfa_window_s)}"),
    )
    emit = F.concat(F.lit("bfa:"), key_column("bfa"))
    return F.when(n >= policy.bfa_attempt_threshold, _support(reason, severity, n, emit, "bfa_rule", "BFA"))


def bruteforce_support(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """Brute force: TCP attempts on a login port within the window."""
    return _attach(df, login_attempts(df, policy, block_us)).withColumn("bfa", _bfa_column(policy)).drop("_tries")


def window_counts(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """What the bounded windows of the rules find (ports, attempts, service baseline), joined to the rows in one go."""
    return _attach(df, scan_ports(df, policy, block_us), login_attempts(df, policy, block_us), service_baseline(df, policy, block_us))


def from_windows(df: DataFrame, policy: Policy) -> DataFrame:
    """Scan and brute-force supports and the baseline where the windows are already counted: columns ports, tries, n, p and b."""
    df = df.select("*", *_base_rates(policy, "n", "p", "b")).withColumnsRenamed({"ports": "_ports", "tries": "_tries"})
    return df.withColumns({"scan": _scan_column(policy), "bfa": _bfa_column(policy)}).drop("_ports", "_tries", "n", "p", "b")


def counter_flags(policy: Policy) -> dict[str, tuple[Column, Column]]:
    """What each counter adds and where it is reset, of rows with their service baseline and ``gap_us``."""
    scored = F.col("score").isNotNull()
    hit = scored & S.is_hit("score", policy.threshold, policy.lower_is_attack)
    idle = F.coalesce(F.col("gap_us") > _us(policy.entity_idle_timeout_s), F.lit(False))
    return {
        "violation_hits": _violation(allowed_ports(policy)),
        "volumetric_hits": _volumetric_counter(policy),
        "hit_streak": (hit, idle | (scored & ~hit)),
    }


def from_counters(df: DataFrame, policy: Policy) -> DataFrame:
    """Decisions of rows that carry their window supports and counters."""
    ports = allowed_ports(policy)
    df = df.withColumns({"service": _service_column(policy, ports), "flood": _flood_column(policy), "volumetric": _volumetric_column(policy)})
    return fuse(support_summary(df), policy)


def _service_column(policy: Policy, ports: Column) -> Column:
    bad, _ = _violation(ports)
    hits = F.col("violation_hits")
    reason = F.concat(
        F.lit("service support: unexpected privileged dst_port "), F.col("dst_port").cast("string"),
        F.lit(" for "), F.col("dst_ip"),
    )
    severity = F.when(hits < 3, "medium").otherwise("high")
    emit = F.concat(F.lit("service:"), key_column("entity"))
    return F.when(bad, _support(reason, severity, hits, emit, "service_rule", "Service-Anomaly"))


def service_support(
    df: DataFrame, policy: Policy, ports: Column | None = None, block_us: int = blocked.DAY_US
) -> DataFrame:
    """Service anomaly: a privileged port outside the destination's allowlist."""
    ports = allowed_ports(policy) if ports is None else ports
    df = with_violation_hits(df, policy, ports, block_us)
    return df.withColumn("service", _service_column(policy, ports)).drop("violation_hits")


def _flood_column(policy: Policy) -> Column:
    pr, br, proto = F.col("packet_rate"), F.col("byte_rate"), F.col("protocol")
    avg = F.greatest(F.col("avg_packet_size"), F.lit(1.0))
    udp = (proto == 17) & ((pr >= policy.udp_flood_packet_rate) | (br >= policy.udp_flood_byte_rate))
    icmp = (proto == 1) & (pr >= policy.icmp_flood_packet_rate)
    tcp = (proto == 6) & (pr >= policy.tcp_small_pkt_attack_rate) & (avg <= policy.small_pkt_avg_size_max)
    one, high = F.lit(1), F.lit("high")
    key = key_column("entity")

    def make(reason: Column, prefix: str, source: str, category: str) -> Column:
        return _support(reason, high, one, F.concat(F.lit(prefix), key), source, category)

    return F.when(
        S.has_activity(),
        F.when(
            udp,
            make(F.format_string("udp flood support: pkt_rate=%.1f, byte_rate=%.1f", pr, br), "udp:", "udp_rule", "UDP-Flood"),
        )
        .when(icmp, make(F.format_string("icmp flood support: pkt_rate=%.1f", pr), "icmp:", "icmp_rule", "ICMP-Flood"))
        .when(
            tcp,
            make(
                F.format_string("tcp small-packet flood support: pkt_rate=%.1f, avg_size=%.1f", pr, avg),
                "tcpflood:", "tcp_flood_rule", "TCP-Flood",
            ),
        ),
    )


def flood_support(df: DataFrame, policy: Policy) -> DataFrame:
    """Protocol floods; no state."""
    return df.withColumn("flood", _flood_column(policy))


def _volumetric_column(policy: Policy) -> Column:
    f = _volume_flags(policy)
    pr, br = F.col("packet_rate"), F.col("byte_rate")
    plain = F.format_string(
        "volumetric support: pkt_rate=%.1f, byte_rate=%.1f, pkt_delta=%.1f, byte_delta=%.1f",
        pr, br, F.col("packet_delta"), F.col("byte_delta"),
    )
    based = F.format_string(
        "baseline volumetric support: pkt_rate=%.1f (%.2fx), byte_rate=%.1f (%.2fx)",
        pr, pr / F.greatest(F.col("base_packet_rate"), F.lit(S.EPS)),
        br, br / F.greatest(F.col("base_byte_rate"), F.lit(S.EPS)),
    )
    severity = F.when(f["hard"] | f["attackish"], "high").otherwise("medium")
    emit = F.concat(F.lit("vol:"), key_column("entity"))
    return F.when(
        f["hard"] | f["warn"],
        _support(
            F.when(f["hard"], plain).otherwise(based), severity, F.col("volumetric_hits"), emit,
            "volumetric_rule", "Traffic-Flood",
        ),
    )


def volumetric_support(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """Hard volume limits, else multiples of the service baseline."""
    df = with_service_baseline(df, policy, block_us)
    df = with_volumetric_hits(df, policy, block_us or blocked.DAY_US)
    return df.withColumn("volumetric", _volumetric_column(policy))


SUPPORTS = ["scan", "bfa", "service", "flood", "volumetric"]


def _pick_supports() -> Column:
    return F.filter(F.array(*SUPPORTS), lambda s: s.isNotNull())


def support_summary(df: DataFrame) -> DataFrame:
    """Ordered support list with its severity, headline and dominant category."""
    df = df.withColumn("supports", _pick_supports())
    s = F.col("supports")
    n = F.size(s)
    has = lambda level: F.exists(s, lambda x: x["severity"] == level)
    return df.withColumns(
        {
            "support_count": n,
            "support_severity": F.when(has("high"), "high").when(has("medium"), "medium").otherwise("low"),
            "support_headline": _headline(s),
            "support_category": F.get(s, F.lit(0))["category"],
            "support_sources": F.array_join(F.transform(s, lambda x: x["source"]), ","),
            "support_reasons": F.array_join(F.transform(s, lambda x: x["reason"]), " | "),
        }
    )


def _headline(s: Column) -> Column:
    n = F.size(s)
    first = F.get(s, F.lit(0))["reason"]
    return (
        F.when(n == 0, "")
        .when(n == 1, first)
        .otherwise(F.concat(first, F.lit(" (+"), (n - 1).cast("string"), F.lit(" supports)")))
    )


def _counted(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """Observations with the numbers that the rules are judged by; no texts yet.

    The bounded windows run on narrow rows of the observations, which they read four
    times; what they find is joined to the rows, and the counters over the entity scope
    read that twice. So both are staged.
    """
    df = stage(window_counts(stage(df, "observations"), policy, block_us), "rule-windows")
    bad, good = _violation(allowed_ports(policy))
    return blocked.running_since_reset(
        df,
        ENTITY,
        ORDER,
        {"violation_hits": (bad.cast("long"), good), "volumetric_hits": _volumetric_counter(policy)},
        blocked.time_block(block_us or blocked.DAY_US),
    )


def _supported(df: DataFrame, policy: Policy) -> DataFrame:
    """Supports of counted rows and their summary."""
    columns = {
        "scan": _scan_column(policy),
        "bfa": _bfa_column(policy),
        "service": _service_column(policy, allowed_ports(policy)),
        "flood": _flood_column(policy),
        "volumetric": _volumetric_column(policy),
    }
    return support_summary(df.withColumns(columns).drop("_ports", "_tries"))


def with_supports(df: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """All five rules on one observation table, and their summary."""
    return _supported(_counted(df, policy, block_us), policy)


# --- fusion -----------------------------------------------------------------------------


def _decision(**fields: Column | str) -> Column:
    order = ["status", "reason", "severity", "hit_count", "emit_key", "decision_source", "category", "sources", "reasons"]
    return F.struct(
        *[(F.lit(fields[k]) if isinstance(fields[k], str) else fields[k]).alias(k) for k in order]
    )


def fuse(df: DataFrame, policy: Policy, flow_key: Column | None = None) -> DataFrame:
    """Decision of rows that carry supports, ``score`` and ``hit_streak``."""
    key = key_column("runtime") if flow_key is None else flow_key
    df = df.withColumn("entity_key", key)
    s, n = F.col("supports"), F.col("support_count")
    sev, headline, key = F.col("support_severity"), F.col("support_headline"), F.col("entity_key")
    any_support = n > 0
    strong = sev.isin("high", "medium")
    first = lambda f: F.get(s, F.lit(0))[f]
    most = F.coalesce(F.array_max(F.transform(s, lambda x: x["hit_count"])), F.lit(0)).cast("long")
    bfa = F.exists(s, lambda x: x["category"] == "BFA")
    reasons, sources = F.col("support_reasons"), F.col("support_sources")
    category = F.coalesce(first("category"), F.lit("Anomaly"))
    emit = F.coalesce(F.get(F.filter(F.transform(s, lambda x: x["emit_key"]), lambda k: k != ""), F.lit(0)), key)

    severe = F.filter(s, lambda x: x["severity"] == "high")
    emergency_on = policy.emergency_rules_enabled and policy.rules_only_attack_enabled
    emergency = F.lit(emergency_on) & (F.size(severe) >= 2)
    one_severe = lambda f: F.get(severe, F.lit(0))[f]
    d_emergency = _decision(
        status="ATTACK",
        reason=F.concat(F.lit("emergency rules-only attack | "), _headline(severe)),
        severity="high",
        hit_count=F.lit(0).cast("long"),
        emit_key=one_severe("emit_key"),
        decision_source=one_severe("source"),
        category=F.coalesce(one_severe("category"), F.lit("Emergency")),
        sources=F.array_join(F.transform(severe, lambda x: x["source"]), ","),
        reasons=F.array_join(F.transform(severe, lambda x: x["reason"]), " | "),
    )

    # without a score
    confirmed = any_support & strong & bfa
    d_support = _decision(
        status=F.when(confirmed, "ATTACK").otherwise("SUSPECT"),
        reason=F.when(confirmed, F.concat(F.lit("rule-confirmed attack | "), headline)).otherwise(headline),
        severity=sev,
        hit_count=most,
        emit_key=emit,
        decision_source=first("source"),
        category=category,
        sources=sources,
        reasons=reasons,
    )
    zero = F.lit(0).cast("long")
    quiet = dict(status="NORMAL", severity="low", hit_count=zero, category="Normal", sources=sources, reasons=reasons)
    d_idle = _decision(reason="", emit_key="", decision_source="runtime", **quiet)
    unscored = F.when(emergency, d_emergency).when(any_support, d_support).otherwise(d_idle)

    # with a score
    score, streak, t = F.col("score"), F.col("hit_streak"), F.lit(policy.threshold)
    hit = S.is_hit(score, t, policy.lower_is_attack)
    margin = t - score if policy.lower_is_attack else score - t
    floor_ok = S.is_hit(score, policy.attack_display_floor, policy.lower_is_attack)
    attack = (
        (sev == "high")
        | (floor_ok & (streak >= policy.min_alert_hits))
        | (streak >= policy.min_alert_hits + 1)
    )
    said = F.format_string("model threshold hit %d times (margin=%.5f)", streak, margin)
    d_hit = _decision(
        status=F.when(attack, "ATTACK").otherwise("SUSPECT"),
        reason=F.when(headline != "", F.concat(said, F.lit(" | "), headline)).otherwise(said),
        severity=F.when(attack & ((sev == "high") | floor_ok), "high").otherwise("medium"),
        hit_count=streak,
        emit_key=F.concat(F.lit("model:"), key),
        decision_source="model",
        category=F.coalesce(first("category"), F.lit("Model-Attack")),
        sources=sources,
        reasons=reasons,
    )
    near = S.near_threshold(score, t, policy.lower_is_attack, policy.rule_assist_ratio)
    d_assist = _decision(
        status=F.when(bfa & ~near, "ATTACK").otherwise("SUSPECT"),
        reason=F.concat(
            F.when(near, "model borderline near threshold | ").otherwise("rule support without model hit | "), headline
        ),
        severity=F.when(sev == "high", "high").otherwise("medium"),
        hit_count=most,
        emit_key=F.concat(F.lit("assist:"), key),
        decision_source=F.when(near, "model+rules").otherwise(first("source")),
        category=category,
        sources=sources,
        reasons=reasons,
    )
    d_miss = _decision(reason="score below threshold", emit_key="", decision_source="model", **quiet)
    scored = (
        F.when(hit, d_hit)
        .when(emergency, d_emergency)
        .when(any_support & (near | strong), d_assist)
        .otherwise(d_miss)
    )
    df = df.withColumn("_d", F.when(score.isNull(), unscored).otherwise(scored))
    names = ["status", "reason", "severity", "hit_count", "emit_key", "decision_source", "category"]
    return (
        df.drop("support_sources", "support_reasons")
        .withColumns(
            {
                **{c: F.col(f"_d.{c}") for c in names},
                "support_sources": F.col("_d.sources"),
                "support_reasons": F.col("_d.reasons"),
                # blocking is a policy of ours: severe attacks only
                "block": (F.col("_d.status") == "ATTACK") & (F.col("_d.severity") == "high"),
                "model_hit": F.coalesce(hit, F.lit(False)),
                "threshold": t,
            }
        )
        .drop("_d")
    )


#: Columns of an observation that ``decide`` reads.  It stages and shuffles whole rows, so
#: who needs no others should select these first; others are carried along.
DECISION_COLUMNS = [
    "row_id", "ts_us", *FLOW, "packet_count", "byte_count", "has_history", "gap_us", "packet_rate", "byte_rate",
    "packet_delta", "byte_delta", "avg_packet_size", "score",
]


def decide(obs: DataFrame, policy: Policy, block_us: int | None = None) -> DataFrame:
    """Observations with a nullable ``score`` to decisions.

    Texts and supports are made behind the last window, so that only numbers are sorted.
    Stage the columns needed before filtering by status or another result: Spark pushes a filter
    below the projections it is made of.
    """
    df = _counted(obs, policy, block_us)
    df = with_hit_streak(df, policy, FLOW, block_us or blocked.DAY_US)
    return fuse(_supported(df, policy), policy)
