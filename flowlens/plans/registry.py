"""Query registry: name -> (Spark plan, oracle SQL) and the shared SQL pieces."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import features, polls
from flowlens.plans import fixtures
from flowlens.policy import Policy
from flowlens.session import compile_wide, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR

TEST_POLICY = Policy.from_dict(
    {
        "threshold": 0.5,
        "scan_window_s": 86400,
        "scan_unique_ports": 4,
        "scan_attack_unique_ports": 8,
        "bfa_window_s": 86400,
        "bfa_attempt_threshold": 3,
        "bfa_attack_threshold": 5,
        "udp_flood_packet_rate": 12,
        "alert_cooldown_seconds": 43200,
        "force_emit_after_s": 43200,
        "baseline_window_s": 86400,
        "baseline_min_samples": 3,
        "rate_multiplier_warn": 1.2,
        "rate_multiplier_attack": 1.5,
        "hard_packet_delta": 10,
        "hard_byte_delta": 8000,
        "hard_packet_rate": 1e5,
        "hard_byte_rate": 1e8,
        "entity_idle_timeout_s": 172800,
        "idle_timeout_s": 172800,
        "tcp_small_pkt_attack_rate": 15,
        "small_pkt_avg_size_max": 600,
        "alert_hold_seconds": 1800,
        "runtime_idle_reset_s": 600,
        "allowlisted_services": {"10.0.1.0": [22, 80], "10.0.1.1": [53]},
    }
)

FLOW_COLS = "dpid, src_ip, dst_ip, src_port, dst_port, protocol"


def final(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles, long integers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(T)`` where ``T`` loads fixture tables of the scale factor."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return final(fn(Tables(spark, sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


class Tables:
    """Fixture tables and the derived frames that several queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        compile_wide(spark)

    def get(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def flows(self) -> DataFrame:
        """Typed flow rows with features, labels and the default key."""
        df = features.with_label_columns(features.with_flow_features(self.get("flow_export")))
        return features.with_key(df, "service")

    def flow_obs(self) -> DataFrame:
        """Completed flows as observations without history."""
        zero = F.lit(0.0)
        return self.flows().withColumns(
            {"has_history": F.lit(False), "packet_delta": zero, "byte_delta": zero}
        )

    def obs(self) -> DataFrame:
        """Poll readings with deltas; a two-day silence drops the state.

        Staged: this is the telemetry table that the rules and reports read.
        """
        df = polls.with_poll_deltas(self.get("poll_stats"), idle_timeout_s=TEST_POLICY.idle_timeout_s)
        return stage(df, "telemetry")

    def scored_runs(self) -> DataFrame:
        """Scored rows spread over three runs."""
        return self.get("scored").withColumns(
            {
                "run_id": F.concat(F.lit("run"), (F.col("row_id") % 3).cast("string")),
                "category": F.when(F.col("status") == "ATTACK", F.col("label")).otherwise("Normal"),
            }
        )


# --- oracle pieces -----------------------------------------------------------------

LABEL_CASE = """CASE WHEN low IN ('','nan','none','normal','benign','background') THEN 'Normal'
 WHEN contains(low,'ddos') THEN 'DDoS' WHEN starts_with(low,'dos') THEN 'DoS'
 WHEN contains(low,'probe') OR contains(low,'scan') THEN 'Probe'
 WHEN contains(low,'brute') OR low = 'bfa' OR contains(low,'patator') THEN 'BFA'
 WHEN contains(low,'web attack') OR contains(low,'xss') OR contains(low,'sql') THEN 'Web-Attack'
 WHEN contains(low,'bot') THEN 'BOTNET' WHEN low = 'u2r' OR contains(low,'infiltration') THEN 'U2R'
 ELSE trim(label_raw) END"""

PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), fixtures.SQL[name].format(us=fixtures.DUCK_US)) for name in fixtures.SQL
}
PIECES["poll_stats"] = (
    (),
    "SELECT * REPLACE (dst_port::BIGINT AS dst_port, protocol::BIGINT AS protocol) FROM ("
    + fixtures.SQL["poll_stats"].format(us=fixtures.DUCK_US)
    + ") t",
)
PIECES["labelled"] = (
    ("flow_export",),
    f"""SELECT *, {LABEL_CASE} AS label FROM (SELECT *,
 trim(regexp_replace(translate(lower(trim(label_raw)), '_-', '  '), '\\s+', ' ', 'g')) AS low FROM flow_export) t""",
)
PIECES["flows"] = (
    ("labelled",),
    """SELECT *, packet_count / dsafe AS packet_rate, byte_count / dsafe AS byte_rate,
 CASE WHEN packet_count > 0 THEN byte_count / greatest(packet_count, 1.0::DOUBLE) ELSE 0.0 END AS avg_packet_size,
 CAST(label <> 'Normal' AS BIGINT) AS is_attack,
 CAST(coalesce(list_position(['Normal','DDoS','DoS','Probe','BFA','Web-Attack','BOTNET','U2R'], label), 1) - 1 AS BIGINT) AS label_index,
 least(greatest(src_port, 0), 65535)::DOUBLE / 65535::DOUBLE AS src_port_norm,
 least(greatest(dst_port, 0), 65535)::DOUBLE / 65535::DOUBLE AS dst_port_norm,
 (protocol = 6)::INT::DOUBLE AS protocol_tcp, (protocol = 17)::INT::DOUBLE AS protocol_udp, (protocol = 1)::INT::DOUBLE AS protocol_icmp,
 concat_ws('__', src_ip, dst_ip, dst_port, protocol) AS conversation_key
FROM (SELECT *, CASE WHEN flow_duration_s = 0 THEN 1e-6 ELSE flow_duration_s END AS dsafe
 FROM (SELECT *, greatest(fwd_pkts + bwd_pkts, 0)::DOUBLE AS packet_count, greatest(fwd_bytes + bwd_bytes, 0)::DOUBLE AS byte_count,
  greatest(duration_us::DOUBLE / 1e6, 0::DOUBLE) AS flow_duration_s FROM labelled) a) b""",
)
PIECES["flow_obs"] = (
    ("flows",),
    "SELECT *, false AS has_history, 0::DOUBLE AS packet_delta, 0::DOUBLE AS byte_delta FROM flows",
)


def obs_sql(source: str, idle_s: float | None) -> str:
    """Poll deltas over ``source``; ``idle_s`` restarts history after a silence."""
    idle = "" if idle_s is None else f" AND ts_us - pts <= {int(idle_s * 1_000_000)}"
    return f"""SELECT * EXCLUDE (pts, pp, pb, pd, ppr, pbr), ts_us - pts AS gap_us,
 CASE WHEN has_history THEN greatest(packet_count - pp, 0) ELSE 0 END::DOUBLE AS packet_delta,
 CASE WHEN has_history THEN greatest(byte_count - pb, 0) ELSE 0 END::DOUBLE AS byte_delta,
 CASE WHEN has_history THEN packet_rate - ppr ELSE 0 END AS packet_rate_delta,
 CASE WHEN has_history THEN byte_rate - pbr ELSE 0 END AS byte_rate_delta
FROM (SELECT *, packet_count / greatest(duration_s, 1e-6) AS packet_rate, byte_count / greatest(duration_s, 1e-6) AS byte_rate,
 byte_count / greatest(packet_count, 1)::DOUBLE AS avg_packet_size,
 pp / greatest(pd, 1e-6) AS ppr, pb / greatest(pd, 1e-6) AS pbr,
 (pts IS NOT NULL{idle}) AS has_history
 FROM (SELECT *, lag(ts_us) OVER w AS pts, lag(packet_count) OVER w AS pp, lag(byte_count) OVER w AS pb, lag(duration_s) OVER w AS pd
  FROM {source} WINDOW w AS (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id)) a) b"""


PIECES["obs"] = (("poll_stats",), obs_sql("poll_stats", TEST_POLICY.idle_timeout_s))
PIECES["scored_runs"] = (
    ("scored",),
    """SELECT *, concat('run', row_id % 3) AS run_id, CASE WHEN status = 'ATTACK' THEN label ELSE 'Normal' END AS category FROM scored""",
)


def piece(name: str, deps: tuple[str, ...], text: str) -> None:
    PIECES[name] = (deps, text)


def with_pieces(names: str, body: str, recursive: str = "") -> str:
    """``body`` after the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in PIECES[n][0]:
            visit(d)
        order.append(n)

    for n in names.split():
        visit(n)
    ctes = [f"{n} AS ({PIECES[n][1].strip()})" for n in order]
    if recursive:
        return "WITH RECURSIVE " + ",\n".join(ctes + [recursive.strip()]) + "\n" + body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def r6(*cols: str, digits: int = 6) -> str:
    """``round(x, d) + 0.0 AS x`` for each column (the sum drops a negative zero)."""
    return ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in cols)
