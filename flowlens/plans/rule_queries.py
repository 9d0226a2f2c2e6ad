"""Queries: rule windows, supports, decisions, alerts, run status, tracking."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import alerts, metrics, polls, rules
from flowlens.operators.features import with_feature_vector
from flowlens.plans.registry import FLOW_COLS, HOUR, DAY, TEST_POLICY as P, obs_sql, piece, query, r6, with_pieces
from flowlens.session import new_path, stage
from flowlens.sources import exports

W_DAY = 86_400_000_000
SEEN = "(b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.row_id <= a.row_id))"
BEFORE = "(b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.row_id < a.row_id))"
RESPONSE = "(src_port > 0 AND src_port <= 1024 AND dst_port >= 1024)"
ACTIVE = "(has_history AND (packet_delta > 0 OR byte_delta > 0))"
OBSERVED = f"({ACTIVE} OR packet_count > 0 OR byte_count > 0)"
SCANNABLE = f"(protocol <> 1 AND src_ip <> '' AND dst_ip <> '' AND src_ip <> '0.0.0.0' AND dst_port >= 0 AND dst_port < 1024 AND {OBSERVED} AND NOT {RESPONSE})"
LOGIN = f"(dst_port IN (21, 22, 23) AND protocol = 6 AND {OBSERVED} AND NOT {RESPONSE})"


def rule_pieces(src: str, p: str) -> None:
    """Oracle pieces of every rule over table ``src``; names start with ``p``."""
    piece(f"{p}scan_n", (src,), f"""SELECT a.row_id, count(DISTINCT b.dst_port) AS n FROM {src} a JOIN {src} b
 ON a.src_ip = b.src_ip AND a.dst_ip = b.dst_ip AND a.protocol = b.protocol AND b.ts_us >= a.ts_us - {W_DAY} AND {SEEN}
 WHERE {q('a', SCANNABLE)} AND {q('b', SCANNABLE)} GROUP BY a.row_id""")
    piece(f"{p}bfa_n", (src,), f"""SELECT a.row_id, count(*) AS n FROM {src} a JOIN {src} b
 ON a.src_ip = b.src_ip AND a.dst_ip = b.dst_ip AND a.dst_port = b.dst_port AND b.ts_us >= a.ts_us - {W_DAY} AND {SEEN}
 WHERE {q('a', LOGIN)} AND {q('b', LOGIN)} GROUP BY a.row_id""")
    piece(f"{p}base", (src,), f"""SELECT a.row_id, greatest(avg(b.packet_rate), 1) AS base_packet_rate, greatest(avg(b.byte_rate), 1) AS base_byte_rate
 FROM {src} a JOIN {src} b ON a.dst_ip = b.dst_ip AND a.dst_port = b.dst_port AND a.protocol = b.protocol AND b.ts_us >= a.ts_us - {W_DAY} AND {BEFORE}
 WHERE b.has_history GROUP BY a.row_id HAVING count(*) >= {P.baseline_min_samples}""")
    allow = "CASE dst_ip WHEN '10.0.1.0' THEN [22, 80] WHEN '10.0.1.1' THEN [53] END"
    judged = f"(protocol <> 1 AND dst_port >= 0 AND dst_port < 1024 AND {OBSERVED} AND NOT {RESPONSE} AND ({allow}) IS NOT NULL)"
    piece(f"{p}viol", (src,), f"""SELECT row_id, bad, sum(bad::INT) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY ts_us, row_id)::BIGINT AS violation_hits
 FROM (SELECT *, ({judged} AND NOT list_contains(coalesce({allow}, []), dst_port)) AS bad FROM {src}) t""")
    piece(f"{p}vflag", (src, f"{p}base"), f"""SELECT s.*, base_packet_rate, base_byte_rate, {ACTIVE} AND (packet_rate >= 1e5 OR byte_rate >= 1e8 OR packet_delta >= 10 OR byte_delta >= 8000) AS hard,
 {ACTIVE} AND coalesce(packet_rate >= base_packet_rate * 1.2::DOUBLE OR byte_rate >= base_byte_rate * 1.2::DOUBLE, false) AS warn,
 {ACTIVE} AND coalesce(packet_rate >= base_packet_rate * 1.5::DOUBLE OR byte_rate >= base_byte_rate * 1.5::DOUBLE, false) AS attackish
 FROM {src} s LEFT JOIN {p}base b USING (row_id)""")
    ent = "PARTITION BY src_ip, dst_ip, dst_port, protocol"
    piece(f"{p}vol", (f"{p}vflag",), f"""SELECT *, sum((hard OR warn)::INT) OVER ({ent}, g ORDER BY ts_us, row_id)::BIGINT AS volumetric_hits FROM (SELECT *,
 sum((packet_delta IS NOT NULL AND {ACTIVE} AND NOT hard AND NOT warn AND base_packet_rate IS NOT NULL)::INT) OVER ({ent} ORDER BY ts_us, row_id) AS g FROM {p}vflag) t""")


def q(alias: str, text: str) -> str:
    """Qualify the columns of a predicate."""
    import re

    cols = "src_ip dst_ip src_port dst_port protocol has_history packet_delta byte_delta packet_count byte_count".split()
    return re.sub(r"\b(" + "|".join(cols) + r")\b", alias + r".\1", text)


rule_pieces("flow_obs", "f_")
rule_pieces("obs", "o_")

_SUP = ["reason", "severity", "hit_count", "emit_key", "source", "category"]


def _shown(df, support):
    return df.filter(F.col(support).isNotNull()).select("row_id", *[F.col(f"{support}.{c}").alias(c) for c in _SUP])


def _with_reason(df, support, *numbers):
    """The support without its reason, the reason's text with ``#`` for numbers, and whether its numbers are ``numbers`` to the digits shown."""
    reason = F.col(f"{support}.reason")
    shown = F.regexp_extract_all(reason, F.lit(r"-?[0-9]+[.][0-9]+"), F.lit(0))
    real = F.filter(F.array(*[n.cast("double") for n in numbers]), lambda x: x.isNotNull())
    near = F.zip_with(shown, real, lambda a, b: F.abs(a.cast("double") - b) <= F.pow(F.lit(10.0), -F.length(F.substring_index(a, ".", -1))) * 0.5 + 1e-9 * F.abs(b))
    right = (F.size(shown) == F.size(real)) & F.forall(near, lambda x: x)
    df = df.filter(F.col(support).isNotNull())
    return df.select("row_id", *[F.col(f"{support}.{c}").alias(c) for c in _SUP[1:]], F.regexp_replace(reason, r"-?[0-9]+[.][0-9]+", "#").alias("reason_text"), right.alias("reason_right"))


@query("w6_service_baseline", with_pieces("obs o_base", f"""SELECT o.row_id, {r6('base_packet_rate', 'base_byte_rate', digits=3)} FROM obs o LEFT JOIN o_base USING (row_id)"""), digits=3)
def _(t):
    return rules.with_service_baseline(t.obs(), P).select("row_id", "base_packet_rate", "base_byte_rate")


piece("obs_score", ("obs",), f"""SELECT * EXCLUDE (k), 'dp' || dpid || '|src=' || src_ip || '|dst=' || dst_ip || '|proto=' || protocol || '|sport=' || src_port || '|dport=' || dst_port AS entity_key,
 k AS buffered, CASE WHEN k >= 4 THEN packet_delta / (packet_delta + 5.0::DOUBLE) END AS score FROM (SELECT *, least(4, row_number() OVER (PARTITION BY {FLOW_COLS}, sess ORDER BY ts_us, row_id)) AS k
 FROM (SELECT *, sum((NOT has_history)::INT) OVER (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id) AS sess FROM obs) a) b""")
piece("streak", ("obs_score",), f"""SELECT *, sum(hit::INT) OVER (PARTITION BY {FLOW_COLS}, g ORDER BY ts_us, row_id)::BIGINT AS hit_streak FROM (SELECT *,
 sum((coalesce(gap_us > {int(P.entity_idle_timeout_s * 1e6)}, false) OR (score IS NOT NULL AND NOT hit))::INT) OVER (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id) AS g
 FROM (SELECT *, (score IS NOT NULL AND score >= 0.5::DOUBLE) AS hit FROM obs_score) a) b""")


def _obs_score(t):
    """Observations with a toy score once the sequence buffer is full."""
    df = with_feature_vector(t.obs())
    df = polls.rolling_sequences(df, 4, idle_timeout_s=P.idle_timeout_s)
    d = F.col("packet_delta")
    return df.withColumn("score", F.when(F.col("phase") == "scored", d / (d + 5.0))).drop("feature_vector", "window")


@query("w7_hit_streak", with_pieces("streak", "SELECT row_id, round(score, 6) AS score, hit_streak FROM streak"))
def _(t):
    return rules.with_hit_streak(_obs_score(t), P).select("row_id", "score", "hit_streak")


@query("w8_volumetric_hits", with_pieces("o_vol", "SELECT row_id, volumetric_hits FROM o_vol"))
def _(t):
    return rules.with_volumetric_hits(rules.with_service_baseline(t.obs(), P), P).select("row_id", "volumetric_hits")


@query("w9_violation_hits", with_pieces("f_viol", "SELECT row_id, violation_hits FROM f_viol"))
def _(t):
    return rules.with_violation_hits(t.flow_obs(), P).select("row_id", "violation_hits")


@query("j2_with_allowlist", with_pieces("flow_obs", """SELECT row_id, array_to_string(ports, ',') AS allowed, list_contains(ports, dst_port) AS port_allowed
 FROM (SELECT *, CASE dst_ip WHEN '10.0.1.0' THEN [22, 80] WHEN '10.0.1.1' THEN [53] END AS ports FROM flow_obs) t"""))
def _(t):
    df = t.flow_obs()
    # the allowlist as a table derived from the observed services
    allow = df.select("dst_ip").distinct().withColumn("ports", rules.allowed_ports(P)).filter(F.col("ports").isNotNull())
    out = rules.with_allowlist(df, allow)
    return out.select("row_id", F.array_join("allowed_ports", ",").alias("allowed"), "port_allowed")


@query("r1_scan_support", with_pieces("flow_obs f_scan_n", """SELECT row_id, 'scan support: ' || n || ' low dst ports to ' || dst_ip || ' in 86400s' AS reason,
 CASE WHEN n >= 8 THEN 'high' ELSE 'medium' END AS severity, n AS hit_count, 'scan:' || src_ip || '->' || dst_ip || ':' || protocol AS emit_key, 'scan_rule' AS source, 'Probe' AS category
 FROM flow_obs JOIN f_scan_n USING (row_id) WHERE n >= 4"""))
def _(t):
    return _shown(rules.scan_support(t.flow_obs(), P), "scan")


@query("r2_bruteforce_support", with_pieces("flow_obs f_bfa_n", """SELECT row_id, 'bfa support: ' || n || ' short TCP attempts to ' || dst_ip || ':' || dst_port || ' in 86400s' AS reason,
 CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS severity, n AS hit_count, 'bfa:' || src_ip || '->' || dst_ip || ':' || dst_port AS emit_key, 'bfa_rule' AS source, 'BFA' AS category
 FROM flow_obs JOIN f_bfa_n USING (row_id) WHERE n >= 3"""))
def _(t):
    return _shown(rules.bruteforce_support(t.flow_obs(), P), "bfa")


ENTITY = "src_ip || '->' || dst_ip || ':' || dst_port || ':' || protocol"


@query("r3_service_support", with_pieces("flow_obs f_viol", f"""SELECT row_id, 'service support: unexpected privileged dst_port ' || dst_port || ' for ' || dst_ip AS reason,
 CASE WHEN violation_hits < 3 THEN 'medium' ELSE 'high' END AS severity, violation_hits AS hit_count, 'service:' || {ENTITY} AS emit_key, 'service_rule' AS source, 'Service-Anomaly' AS category
 FROM flow_obs JOIN f_viol USING (row_id) WHERE bad"""))
def _(t):
    return _shown(rules.service_support(t.flow_obs(), P), "service")


FLOOD = f"""CASE WHEN {ACTIVE} AND protocol = 17 AND (packet_rate >= 12 OR byte_rate >= 2e6) THEN 'udp' WHEN {ACTIVE} AND protocol = 1 AND packet_rate >= 2000 THEN 'icmp'
 WHEN {ACTIVE} AND protocol = 6 AND packet_rate >= 15 AND greatest(avg_packet_size, 1) <= 600 THEN 'tcpflood' END"""


@query("r4_flood_support", with_pieces("obs", f"""SELECT row_id, 'high' AS severity, 1::BIGINT AS hit_count, f || ':' || {ENTITY} AS emit_key,
 CASE f WHEN 'tcpflood' THEN 'tcp_flood_rule' ELSE f || '_rule' END AS source, CASE f WHEN 'udp' THEN 'UDP-Flood' WHEN 'icmp' THEN 'ICMP-Flood' ELSE 'TCP-Flood' END AS category,
 CASE f WHEN 'udp' THEN 'udp flood support: pkt_rate=#, byte_rate=#' WHEN 'icmp' THEN 'icmp flood support: pkt_rate=#' ELSE 'tcp small-packet flood support: pkt_rate=#, avg_size=#' END AS reason_text, true AS reason_right
 FROM (SELECT *, {FLOOD} AS f FROM obs) t WHERE f IS NOT NULL"""))
def _(t):
    second = F.when(F.col("protocol") == 17, F.col("byte_rate")).when(F.col("protocol") == 6, F.greatest("avg_packet_size", F.lit(1.0)))
    return _with_reason(rules.flood_support(t.obs(), P), "flood", F.col("packet_rate"), second)


@query("r5_volumetric_support", with_pieces("o_vol", f"""SELECT row_id, CASE WHEN hard OR attackish THEN 'high' ELSE 'medium' END AS severity, volumetric_hits AS hit_count,
 'vol:' || {ENTITY} AS emit_key, 'volumetric_rule' AS source, 'Traffic-Flood' AS category, CASE WHEN hard THEN 'volumetric support: pkt_rate=#, byte_rate=#, pkt_delta=#, byte_delta=#'
 ELSE 'baseline volumetric support: pkt_rate=# (#x), byte_rate=# (#x)' END AS reason_text, true AS reason_right FROM o_vol WHERE hard OR warn"""))
def _(t):
    df = rules.volumetric_support(t.obs(), P)
    plain = F.startswith(F.col("volumetric.reason"), F.lit("volumetric"))
    per = lambda rate, base: F.col(rate) / F.greatest(F.col(base), F.lit(1e-6))
    numbers = [F.col("packet_rate"), F.when(plain, F.col("byte_rate")).otherwise(per("packet_rate", "base_packet_rate")),
               F.when(plain, F.col("packet_delta")).otherwise(F.col("byte_rate")), F.when(plain, F.col("byte_delta")).otherwise(per("byte_rate", "base_byte_rate"))]
    return _with_reason(df, "volumetric", *numbers)


piece("supported", ("streak", "o_scan_n", "o_bfa_n", "o_viol", "o_vol"), f"""SELECT *, len(sources) AS n_sup, CASE WHEN list_contains(sevs, 'high') THEN 'high' WHEN list_contains(sevs, 'medium') THEN 'medium' ELSE 'low' END AS sev
FROM (SELECT s.row_id, s.ts_us, s.entity_key, s.score, s.hit_streak, s.src_ip, s.dst_ip, s.dst_port, s.protocol, s.buffered, s.packet_delta,
 list_filter([CASE WHEN sc.n >= 4 THEN 'scan_rule' END, CASE WHEN bf.n >= 3 THEN 'bfa_rule' END, CASE WHEN vi.bad THEN 'service_rule' END,
  CASE fl WHEN 'tcpflood' THEN 'tcp_flood_rule' WHEN 'udp' THEN 'udp_rule' WHEN 'icmp' THEN 'icmp_rule' END, CASE WHEN vo.hard OR vo.warn THEN 'volumetric_rule' END], lambda x: x IS NOT NULL) AS sources,
 list_filter([CASE WHEN sc.n >= 4 THEN 'Probe' END, CASE WHEN bf.n >= 3 THEN 'BFA' END, CASE WHEN vi.bad THEN 'Service-Anomaly' END,
  CASE fl WHEN 'tcpflood' THEN 'TCP-Flood' WHEN 'udp' THEN 'UDP-Flood' WHEN 'icmp' THEN 'ICMP-Flood' END, CASE WHEN vo.hard OR vo.warn THEN 'Traffic-Flood' END], lambda x: x IS NOT NULL) AS cats,
 list_filter([CASE WHEN sc.n >= 8 THEN 'high' WHEN sc.n >= 4 THEN 'medium' END, CASE WHEN bf.n >= 5 THEN 'high' WHEN bf.n >= 3 THEN 'medium' END,
  CASE WHEN vi.bad THEN CASE WHEN vi.violation_hits < 3 THEN 'medium' ELSE 'high' END END, CASE WHEN fl IS NOT NULL THEN 'high' END,
  CASE WHEN vo.hard OR vo.attackish THEN 'high' WHEN vo.warn THEN 'medium' END], lambda x: x IS NOT NULL) AS sevs,
 list_filter([CASE WHEN sc.n >= 4 THEN sc.n END, CASE WHEN bf.n >= 3 THEN bf.n END, CASE WHEN vi.bad THEN vi.violation_hits END, CASE WHEN fl IS NOT NULL THEN 1 END,
  CASE WHEN vo.hard OR vo.warn THEN vo.volumetric_hits END], lambda x: x IS NOT NULL) AS hits,
 list_filter([CASE WHEN sc.n >= 4 THEN 'scan:' || s.src_ip || '->' || s.dst_ip || ':' || s.protocol END, CASE WHEN bf.n >= 3 THEN 'bfa:' || s.src_ip || '->' || s.dst_ip || ':' || s.dst_port END,
  CASE WHEN vi.bad THEN 'service:' || ent END, CASE WHEN fl IS NOT NULL THEN fl || ':' || ent END, CASE WHEN vo.hard OR vo.warn THEN 'vol:' || ent END], lambda x: x IS NOT NULL) AS emits
 FROM (SELECT *, {FLOOD} AS fl, {ENTITY} AS ent FROM streak) s LEFT JOIN o_scan_n sc USING (row_id) LEFT JOIN o_bfa_n bf USING (row_id)
 LEFT JOIN o_viol vi USING (row_id) LEFT JOIN o_vol vo USING (row_id)) t""")


@query("r6_supports", with_pieces("supported", """SELECT row_id, n_sup AS support_count, sev AS support_severity, cats[1] AS support_category, array_to_string(sources, ',') AS support_sources FROM supported"""))
def _(t):
    df = rules.with_supports(t.obs(), P)
    return df.select("row_id", "support_count", "support_severity", "support_category", "support_sources")


_ATT = "(sev = 'high' OR (score >= 0.2::DOUBLE AND hit_streak >= 2) OR hit_streak >= 3)"
_BFA = "list_contains(cats, 'BFA')"
_NEAR = "(score >= 0.5::DOUBLE * 0.92::DOUBLE)"
piece("decided", ("supported",), f"""SELECT *, CASE WHEN score IS NULL THEN CASE WHEN n_sup > 0 AND sev IN ('high', 'medium') AND {_BFA} THEN 'ATTACK' WHEN n_sup > 0 THEN 'SUSPECT' ELSE 'NORMAL' END
  WHEN score >= 0.5 THEN CASE WHEN {_ATT} THEN 'ATTACK' ELSE 'SUSPECT' END
  WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN CASE WHEN {_BFA} AND NOT {_NEAR} THEN 'ATTACK' ELSE 'SUSPECT' END ELSE 'NORMAL' END AS status,
 CASE WHEN score IS NULL THEN CASE WHEN n_sup > 0 THEN sev ELSE 'low' END WHEN score >= 0.5 THEN CASE WHEN {_ATT} AND (sev = 'high' OR score >= 0.2::DOUBLE) THEN 'high' ELSE 'medium' END
  WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN CASE WHEN sev = 'high' THEN 'high' ELSE 'medium' END ELSE 'low' END AS severity,
 CASE WHEN score IS NULL THEN coalesce(list_max(hits), 0) WHEN score >= 0.5 THEN hit_streak WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN list_max(hits) ELSE 0 END::BIGINT AS hit_count,
 CASE WHEN score IS NULL THEN CASE WHEN n_sup > 0 THEN emits[1] ELSE '' END WHEN score >= 0.5 THEN 'model:' || entity_key WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN 'assist:' || entity_key ELSE '' END AS emit_key,
 CASE WHEN score IS NULL THEN CASE WHEN n_sup > 0 THEN sources[1] ELSE 'runtime' END WHEN score >= 0.5 THEN 'model' WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN
  CASE WHEN {_NEAR} THEN 'model+rules' ELSE sources[1] END ELSE 'model' END AS decision_source,
 CASE WHEN score IS NULL THEN CASE WHEN n_sup > 0 THEN cats[1] ELSE 'Normal' END WHEN score >= 0.5 THEN coalesce(cats[1], 'Model-Attack') WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN cats[1] ELSE 'Normal' END AS category,
 CASE WHEN score IS NULL THEN CASE WHEN n_sup > 0 AND sev IN ('high', 'medium') AND {_BFA} THEN 'rule-confirmed attack' WHEN n_sup > 0 THEN 'support' ELSE '' END
  WHEN score >= 0.5 THEN 'model threshold hit ' || hit_streak || ' times' WHEN n_sup > 0 AND ({_NEAR} OR sev IN ('high', 'medium')) THEN
  CASE WHEN {_NEAR} THEN 'model borderline near threshold' ELSE 'rule support without model hit' END ELSE 'score below threshold' END AS reason_head
 FROM supported""")
_DCOLS = ["status", "severity", "hit_count", "emit_key", "decision_source", "category"]


def _decided(t, *columns):
    """Decisions over the scored observations; the records show no columns but those that decisions read.

    With ``columns``, those of a staged table: a filter on a decision would otherwise be pushed below the
    projections that make it, where all of them are worked out a second time, nested into one expression.
    """
    df = rules.decide(_obs_score(t).select(*rules.DECISION_COLUMNS), P)
    return stage(df.select(*columns), "decisions") if columns else df


def _reason_head():
    r = F.split_part(F.split_part("reason", F.lit(" | "), F.lit(1)), F.lit(" (margin"), F.lit(1))
    return F.when(r.rlike("^(scan|bfa|service|udp|icmp|tcp|volumetric|baseline).*support"), "support").otherwise(r)


@query("r7_decide_unscored", with_pieces("decided", f"SELECT row_id, {', '.join(_DCOLS)}, reason_head FROM decided WHERE score IS NULL"))
def _(t):
    return _decided(t).filter(F.col("score").isNull()).select("row_id", *_DCOLS, _reason_head().alias("reason_head"))


@query("r8_decide_scored", with_pieces("decided", f"SELECT row_id, {', '.join(_DCOLS)}, reason_head FROM decided WHERE score IS NOT NULL"))
def _(t):
    return _decided(t).filter(F.col("score").isNotNull()).select("row_id", *_DCOLS, _reason_head().alias("reason_head"))


# cool-down: walk the candidates of a key in order
def emit_sql(src: str, key: str, cool_us: int) -> str:
    return f"""cand AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, row_id) AS rn FROM {src}),
walk AS (SELECT {key} AS k, rn, row_id, ts_us AS last_us, true AS emit FROM cand WHERE rn = 1
 UNION ALL SELECT c.{key}, c.rn, c.row_id, CASE WHEN c.ts_us - w.last_us >= {cool_us} THEN c.ts_us ELSE w.last_us END, c.ts_us - w.last_us >= {cool_us}
 FROM walk w JOIN cand c ON c.{key} = w.k AND c.rn = w.rn + 1)"""


COOL = 43200 * 1_000_000
piece("attacks", ("scored",), "SELECT *, entity_key AS emit_key FROM scored WHERE status = 'ATTACK'")


@query("r9_emit_alerts", with_pieces("attacks", "SELECT row_id FROM walk WHERE emit", emit_sql("attacks", "emit_key", COOL)))
def _(t):
    df = t.get("scored").withColumn("emit_key", F.lit(""))
    return alerts.emit_alerts(df, P.alert_cooldown_seconds).select("row_id")


@query("r9_emit_decisions", with_pieces("decided", "SELECT row_id FROM walk WHERE emit", emit_sql("(SELECT * FROM decided WHERE status = 'ATTACK')", "emit_key", COOL)))
def _(t):
    df = _decided(t, "row_id", "ts_us", "status", "emit_key", "entity_key")
    return alerts.emit_alerts(df, P.alert_cooldown_seconds).select("row_id")


_AR = ["row_id", "ts_us", "entity_key", "status", "severity", "block", "model_hit", "category", "support_sources"]


@query("r10_alert_rows", with_pieces("decided", """SELECT row_id, ts_us, entity_key, emit_key, round(coalesce(score, 0), 6) AS anomaly_score, status, severity, severity = 'high' AS block,
 coalesce(score >= 0.5, false) AS model_hit, category, array_to_string(sources, ',') AS support_sources, 0.5::DOUBLE AS threshold FROM decided WHERE status = 'ATTACK'"""))
def _(t):
    shown = ["row_id", "ts_us", "entity_key", "emit_key", "anomaly_score", "status", "severity", "block", "model_hit", "category",
             "support_sources", "threshold"]
    decided = _decided(t, "score", *[c for c in shown if c != "anomaly_score"])
    return alerts.alert_rows(decided.filter(F.col("status") == "ATTACK")).select(*shown)


@query("r10_score_rows", with_pieces("decided", """SELECT row_id, ts_us, entity_key, round(score, 6) AS score, 0.5::DOUBLE AS threshold, status, 'scored' AS phase, severity, category, '' AS label, '' AS source_file,
 array_to_string(sources, ',') AS support_sources FROM decided WHERE score IS NOT NULL"""))
def _(t):
    df = alerts.score_rows(_decided(t))
    return df.select("row_id", "ts_us", "entity_key", "score", "threshold", "status", "phase", "severity", "category", "label", "source_file",
                     "support_sources")


@query("r11_block_candidates", with_pieces("decided", "SELECT DISTINCT src_ip FROM decided WHERE status = 'ATTACK' AND severity = 'high'"))
def _(t):
    return alerts.block_candidates(_decided(t, "src_ip", "block"))


# --- tracking ------------------------------------------------------------------------------

FORCE = int(P.force_emit_after_s * 1_000_000)
IDLE = int(P.idle_timeout_s * 1_000_000)


def track_sql(src: str, fresh: str) -> str:
    """Walk the readings of each flow; the state is the last emitted counters."""
    fires = f"""(c.fresh OR c.packet_count < w.p OR c.byte_count < w.b OR c.packet_count - w.p >= 1 OR c.byte_count - w.b >= 1 OR c.ts_us - w.last_us >= {FORCE})"""
    return f"""live AS (SELECT *, {fresh} AS fresh, concat_ws('|', {FLOW_COLS}) AS k FROM {src}),
cand AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts_us, row_id) AS rn FROM live WHERE NOT removed),
walk AS (SELECT k, rn, row_id, ts_us AS last_us, packet_count AS p, byte_count AS b, true AS emit FROM cand WHERE rn = 1
 UNION ALL SELECT c.k, c.rn, c.row_id, CASE WHEN {fires} THEN c.ts_us ELSE w.last_us END, CASE WHEN {fires} THEN c.packet_count ELSE w.p END,
 CASE WHEN {fires} THEN c.byte_count ELSE w.b END, {fires} FROM walk w JOIN cand c ON c.k = w.k AND c.rn = w.rn + 1),
kept AS (SELECT l.*, sum(l.fresh::INT) OVER (PARTITION BY l.k ORDER BY l.ts_us, l.row_id) AS life FROM live l JOIN walk w USING (row_id) WHERE w.emit),
tracked AS (SELECT row_id, NOT fresh AS has_history, CASE WHEN fresh THEN 0 ELSE greatest(packet_count - lag(packet_count) OVER x, 0) END::DOUBLE AS packet_delta,
 CASE WHEN fresh THEN 0 ELSE greatest(byte_count - lag(byte_count) OVER x, 0) END::DOUBLE AS byte_delta FROM kept WINDOW x AS (PARTITION BY k ORDER BY ts_us, row_id))"""


_LAGS = f"""SELECT *, lag(ts_us) OVER w AS pts, lag(removed) OVER w AS prem FROM (SELECT *, %s AS removed FROM poll_stats) s
 WHERE packet_count > 0 OR byte_count > 0 OR removed WINDOW w AS (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id)"""
piece("live_rows", ("poll_stats",), _LAGS % "false")
piece("live_removed", ("poll_stats",), _LAGS % "(row_id % 19 = 0)")
_FRESH = f"(pts IS NULL OR ts_us - pts > {IDLE})"
_TR = "SELECT row_id, has_history, packet_delta, byte_delta FROM tracked"


@query("x1_track_flows", with_pieces("live_rows", _TR, track_sql("live_rows", _FRESH)))
def _(t):
    return polls.track_flows(t.get("poll_stats"), P, block_us=DAY).select("row_id", "has_history", "packet_delta", "byte_delta")


@query("x3_track_with_removals", with_pieces("live_removed", _TR, track_sql("live_removed", f"({_FRESH} OR coalesce(prem, false))")))
def _(t):
    df = t.get("poll_stats").withColumn("removed", F.col("row_id") % 19 == 0)
    return polls.track_flows(df, P, removed="removed", block_us=DAY).select("row_id", "has_history", "packet_delta", "byte_delta")


def _sess_sql(idle_s: int, removed: str) -> str:
    return f"""SELECT row_id, session_id, row_number() OVER (PARTITION BY {FLOW_COLS}, session_id ORDER BY ts_us, row_id) AS session_row FROM (SELECT *,
 sum(start::INT) OVER (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id)::BIGINT AS session_id FROM (SELECT *, (pts IS NULL OR ts_us - pts > {idle_s * 1_000_000} OR prem) AS start
 FROM (SELECT *, lag(ts_us) OVER w AS pts, coalesce(lag({removed}) OVER w, false) AS prem FROM poll_stats WINDOW w AS (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id)) a) b) c"""


@query("x2_idle_sessions", with_pieces("poll_stats", _sess_sql(86400, "false")))
def _(t):
    return polls.with_sessions(t.get("poll_stats"), idle_timeout_s=86400).select("row_id", "session_id", "session_row")


@query("x3_removal_sessions", with_pieces("poll_stats", _sess_sql(86400, "row_id % 13 = 0")))
def _(t):
    df = t.get("poll_stats").withColumn("removed", F.col("row_id") % 13 == 0)
    return polls.with_sessions(df, idle_timeout_s=86400, removed="removed").select("row_id", "session_id", "session_row")


@query("x4_rolling_sequences", with_pieces("obs_score", f"""SELECT row_id, CASE WHEN buffered >= 4 THEN 'scored' ELSE 'warmup_' || buffered || '/4' END AS phase,
 CASE WHEN buffered >= 4 THEN round(lag(packet_count, 3) OVER (PARTITION BY {FLOW_COLS} ORDER BY ts_us, row_id), 6) END::DOUBLE AS oldest,
 CASE WHEN buffered >= 4 THEN packet_count END::DOUBLE AS newest FROM obs_score"""))
def _(t):
    df = polls.rolling_sequences(with_feature_vector(t.obs()), 4, idle_timeout_s=P.idle_timeout_s)
    at = lambda i: F.get(F.get("window", F.lit(i)), F.lit(0))
    return df.select("row_id", "phase", at(0).alias("oldest"), at(3).alias("newest"))


# --- run status ----------------------------------------------------------------------------------

HOLD = 1800 * 1_000_000
RANK = "CASE {a}status WHEN 'ATTACK' THEN 2 WHEN 'SUSPECT' THEN 1 ELSE 0 END"
piece("hold", ("scored_runs",), f"""SELECT a.run_id, a.row_id, any_value(a.ts_us) AS ts_us, any_value(a.status) AS status, any_value(a.reason) AS reason, max(b.score) AS peak_score,
 arg_max(b.status, ({RANK.format(a='b.')}, b.score, b.category)) AS hold_status, arg_max(b.category, ({RANK.format(a='b.')}, b.score, b.category)) AS hold_category,
 count(*) FILTER (b.status IN ('ATTACK', 'SUSPECT')) AS signal_count FROM scored_runs a JOIN scored_runs b
 ON a.run_id = b.run_id AND b.ts_us >= a.ts_us - {HOLD} AND {SEEN} GROUP BY a.run_id, a.row_id""")


@query("w10_hold_window", with_pieces("hold", "SELECT run_id, row_id, round(peak_score, 6) AS peak_score, hold_status, hold_category, signal_count FROM hold"))
def _(t):
    df = alerts.with_hold_window(t.scored_runs(), 1800.0)
    return df.select("run_id", "row_id", "peak_score", "hold_status", "hold_category", "signal_count")


_R = lambda c: f"CASE {c} WHEN 'ATTACK' THEN 2 WHEN 'SUSPECT' THEN 1 ELSE 0 END"


@query("x7_run_status", with_pieces("hold", f"""SELECT run_id, row_id, ts_us AS at_us, CASE WHEN up THEN hold_status WHEN status = 'NORMAL' AND hit THEN 'SUSPECT' ELSE status END AS run_status,
 CASE WHEN up AND hold_category <> '' THEN 'holding recent ' || hold_category || ' evidence' WHEN NOT up AND status = 'NORMAL' AND hit THEN 'recent model score above threshold; confirming' ELSE reason END AS run_reason,
 'active' AS run_phase, signal_count AS active_signals, round(peak_score, 6) AS display_score FROM (SELECT *, {_R('hold_status')} > {_R('status')} AS up, peak_score >= 0.5 AS hit FROM hold) t
 UNION ALL SELECT run_id, row_id, ts_us + 600000001, 'NORMAL', '', 'idle', 0, 0.0 FROM (SELECT *, lead(ts_us) OVER (PARTITION BY run_id ORDER BY ts_us, row_id) AS nxt FROM hold) u
 WHERE nxt IS NULL OR nxt > ts_us + 600000000"""))
def _(t):
    return alerts.run_status(t.scored_runs(), P)


_SHOWN = f"""SELECT *, CASE WHEN up THEN hold_status WHEN status = 'NORMAL' AND hit THEN 'SUSPECT' ELSE status END AS shown FROM (SELECT h.*, s.score, {_R('h.hold_status')} > {_R('h.status')} AS up,
 h.peak_score >= 0.5 AS hit, lead(h.ts_us) OVER (PARTITION BY h.run_id ORDER BY h.ts_us, h.row_id) AS nxt FROM hold h JOIN scored_runs s USING (row_id)) t"""


@query("x7_run_status_release", with_pieces("hold", f"""SELECT run_id, row_id, ts_us AS at_us, shown AS run_status, 'active' AS run_phase, signal_count AS active_signals, round(peak_score, 6) AS display_score FROM ({_SHOWN}) a
 UNION ALL SELECT run_id, row_id, ts_us + {HOLD + 1}, 'NORMAL', 'active', 0, round(score, 6) FROM ({_SHOWN}) b WHERE shown <> 'NORMAL' AND (nxt IS NULL OR nxt > ts_us + {HOLD})
 UNION ALL SELECT run_id, row_id, ts_us + 7200000001, 'NORMAL', 'idle', 0, 0.0 FROM ({_SHOWN}) c WHERE nxt IS NULL OR nxt > ts_us + 7200000000"""))
def _(t):
    """A hold that ends before the idle reset releases the alarm."""
    df = alerts.run_status(t.scored_runs(), dataclasses.replace(P, runtime_idle_reset_s=7200.0))
    return df.drop("run_reason")


@query("a29_dominant_decision", with_pieces("scored", f"""SELECT batch, arg_max(row_id, (r, sc, row_id)) AS row_id, arg_max(status, (r, sc, row_id)) AS status, round(arg_max(score, (r, sc, row_id)), 6) AS score,
 arg_max(reason, (r, sc, row_id)) AS reason, arg_max(decision_source, (r, sc, row_id)) AS decision_source FROM (SELECT *, row_id // 256 AS batch, {_R('status')} AS r, coalesce(score, -1) AS sc FROM scored) t GROUP BY batch"""))
def _(t):
    df = t.get("scored").withColumn("batch", F.floor(F.col("row_id") / 256).cast("long"))
    return alerts.dominant_decision(df, ["batch"])


@query("s5_write_alerts_scores", with_pieces("scored", "SELECT 'alerts' AS sink, count(*) AS n FROM scored WHERE status = 'ATTACK' UNION ALL SELECT 'scores', 2 * count(*) FROM scored"))
def _(t):
    """Sinks by run: alerts of one run, scores of two, and a repeat of each that adds nothing."""
    df = t.get("scored")
    a, s = new_path(t.spark, "alerts"), new_path(t.spark, "scores")
    for _ in range(2):
        exports.write_alerts(df.filter(F.col("status") == "ATTACK"), a, "run 1")
        exports.write_scores(df, s, "run 1")
        exports.write_scores(df, s, "run/2")
    count = lambda p, n: t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("sink"), "n")
    return count(a, "alerts").union(count(s, "scores"))


@query("s8_export_alerts", with_pieces("scored_runs", """SELECT row_id, entity_key, status, 'said "' || reason || '", twice' AS reason FROM scored_runs WHERE run_id = 'run1' AND status = 'ATTACK'"""))
def _(t):
    """CSV export of one run with quoting, read back."""
    path = new_path(t.spark, "export-alerts")
    df = t.scored_runs().filter(F.col("status") == "ATTACK")
    df = df.select("run_id", "row_id", "entity_key", "status", F.concat(F.lit('said "'), "reason", F.lit('", twice')).alias("reason"))
    exports.export_alerts(df, "run1", path)
    back = t.spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return back.select(F.col("row_id").cast("long").alias("row_id"), "entity_key", "status", "reason")


# --- clean runs -----------------------------------------------------------------------------------

CLEAN = "score IS NOT NULL AND status = 'NORMAL' AND decision_source = 'model' AND support_sources = '' AND phase IN ('scored', 'normalizing', '') AND NOT contains(lower(reason), 'threshold hit')"
# alerts: some 0.5 % of the rows
piece("alerted", ("scored",), "SELECT entity_key, 'model:' || entity_key AS emit_key FROM scored WHERE row_id % 211 = 0")
piece("alert_keys", ("alerted",), "SELECT entity_key AS k FROM alerted UNION SELECT emit_key FROM alerted")
piece("clean", ("scored", "alert_keys"), f"SELECT * FROM scored WHERE {CLEAN} AND entity_key NOT IN (SELECT k FROM alert_keys)")


def _alerted(t):
    df = t.get("scored").filter(F.col("row_id") % 211 == 0)
    return df.select("entity_key", F.concat(F.lit("model:"), "entity_key").alias("emit_key"))


@query("f3_clean_benign", with_pieces("scored", f"SELECT row_id, entity_key, 'Normal' AS label FROM scored WHERE {CLEAN}"))
def _(t):
    return alerts.clean_benign(t.get("scored")).select("row_id", "entity_key", "label")


@query("j1_exclude_alerted", with_pieces("scored alert_keys", "SELECT row_id, entity_key FROM scored WHERE entity_key NOT IN (SELECT k FROM alert_keys)"))
def _(t):
    return alerts.exclude_alerted(t.get("scored"), _alerted(t)).select("row_id", "entity_key")


@query("a12_clean_summary", with_pieces("clean", """SELECT (SELECT count(*) FROM scored) AS n_rows_input, (SELECT count(*) FROM alert_keys) AS n_alert_keys_excluded, count(*) AS n_rows_output,
 round(avg(score), 6) AS score_mean, round(quantile_cont(score, 0.95), 6) AS score_p95, round(quantile_cont(score, 0.99), 6) AS score_p99 FROM clean"""))
def _(t):
    return alerts.clean_summary(t.get("scored"), _alerted(t))


@query("m8_calibrate_run", with_pieces("clean", """SELECT count(*) AS n_rows, count(*) AS n_normal, 0::BIGINT AS n_attack, round(avg(score), 6) AS normal_mean, NULL::DOUBLE AS attack_mean,
 round(avg((score >= (SELECT quantile_cont(score, 0.99) FROM clean))::INT), 6) AS estimated_fpr, NULL::DOUBLE AS estimated_tpr, round((SELECT quantile_cont(score, 0.99) FROM clean), 6) AS recommended_threshold FROM clean"""))
def _(t):
    return alerts.calibrate_run(t.get("scored"), _alerted(t), 0.01)
