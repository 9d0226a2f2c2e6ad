"""Detection policy and fixed vocabularies.

The policy is a small driver-side value: every field ends up as a literal in a
Spark expression.  Nothing here grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any, Mapping

# Traffic classes, in index order 0..7.
LABELS = ["Normal", "DDoS", "DoS", "Probe", "BFA", "Web-Attack", "BOTNET", "U2R"]

# Feature contracts, in vector order.
RUNTIME10 = [
    "packet_count",
    "byte_count",
    "flow_duration_s",
    "packet_rate",
    "byte_rate",
    "avg_packet_size",
    "dst_port_norm",
    "protocol_tcp",
    "protocol_udp",
    "protocol_icmp",
]
# The longer contract, in vector order.
CORE11 = [
    "packet_count",
    "byte_count",
    "flow_duration_s",
    "packet_rate",
    "byte_rate",
    "avg_packet_size",
    "src_port_norm",
    "dst_port_norm",
    "protocol_tcp",
    "protocol_udp",
    "protocol_icmp",
]
# Names of the contracts.
FEATURE_SCHEMES = {
    "insdn_runtime10_v2": RUNTIME10,
    "insdn_ml_core_v1": CORE11,
    "insdn_openflow_v1": RUNTIME10,
    "telemetry_v2": RUNTIME10,
    "telemetry_v1": CORE11,
}
DEFAULT_SCHEME = "insdn_runtime10_v2"

# Reconstruction-error weights per feature before normalisation.
FEATURE_WEIGHTS = {
    "packet_count": 2.0,
    "byte_count": 2.0,
    "flow_duration_s": 1.0,
    "packet_rate": 3.5,
    "byte_rate": 3.5,
    "avg_packet_size": 2.0,
    "packet_delta": 2.5,
    "byte_delta": 2.5,
    "packet_rate_delta": 3.0,
    "byte_rate_delta": 3.0,
    "src_port_norm": 0.7,
    "dst_port_norm": 0.7,
    "protocol_tcp": 0.6,
    "protocol_udp": 0.6,
    "protocol_icmp": 0.6,
    "flow_age_s": 1.0,
    "inter_poll_gap_s": 1.5,
}


def feature_names(scheme: str = DEFAULT_SCHEME) -> list[str]:
    if scheme not in FEATURE_SCHEMES:
        raise ValueError(f"unknown feature scheme {scheme!r}; one of {sorted(FEATURE_SCHEMES)}")
    return list(FEATURE_SCHEMES[scheme])


def feature_weights(names: list[str]) -> list[float]:
    """Per-feature weights scaled to mean 1 (unlisted features weigh 1)."""
    raw = [FEATURE_WEIGHTS.get(n, 1.0) for n in names]
    mean = max(sum(raw) / len(raw), 1e-6)
    return [w / mean for w in raw]


@dataclass(frozen=True)
class Policy:
    """Rule, alert and state settings."""

    # The defaults of all settings.
    # model decision
    threshold: float = 0.5
    score_direction: str = "higher_is_attack"
    min_alert_hits: int = 2
    rule_assist_ratio: float = 0.92
    attack_display_floor: float = 0.20
    # alerts
    alert_cooldown_seconds: float = 5.0
    alert_hold_seconds: float = 8.0
    # port scan
    disable_scan_rule: bool = False
    scan_window_s: float = 6.0
    scan_unique_ports: int = 12
    scan_attack_unique_ports: int = 40
    # brute force
    bfa_window_s: float = 8.0
    bfa_attempt_threshold: int = 10
    bfa_attack_threshold: int = 20
    bfa_ports: tuple[int, ...] = (21, 22, 23)
    # volumetric
    hard_packet_rate: float = 4000.0
    hard_byte_rate: float = 4_000_000.0
    hard_packet_delta: float = 2500.0
    hard_byte_delta: float = 2_000_000.0
    baseline_window_s: float = 30.0
    baseline_min_samples: int = 4
    rate_multiplier_warn: float = 2.5
    rate_multiplier_attack: float = 4.0
    # protocol floods
    udp_flood_packet_rate: float = 3000.0
    udp_flood_byte_rate: float = 2_000_000.0
    icmp_flood_packet_rate: float = 2000.0
    tcp_small_pkt_attack_rate: float = 2500.0
    small_pkt_avg_size_max: float = 120.0
    # rules-only attacks
    rules_only_attack_enabled: bool = False
    emergency_rules_enabled: bool = False
    # state
    entity_idle_timeout_s: float = 20.0
    idle_timeout_s: float = 120.0
    runtime_idle_reset_s: float = 6.0
    force_emit_after_s: float = 15.0
    min_packet_delta: float = 1.0
    min_byte_delta: float = 1.0
    seq_len: int = 4
    allowlisted_services: Mapping[str, tuple[int, ...]] = field(default_factory=dict)

    @property
    def lower_is_attack(self) -> bool:
        return self.score_direction == "lower_is_attack"

    @classmethod
    def from_dict(cls, values: Mapping[str, Any] | None = None) -> "Policy":
        """Known keys override the defaults; unknown manifest keys are ignored.

        The idle time-out follows the hold time unless it is given.
        """
        values = dict(values or {})
        known = {f.name for f in fields(cls)}
        picked = {k: v for k, v in values.items() if k in known}
        if "allowlisted_services" in picked:
            picked["allowlisted_services"] = {
                str(ip): tuple(int(p) for p in ports)
                for ip, ports in (picked["allowlisted_services"] or {}).items()
            }
        if "bfa_ports" in picked:
            picked["bfa_ports"] = tuple(int(p) for p in picked["bfa_ports"])
        out = replace(cls(), **picked)
        if "entity_idle_timeout_s" not in picked:
            out = replace(out, entity_idle_timeout_s=max(out.alert_hold_seconds, 20.0))
        return out


# What a model bundle ships with.
BUNDLE_POLICY = Policy.from_dict(
    {
        "alert_hold_seconds": 10.0,
        "scan_window_s": 8.0,
        "scan_unique_ports": 10,
        "baseline_window_s": 60.0,
        "baseline_min_samples": 3,
    }
)

# What the live deployment overrides.
DEPLOYMENT_POLICY = Policy.from_dict(
    {
        "alert_cooldown_seconds": 2.0,
        "alert_hold_seconds": 4.0,
        "attack_display_floor": 0.50,
        "scan_unique_ports": 10,
        "scan_attack_unique_ports": 24,
        "hard_packet_rate": 5000.0,
        "hard_byte_rate": 5_000_000.0,
        "hard_packet_delta": 3000.0,
        "hard_byte_delta": 2_500_000.0,
        "baseline_window_s": 20.0,
        "rate_multiplier_warn": 2.0,
        "rate_multiplier_attack": 3.5,
        "udp_flood_packet_rate": 3500.0,
        "udp_flood_byte_rate": 2_500_000.0,
        "icmp_flood_packet_rate": 2500.0,
    }
)
