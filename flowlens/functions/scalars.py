"""Column functions.  Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.policy import LABELS

EPS = 1e-6

# Timestamp patterns tried in order, day first.
TIMESTAMP_FORMATS = [
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "yyyy-M-d H:mm:ss.SSSSSS",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d'T'H:mm:ss",
    "yyyy-M-d",
]


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str, default: float = 0.0) -> Column:
    """Text to double; bad text, NaN, infinities and nulls give ``default``."""
    text = strip(c)
    x = text.try_cast("double")
    # the parser also takes type suffixes (1d, 1f) and hexadecimal floats
    plain = ~F.lower(text).rlike("[dfx]")
    return F.when(x.isNotNull() & plain, clean(x, default)).otherwise(F.lit(default))


def with_numbers(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """``num`` of several text columns in place; each text is stripped and parsed once."""
    df = df.withColumns({f"_t_{c}": strip(c) for c in defaults})
    parsed = {f"_x_{c}": F.when(~F.col(f"_t_{c}").rlike("[dfxDFX]"), F.col(f"_t_{c}").try_cast("double")) for c in defaults}
    df = df.withColumns(parsed)
    return df.withColumns({c: clean(f"_x_{c}", d) for c, d in defaults.items()}).drop(*[f"_{v}_{c}" for c in defaults for v in "tx"])


def finite_or(c: Column | str, nan: float = 0.0, inf: float = 1e6) -> Column:
    x = col_of(c).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(nan))
        .when(x == float("inf"), F.lit(inf))
        .when(x == float("-inf"), F.lit(-inf))
        .otherwise(x)
    )


def clean(c: Column | str, default: float = 0.0) -> Column:
    """A double column with NaN, null and infinities replaced."""
    return finite_or(c, nan=default, inf=default)


def strip(c: Column | str) -> Column:
    return F.btrim(col_of(c).cast("string"), F.lit(" \t\n\r\x0b\x0c"))


def fold_text(c: Column | str) -> Column:
    """Lower case, ``_`` and ``-`` as spaces, runs of blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(strip(c)), "_-", "  "), r"\s+", " "))


def label_of(low: Column, text: Column) -> Column:
    """Class of a folded label; ``text`` is kept when no rule matches.

    Pass columns, not expressions: every rule reads ``low`` again.
    """
    return (
        F.when(low.isNull() | low.isin("", "nan", "none", "normal", "benign", "background"), "Normal")
        .when(low.contains("ddos"), "DDoS")
        .when(low.startswith("dos"), "DoS")
        .when(low.contains("probe") | low.contains("scan"), "Probe")
        .when(low.contains("brute") | (low == "bfa") | low.contains("patator"), "BFA")
        .when(low.contains("web attack") | low.contains("xss") | low.contains("sql"), "Web-Attack")
        .when(low.contains("bot"), "BOTNET")
        .when((low == "u2r") | low.contains("infiltration"), "U2R")
        .otherwise(text)
    )


def normalise_label(c: Column | str) -> Column:
    """Class of a raw label; the folded text is bound once per row."""
    pair = F.array(F.struct(fold_text(c).alias("low"), strip(c).alias("text")))
    return F.get(F.transform(pair, lambda p: label_of(p["low"], p["text"])), F.lit(0))


def is_attack(label: Column | str) -> Column:
    return (col_of(label) != "Normal").cast("long")


def label_index(label: Column | str) -> Column:
    """0..7; an unknown label maps to 0."""
    pos = F.array_position(F.array(*[F.lit(x) for x in LABELS]), col_of(label))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(0)).cast("long")


def parse_ts(c: Column | str, row_id: Column | str, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First matching pattern; unparsable text becomes the epoch plus row_id ms."""
    text = strip(c)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries, F.timestamp_millis(col_of(row_id).cast("long")))


def port_norm(c: Column | str) -> Column:
    p = clean(c)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(65535.0)) / F.lit(65535.0)


def ratio(n: Column, d: Column, floor: float) -> Column:
    return n / F.greatest(d, F.lit(floor))


def signed_log1p(c: Column | str) -> Column:
    x = col_of(c).cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def signed_log1p_array(c: Column | str) -> Column:
    return F.transform(col_of(c), signed_log1p)


def attack_label(c: Column | str) -> Column:
    """Display name of an alert category (ordered substring rules)."""
    raw = col_of(c)
    low = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when((low == "") | (low == "normal"), "Anomaly")
        .when(low.contains("bfa") | low.contains("brute"), "Brute Force")
        .when(low.contains("probe") | low.contains("scan"), "Probe / Scan")
        .when(low.contains("ddos"), "DDoS")
        .when(low.contains("dos"), "DoS")
        .when(low.contains("udp"), "UDP Flood")
        .when(low.contains("tcp"), "TCP Flood")
        .when(low.contains("icmp"), "ICMP Flood")
        .when(low.contains("bot"), "Botnet")
        .when(low.contains("u2r"), "Priv. Escalation")
        .when(low.contains("web"), "Web Attack")
        .when(low.contains("flood") | low.contains("traffic"), "Traffic Flood")
        .otherwise(raw)
    )


def proto_name(c: Column | str) -> Column:
    p = col_of(c)
    return (
        F.when(p == 6, "TCP")
        .when(p == 17, "UDP")
        .when(p == 1, "ICMP")
        .when(p >= 0, p.cast("string"))
        .otherwise(F.lit("—"))
    )


def pressure_state(
    runtime_depth: Column,
    raw_depth: Column,
    timeouts: Column,
    reply_delay_ms: Column,
    queue_threshold: int,
    raw_threshold: int,
    reply_delay_high_ms: float,
) -> Column:
    third = lambda n: max(1, n // 3)
    return (
        F.when(
            (timeouts > 0)
            | (runtime_depth >= queue_threshold)
            | (raw_depth >= raw_threshold)
            | (reply_delay_ms >= reply_delay_high_ms),
            "high",
        )
        .when(
            (runtime_depth >= third(queue_threshold))
            | (raw_depth >= third(raw_threshold))
            | (reply_delay_ms >= reply_delay_high_ms * 0.6),
            "medium",
        )
        .otherwise("normal")
    )


def recommended_interval(
    current: Column,
    lowest: Column,
    highest: Column,
    runtime_depth: Column,
    raw_depth: Column,
    reply_delay_ms: Column,
    timeouts: Column,
    throughput: Column,
    queue_threshold: int,
    raw_threshold: int,
    reply_delay_high_ms: float,
) -> Column:
    """Poll-interval advice: slow down under pressure, speed up gently when idle."""

    # Factors and steps below.
    def slower(x: Column, factor: float, plus: float) -> Column:
        return F.greatest(x, F.least(highest, x * factor + plus))

    calm = (
        (runtime_depth <= max(16, queue_threshold // 12))
        & (raw_depth <= max(8, raw_threshold // 12))
        & (reply_delay_ms <= max(10.0, reply_delay_high_ms * 0.4))
        & (timeouts == 0)
        & (throughput > 0)
    )
    x = current.cast("double")
    x = F.when(timeouts > 0, slower(x, 1.20, 0.10)).otherwise(x)
    x = F.when(reply_delay_ms >= reply_delay_high_ms, slower(x, 1.10, 0.05)).otherwise(x)
    x = (
        F.when(runtime_depth >= queue_threshold, slower(x, 1.15, 0.10))
        .when(calm, F.least(x, F.greatest(lowest, x * 0.95)))
        .otherwise(x)
    )
    x = F.when(raw_depth >= raw_threshold, slower(x, 1.10, 0.05)).otherwise(x)
    return F.greatest(lowest, F.least(highest, x))


def norm_status(c: Column | str) -> Column:
    s = F.upper(strip(c))
    return F.when(s.isin("NORMAL", "SUSPECT", "ATTACK"), s).otherwise(F.lit("NORMAL"))


def status_rank(c: Column | str) -> Column:
    s = norm_status(c)
    return F.when(s == "ATTACK", 2).when(s == "SUSPECT", 1).otherwise(0)


def severity_rank(c: Column | str) -> Column:
    s = F.lower(col_of(c))
    return F.when(s == "high", 2).when(s == "medium", 1).otherwise(0)


def parse_meta(c: Column | str) -> Column:
    """``k=v,k=v`` to a map; items without ``=`` are dropped, both sides trimmed."""
    items = F.filter(F.split(col_of(c), ","), lambda x: x.contains("="))
    entry = lambda x: F.struct(
        strip(F.substring_index(x, "=", 1)).alias("k"),
        strip(F.regexp_replace(x, r"^[^=]*=", "")).alias("v"),
    )
    # the last item of a repeated key wins
    entries = F.transform(items, entry)
    n = F.size(entries)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda later: later["k"] == e["k"]
        ),
    )
    return F.map_from_entries(last)


def score_band(score: Column | str, threshold: Column | float) -> Column:
    s = col_of(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(s >= t, "alert").when(s >= t * 0.82, "high").otherwise("normal")


def banner(status: Column | str, active_signals: Column | str) -> Column:
    s = F.upper(F.coalesce(col_of(status), F.lit("NORMAL")))
    return (
        F.when((s == "ATTACK") | (F.coalesce(col_of(active_signals), F.lit(0)) > 0), "attack")
        .when(s == "SUSPECT", "suspect")
        .otherwise("normal")
    )


# --- flow predicates -------------------------------------------------------


def is_response(src_port: Column | str = "src_port", dst_port: Column | str = "dst_port") -> Column:
    s, d = col_of(src_port), col_of(dst_port)
    return (s > 0) & (s <= 1024) & (d >= 1024)


def is_ephemeral(port: Column | str = "dst_port") -> Column:
    return col_of(port) >= 1024


def has_activity(
    history: Column | str = "has_history",
    packet_delta: Column | str = "packet_delta",
    byte_delta: Column | str = "byte_delta",
) -> Column:
    return F.coalesce(col_of(history) & ((col_of(packet_delta) > 0) | (col_of(byte_delta) > 0)), F.lit(False))


def has_observed() -> Column:
    return has_activity() | (F.col("packet_count") > 0) | (F.col("byte_count") > 0)


def is_hit(score: Column | str, threshold: Column | float, lower_is_attack: bool = False) -> Column:
    s = col_of(score)
    return s <= threshold if lower_is_attack else s >= threshold


def near_threshold(
    score: Column | str, threshold: Column | float, lower_is_attack: bool = False, assist: float = 0.92
) -> Column:
    s = col_of(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return s <= t / max(assist, EPS) if lower_is_attack else s >= t * assist
