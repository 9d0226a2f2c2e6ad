"""Alert emission, records, run status and clean-run calibration."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import blocked, metrics
from flowlens.operators.emission import keep_changed
from flowlens.operators.quantiles import cumulative, quantiles_from
from flowlens.policy import Policy
from flowlens.session import stage

HOUR_US = 3_600_000_000


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def emit_alerts(decisions: DataFrame, cooldown_s: float = 5.0, block_us: int = HOUR_US) -> DataFrame:
    """ATTACK rows, at most one per emit key and cool-down.

    The cool-down runs from the last emitted alert and an exactly elapsed one emits.
    """
    key = F.when(F.coalesce("emit_key", F.lit("")) != "", F.col("emit_key")).otherwise(F.col("entity_key"))
    attacks = decisions.filter(S.norm_status("status") == "ATTACK").withColumn("emit_key", key)
    return keep_changed(attacks, ["emit_key"], _us(cooldown_s), block_us=block_us)


# Columns of alert and score records.
ALERT_COLUMNS = [
    "ts_us", "entity_key", "emit_key", "anomaly_score", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "packet_rate", "packet_delta", "byte_rate", "byte_delta", "status", "reason", "severity", "block", "hit_count",
    "decision_source", "category", "support_sources", "support_reasons", "threshold", "model_hit",
]

SCORE_COLUMNS = [
    "ts_us", "entity_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "score", "threshold", "status",
    "phase", "reason", "decision_source", "category", "severity", "packet_rate", "byte_rate", "packet_delta",
    "byte_delta", "label", "source_file", "support_sources", "support_reasons",
]


def _project(df: DataFrame, columns: Sequence[str], keep: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    have = set(df.columns)
    cols = [F.col(c) for c in keep if c in have]
    for c in columns:
        cols.append(F.col(c) if c in have else defaults.get(c, F.lit("")).alias(c))
    return df.select(*cols)


def alert_rows(decisions: DataFrame) -> DataFrame:
    """Alert records (24 columns, after ``run_id`` / ``row_id`` when present).

    A missing score counts as 0, also when it is tested against the threshold.
    """
    score = F.coalesce(F.col("score"), F.lit(0.0))
    df = decisions.withColumns({"anomaly_score": score, "status": S.norm_status("status")})
    return _project(df, ALERT_COLUMNS, ["run_id", "row_id"], {})


def score_rows(decisions: DataFrame) -> DataFrame:
    """Score records of the rows that were scored, with their category."""
    df = decisions.filter(F.col("score").isNotNull()).withColumn("status", S.norm_status("status"))
    return _project(df, SCORE_COLUMNS, ["run_id", "row_id"], {"phase": F.lit("scored")})


def block_candidates(alerts: DataFrame) -> DataFrame:
    """Distinct source addresses of alerts flagged ``block``."""
    ip = F.trim("src_ip")
    return alerts.filter(F.col("block")).select(ip.alias("src_ip")).filter(F.col("src_ip") != "").distinct()


# --- clean-run calibration -----------------------------------------------------------


def clean_benign(scores: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Conservative benign subset of a live run, labelled Normal."""
    have = set(scores.columns)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    keep = F.col("score").isNotNull() & ~F.isnan("score")
    if "status" in have:
        keep = keep & (F.upper(text("status")) == "NORMAL")
    if "decision_source" in have:
        keep = keep & (text("decision_source") == "model")
    if "support_sources" in have:
        keep = keep & (text("support_sources") == "")
    if "phase" in have:
        keep = keep & text("phase").isin("scored", "normalizing", "")
    if "reason" in have:
        keep = keep & ~F.lower(text("reason")).contains("threshold hit")
    out = scores.filter(keep)
    if alerts is not None:
        out = exclude_alerted(out, alerts)
    return out.withColumn("label", F.lit("Normal"))


def alerted_keys(alerts: DataFrame) -> DataFrame:
    """Distinct non-empty entity and emit keys of the alerts."""
    cols = [F.trim(c) for c in ("entity_key", "emit_key") if c in alerts.columns]
    return alerts.select(F.explode(F.array(*cols)).alias("alert_key")).filter(F.col("alert_key") != "").distinct()


def exclude_alerted(scores: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows of entities that never alerted."""
    keys = alerted_keys(alerts)
    return scores.join(keys, F.trim(F.coalesce("entity_key", F.lit(""))) == F.col("alert_key"), "left_anti")


def clean_summary(scores: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Rows in and out, excluded keys, mean, p95 and p99 of the clean subset."""
    clean = stage(clean_benign(scores, alerts), "clean")  # read four times
    cum = cumulative(clean, F.col("score"), {"n": F.lit(1).cast("long")})
    q = quantiles_from(cum, [0.95, 0.99])
    stats = q.agg(
        F.max(F.when(F.col("q_index") == 0, F.col("value"))).alias("score_p95"),
        F.max(F.when(F.col("q_index") == 1, F.col("value"))).alias("score_p99"),
    ).select(F.struct("score_p95", "score_p99").alias("s"))
    n_in = scores.agg(F.count(F.lit(1))).scalar()
    n_keys = F.lit(0).cast("long") if alerts is None else alerted_keys(alerts).agg(F.count(F.lit(1))).scalar()
    out = clean.agg(F.count(F.lit(1)).alias("n_rows_output"), F.avg("score").alias("score_mean"))
    return (
        out.withColumns({"n_rows_input": n_in, "n_alert_keys_excluded": n_keys, "_s": stats.scalar()})
        .select("n_rows_input", "n_alert_keys_excluded", "n_rows_output", "score_mean", "_s.*")
    )


def calibrate_run(
    scores: DataFrame, alerts: DataFrame | None, fpr: float = 0.01, direction: str = metrics.HIGHER
) -> DataFrame:
    """Threshold and score summary from an unlabelled run: one row."""
    clean = stage(clean_benign(scores, alerts), "clean")  # read several times
    threshold = metrics.threshold_at_fpr(clean, fpr, direction)
    t = threshold.scalar()
    return metrics.score_summary(clean, t, direction).withColumn("recommended_threshold", threshold.scalar())


# Fixed value: reason of a released run status.
RELEASED = "telemetry stabilized below alert hold window"

# --- run status ----------------------------------------------------------------------


def with_hold_window(
    df: DataFrame, hold_s: float = 8.0, keys: Sequence[str] = ("run_id",), block_us: int = HOUR_US
) -> DataFrame:
    """Evidence of the last ``hold_s`` seconds of a run, current row included.

    ``peak_score``, ``hold_status`` and ``hold_category`` of the worst row (status,
    then score, then the larger category) and the number of ``signal_count`` rows.
    """
    keys = list(keys)
    category = F.col("category") if "category" in df.columns else F.lit("")
    worst = F.struct(
        S.status_rank("status").alias("rank"), F.col("score").alias("score"), category.alias("category")
    )
    both = F.struct(F.col("score").alias("peak"))
    df = blocked.sliding_max(df, keys, {"_worst": worst, "_peak": both}, _us(hold_s))
    df = blocked.sliding_totals(
        df, keys, _us(hold_s), {"signal_count": (S.status_rank("status") > 0).cast("long")}, block_us
    )
    return df.withColumns(
        {
            "peak_score": F.col("_peak.peak"),
            "hold_status": F.when(F.col("_worst.rank") == 2, "ATTACK")
            .when(F.col("_worst.rank") == 1, "SUSPECT")
            .otherwise("NORMAL"),
            "hold_category": F.col("_worst.category"),
        }
    ).drop("_worst", "_peak")


def run_status(
    decisions: DataFrame,
    policy: Policy,
    keys: Sequence[str] = ("run_id",),
    block_us: int = HOUR_US,
) -> DataFrame:
    """Display status of a run after every row, and one idle row per silence.

    While rows arrive the worst status of the hold window wins; a recent model
    hit alone is SUSPECT.  A signal that no row renews is released once the hold has
    passed, if that comes before the idle reset: NORMAL, with the row's own score.
    After ``runtime_idle_reset_s`` without rows the run is NORMAL (phase ``idle``)
    until the next one.
    """
    keys = list(keys)
    # the look-ahead reads its input twice, so it comes before the windows
    df = blocked.with_next(decisions, keys, ["ts_us", "row_id"], {"_nts": "ts_us"}, blocked.time_block(block_us))
    df = with_hold_window(df, policy.alert_hold_seconds, keys, block_us)
    peak = F.col("peak_score")
    hit = F.coalesce((peak != 0) & S.is_hit(peak, policy.threshold, policy.lower_is_attack), F.lit(False))
    own, held = S.norm_status("status"), F.col("hold_status")
    promoted = S.status_rank("hold_status") > S.status_rank("status")
    status = F.when(promoted, held).when((own == "NORMAL") & hit, "SUSPECT").otherwise(own)
    # Texts of a held status.
    reason = (
        F.when(
            promoted & (F.coalesce("hold_category", F.lit("")) != ""),
            F.concat(F.lit("holding recent "), F.col("hold_category"), F.lit(" evidence")),
        )
        .when(promoted & hit, "holding recent model evidence above threshold")
        .when(~promoted & (own == "NORMAL") & hit, "recent model score above threshold; confirming")
        .otherwise(F.col("reason"))
    )
    idle_us = _us(policy.runtime_idle_reset_s)
    idle_from = F.col("ts_us") + F.lit(idle_us + 1)
    silent = F.col("_nts").isNull() | (F.col("_nts") > F.col("ts_us") + F.lit(idle_us))
    state = lambda t, st, rs, ph, sig, score: F.struct(
        t.alias("at_us"), st.alias("run_status"), rs.alias("run_reason"), ph.alias("run_phase"),
        sig.alias("active_signals"), score.alias("display_score"),
    )
    live = state(F.col("ts_us"), status, reason, F.lit("active"), F.col("signal_count"), peak)
    idle = state(idle_from, F.lit("NORMAL"), F.lit(""), F.lit("idle"), F.lit(0).cast("long"), F.lit(0.0))
    hold_us = _us(policy.alert_hold_seconds)
    quiet = F.col("_nts").isNull() | (F.col("_nts") > F.col("ts_us") + F.lit(hold_us))
    released = state(
        F.col("ts_us") + F.lit(hold_us + 1), F.lit("NORMAL"), F.lit(RELEASED), F.lit("active"), F.lit(0).cast("long"),
        F.coalesce("score", F.lit(0.0)),
    )
    release = F.when(F.lit(hold_us < idle_us) & status.isin("ATTACK", "SUSPECT") & quiet, released)
    states = F.filter(F.array(live, release, F.when(silent, idle)), lambda x: x.isNotNull())
    return df.select(*keys, "row_id", F.explode(states).alias("_s")).select(*keys, "row_id", "_s.*")


def dominant_decision(
    df: DataFrame, batch: Sequence[str], order: str = "row_id"
) -> DataFrame:
    """Worst decision per batch: status, then score (none is -1), the last one of equals."""
    rank = F.struct(
        S.status_rank("status"), F.coalesce(F.col("score"), F.lit(-1.0)), F.col(order)
    )
    pick = F.max_by(F.struct(order, S.norm_status("status").alias("status"), "score", "reason", "decision_source"), rank)
    return df.groupBy(*batch).agg(pick.alias("_d")).select(*batch, "_d.*")


def latest_alerts(alerts: DataFrame, n: int = 20, run_id: str | None = None) -> DataFrame:
    """The newest ``n`` alerts (of a run)."""
    df = alerts if run_id is None else alerts.filter(F.col("run_id") == run_id)
    return df.orderBy(F.desc("ts_us"), F.desc("row_id")).limit(n)


def latest_by_run(df: DataFrame, n_alerts: int = 20) -> tuple[DataFrame, DataFrame]:
    """Latest row of every run, and its newest ``n_alerts`` ATTACK rows.

    The state is a plain aggregate; the per-run list is a top-n whose partial
    limit runs before the shuffle.
    """
    others = [c for c in df.columns if c != "run_id"]
    state = df.groupBy("run_id").agg(F.max_by(F.struct(*others), F.struct("ts_us", "row_id")).alias("_s"))
    w = Window.partitionBy("run_id").orderBy(F.desc("ts_us"), F.desc("row_id"))
    alerts = df.filter(S.norm_status("status") == "ATTACK").withColumn("alert_rank", F.row_number().over(w))
    return state.select("run_id", "_s.*"), alerts.filter(F.col("alert_rank") <= n_alerts)
