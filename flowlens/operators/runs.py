"""Incidents, searches, run summaries, comparison and ranking."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import blocked
from flowlens.operators.emission import keep_changed
from flowlens.operators.features import LATENCY_COLUMNS

_NONE = "—"


def incidents(alerts: DataFrame) -> DataFrame:
    """Alerts rolled up by type, source and target; the worst first."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    port = F.coalesce(F.col("dst_port").cast("string"), F.lit("?"))
    df = alerts.select(
        S.attack_label("category").alias("type"),
        F.when(text("src_ip") != "", F.col("src_ip")).otherwise(_NONE).alias("src"),
        F.when(text("dst_ip") != "", F.concat("dst_ip", F.lit(":"), port)).otherwise(_NONE).alias("dst"),
        F.coalesce(F.col("anomaly_score"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("hit_count"), F.lit(0)).alias("hits"),
        S.severity_rank("severity").alias("sev"),
        "ts_us",
        "row_id",
        "reason",
        "category",
    )
    said = text("reason") != ""
    at = F.struct("ts_us", "row_id")
    out = df.groupBy("type", "src", "dst").agg(
        F.max("score").alias("score"),
        F.max("hits").alias("hits"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("n_alerts"),
        F.max("sev").alias("severity_rank"),
        F.coalesce(F.max_by(F.when(said, F.col("reason")), F.when(said, at)), F.lit("")).alias("reason"),
        F.min_by("category", at).alias("category"),
    )
    out = out.withColumn(
        "severity",
        F.when(F.col("severity_rank") == 2, "high").when(F.col("severity_rank") == 1, "medium").otherwise("low"),
    )
    return out.orderBy(F.desc("severity_rank"), F.desc("score"), "type", "src", "dst")


def attack_sources(inc: DataFrame, n: int | None = None) -> DataFrame:
    """Alert count and last time per source address, the busiest first."""
    out = (
        inc.filter(F.col("src") != _NONE)
        .groupBy("src")
        .agg(F.sum("n_alerts").alias("n_alerts"), F.max("last_us").alias("last_us"))
        .orderBy(F.desc("n_alerts"), "src")
    )
    return out if n is None else out.limit(n)


def _contains(hay: Sequence[Column], q: str) -> Column:
    return F.lower(F.concat_ws(" ", *hay)).contains(q.lower())


def search_incidents(inc: DataFrame, q: str = "", severity: str = "", type_: str = "") -> DataFrame:
    """Filter by severity, type substring and free text."""
    if severity:
        inc = inc.filter(F.lower("severity") == severity.lower())
    if type_:
        inc = inc.filter(F.lower("type").contains(type_.lower()))
    if q:
        cols = [F.coalesce(F.col(c), F.lit("")) for c in ("src", "dst", "type", "reason", "category")]
        inc = inc.filter(_contains(cols, q))
    return inc


def search_flows(flows: DataFrame, q: str = "", proto: int | None = None, key: str = "entity_key") -> DataFrame:
    """Filter flows by protocol and free text over addresses, key, port and protocol name."""
    if proto is not None:
        flows = flows.filter(F.col("protocol") == proto)
    if q:
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src_ip", "dst_ip", key, "dst_port")]
        flows = flows.filter(_contains([*text, S.proto_name("protocol")], q))
    return flows


def attack_links(links: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with an attacking end, and the switches they touch.

    Two equi semi joins, so either side can be any size.
    """
    ips = sources.select(F.col("src").alias("_ip")).distinct()
    by_src = links.join(ips, links["src_ip"] == ips["_ip"], "left_semi")
    by_dst = links.join(ips, links["dst_ip"] == ips["_ip"], "left_semi")
    hit = by_src.union(by_dst).distinct()
    return hit, hit.filter(F.col("dpid").isNotNull()).select("dpid").distinct()


# --- runs --------------------------------------------------------------------------


def list_runs(df: DataFrame) -> DataFrame:
    """Run names, newest name first."""
    return df.select("run_id").filter(F.coalesce("run_id", F.lit("")) != "").distinct().orderBy(F.desc("run_id"))


def run_totals(scores: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows, scored rows, throughput, top score and alert counts per run."""
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    status = S.norm_status("status")
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("score").alias("scored_rows"),
        (F.count(F.lit(1)) / F.greatest(span, F.lit(S.EPS))).alias("throughput_obs_s"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.count_if(status == "ATTACK").alias("alerts_attack"),
        F.count_if(status == "SUSPECT").alias("alerts_suspect"),
    )


def with_run_meta(runs: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Attach ``k=v`` metadata as the map ``meta_map`` (empty when there is none)."""
    df = runs if meta is None else runs.join(meta.select("run_id", "meta"), "run_id", "left")
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn("meta_map", F.coalesce(S.parse_meta("meta"), empty))


# Report fields that come from the metrics table of a run, with defaults.
_METRIC_FIELDS = {
    "avg_switch_latency_ms": 0.0,
    "avg_inference_ms": 0.0,
    "avg_reply_delay_ms": 0.0,
    "max_reply_delay_ms": 0.0,
    "avg_total_e2e_ms": 0.0,
    "throughput_obs_s": 0.0,
    "recommended_poll_interval_s": 0.0,
    "timeout_total": 0,
    "trimmed_flows_total": 0,
    "dropped_rows": 0,
    "csv_drop_count": 0,
    "stream_drop_count": 0,
    "feature_state_count": 0,
    "raw_stats_queue_depth": 0,
    "queue_depth": 0,
    "status": "",
    "phase": "",
    "model_name": "",
}


def summarize_run(runs: DataFrame, scores: DataFrame, alerts: DataFrame) -> DataFrame:
    """One report row of 26 fields per run.

    ``attack_to_alert_s`` is the time from the first attack-labelled score row to
    the first ATTACK alert at or after it.
    """
    status = S.norm_status("status")
    a = alerts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("alerts_total"),
        F.count_if(status == "ATTACK").alias("alerts_attack"),
        F.count_if(status == "SUSPECT").alias("alerts_suspect"),
    )
    s = scores.groupBy("run_id").agg(
        F.max("score").alias("peak_score"),
        F.min(F.when(S.normalise_label("label") != "Normal", F.col("ts_us"))).alias("_first_attack"),
    )
    first = (
        alerts.filter(status == "ATTACK")
        .join(s.select("run_id", "_first_attack"), "run_id")
        .filter(F.col("ts_us") >= F.col("_first_attack"))
        .groupBy("run_id")
        .agg(F.min("ts_us").alias("_first_alert"))
    )
    df = with_run_meta(runs).join(a, "run_id", "left").join(s, "run_id", "left").join(first, "run_id", "left")
    zero = F.lit(0).cast("long")
    have = set(runs.columns)
    cols = {}
    for c, default in _METRIC_FIELDS.items():
        cols[c] = F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    return df.select(
        "run_id",
        F.col("meta_map"),
        S.num(F.get(F.array(F.col("meta_map")["poll_interval_s"]), F.lit(0))).alias("poll_interval_s"),
        *[v.alias(k) for k, v in cols.items()],
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("alerts_total", "alerts_attack", "alerts_suspect")],
        ((F.col("_first_alert") - F.col("_first_attack")) / 1e6).alias("attack_to_alert_s"),
        F.coalesce("peak_score", F.lit(0.0)).alias("peak_score"),
    )


def _run_group(runs: DataFrame, key: str) -> Column:
    return F.coalesce(F.col("meta_map")[key], *([F.col(key).cast("string")] if key in runs.columns else []), F.lit("None"))


def run_groups(runs: DataFrame, key: str) -> DataFrame:
    """(group, run_id): the runs behind each row of ``compare_runs``."""
    return runs.select(_run_group(runs, key).alias("group"), "run_id")


def compare_runs(runs: DataFrame, key: str) -> DataFrame:
    """Means and sums over the runs that share a metadata value; ``run_groups`` lists them."""
    group = _run_group(runs, key)
    have = set(runs.columns)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    return (
        runs.groupBy(group.alias("group"))
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.avg(num("avg_total_e2e_ms")).alias("avg_total_e2e_ms"),
            F.avg(num("avg_reply_delay_ms")).alias("avg_reply_delay_ms"),
            F.avg(num("throughput_obs_s")).alias("avg_throughput_obs_s"),
            F.sum(num("timeout_total").cast("long")).alias("timeout_total"),
            F.sum(num("trimmed_flows_total").cast("long")).alias("trimmed_flows_total"),
            F.avg(num("recommended_poll_interval_s")).alias("avg_recommended_poll_interval_s"),
        )
        .orderBy("group")
    )


def rank_runs(runs: DataFrame) -> DataFrame:
    """Runs by ``rank_score``, the best (lowest) first."""
    have = set(runs.columns)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    drops = num("dropped_rows") + num("csv_drop_count") + num("stream_drop_count")
    score = (
        num("avg_total_e2e_ms")
        + num("timeout_total") * 150.0
        + drops * 2.0
        + num("trimmed_flows_total") * 0.05
        - num("throughput_obs_s") * 0.30
    )
    return runs.withColumn("rank_score", score).orderBy("rank_score", "run_id")


def score_timeline(df: DataFrame, step_s: float = 1.0, n: int = 90, block_us: int = blocked.DAY_US) -> DataFrame:
    """The last ``n`` points of a run's score line.

    A row is a point when nine tenths of a step have passed since the last point, or when
    its status or its score (to five digits) is not that of the last point.
    """
    force = int(round(max(step_s, 0.25) * 900_000))
    score = F.round(F.coalesce("score", F.lit(-1.0)), 5)
    keep = keep_changed(df, ["run_id"], force, score, S.status_rank("status"), None, 1e-9, 1e-9, block_us)
    newest = Window.partitionBy("run_id").orderBy(F.desc("ts_us"), F.desc("row_id"))
    top = keep.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    return top.select("run_id", "row_id", "ts_us", "score", "status")


def health_windows(df: DataFrame, width: str = "1 minute", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Rows, attacks and mean latency per time window; also on a stream with a watermark."""
    at = F.timestamp_micros("ts_us")
    df = df.withColumn("_at", at)
    if late:
        df = df.withWatermark("_at", late)
    bucket = F.window("_at", width, slide) if slide else F.window("_at", width)
    latency = [c for c in LATENCY_COLUMNS if c in df.columns]
    return df.groupBy(bucket.alias("_w")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(S.norm_status("status") == "ATTACK").alias("n_attack"),
        *[F.avg(c).alias(f"avg_{c}") for c in latency],
    ).select(
        F.unix_micros("_w.start").alias("start_us"), F.unix_micros("_w.end").alias("end_us"),
        "n_rows", "n_attack", *[f"avg_{c}" for c in latency],
    )
