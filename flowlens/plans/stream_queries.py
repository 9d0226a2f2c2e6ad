"""Streaming queries: run to the end of the given tables, then read the sink.

The derived table is written in a few time slices, so that every stream has
several micro-batches; results must equal the batch oracles.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from flowlens.operators import models, polls, runs
from flowlens.operators.features import with_feature_vector
from flowlens.plans.registry import DAY, ORACLES, TEST_POLICY as P, piece, query, with_pieces
from flowlens.plans.rule_queries import COOL, _DCOLS, _FRESH, _TR, _obs_score, _reason_head, emit_sql, track_sql
from flowlens.plans.run_queries import _HEALTH, _SCORED_SQL, _model_windows, _score_given, _stats, _with_latency
from flowlens.session import new_path, stage
from flowlens.sources import exports
from flowlens.streaming import keyed, meters, streams

SLICES = 3


def _sliced(df, keys, ts="ts_us", closing=None, files=2):
    """Write ``df`` as files in time order, ``files`` a slice; all rows of a key in a slice share a file.

    ``closing``: columns of one more row, written last and a day after the end, that moves
    the watermark past every real row.
    """
    path = new_path(df.sparkSession, "slices")
    df = stage(df, "stream-input")
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    step = (hi - lo) // SLICES + 1
    for i in range(SLICES):
        part = df.filter((F.col(ts) >= lo + i * step) & (F.col(ts) < lo + (i + 1) * step))
        part.repartition(files, *keys).write.mode("append").parquet(path)
    if closing:
        end = {ts: F.lit(hi + DAY).cast("long"), **closing}
        last = df.limit(1).select(*[(end[c].cast(t) if c in end else F.col(c)).alias(c) for c, t in df.dtypes])
        last.coalesce(1).write.mode("append").parquet(path)
    return path


def _to_table(df, name):
    spark = df.sparkSession
    path, check = new_path(spark, name), new_path(spark, "stream-check")
    streams.run_to_end(exports.stream_rows(df, path, check))
    return spark.read.schema(df.schema).parquet(path)


@query("x1_track_flows_stream", with_pieces("live_rows", _TR, track_sql("live_rows", _FRESH)))
def _(t):
    path = _sliced(t.get("poll_stats").drop("ts"), polls.FLOW_KEY)
    df = streams.track_flows_stream(streams.table_stream(t.spark, path, 2), P)
    return _to_table(df, "tracked").select("row_id", "has_history", "packet_delta", "byte_delta")


@query("x3_track_flows_stream_removals", with_pieces("live_removed", _TR, track_sql("live_removed", f"({_FRESH} OR coalesce(prem, false))")))
def _(t):
    """Removals drop the state of a flow in the stream as in the batch."""
    path = _sliced(t.get("poll_stats").drop("ts").withColumn("removed", F.col("row_id") % 19 == 0), polls.FLOW_KEY)
    df = streams.track_flows_stream(streams.table_stream(t.spark, path, 2), P, removed="removed")
    return _to_table(df, "tracked").select("row_id", "has_history", "packet_delta", "byte_delta")


@query("x6_alerts_stream", with_pieces("attacks", "SELECT row_id FROM walk WHERE emit", emit_sql("attacks", "emit_key", COOL)))
def _(t):
    path = _sliced(t.get("scored").drop("ts").withColumn("emit_key", F.lit("")), ["entity_key"])
    df = streams.alerts_stream(streams.table_stream(t.spark, path, 2), P.alert_cooldown_seconds)
    return _to_table(df, "alerts").select("row_id")


@query("x5_rules_stream", with_pieces("decided", f"SELECT row_id, {', '.join(_DCOLS)}, reason_head FROM decided"))
def _(t):
    """Windows of every rule's scope, then counters and decisions, each a query on keyed state."""
    obs = _obs_score(t).drop("ts", "poll_request_us", "poll_reply_us")
    path = _sliced(obs, polls.FLOW_KEY)
    windows, out = new_path(t.spark, "rule-windows"), new_path(t.spark, "decisions")
    streams.run_to_end(keyed.rule_windows_stream(streams.table_stream(t.spark, path, 2), P, windows, new_path(t.spark, "stream-check")))
    found = streams.table_stream(t.spark, windows).drop("batch")
    streams.run_to_end(keyed.rule_decisions_stream(found, P, out, new_path(t.spark, "stream-check")))
    return t.spark.read.parquet(out).select("row_id", *_DCOLS, _reason_head().alias("reason_head"))


@query("x4_rolling_sequences_stream", ORACLES["x4_rolling_sequences"])
def _(t):
    """Warm-up phases, windows and idle restarts over several micro-batches."""
    path = _sliced(with_feature_vector(t.obs()).select(*polls.FLOW_KEY, "row_id", "ts_us", "feature_vector"), polls.FLOW_KEY, files=12)
    df = keyed.rolling_sequences_stream(streams.table_stream(t.spark, path, 12), 4, idle_timeout_s=P.idle_timeout_s)
    at = lambda i: F.get(F.get("window", F.lit(i)), F.lit(0))
    return _to_table(df, "sequences").select("row_id", "phase", at(0).alias("oldest"), at(3).alias("newest"))


def _status_stream(t, policy):
    """Status rows of all runs; the closing row of another run moves the watermark past every timer."""
    rows = t.scored_runs().drop("ts")
    path = _sliced(rows, ["run_id"], closing={"run_id": F.lit("closing"), "row_id": F.lit(-1)})
    df = keyed.run_status_stream(streams.table_stream(t.spark, path, 2), policy)
    return _to_table(df, "run-status").filter("run_id <> 'closing'")


@query("x7_run_status_stream", ORACLES["x7_run_status"])
def _(t):
    """A hold longer than the idle reset."""
    return _status_stream(t, P)


@query("x7_run_status_release_stream", ORACLES["x7_run_status_release"])
def _(t):
    """A hold shorter than the idle reset: released by a timer."""
    return _status_stream(t, dataclasses.replace(P, runtime_idle_reset_s=7200.0)).drop("run_reason")


@query(
    "x8_latest_state_stream",
    with_pieces(
        "scored_runs",
        "SELECT run_id, row_id, ts_us, status, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us DESC, row_id DESC) AS r FROM scored_runs) t WHERE r = 1",
    ),
)
def _(t):
    df = t.scored_runs().select("run_id", "row_id", "ts_us", "status", "score")
    src = _sliced(df, ["run_id"])
    path, check = new_path(t.spark, "latest"), new_path(t.spark, "stream-check")
    q = streams.latest_by_run_stream(streams.table_stream(t.spark, src, 2), path, check)
    streams.run_to_end(q)
    n = q.lastProgress["batchId"]
    fs = t.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(t.spark._jsc.hadoopConfiguration())
    while n > 0 and not fs.exists(t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")):
        n -= 1
    return t.spark.read.parquet(f"{path}/v{n}").select("run_id", "s.*")


@query("x9_health_stream", with_pieces("scored", _HEALTH.format(w=3_600_000_000)))
def _(t):
    """All windows; the one of the closing row stays open behind the watermark."""
    path = _sliced(_with_latency(t.get("scored").drop("ts")), ["row_id"], closing={"row_id": F.lit(-1)})
    return _to_table(streams.health_stream(streams.table_stream(t.spark, path, 2), "1 hour", "1 hour"), "health")


@query(
    "j3_correlate_polls_stream",
    with_pieces("correlated", "SELECT dpid, poll_cycle_id, request_us, reply_us, timed_out, round(reply_delay_ms, 6) AS reply_delay_ms FROM correlated"),
)
def _(t):
    """All requests; the closing row of both sides has switch -1."""
    log = t.get("poll_log")
    closing = {"dpid": F.lit(-1), "poll_cycle_id": F.lit(-1)}
    req = _sliced(log.select("dpid", "poll_cycle_id", "request_us"), ["dpid"], "request_us", closing)
    rep = _sliced(log.filter("reply_us IS NOT NULL").select("dpid", "poll_cycle_id", "reply_us"), ["dpid"], "reply_us", closing)
    df = streams.correlate_polls_stream(streams.table_stream(t.spark, req, 2), streams.table_stream(t.spark, rep, 2), 0.6, "1 hour")
    return _to_table(df, "correlated").filter("dpid >= 0")


#: Replies in up to three messages, of which some repeat and some come too late.
piece("messages", ("poll_log",), """SELECT dpid, poll_cycle_id, reply_us + i * 40000 AS reply_us, flows + i AS flows, again FROM poll_log, range(3) r(i), range(2) q(again)
 WHERE reply_us IS NOT NULL AND i <= poll_cycle_id % 3 AND (again = 0 OR poll_cycle_id % 5 = 0)""")
_PARTS_SQL = with_pieces(
    "messages",
    """SELECT l.dpid, l.poll_cycle_id, request_us, max(m.reply_us) AS reply_us, sum(m.flows)::BIGINT AS flows, max(m.reply_us) IS NULL AS timed_out,
 round((max(m.reply_us) - request_us) / 1000.0, 6) AS reply_delay_ms FROM poll_log l LEFT JOIN (SELECT DISTINCT dpid, poll_cycle_id, reply_us, flows FROM messages) m
 ON m.dpid = l.dpid AND m.poll_cycle_id = l.poll_cycle_id AND m.reply_us >= request_us AND m.reply_us <= request_us + 600000 GROUP BY l.dpid, l.poll_cycle_id, request_us""",
)


def _messages(log):
    rows = log.filter("reply_us IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("poll_cycle_id") % 3).cast("int"))))
    rows = rows.withColumn("again", F.explode(F.when(F.col("poll_cycle_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("dpid", "poll_cycle_id", (F.col("reply_us") + F.col("i") * 40_000).alias("reply_us"), (F.col("flows") + F.col("i")).alias("flows"))


@query("j3_correlate_polls_parts", _PARTS_SQL)
def _(t):
    """Replies in several messages, some repeated or late."""
    log = t.get("poll_log")
    return polls.correlate_polls(log.select("dpid", "poll_cycle_id", "request_us"), _messages(log), 0.6)


@query("j3_correlate_polls_parts_stream", _PARTS_SQL)
def _(t):
    """The same as streams: one row per request; the closing row of both sides has switch -1."""
    log = t.get("poll_log")
    closing = {"dpid": F.lit(-1), "poll_cycle_id": F.lit(-1)}
    req = _sliced(log.select("dpid", "poll_cycle_id", "request_us"), ["dpid"], "request_us", closing)
    rep = _sliced(_messages(log), ["dpid"], "reply_us", closing)
    df = streams.correlate_polls_stream(streams.table_stream(t.spark, req, 2), streams.table_stream(t.spark, rep, 2), 0.6, "1 hour")
    return _to_table(df, "correlated").filter("dpid >= 0")


@query("s5_stream_sink", with_pieces("scored", "SELECT row_id, round(score, 6) AS score FROM scored WHERE status = 'ATTACK'"))
def _(t):
    """Append sink of a stream of score rows."""
    path = _sliced(t.get("scored").drop("ts"), ["entity_key"])
    df = streams.table_stream(t.spark, path, 2).filter("status = 'ATTACK'").select("row_id", "score")
    return _to_table(df, "scores")


@query("x10_score_stream")
def _(t):
    """Micro-batch scoring of test windows with a fitted classifier."""
    w = _model_windows(t)
    stats = _stats(w)
    model = models.fit_classifier(w.filter(F.col("split") == "train"), stats=stats, maxIter=20)
    src = _sliced(w.filter(F.col("split") == "test"), ["flow_key"], "end_us")
    path, check = new_path(t.spark, "scored-windows"), new_path(t.spark, "stream-check")
    score = lambda d: models.score_classifier(d, model, stats=stats).select("flow_key", "window_start", "is_attack", "score")
    streams.run_to_end(streams.score_stream(streams.table_stream(t.spark, src, 2), score, path, check))
    return t.spark.read.parquet(path)


@query("x10_score_stream_given", with_pieces("given_windows", _SCORED_SQL))
def _(t):
    """Micro-batch scoring of test windows by given coefficients."""
    src = _sliced(_model_windows(t).filter(F.col("split") == "test"), ["flow_key"], "end_us")
    path, check = new_path(t.spark, "scored-windows"), new_path(t.spark, "stream-check")
    score = lambda d: _score_given(d).select("flow_key", "window_start", "is_attack", "score")
    streams.run_to_end(streams.score_stream(streams.table_stream(t.spark, src, 2), score, path, check))
    return t.spark.read.parquet(path)


@query(
    "x9_late_rows",
    with_pieces("scored", "SELECT count(*) + count(*) FILTER (row_id % 50 = 0) + 1 AS rows_in, count(*) FILTER (row_id % 50 = 0) AS rows_late, count(*) + 1 AS rows_kept FROM scored"),
)
def _(t):
    """Counters of a stream with known late rows: a fiftieth of the rows comes again, under new ids, after the watermark has passed."""
    rows = t.get("scored").select("row_id", "ts_us", "status")
    path = _sliced(rows, ["row_id"], closing={"row_id": F.lit(-1)})
    first = rows.agg(F.min("ts_us")).first()[0]
    late = rows.filter("row_id % 50 = 0").select((-2 - F.col("row_id")).alias("row_id"), F.lit(first).alias("ts_us"), "status")
    late.repartition(2).write.mode("append").parquet(path)
    df = meters.counted(streams.table_stream(t.spark, path, 2), "read").withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", "1 hour")
    df = meters.counted(df.dropDuplicatesWithinWatermark(["row_id"]), "kept")
    q = exports.stream_rows(df.drop("_at"), new_path(t.spark, "kept"), new_path(t.spark, "stream-check"))
    streams.run_to_end(q)
    return meters.as_row(t.spark, meters.of_query(q)).select(F.col("observed")["read.rows"].alias("rows_in"), "rows_late", F.col("observed")["kept.rows"].alias("rows_kept"))
