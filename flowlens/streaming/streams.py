"""Structured Streaming forms of the stateful operators, on event time.

Keyed state is small and bounded (last emitted reading, last alert). Operators with list
or map state and timers are in ``keyed``.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.operators import alerts, runs
from flowlens.operators.polls import FLOW_KEY
from flowlens.policy import Policy


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream over the files of a table; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


# --- state of many small keys -------------------------------------------------------

#: Keys are dealt out to this many groups, each with the states of its keys: a call, its frames
#: and its state cost as much for one key as for hundreds.
BUCKETS = 512


def _by_bucket(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    out: str,
    fields: Sequence[tuple[str, str]],
    fold: Callable[[tuple, list[tuple], tuple | None], tuple[tuple | None, list[tuple], int]],
    buckets: int,
) -> DataFrame:
    """``fold(key, rows, last)`` over the rows of each key in a micro-batch, in order; ``rows`` are ``columns``.

    It returns the key's state, what to emit and the time in ms at which silence frees the state. A state is
    freed when the watermark has passed that time, and not in a micro-batch that has rows of its key.
    ``_at`` is the watermarked time. NULL keys are keys.
    """
    names = [c.strip().split()[0] for c in out.split(",")]
    wide = [n for n, t in ((c.strip().split()) for c in out.split(",")) if t == "bigint"]
    types = ", ".join(f"{n} array<{t}>" for n, t in (("key", "string"), *fields, ("wake", "bigint")))

    def step(_bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (last, wake) for k, *last, wake in zip(*state.get)} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        groups: dict[str, list[tuple]] = {}
        values: dict[str, tuple] = {}
        if not state.hasTimedOut:
            for f in batches:
                lists = [f[c].astype(object).where(f[c].notna(), None).tolist() for c in keys] + [f[c].tolist() for c in columns]
                for text, *row in zip(f["_key"].tolist(), *lists):
                    rows = groups.get(text)
                    if rows is None:
                        rows = groups[text] = []
                        values[text] = tuple(row[: len(keys)])
                    rows.append(tuple(row[len(keys) :]))
        emitted: list[tuple] = []
        for text, (_, wake) in list(known.items()):
            if text not in groups and wake < now:
                del known[text]
        for text, rows in groups.items():
            rows.sort(key=lambda r: [(x != x, 0 if x != x else x) for x in r[:2]])  # nulls last
            last = known.get(text)
            kept, more, wake = fold(values[text], rows, None if last is None else tuple(last[0]))
            emitted += more
            if kept is not None:
                known[text] = (list(kept), max(wake, now + 1))
        if known:
            state.update(tuple(map(list, zip(*((k, *last, wake) for k, (last, wake) in known.items())))))
            state.setTimeoutTimestamp(max(min(wake for _, wake in known.values()), now + 1))
        elif state.exists:
            state.remove()
        if emitted:
            yield pd.DataFrame(emitted, columns=names).astype({n: "Int64" for n in wide})

    text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
    rows = df.withColumn("_key", text).select(bucket.alias("_bucket"), "_key", *keys, *columns, "_at")
    return rows.groupBy("_bucket").applyInPandasWithState(step, out, types, "append", GroupStateTimeout.EventTimeTimeout)


# --- flow tracker ------------------------------------------------------------------


def track_flows_stream(
    df: DataFrame,
    policy: Policy = Policy(),
    keys: Sequence[str] = FLOW_KEY,
    late: str = "1 hour",
    removed: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Emit-on-change observations of a stream of readings.

    State per flow: last emitted reading and last row time.  A silence above the
    time-out or a removal drops it; an event-time timer frees silent flows.
    """
    keys = list(keys)
    force, idle = _us(policy.force_emit_after_s), _us(policy.idle_timeout_s)
    min_p, min_b = policy.min_packet_delta, policy.min_byte_delta
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    out = (
        f"{key_types}, row_id bigint, ts_us bigint, packet_count double, byte_count double, duration_s double, "
        "packet_rate double, byte_rate double, packet_delta double, byte_delta double, packet_rate_delta double, "
        "byte_rate_delta double, has_history boolean, gap_us bigint"
    )
    fields = [("p", "double"), ("b", "double"), ("pr", "double"), ("br", "double"), ("emitted", "bigint"), ("seen", "bigint"), ("gone", "boolean")]

    def fold(key: tuple, rows: list[tuple], last: tuple | None) -> tuple[tuple | None, list[tuple], int]:
        kept = []
        for ts, rid, p, b, d, gone in rows:
            if gone:
                if last is not None:
                    last = (*last[:5], ts, True)
                continue
            p, b = float(p), float(b)
            if p <= 0 and b <= 0:
                continue
            pr, br = p / max(d, 1e-6), b / max(d, 1e-6)
            fresh = last is None or last[6] or ts - last[5] > idle
            if not fresh:
                dp, db = p - last[0], b - last[1]
                if not (dp < 0 or db < 0 or dp >= min_p or db >= min_b or ts - last[4] >= force):
                    last = (*last[:5], ts, False)
                    continue
            delta = (0.0, 0.0, 0.0, 0.0) if fresh else (
                max(p - last[0], 0.0), max(b - last[1], 0.0), pr - last[2], br - last[3]
            )
            gap = None if last is None else ts - last[4]
            kept.append((*key, rid, ts, p, b, d, pr, br, *delta, not fresh, gap))
            last = (p, b, pr, br, ts, ts, False)
        return last, kept, 0 if last is None else (last[5] + idle) // 1000 + 1

    gone = F.coalesce(F.col(removed), F.lit(False)) if removed else F.lit(False)
    rows = df.withColumns({"_gone": gone, "_at": F.timestamp_micros("ts_us"), "duration_s": F.col("duration_s").cast("double")})
    columns = ["ts_us", "row_id", "packet_count", "byte_count", "duration_s", "_gone"]
    return _by_bucket(rows.withWatermark("_at", late), keys, columns, out, fields, fold, buckets)


# --- alerts ------------------------------------------------------------------------


def alerts_stream(decisions: DataFrame, cooldown_s: float = 5.0, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """ATTACK rows of a stream, at most one per emit key and cool-down.

    The state of a key is freed once its cool-down has passed the watermark.
    """
    cool = _us(cooldown_s)

    def fold(key: tuple, rows: list[tuple], last: tuple | None) -> tuple[tuple | None, list[tuple], int]:
        at = None if last is None else last[0]
        kept = []
        for ts, rid in rows:
            if at is None or ts - at >= cool:
                kept.append((*key, rid, ts))
                at = ts
        return (at,), kept, (at + cool) // 1000 + 1

    key = F.when(F.coalesce("emit_key", F.lit("")) != "", F.col("emit_key")).otherwise(F.col("entity_key"))
    rows = decisions.filter(F.upper("status") == "ATTACK").select(key.alias("emit_key"), "row_id", "ts_us", F.timestamp_micros("ts_us").alias("_at"))
    return _by_bucket(
        rows.withWatermark("_at", late), ["emit_key"], ["ts_us", "row_id"], "emit_key string, row_id bigint, ts_us bigint", [("last", "bigint")], fold, buckets
    )


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# --- aggregates, joins, scoring --------------------------------------------------------


def latest_by_run_stream(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Latest row of every run, kept as versions of a small table (one row per run)."""
    others = [c for c in df.columns if c != "run_id"]
    state = df.groupBy("run_id").agg(F.max_by(F.struct(*others), F.struct("ts_us", "row_id")).alias("s"))

    def on_batch(batch: DataFrame, n: int) -> None:
        rows = batch.select("run_id", "s")
        if n > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/v{n - 1}"))
        order = F.struct("s.ts_us", "s.row_id")
        rows.groupBy("run_id").agg(F.max_by("s", order).alias("s")).write.mode("overwrite").parquet(f"{path}/v{n}")
        if n >= 2:  # a repeated batch reads the version before it
            _delete(batch.sparkSession, f"{path}/v{n - 2}")

    return (
        state.writeStream.outputMode("update")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def health_stream(df: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Health windows of a stream; rows later than ``late`` are dropped."""
    return runs.health_windows(df, width, late)


def correlate_polls_stream(requests: DataFrame, replies: DataFrame, timeout_s: float, late: str = "10 minutes") -> DataFrame:
    """``correlate_polls`` of two streams, as three stateful operators in a chain.

    Repeated messages are dropped within the watermark, each request meets its messages
    within the time-out, and what it met is reduced to one reply: the last message's time,
    numbers summed. A request without a message in time has timed out.
    """
    extra = [c for c in replies.columns if c not in ("dpid", "poll_cycle_id", "reply_us")]
    numbers = {f.name for f in replies.schema.fields if isinstance(f.dataType, T.NumericType)}
    r = replies.withColumn("r_at", F.timestamp_micros("reply_us")).withWatermark("r_at", late)
    r = r.dropDuplicatesWithinWatermark(list(replies.columns)).withColumnsRenamed({"dpid": "r_dpid", "poll_cycle_id": "r_cycle"})
    q = requests.select("dpid", "poll_cycle_id", "request_us").withColumn("q_at", F.timestamp_micros("request_us")).withWatermark("q_at", late)
    limit = F.expr(f"INTERVAL '{timeout_s:.6f}' SECOND")
    same = (F.col("dpid") == F.col("r_dpid")) & (F.col("poll_cycle_id") == F.col("r_cycle"))
    met = q.join(r, same & (F.col("r_at") >= F.col("q_at")) & (F.col("r_at") <= F.col("q_at") + limit), "leftOuter").drop("r_at", "r_dpid", "r_cycle")
    one = met.groupBy("dpid", "poll_cycle_id", "request_us", "q_at").agg(
        F.max("reply_us").alias("reply_us"), *[(F.sum(c) if c in numbers else F.max_by(c, "reply_us")).alias(c) for c in extra]
    )
    return one.select(
        "dpid", "poll_cycle_id", "request_us", "reply_us", *extra, F.col("reply_us").isNull().alias("timed_out"),
        ((F.col("reply_us") - F.col("request_us")) / 1000.0).alias("reply_delay_ms"),
    )


def score_stream(
    windows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Score window rows in micro-batches into a table.

    The batch size is the source's (``max_files``), the pace ``every``.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        score(windows)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query; raises what it raised."""
    query.awaitTermination()


def emitted(alert_ids: DataFrame, decisions: DataFrame) -> DataFrame:
    """Full alert records of emitted row ids."""
    return alerts.alert_rows(decisions.join(alert_ids.select("row_id"), "row_id", "left_semi"))
