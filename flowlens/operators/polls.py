"""Polled counters: reply aggregation, deltas, state, poll health, topology."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import scalars as S
from flowlens.operators import blocked
from flowlens.operators.emission import keep_changed
from flowlens.operators.features import with_protocol_onehot
from flowlens.policy import Policy
from flowlens.session import stage

FLOW_KEY = ["dpid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
ORDER = ["ts_us", "row_id"]


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def aggregate_reply(stats: DataFrame, keys: Sequence[str] = ("dpid", "poll_cycle_id", "flow_key")) -> DataFrame:
    """Sum the entries of one reply that share a flow key; longest duration wins."""
    duration = F.col("duration_sec") + F.col("duration_nsec") / 1e9
    return stats.groupBy(*keys).agg(
        F.sum(F.col("packet_count").cast("double")).alias("packet_count"),
        F.sum(F.col("byte_count").cast("double")).alias("byte_count"),
        F.max(duration).alias("duration_s"),
    )


def _rates(packets: Column, octets: Column, duration: Column) -> tuple[Column, Column]:
    safe = F.greatest(duration, F.lit(S.EPS))
    return packets / safe, octets / safe


def with_poll_deltas(
    df: DataFrame,
    keys: Sequence[str] = FLOW_KEY,
    idle_timeout_s: float | None = None,
    removed: str | None = None,
    block_us: int = blocked.DAY_US,
) -> DataFrame:
    """Rates of each reading and its change against the previous one of the flow.

    With ``idle_timeout_s`` (or a ``removed`` flag column) the flow's state is
    dropped after a longer silence (or after a removal), so history restarts.
    ``session_start`` marks such rows; ``gap_us`` is the time since the previous one.
    """
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "packet_count": F.greatest(F.col("packet_count").cast("double"), zero),
            "byte_count": F.greatest(F.col("byte_count").cast("double"), zero),
        }
    )
    fields = {"_pts": "ts_us", "_pp": "packet_count", "_pb": "byte_count", "_pd": "duration_s"}
    if removed:
        fields["_prem"] = removed
    df = blocked.with_previous(df, keys, ORDER, fields, blocked.time_block(block_us))
    start = F.col("_pts").isNull()
    if idle_timeout_s is not None:
        start = start | (F.col("ts_us") - F.col("_pts") > _us(idle_timeout_s))
    if removed:
        start = start | F.coalesce(F.col("_prem"), F.lit(False))
    pr, br = _rates(F.col("packet_count"), F.col("byte_count"), F.col("duration_s"))
    ppr, pbr = _rates(F.col("_pp"), F.col("_pb"), F.col("_pd"))
    df = df.withColumns(
        {
            "session_start": F.coalesce(start, F.lit(True)),
            "gap_us": F.col("ts_us") - F.col("_pts"),
            "packet_rate": pr,
            "byte_rate": br,
        }
    )
    seen = ~F.col("session_start")
    change = lambda now, before: F.when(seen, F.greatest(now - before, zero)).otherwise(zero)
    diff = lambda now, before: F.when(seen, now - before).otherwise(zero)
    df = df.withColumns(
        {
            "has_history": seen,
            "flow_duration_s": F.greatest(F.col("duration_s"), zero),
            "avg_packet_size": S.ratio(F.col("byte_count"), F.col("packet_count"), 1.0),
            "packet_delta": change(F.col("packet_count"), F.col("_pp")),
            "byte_delta": change(F.col("byte_count"), F.col("_pb")),
            "packet_rate_delta": diff(F.col("packet_rate"), ppr),
            "byte_rate_delta": diff(F.col("byte_rate"), pbr),
            "src_port_norm": S.port_norm("src_port"),
            "dst_port_norm": S.port_norm("dst_port"),
        }
    )
    return with_protocol_onehot(df).drop(*fields)


def with_sessions(
    df: DataFrame,
    keys: Sequence[str] = FLOW_KEY,
    idle_timeout_s: float = 120.0,
    removed: str | None = None,
    block_us: int = blocked.DAY_US,
) -> DataFrame:
    """Number the lives of a flow: a silence above the time-out or a removal ends one.

    Adds ``session_id`` (1-based per key) and ``session_row`` (1-based in it).
    """
    fields = {"_pts": "ts_us"}
    if removed:
        fields["_prem"] = removed
    df = blocked.with_previous(df, keys, ORDER, fields, blocked.time_block(block_us))
    start = F.col("_pts").isNull() | (F.col("ts_us") - F.col("_pts") > _us(idle_timeout_s))
    if removed:
        start = start | F.coalesce(F.col("_prem"), F.lit(False))
    df = df.withColumn("_start", F.coalesce(start, F.lit(True))).drop(*fields)
    df = blocked.running_since_reset(
        df,
        keys,
        ORDER,
        {
            "session_id": (F.col("_start").cast("long"), F.lit(False)),
            "session_row": (F.lit(1), F.col("_start")),
        },
        blocked.time_block(block_us),
    )
    return df.drop("_start")


def track_flows(
    df: DataFrame,
    policy: Policy = Policy(),
    keys: Sequence[str] = FLOW_KEY,
    removed: str | None = None,
    block_us: int = 3_600_000_000,
) -> DataFrame:
    """Emit-on-change observations: deltas are against the last emitted reading.

    Readings without any traffic are dropped first.  ``removed`` rows only end
    the state of their flow.
    """
    keys = list(keys)
    live = (F.col("packet_count") > 0) | (F.col("byte_count") > 0)
    rows = df.filter(live | F.col(removed)) if removed else df.filter(live)
    fields = {"_pts": "ts_us"}
    if removed:
        fields["_prem"] = removed
    rows = blocked.with_previous(rows, keys, ORDER, fields, blocked.time_block(block_us))
    fresh = F.col("_pts").isNull() | (F.col("ts_us") - F.col("_pts") > _us(policy.idle_timeout_s))
    if removed:
        fresh = fresh | F.coalesce(F.col("_prem"), F.lit(False))
    rows = rows.withColumn("_fresh", F.coalesce(fresh, F.lit(True))).drop(*fields)
    if removed:
        # a removal is not a reading; the next reading starts afresh
        rows = rows.filter(~F.col(removed))
    kept = keep_changed(
        rows,
        keys,
        _us(policy.force_emit_after_s),
        packets=F.col("packet_count"),
        octets=F.col("byte_count"),
        fresh=F.col("_fresh"),
        min_packet_delta=policy.min_packet_delta,
        min_byte_delta=policy.min_byte_delta,
        block_us=block_us,
    )
    # read twice below (summary and rows), so the fold is not repeated
    kept = stage(kept.withColumnRenamed("_fresh", "_life"), "observations")
    return _restart_history(with_poll_deltas(kept, keys, None, None, block_us))


def _restart_history(df: DataFrame) -> DataFrame:
    # the first row of a life is always kept, so the flag also marks it among kept rows
    fresh = F.col("_life")
    zeroed = {
        c: F.when(fresh, F.lit(0.0)).otherwise(F.col(c))
        for c in ("packet_delta", "byte_delta", "packet_rate_delta", "byte_rate_delta")
    }
    return df.withColumns(
        {**zeroed, "has_history": F.col("has_history") & ~fresh, "session_start": F.col("session_start") | fresh}
    ).drop("_life")


def rolling_sequences(
    df: DataFrame,
    n: int = 4,
    vector: str = "feature_vector",
    keys: Sequence[str] = FLOW_KEY,
    idle_timeout_s: float = 120.0,
    removed: str | None = None,
    block_us: int = blocked.DAY_US,
) -> DataFrame:
    """Rolling window of the last ``n`` vectors of a live flow, one per row.

    ``phase`` is ``warmup_k/n`` until the buffer is full, then ``scored`` with the
    window in ``window``.  A silence above the time-out or a removal empties the buffer.
    """
    gone = F.coalesce(F.col(removed), F.lit(False)) if removed else F.lit(False)
    row = F.struct(F.col("ts_us").alias("t"), gone.alias("gone"), F.col(vector).alias("v"))
    df = blocked.with_recent(df, keys, ORDER, row, n, blocked.time_block(block_us), name="_recent")
    size = F.size("_recent")
    limit = F.lit(_us(idle_timeout_s))
    # index of the last row that starts a session, within the recent rows
    starts = F.transform(
        "_recent",
        lambda x, i: F.when(
            (i > 0)
            & (
                (x["t"] - F.get("_recent", i - 1)["t"] > limit)
                | F.get("_recent", i - 1)["gone"]
            ),
            i,
        ).otherwise(F.lit(0)),
    )
    df = df.withColumn("_from", F.array_max(starts))
    filled = size - F.col("_from")
    df = df.withColumn("buffered", filled)
    full = F.col("buffered") >= n
    return df.withColumns(
        {
            "phase": F.when(full, "scored").otherwise(
                F.concat(F.lit("warmup_"), F.col("buffered").cast("string"), F.lit(f"/{n}"))
            ),
            "window": F.when(full, F.transform("_recent", lambda x: x["v"])),
        }
    ).drop("_recent", "_from")


# --- replies, poll health ------------------------------------------------------


def _informative() -> list[Column]:
    """Order of a reply's items, the most informative first."""
    known = F.col("has_history")
    return [
        known.cast("double").desc(),
        F.when(known, F.col("packet_delta")).otherwise(F.col("packet_count")).desc(),
        F.when(known, F.col("byte_delta")).otherwise(F.col("byte_count")).desc(),
        F.when(known, F.col("packet_count")).otherwise(F.lit(0.0)).desc(),
        F.col("row_id").asc(),
    ]


def trim_reply(df: DataFrame, k: int, keys: Sequence[str] = ("dpid", "poll_cycle_id")) -> DataFrame:
    """Keep the ``k`` most informative items of every reply.

    ``k`` is a literal, so each map task already drops all but its best ``k``.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_informative()))
    return df.withColumn("reply_rank", rank).filter(F.col("reply_rank") <= k)


def trim_under_pressure(
    df: DataFrame,
    pressure: Column,
    timeouts: Column,
    high: int = 1200,
    extreme: int | None = None,
    keys: Sequence[str] = ("dpid", "poll_cycle_id"),
) -> DataFrame:
    """Keep of every reply as many items as its pressure allows (``trim_limit``).

    The window is one reply of one switch; replies are what a switch sends at once.
    """
    reply = Window.partitionBy(*keys)
    df = df.withColumns({"_items": F.count(F.lit(1)).over(reply), "reply_rank": F.row_number().over(reply.orderBy(*_informative()))})
    limit = trim_limit(pressure, timeouts, F.col("_items"), high, extreme)
    df = df.withColumn("_limit", limit)
    return df.filter((F.col("_limit") == 0) | (F.col("reply_rank") <= F.col("_limit"))).drop("_items", "_limit")


def trim_limit(
    pressure: Column, timeouts: Column, items: Column, high: int = 1200, extreme: int | None = None
) -> Column:
    """Item limit of a reply under pressure; 0 means no limit."""
    extreme = extreme if extreme is not None else max(200, high // 2)
    return (
        F.when((pressure == "high") & (timeouts > 0), extreme)
        .when(pressure == "high", high)
        .when((pressure == "medium") & (items > 2 * high), high)
        .otherwise(0)
    )


def active_flows(obs: DataFrame, n: int | None = 120, keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """The ``n`` most recently seen flows (None: all, in no order) with their latest counters."""
    last = F.struct("ts_us", "row_id")
    state = ["packet_count", "byte_count", "packet_rate", "byte_rate"]
    flows = obs.groupBy(*keys).agg(
        F.max_by(F.struct(*state), last).alias("_s"),
        F.max("ts_us").alias("last_seen_us"),
        F.min("ts_us").alias("_first"),
        F.count(F.lit(1)).alias("seen_polls"),
    )
    flows = flows.select(
        *keys,
        *[F.col(f"_s.{c}").alias(f"last_{c}") for c in state],
        ((F.col("last_seen_us") - F.col("_first")) / 1e6).alias("flow_age_s"),
        "seen_polls",
        "last_seen_us",
    )
    if n is None:
        return flows
    newest = [F.desc(c) for c in ("last_seen_us", "last_packet_rate", "last_byte_rate")]
    return flows.orderBy(*newest, *[F.asc(k) for k in keys]).limit(n)


def topology(obs: DataFrame, n_hosts: int = 60, n_links: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Switches, hosts (first ``n_hosts`` by address, with the full count) and links."""
    hosts = hosts_of(obs)
    listed = (
        hosts.orderBy("ip")
        .limit(n_hosts)
        .withColumn("host_count", hosts.agg(F.count(F.lit(1))).scalar())
    )
    switches = obs.select("dpid").distinct()
    links = active_flows(obs, n_links).select(
        "dpid", "src_ip", "dst_ip", "dst_port", "protocol",
        F.col("last_packet_rate").alias("packet_rate"), F.col("last_byte_rate").alias("byte_rate"),
    )
    return switches, listed, links


def hosts_of(*tables: DataFrame) -> DataFrame:
    """Distinct non-empty addresses over the source and destination columns."""
    both = None
    for t in tables:
        ips = t.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
        both = ips if both is None else both.union(ips)
    return both.filter((F.col("ip") != "") & F.col("ip").isNotNull()).distinct()


def correlate_polls(requests: DataFrame, replies: DataFrame, timeout_s: float) -> DataFrame:
    """Requests with their reply, or a time-out when none came in time.

    A reply may come in several messages, and messages may repeat: those in time are one
    reply, whose time is the last one's; its numbers are summed over different messages.
    """
    extra = [c for c in replies.columns if c not in ("dpid", "poll_cycle_id", "reply_us")]
    numbers = {f.name for f in replies.schema.fields if isinstance(f.dataType, T.NumericType)}
    asked = requests.select(F.col("dpid").alias("_d"), F.col("poll_cycle_id").alias("_c"), F.col("request_us").alias("_q")).distinct()
    in_time = (F.col("reply_us") >= F.col("_q")) & (F.col("reply_us") <= F.col("_q") + F.lit(_us(timeout_s)))
    got = replies.distinct().join(asked, (F.col("dpid") == F.col("_d")) & (F.col("poll_cycle_id") == F.col("_c")) & in_time)
    one = got.groupBy("_d", "_c", "_q").agg(
        F.max("reply_us").alias("reply_us"),
        *[(F.sum(c) if c in numbers else F.max_by(c, "reply_us")).alias(c) for c in extra],
    )
    same = (F.col("q.dpid") == F.col("r._d")) & (F.col("q.poll_cycle_id") == F.col("r._c")) & (F.col("q.request_us") == F.col("r._q"))
    return requests.alias("q").join(one.alias("r"), same, "left").select(
        "q.*",
        F.col("r.reply_us").alias("reply_us"),
        *[F.col(f"r.{c}").alias(c) for c in extra],
        F.col("r.reply_us").isNull().alias("timed_out"),
        ((F.col("r.reply_us") - F.col("request_us")) / 1000.0).alias("reply_delay_ms"),
    )


def switch_poll_metrics(polls: DataFrame) -> DataFrame:
    """Per switch: polls, replies, time-outs, delays, flows per reply, trims."""
    got = ~F.col("timed_out")
    last = lambda c: F.max_by(F.when(got, F.col(c)), F.when(got, F.struct("reply_us", "poll_cycle_id")))
    when = lambda c: F.when(got, F.col(c))
    return polls.groupBy("dpid").agg(
        F.count(F.lit(1)).alias("polls_sent"),
        F.count(when("poll_cycle_id")).alias("replies_received"),
        F.sum(F.col("timed_out").cast("long")).alias("timeouts"),
        F.coalesce(F.avg(when("reply_delay_ms")), F.lit(0.0)).alias("avg_reply_delay_ms"),
        F.coalesce(F.max(when("reply_delay_ms")), F.lit(0.0)).alias("max_reply_delay_ms"),
        F.coalesce(last("reply_delay_ms"), F.lit(0.0)).alias("last_reply_delay_ms"),
        F.coalesce(F.avg(when("flows")), F.lit(0.0)).alias("avg_flows_per_reply"),
        F.coalesce(F.sum(when("flows")), F.lit(0)).alias("total_flows_observed"),
        F.coalesce(last("flows"), F.lit(0)).alias("last_flows_per_reply"),
        F.coalesce(last("parts"), F.lit(0)).alias("last_reply_parts"),
        F.sum((got & (F.col("trimmed") > 0)).cast("long")).alias("trimmed_replies"),
        F.coalesce(F.sum(when("trimmed")), F.lit(0)).alias("trimmed_flows"),
    )


def polling_summary(metrics: DataFrame) -> DataFrame:
    """One row over all switches; zeros when there is none."""
    z = F.lit(0.0)
    return metrics.agg(
        F.count(F.lit(1)).alias("switch_count"),
        F.coalesce(F.sum("timeouts"), F.lit(0)).alias("timeout_total"),
        F.coalesce(F.avg("avg_reply_delay_ms"), z).alias("avg_reply_delay_ms"),
        F.coalesce(F.max("max_reply_delay_ms"), z).alias("max_reply_delay_ms"),
        F.coalesce(F.avg("avg_flows_per_reply"), z).alias("avg_flows_per_reply"),
        F.coalesce(F.sum("trimmed_flows"), F.lit(0)).alias("trimmed_flows_total"),
    )
