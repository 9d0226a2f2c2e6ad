"""Completed flows to poll snapshots and replay steps; label votes."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators.features import with_key


def expand_snapshots(
    flows: DataFrame, interval_s: float = 2.0, max_polls: int = 6, anchor_s: float | None = None
) -> DataFrame:
    """What polls on a fixed grid would have seen of each completed flow.

    The grid starts at the earliest flow start rounded down to the interval
    (one aggregate); a stream must pass ``anchor_s``.  A flow that ends between
    two polls still gives one snapshot.
    """
    step = float(interval_s)
    start = F.col("ts_us") / 1e6
    if anchor_s is None:
        first = flows.agg((F.floor(F.min(start) / step) * step).cast("double").alias("a"))
        flows = flows.withColumn("_anchor", first.scalar())
    else:
        flows = flows.withColumn("_anchor", F.lit(float(anchor_s)))
    flows = flows.withColumns(
        {"_start": start, "_dur": F.greatest(S.clean("flow_duration_s"), F.lit(S.EPS))}
    )
    offset = F.col("_start") - F.col("_anchor")
    end = F.least(F.col("_start") + F.col("_dur"), F.col("_start") + float(max_polls) * step)
    flows = flows.withColumns(
        {
            "_first": F.ceil(offset / step).cast("long"),
            "_last": F.floor((end - F.col("_anchor")) / step + 1e-9).cast("long"),
        }
    )
    polls = F.sequence(F.col("_first"), F.greatest(F.col("_first"), F.col("_last")))
    rows = flows.withColumn("poll_index", F.explode(polls))
    poll_ts = F.col("_anchor") + F.col("poll_index") * step
    elapsed = F.least(F.greatest(poll_ts - F.col("_start"), F.lit(0.0)), F.col("_dur"))
    rows = rows.withColumns({"_poll_ts": poll_ts, "_elapsed": elapsed})
    frac = F.least(F.greatest(F.col("_elapsed") / F.col("_dur"), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("snapshot_frac", frac)
    rows = rows.withColumns(
        {
            "packet_count": F.col("packet_count") * F.col("snapshot_frac"),
            "byte_count": F.col("byte_count") * F.col("snapshot_frac"),
            "flow_duration_s": F.col("_elapsed"),
            "ts_us": F.round(F.col("_poll_ts") * 1e6).cast("long"),
            "start_us": F.col("ts_us"),
            "poll_interval_s": F.lit(step),
        }
    )
    rows = rows.withColumns(
        {
            "packet_rate": S.ratio(F.col("packet_count"), F.col("flow_duration_s"), S.EPS),
            "byte_rate": S.ratio(F.col("byte_count"), F.col("flow_duration_s"), S.EPS),
            "avg_packet_size": S.ratio(F.col("byte_count"), F.col("packet_count"), 1.0),
        }
    )
    return rows.drop("_anchor", "_start", "_dur", "_first", "_last", "_poll_ts", "_elapsed")


# --- label votes -----------------------------------------------------------------


def vote_label(
    df: DataFrame,
    keys: Sequence[str],
    mode: str = "any_attack_priority",
    label: str = "label",
    order: Sequence[str] = ("ts_us", "row_id"),
) -> DataFrame:
    """One label per key.

    ``any_attack_priority``: most frequent attack label, ties to the larger
    name; ``majority``: the same over all labels; ``last_step``: the last attack
    label, else the last label.  Only counters per (key, label) are shuffled.
    """
    text = F.col(label)
    if mode == "last_step":
        at = F.struct(*order)
        attack = text != "Normal"
        return df.groupBy(*keys).agg(
            F.coalesce(
                F.max_by(F.when(attack, text), F.when(attack, at)),
                F.max_by(text, at),
            ).alias(label)
        )
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    if mode == "any_attack_priority":
        score = F.struct(F.when(text != "Normal", F.col("_n")).otherwise(F.lit(0)), text)
    elif mode == "majority":
        score = F.struct(F.col("_n"), text)
    else:
        raise ValueError(f"unknown vote mode {mode!r}")
    return counts.groupBy(*keys).agg(F.max_by(text, score).alias(label))


def vote_array(labels: Column, mode: str = "any_attack_priority") -> Column:
    """The same vote over a short array of labels in row order."""
    attacks = F.filter(labels, lambda x: x != "Normal")
    if mode == "last_step":
        return F.when(F.size(attacks) > 0, F.element_at(attacks, -1)).otherwise(F.element_at(labels, -1))
    pool = attacks if mode == "any_attack_priority" else labels
    scored = F.transform(
        F.array_distinct(pool), lambda x: F.struct(F.size(F.filter(pool, lambda y: y == x)).alias("n"), x.alias("l"))
    )
    best = F.array_max(scored)["l"]
    return F.coalesce(best, F.lit("Normal"))


def aggregate_snapshots(snapshots: DataFrame, key_mode: str = "flow") -> DataFrame:
    """Merge snapshots of one (file, key, poll): what a switch entry would show.

    Snapshots are first reduced per (file, key, poll, source port, label), so a
    key or poll that holds much of the data is combined before the shuffle.
    """
    keys = ["source_file", "conversation_key", "poll_index"]
    df = with_key(snapshots, key_mode)
    # the first row in (file, time, row) order supplies the identity
    lead = ["flow_id", "src_ip", "dst_ip", "dst_port", "protocol", "dst_port_norm",
            "protocol_tcp", "protocol_udp", "protocol_icmp", "poll_interval_s"]
    order = F.struct("start_us", "row_id") if "start_us" in df.columns else F.struct("row_id")
    fine = df.groupBy(*keys, "src_port", "label").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("packet_count").alias("_p"),
        F.sum("byte_count").alias("_b"),
        F.max("flow_duration_s").alias("_d"),
        F.max("snapshot_frac").alias("_f"),
        F.max("is_attack").alias("_a"),
        F.max("ts_us").alias("_t"),
        F.min(order).alias("_o"),
        F.min_by(F.struct(*lead, "label_index"), order).alias("_lead"),
    )
    by_label = fine.groupBy(*keys, "label").agg(
        F.sum("_n").alias("_n"),
        F.sum("_p").alias("_p"),
        F.sum("_b").alias("_b"),
        F.max("_d").alias("_d"),
        F.max("_f").alias("_f"),
        F.max("_a").alias("_a"),
        F.max("_t").alias("_t"),
        F.min("_o").alias("_o"),
        F.min_by("_lead", "_o").alias("_lead"),
        F.collect_set("src_port").alias("_ports"),
    )
    text = F.col("label")
    vote = F.struct(F.when(text != "Normal", F.col("_n")).otherwise(F.lit(0)), text)
    merged = by_label.groupBy(*keys).agg(
        F.max_by(text, vote).alias("label"),
        F.max_by(F.col("_lead.label_index"), vote).alias("label_index"),
        F.sum("_n").alias("_n"),
        F.sum("_p").alias("packet_count"),
        F.sum("_b").alias("byte_count"),
        F.max("_d").alias("flow_duration_s"),
        F.max("_f").alias("snapshot_frac"),
        F.max("_a").cast("long").alias("is_attack"),
        F.max("_t").alias("ts_us"),
        F.min_by("_lead", "_o").alias("_lead"),
        F.array_distinct(F.flatten(F.collect_list("_ports"))).alias("_ports"),
    )
    p, b, d = F.col("packet_count"), F.col("byte_count"), F.col("flow_duration_s")
    return merged.select(
        *keys,
        *[F.col(f"_lead.{c}").alias(c) for c in lead],
        F.when(F.size("_ports") == 1, F.element_at("_ports", 1)).otherwise(F.lit(-1)).cast("long").alias("src_port"),
        "label", "label_index", "is_attack", "ts_us", "packet_count", "byte_count", "flow_duration_s",
        S.ratio(p, d, S.EPS).alias("packet_rate"),
        S.ratio(b, d, S.EPS).alias("byte_rate"),
        S.ratio(b, p, 1.0).alias("avg_packet_size"),
        F.col("_n").cast("double").alias("subflow_count_same_key"),
        F.size(F.filter("_ports", lambda x: x != -1)).cast("double").alias("unique_src_ports_same_key"),
        "snapshot_frac",
        F.col("poll_index").alias("row_id"),
    )


# --- replay -----------------------------------------------------------------------


def expand_replay(flows: DataFrame, interval_s: float = 1.0, max_polls: int = 6) -> DataFrame:
    """Completed flow to evenly growing readings with their step deltas."""
    step = max(float(interval_s), 1e-3)
    duration = F.greatest(F.coalesce(F.col("flow_duration_s"), F.lit(0.0)), F.lit(step))
    zero = F.lit(0.0)
    df = flows.withColumns(
        {
            "packet_count_total": F.greatest(S.clean("packet_count"), zero),
            "byte_count_total": F.greatest(S.clean("byte_count"), zero),
            "_dur": duration,
        }
    )
    steps = F.greatest(F.lit(2), F.least(F.lit(int(max_polls)), F.ceil(F.col("_dur") / step))).cast("int")
    df = df.withColumn("n_polls", steps).withColumn("poll_step", F.explode(F.sequence(F.lit(1), F.col("n_polls"))))
    n = F.col("n_polls").cast("double")

    def at(k: Column) -> dict[str, Column]:
        frac = F.least(F.greatest(k / n, zero), F.lit(1.0))
        p, b = F.col("packet_count_total") * frac, F.col("byte_count_total") * frac
        d = F.greatest(F.col("_dur") * frac, F.lit(S.EPS))
        return {"p": p, "b": b, "d": d, "pr": p / d, "br": b / d}

    k = F.col("poll_step").cast("double")
    now, before = at(k), at(k - 1)
    later = F.col("poll_step") > 1
    delta = lambda x: now[x] - F.when(later, before[x]).otherwise(zero)
    df = df.withColumns(
        {
            "flow_key": F.concat(F.lit("replay::"), F.col("source_file"), F.lit("::"), F.col("row_id").cast("string")),
            "packet_count": now["p"],
            "byte_count": now["b"],
            "flow_duration_s": now["d"],
            "packet_rate": now["pr"],
            "byte_rate": now["br"],
            "packet_delta": delta("p"),
            "byte_delta": delta("b"),
            "packet_rate_delta": delta("pr"),
            "byte_rate_delta": delta("br"),
            "has_history": later,
            "ts_us": F.col("ts_us") + F.round(F.col("poll_step") * (float(interval_s) * 1e6)).cast("long"),
        }
    )
    avg = F.when(F.col("packet_count") > 0, S.ratio(F.col("byte_count"), F.col("packet_count"), 1.0)).otherwise(zero)
    return df.withColumn("avg_packet_size", avg).drop("_dur")


def replay_summary(replay: DataFrame) -> DataFrame:
    """Replay rows per label, and in total (``label`` = ``TOTAL``)."""
    return (
        replay.rollup("label")
        .agg(F.grouping("label").alias("_all"), F.count(F.lit(1)).alias("n_rows"))
        .select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("label")).alias("label"), "n_rows")
    )
