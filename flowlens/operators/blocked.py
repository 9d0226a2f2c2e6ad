"""Windows over keys of any size.

A window partitioned by a flow key, a service or a run puts every row of that
key into one task.  Keys are heavily skewed in traffic data (one victim service
can hold a third of all rows), so each key is cut into *blocks* of its order
column and the work is done per ``(key, block)``:

* ``sliding`` windows of a bounded length copy the rows of the last ``w`` before
  a block into it as a non-output halo: one shuffle, no second pass;
* windows that look back without bound (previous row, row numbers, running
  totals, streaks) add a *carry*: one small summary row per ``(key, block)``,
  folded over the blocks of the key and joined back on the same partitioning.
  Only keys of more than ``KEY_ROWS`` rows are cut, as counted beforehand: a block
  of a small key holds a row or two, and a summary for each would double the data.
  Where no key is that large, a key is one window, in one shuffle, which windows
  over the same key and order share.

Block ids must not decrease along the order of the key.  A summary holds one row
per non-empty block, so the fold over the blocks of a hot key stays small.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import stage

BLOCK = "_block"
KEY = "_k"
DAY_US = 86_400_000_000
_FIRST = Window.unboundedPreceding
#: Rows of a key that one task may hold; larger keys are cut into blocks.
KEY_ROWS = 250_000


def time_block(block_us: int, ts: str = "ts_us") -> Column:
    return F.floor(F.col(ts) / F.lit(int(block_us))).cast("long")


def _order(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys of more than ``KEY_ROWS`` rows, staged; None where there are none.  The input is counted once."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    most = counts.agg(F.max("_c")).first()[0]
    if most is None or most <= KEY_ROWS:
        return None
    return stage(counts.filter(F.col("_c") > KEY_ROWS).select(*keys), "hot-keys")


def _placed(df: DataFrame, keys: Sequence[str], block: Column, hot: DataFrame) -> DataFrame:
    """Add the block, NULL on keys that aren't hot, and ``_k``, the key and block as one value.

    A struct is never NULL and NULLs inside it are equal, so grouping, windows and
    the join of the carry treat NULL keys and NULL times as values like any other,
    and all of them share one partitioning.
    """
    # one row per KEY_ROWS rows at most
    marks = F.broadcast(hot.select(F.struct(*keys).alias("_hk")))
    df = df.withColumn(KEY, F.struct(*keys)).join(marks, F.col(KEY) == F.col("_hk"), "left")
    return df.withColumn(BLOCK, F.when(F.col("_hk").isNotNull(), block)).drop("_hk").withColumn(KEY, F.struct(*keys, BLOCK))


def _carry(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], over_blocks) -> DataFrame:
    """Summaries per (key, block), then ``over_blocks(before, whole)`` columns."""
    summary = df.groupBy(KEY).agg(*[c.alias(n) for n, c in aggs.items()])
    w = Window.partitionBy(*[f"{KEY}.{k}" for k in keys])
    ordered = w.orderBy(f"{KEY}.{BLOCK}")
    cols = over_blocks(ordered.rowsBetween(_FIRST, -1), w, ordered)
    return summary.select(KEY, *[c.alias(n) for n, c in cols.items()])


def _join_back(df: DataFrame, carry: DataFrame) -> DataFrame:
    return df.join(carry, KEY).drop(KEY)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    number: str = "rn",
    total: str | None = "n",
) -> DataFrame:
    """Dense 1-based row number along ``order`` and the row count of the key."""
    hot = _hot_keys(df, keys)
    if hot is None:
        part = Window.partitionBy(*keys)
        cols = {number: F.row_number().over(part.orderBy(*order)).cast("long")}
        if total:
            cols[total] = F.count(F.lit(1)).over(part)
        return df.withColumns(cols)
    df = _placed(df, keys, block, hot)
    carry = _carry(
        df,
        keys,
        {"_c": F.count(F.lit(1))},
        lambda before, whole, _: {
            "_before": F.coalesce(F.sum("_c").over(before), F.lit(0)),
            "_total": F.sum("_c").over(whole),
        },
    )
    local = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    out = _join_back(df.withColumn("_local", local), carry)
    out = out.withColumn(number, (F.col("_before") + F.col("_local")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop(BLOCK, "_local", "_before", "_total")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    block: Column,
    least: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` and minima of ``least`` along the order of each key."""
    names, low = list(sums), dict(least or {})
    hot = _hot_keys(df, keys)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, 0)
        minima = {n: F.min(c).over(w) for n, c in low.items()}
        return df.withColumns({n: F.coalesce(F.sum(sums[n]).over(w), F.lit(0)) for n in names} | minima)
    df = _placed(df, keys, block, hot)
    w = Window.partitionBy(KEY).orderBy(*order).rowsBetween(_FIRST, 0)
    running = {f"_l_{n}": F.sum(sums[n]) for n in names} | {f"_l_{n}": F.min(c) for n, c in low.items()}
    local = df.select("*", *[c.over(w).alias(n) for n, c in running.items()])
    carry = _carry(
        df,
        keys,
        {f"_s_{n}": F.sum(sums[n]) for n in names} | {f"_s_{n}": F.min(c) for n, c in low.items()},
        lambda before, *_: {f"_b_{n}": F.sum(f"_s_{n}").over(before) for n in names}
        | {f"_b_{n}": F.min(f"_s_{n}").over(before) for n in low},
    )
    out = _join_back(local, carry)
    zero = F.lit(0)
    for n in names:
        out = out.withColumn(n, F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_b_{n}"), zero))
    for n in low:
        out = out.withColumn(n, F.least(f"_l_{n}", f"_b_{n}"))
    return out.drop(BLOCK, *[f"_{x}_{n}" for n in [*names, *low] for x in "lb"])


def running_since_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counters: Mapping[str, tuple[Column, Column]],
    block: Column,
) -> DataFrame:
    """Counters ``{name: (add, reset)}``: sum of ``add`` since the last reset row.

    A reset row starts the new span and its own ``add`` counts.
    """
    names = list(counters)
    hot = _hot_keys(df, keys)
    if hot is not None:
        df = _placed(df, keys, block, hot)
    for n in names:
        add, reset = counters[n]
        df = df.withColumn(f"_a_{n}", F.coalesce(add.cast("long"), F.lit(0))).withColumn(f"_r_{n}", F.coalesce(reset, F.lit(False)))
    # running total less the total before the last reset: every counter shares one sort
    part = Window.partitionBy(*keys) if hot is None else Window.partitionBy(KEY)
    w = part.orderBy(*order).rowsBetween(_FIRST, 0)
    local = df.withColumns({f"_s_{n}": F.sum(f"_a_{n}").over(w) for n in names})
    base = {f"_b_{n}": F.last(F.when(F.col(f"_r_{n}"), F.col(f"_s_{n}") - F.col(f"_a_{n}")), ignorenulls=True).over(w) for n in names}
    local = local.withColumns(base).withColumns({f"_v_{n}": F.col(f"_s_{n}") - F.coalesce(f"_b_{n}", F.lit(0)) for n in names})
    if hot is None:
        return local.withColumnsRenamed({f"_v_{n}": n for n in names}).drop(*[f"_{x}_{n}" for n in names for x in "arsb"])
    last = _order(order)
    aggs = {f"_t_{n}": F.max_by(f"_v_{n}", last) for n in names} | {f"_h_{n}": F.bool_or(f"_r_{n}") for n in names}
    summary = local.groupBy(KEY).agg(*[c.alias(k) for k, c in aggs.items()])
    ordered = Window.partitionBy(*[f"{KEY}.{k}" for k in keys]).orderBy(f"{KEY}.{BLOCK}")
    upto = ordered.rowsBetween(_FIRST, 0)
    summary = summary.withColumns({f"_i_{n}": F.sum(f"_t_{n}").over(upto) for n in names})
    summary = summary.withColumns(
        {f"_j_{n}": F.last(F.when(F.col(f"_h_{n}"), F.col(f"_i_{n}") - F.col(f"_t_{n}")), ignorenulls=True).over(upto) for n in names}
    ).withColumns({f"_o_{n}": F.col(f"_i_{n}") - F.coalesce(f"_j_{n}", F.lit(0)) for n in names})
    carry = summary.select(KEY, *[F.coalesce(F.lag(f"_o_{n}").over(ordered), F.lit(0)).alias(f"_c_{n}") for n in names])
    out = _join_back(local, carry)
    for n in names:
        out = out.withColumn(n, F.col(f"_v_{n}") + F.when(F.col(f"_b_{n}").isNull(), F.col(f"_c_{n}")).otherwise(F.lit(0)))
    return out.drop(BLOCK, *[f"_{x}_{n}" for n in names for x in "arsbvc"])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Mapping[str, str],
    block: Column,
) -> DataFrame:
    """``{new: source}``: value of ``source`` on the previous row of the key."""
    hot = _hot_keys(df, keys)
    if hot is None:
        part = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: F.lag(src).over(part) for new, src in fields.items()})
    df = _placed(df, keys, block, hot)
    row = F.struct(*[F.col(src).alias(new) for new, src in fields.items()])
    carry = _carry(
        df,
        keys,
        {"_last": F.max_by(row, _order(order))},
        lambda _b, _w, ordered: {"_prior": F.lag("_last").over(ordered)},
    )
    local = F.lag(row).over(Window.partitionBy(KEY).orderBy(*order))
    out = _join_back(df.withColumn("_prev", local), carry)
    out = out.withColumn("_prev", F.coalesce("_prev", "_prior"))
    return out.select("*", *[F.col(f"_prev.{n}").alias(n) for n in fields]).drop(BLOCK, "_prev", "_prior")


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Mapping[str, str],
    block: Column,
) -> DataFrame:
    """``{new: source}``: value of ``source`` on the next row of the key."""
    hot = _hot_keys(df, keys)
    if hot is None:
        part = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: F.lead(src).over(part) for new, src in fields.items()})
    df = _placed(df, keys, block, hot)
    row = F.struct(*[F.col(src).alias(new) for new, src in fields.items()])
    carry = _carry(
        df,
        keys,
        {"_head": F.min_by(row, _order(order))},
        lambda _b, _w, ordered: {"_later": F.lead("_head").over(ordered)},
    )
    local = F.lead(row).over(Window.partitionBy(KEY).orderBy(*order))
    out = _join_back(df.withColumn("_next", local), carry)
    out = out.withColumn("_next", F.coalesce("_next", "_later"))
    return out.select("*", *[F.col(f"_next.{n}").alias(n) for n in fields]).drop(BLOCK, "_next", "_later")


def with_recent(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row: Column,
    n: int,
    block: Column | None,
    name: str = "recent",
    number: str | None = None,
    first: Column | None = None,
) -> DataFrame:
    """Array of ``row`` over the last ``n`` rows of the key, current row last.

    ``number`` also adds the 1-based row number along the key, ``first`` the
    value of an expression on the first row of the key (as ``first``).

    Without a ``block`` a key is one window, in one shuffle: only for keys of few rows.
    """
    hot = None if block is None else _hot_keys(df, keys)
    if hot is None:
        part = Window.partitionBy(*keys).orderBy(*order)
        cols = {name: F.collect_list(row).over(part.rowsBetween(-(n - 1), 0))}
        if first is not None:
            cols["first"] = F.first(first).over(part.rowsBetween(_FIRST, 0))
        if number:
            cols[number] = F.row_number().over(part).cast("long")
        return df.withColumns(cols)
    df = _placed(df, keys, block, hot).withColumn("_row", row)
    part = Window.partitionBy(KEY).orderBy(*order)
    local = df.withColumn("_arr", F.collect_list("_row").over(part.rowsBetween(-(n - 1), 0)))
    back = max(n - 1, 1)

    aggs = {"_tail": F.max_by("_arr", _order(order)), "_c": F.count(F.lit(1))}
    if first is not None:
        aggs["_f"] = F.min_by(first, _order(order))

    def over_blocks(before, _whole, ordered):
        cols = {
            "_prior": F.flatten(F.collect_list("_tail").over(ordered.rowsBetween(-back, -1))),
            "_before": F.coalesce(F.sum("_c").over(before), F.lit(0)),
        }
        if first is not None:
            cols["first"] = F.first("_f").over(ordered.rowsBetween(_FIRST, 0))
        return cols

    carry = _carry(local, keys, aggs, over_blocks)
    if number:
        local = local.withColumn("_local", F.row_number().over(part))
    out = _join_back(local, carry)
    both = F.concat(F.col("_prior"), F.col("_arr"))
    take = F.least(F.lit(n), F.size(both))
    out = out.withColumn(name, F.slice(both, F.size(both) - take + 1, take))
    drop = [BLOCK, "_row", "_arr", "_prior", "_before"]
    if number:
        out = out.withColumn(number, (F.col("_before") + F.col("_local")).cast("long"))
        drop.append("_local")
    return out.drop(*drop)


# --- windows of bounded length ----------------------------------------------


def with_halo(df: DataFrame, window_us: int, block_us: int, ts: str = "ts_us") -> DataFrame:
    """Copy rows into the next block while they can still matter there.

    Adds ``_block`` and ``_out`` (false on copies).  ``block_us`` is raised to
    the window length, so a row reaches at most one later block.  Rows without a
    time share a block of their own.
    """
    size = F.lit(max(int(block_us), int(window_us) + 1))
    home = F.floor(F.col(ts) / size).cast("long")
    last = F.floor((F.col(ts) + F.lit(int(window_us))) / size).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn(BLOCK, F.explode_outer(F.sequence(F.col("_home"), last)))
        .withColumn("_out", F.col(BLOCK).eqNullSafe(F.col("_home")))
        .drop("_home")
    )


def sliding_totals(
    df: DataFrame,
    keys: Sequence[str],
    window_us: int,
    totals: Mapping[str, Column],
    block_us: int,
    ts: str = "ts_us",
    row_id: str = "row_id",
    include_current: bool = True,
) -> DataFrame:
    """Exact sums over the rows of the key with ``ts`` in ``[t - w, t]`` seen so far.

    Each row adds its value when it arrives and takes it away one microsecond
    after the window has passed it, so a running sum gives the sliding sum in
    ``n log n`` whatever the number of rows in the window.  Values should be
    integers or decimals: a float sum would not cancel exactly.
    """
    names = list(totals)
    df = df.withColumns({f"_v_{n}": totals[n] for n in names})
    kinds = {n: df.schema[f"_v_{n}"].dataType for n in names}
    base = with_halo(df, window_us, block_us, ts)
    values = lambda sign: [
        (F.col(f"_v_{n}") if sign > 0 else (-F.col(f"_v_{n}")).cast(kinds[n])).alias(n) for n in names
    ]
    events = F.array(
        F.struct(F.col(ts).alias("at"), F.lit(1).alias("kind"), *values(1)),
        F.struct((F.col(ts) + F.lit(int(window_us) + 1)).alias("at"), F.lit(0).alias("kind"), *values(-1)),
    )
    # shuffle single rows; the second event of a row is made behind the exchange
    timed = F.filter(events, lambda x: x["at"].isNotNull() | (x["kind"] == 1))
    base = base.repartition(*keys, BLOCK).withColumn("_e", F.explode(timed))
    w = Window.partitionBy(*keys, BLOCK).orderBy("_e.at", "_e.kind", row_id)
    frame = w.rowsBetween(_FIRST, 0 if include_current else -1)
    out = base.withColumns({n: F.sum(f"_e.{n}").over(frame) for n in names})
    return out.filter("_out AND _e.kind = 1").drop(BLOCK, "_out", "_e", *[f"_v_{n}" for n in names])


def sliding_distinct(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    window_us: int,
    block_us: int,
    name: str,
    when: Column | None = None,
    ts: str = "ts_us",
    row_id: str = "row_id",
) -> DataFrame:
    """Exact distinct count of ``value`` over ``[t - w, t]``, current row included.

    Only rows that satisfy ``when`` are counted.  A value is present from an
    occurrence until ``w`` after it; back-to-back presences are merged, so only
    +1 / -1 edges are summed.  No set is built.
    """
    w_us = F.lit(int(window_us))
    flag = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    base = with_halo(df.withColumn("_on", flag), window_us, block_us, ts).repartition(*keys, BLOCK)
    same = Window.partitionBy(*keys, BLOCK, "_on", value).orderBy(ts, row_id)
    mark = F.struct(F.col(ts).alias("t"))  # not NULL where the time is
    base = base.withColumns({"_p": F.lag(mark).over(same), "_n": F.lead(mark).over(same)})
    far = lambda gap: F.coalesce(gap > w_us, F.lit(False))
    starts = F.col("_on") & (F.col("_p").isNull() | far(F.col(ts) - F.col("_p.t")))
    stops = F.col("_on") & F.col(ts).isNotNull() & (F.col("_n").isNull() | far(F.col("_n.t") - F.col(ts)))
    # a row is itself an event and, at the end of a presence, a second one
    edges = F.array(
        F.struct(F.col(ts).alias("at"), F.lit(1).alias("kind"), starts.cast("int").alias("edge")),
        F.when(stops, F.struct((F.col(ts) + w_us + 1).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("edge"))),
    )
    events = base.withColumn("_e", F.explode(F.filter(edges, lambda x: x.isNotNull())))
    w = Window.partitionBy(*keys, BLOCK).orderBy("_e.at", "_e.kind", row_id).rowsBetween(_FIRST, 0)
    out = events.withColumn(name, F.sum("_e.edge").over(w))
    return out.filter("_out AND _e.kind = 1").drop(BLOCK, "_out", "_on", "_e", "_p", "_n")


def sliding_max(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    window_us: int,
    ts: str = "ts_us",
    row_id: str = "row_id",
) -> DataFrame:
    """Exact maxima over ``[t - w, t]`` (rows seen so far); ``row_id`` must be unique.

    The line is cut into cells as long as the window.  A window is the tail of
    the previous cell plus the head of its own: the head is a running maximum,
    the tail a running maximum taken backwards and read at ``t - w``.  Every row
    goes to its own cell and, as a question, to the one before; only the key, the
    time, the id and the values travel, and the two answers join the row on its id.
    Rows without a time see the rows without a time up to their own.
    """
    w_us = F.lit(int(window_us))
    names = list(values)
    rows = df.withColumns({f"_v_{n}": values[n] for n in names})
    kinds = {n: rows.schema[f"_v_{n}"].dataType for n in names}
    cell = lambda t: F.floor(t / w_us).cast("long")

    def event(at: Column, kind: int, vals: list[Column]) -> Column:
        return F.struct(cell(at).alias(BLOCK), at.alias("_at"), F.lit(kind).alias("_kind"), F.col(row_id).alias("_rid"), *vals)

    events = F.array(
        event(F.col(ts), 0, [F.col(f"_v_{n}").alias(f"_v_{n}") for n in names]),
        event(F.col(ts) - w_us, 1, [F.lit(None).cast(kinds[n]).alias(f"_v_{n}") for n in names]),
    )
    timed = F.filter(events, lambda x: x["_at"].isNotNull() | (x["_kind"] == 0))
    placed = rows.select(*keys, F.explode(timed).alias("_e")).select(*keys, "_e.*")
    part = Window.partitionBy(*keys, BLOCK)
    head = part.orderBy("_at", "_kind", "_rid").rowsBetween(_FIRST, 0)
    tail = part.orderBy(F.desc("_at"), F.asc("_kind")).rowsBetween(_FIRST, 0)
    own = F.col("_kind") == 0
    placed = placed.withColumns({f"_h_{n}": F.when(own, F.max(f"_v_{n}").over(head)) for n in names})
    placed = placed.withColumns({f"_t_{n}": F.when(~own, F.max(f"_v_{n}").over(tail)) for n in names})
    best = lambda n: F.greatest(F.max(f"_h_{n}"), F.max(f"_t_{n}")).alias(f"_m_{n}")
    met = placed.groupBy("_rid").agg(*[best(n) for n in names])
    out = df.join(met, F.col(row_id) == F.col("_rid"))
    return out.select(*df.columns, *[F.col(f"_m_{n}").alias(n) for n in names])
