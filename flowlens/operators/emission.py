"""Keep-if-changed and cool-down folds, exact and without a task per key.

Whether a row is kept depends on the last *kept* row of its key: it is kept when a counter
went back or grew by a minimum, when ``force_us`` have passed, or when the state was dropped.
That is sequential, but mostly only in short stretches:

1. Some rows are kept whatever came before them: the first of a key, those after a dropped
   state, after a silence of ``force_us``, or whose counters changed against the row before
   (with integral counters any change is enough; else a jump by the minimum). They cut a key
   into segments, each of which begins with a kept row.
2. A segment shorter than ``force_us`` whose counters stand still keeps nothing else, however
   many rows it has.
3. Other segments of at most ``LIMIT`` rows are folded as one sorted array.
4. Longer ones are ranked as a list. Where only the time matters, every row's successor, the
   row that would be kept after it, lies one or two cells of ``force_us`` further, and is found
   inside the cell. Successors of successors are joined until they span the segment (pointer
   doubling), and the rows that the segment's first one reaches are kept: ``log n`` joins.
   Where counters grow by less than a minimum, arrays of ``LIMIT`` rows are folded one after
   the other, all segments at once.

All of it is DataFrame work in the JVM; no array exceeds ``LIMIT`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import blocked
from flowlens.session import stage

LIMIT = 1024
_SEGMENT = ["_key", "_seg"]
_ORDER = ["_ts", "_rid"]


def _fires(p: Column, b: Column, p0: Column, b0: Column, min_p: float, min_b: float) -> Column:
    """Whether counters went back or grew by a minimum."""
    return (p < p0) | (b < b0) | (p - p0 >= min_p) | (b - b0 >= min_b)


def _segments(small: DataFrame, force_us: int, limits: tuple[float, float] | None, block_us: int) -> DataFrame:
    """Rows with ``_seg``, the number of their segment in the key, and whether they begin it.

    ``limits``: minimum growths, or None where any change is enough.
    """
    block = blocked.time_block(block_us, "_ts")
    df = blocked.with_previous(small, ["_key"], _ORDER, {"_pts": "_ts", "_pp": "_p", "_pb": "_b"}, block)
    p, b, pp, pb = (F.col(c) for c in ("_p", "_b", "_pp", "_pb"))
    if limits is None:
        jump = (p != pp) | (b != pb)
    else:  # the row before is no less than the last kept one
        jump = (p - pp >= limits[0]) | (b - pb >= limits[1])
    begins = F.col("_pts").isNull() | F.col("_fresh") | (F.col("_ts") - F.col("_pts") >= force_us) | jump
    df = df.withColumn("_begins", F.coalesce(begins, F.lit(True))).select("_key", "_ts", "_rid", "_p", "_b", "_begins")
    return blocked.running_sums(df, ["_key"], _ORDER, {"_seg": F.col("_begins").cast("long")}, block)


def _folded(rows: Column, first: Column, force_us: int, limits: tuple[float, float] | None) -> Column:
    """State (ts, p, b, kept row ids) after a sorted array of rows, from the state ``first``."""

    def step(acc: Column, x: Column) -> Column:
        hit = x["ts"] - acc["ts"] >= force_us
        if limits is not None:
            hit = hit | _fires(x["p"], x["b"], acc["p"], acc["b"], *limits)
        kept = F.struct(x["ts"].alias("ts"), x["p"].alias("p"), x["b"].alias("b"), F.concat(acc["kept"], F.array(x["rid"])).alias("kept"))
        return F.when(hit, kept).otherwise(acc)

    return F.aggregate(rows, first, step)


_ROW = "struct<ts:bigint,rid:bigint,p:double,b:double>"
_STATE = "struct<ts:bigint,p:double,b:double,kept:array<bigint>>"


def _row() -> Column:
    return F.struct(F.col("_ts").alias("ts"), F.col("_rid").alias("rid"), F.col("_p").alias("p"), F.col("_b").alias("b")).cast(_ROW)


def _short(rows: DataFrame, force_us: int, limits: tuple[float, float] | None) -> DataFrame:
    """Kept ``_rid`` of segments that fit an array."""
    arrays = rows.groupBy(*_SEGMENT).agg(F.array_sort(F.collect_list(_row())).alias("rows"))
    head = F.get("rows", F.lit(0))
    first = F.struct(head["ts"].alias("ts"), head["p"].alias("p"), head["b"].alias("b"), F.array(head["rid"]).alias("kept")).cast(_STATE)
    return arrays.select(F.explode(_folded(F.col("rows"), first, force_us, limits)["kept"]).alias("_rid"))


def _ranked(rows: DataFrame, force_us: int) -> DataFrame:
    """Kept ``_rid`` of long segments without counters, by pointer doubling.

    Rows of a segment are less than ``force_us`` apart, so no cell inside it is empty and the
    successor of a row lies in the next cell, at or after the row's own place, or leads the
    one after.
    """
    cell = F.floor((F.col("_ts") - F.col("_from")) / force_us).cast("long")
    rows = stage(rows.select(*_SEGMENT, "_ts", "_rid", cell.alias("_cell")), "fold-cells")
    places = F.array(
        F.struct(F.col("_cell").alias("c"), F.col("_ts").alias("at"), F.lit(1).alias("kind")),
        F.struct((F.col("_cell") + 1).alias("c"), (F.col("_ts") + F.lit(force_us)).alias("at"), F.lit(0).alias("kind")),
    )
    events = rows.select(*_SEGMENT, "_rid", F.explode(places).alias("e")).select(*_SEGMENT, "_rid", "e.*")
    backwards = Window.partitionBy(*_SEGMENT, "c").orderBy(F.desc("at"), F.desc("kind"), F.desc("_rid")).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_here", F.last(F.when(F.col("kind") == 1, F.col("_rid")), ignorenulls=True).over(backwards))
    heads = rows.groupBy(*_SEGMENT, (F.col("_cell") - 1).alias("c")).agg(F.min_by("_rid", F.struct("_ts", "_rid")).alias("_ahead"))
    asked = events.filter("kind = 0").join(heads, [*_SEGMENT, "c"], "left")
    jump = stage(asked.select("_rid", F.coalesce("_here", "_ahead").alias("_to")).filter("_to IS NOT NULL"), "fold-jumps")
    span = rows.agg(F.max("_cell")).first()[0]
    jumps = [jump]
    while 1 << len(jumps) <= span + 1:
        far = jumps[-1].select(F.col("_rid").alias("_to"), F.col("_to").alias("_far"))
        jumps.append(stage(jumps[-1].join(far, "_to").select("_rid", F.col("_far").alias("_to")), "fold-jumps"))
    kept = rows.groupBy(*_SEGMENT).agg(F.min_by("_rid", F.struct("_ts", "_rid")).alias("_rid")).select("_rid")
    for jump in reversed(jumps):
        kept = stage(kept, "fold-kept")
        kept = kept.unionByName(kept.join(jump, "_rid").select(F.col("_to").alias("_rid")))
    return kept


def _in_turn(rows: DataFrame, force_us: int, limits: tuple[float, float], block_us: int) -> DataFrame:
    """Kept ``_rid`` of long segments with counters: arrays of ``LIMIT`` rows, one of each segment per round."""
    numbered = blocked.ranked(rows, _SEGMENT, _ORDER, blocked.time_block(block_us, "_ts"), "_rn", None)
    numbered = stage(numbered.withColumn("_part", F.floor((F.col("_rn") - 1) / LIMIT).cast("long")), "fold-parts", ["_part"])
    last = numbered.agg(F.max("_part")).first()[0]
    state: DataFrame | None = None
    kept = []
    for n in range(last + 1):
        part = numbered.filter(F.col("_part") == n).groupBy(*_SEGMENT).agg(F.array_sort(F.collect_list(_row())).alias("rows"))
        if state is None:
            head = F.get("rows", F.lit(0))
            first = F.struct(head["ts"].alias("ts"), head["p"].alias("p"), head["b"].alias("b"), F.array(head["rid"]).alias("kept")).cast(_STATE)
        else:
            part = part.join(state.withColumnRenamed("state", "before"), _SEGMENT)
            old = F.col("before")
            first = F.struct(old["ts"].alias("ts"), old["p"].alias("p"), old["b"].alias("b"), F.array().cast("array<bigint>").alias("kept")).cast(_STATE)
        state = stage(part.select(*_SEGMENT, _folded(F.col("rows"), first, force_us, limits).alias("state")), "fold-state")
        kept.append(state.select(F.explode("state.kept").alias("_rid")))
    return reduce(DataFrame.unionByName, kept)


def keep_changed(
    df: DataFrame,
    keys: Sequence[str],
    force_us: int,
    packets: Column | None = None,
    octets: Column | None = None,
    fresh: Column | None = None,
    min_packet_delta: float = 1.0,
    min_byte_delta: float = 1.0,
    block_us: int = 3_600_000_000,
    ts: str = "ts_us",
    row_id: str = "row_id",
) -> DataFrame:
    """Rows of ``df`` kept by the fold; ``row_id`` must be unique.

    ``df`` is read twice, so it is staged once first.

    Without counters this is a plain cool-down of ``force_us``.  ``fresh`` marks
    rows before which the state of the key was dropped.  NULL keys are keys; a row
    without a time can't be placed, so it is kept and touches no state.
    """
    force_us = int(force_us)
    given = df.columns
    counters = [F.lit(1) if packets is None else packets, F.lit(0) if octets is None else octets]
    whole = all(isinstance(f.dataType, T.IntegralType) for f in df.select(*counters).schema.fields)
    tiny = max(min_packet_delta, min_byte_delta) <= 1e-6
    limits = None if tiny or (whole and max(min_packet_delta, min_byte_delta) <= 1) else (float(min_packet_delta), float(min_byte_delta))
    df = df.withColumns(
        {
            "_p": counters[0].cast("double"),
            "_b": counters[1].cast("double"),
            "_fresh": F.lit(False) if fresh is None else F.coalesce(fresh, F.lit(False)),
        }
    )
    df = stage(df, "fold-input")
    small = df.filter(F.col(ts).isNotNull()).select(
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"),
        F.col(ts).cast("long").alias("_ts"),
        F.col(row_id).cast("long").alias("_rid"),
        "_p",
        "_b",
        "_fresh",
    )
    rows = stage(_segments(small, force_us, limits, int(block_us)), "fold-segments")
    kinds = rows.groupBy(*_SEGMENT).agg(
        F.min("_ts").alias("_from"), (F.max("_ts") - F.min("_ts")).alias("_span"), F.count(F.lit(1)).alias("_n"),
        *([] if limits is None else [((F.max("_p") > F.min("_p")) | (F.max("_b") > F.min("_b"))).alias("_moves")]),
    )
    more = F.col("_span") >= force_us
    open_ = stage(kinds.filter(more if limits is None else more | F.col("_moves")).select(*_SEGMENT, "_from", "_n"), "fold-open")
    kept = rows.filter("_begins").select("_rid")
    inside = rows.join(open_, _SEGMENT)
    kept = kept.unionByName(_short(inside.filter(F.col("_n") <= LIMIT), force_us, limits))
    if not open_.filter(F.col("_n") > LIMIT).isEmpty():
        long = inside.filter(F.col("_n") > LIMIT)
        kept = kept.unionByName(_ranked(long, force_us) if limits is None else _in_turn(long, force_us, limits, int(block_us)))
    kept = kept.select(F.col("_rid").alias(row_id)).unionByName(df.filter(F.col(ts).isNull()).select(F.col(row_id).cast("long").alias(row_id)))
    return df.join(kept, row_id, "left_semi").select(*given)
