"""Exact quantiles and cumulative curves without gathering the values.

Values are first counted per distinct value (combined before the shuffle).  The
distinct values are then cut into ranges at sketch quantiles; a table with one
row per range gives the running totals at the range borders, and only inside a
range is anything sorted.  The sketch only balances the ranges: results are
exact for any borders.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIRST = Window.unboundedPreceding
_G, _V, _R = "_group", "_value", "_range"


def _count_leading(df: DataFrame, name: str, items: Column, size: int, test) -> DataFrame:
    """Column ``name``: how many leading ``items`` pass a monotone ``test`` (binary search).

    One projection per halving, so that every step is generated code.
    """
    df = df.withColumn(name, F.lit(0))
    step = 1 << max(size.bit_length() - 1, 0)
    while step:
        here = F.get(items, F.col(name) + F.lit(step - 1))
        df = df.withColumn(name, F.col(name) + F.when(test(here), step).otherwise(0))
        step >>= 1
    return df


def default_ranges(spark: SparkSession) -> int:
    """As many ranges as the session has shuffle partitions, so that a range fits a task."""
    return min(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), 20_000)


def cumulative(
    df: DataFrame,
    value: Column,
    sums: Mapping[str, Column],
    group: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Per distinct value: sums and sums over all smaller values (``before_*``).

    ``group`` must take few values (features, classes); the borders table has
    one row per group.  Columns: ``_group, _value, <sums>, before_<sums>,
    total_<sums>``.
    """
    n = max(4, int(ranges or default_ranges(df.sparkSession)))
    names = list(sums)
    base = df.select(
        (F.lit(0) if group is None else group).alias(_G),
        value.cast("double").alias(_V),
        *[sums[s].alias(s) for s in names],
    ).filter(F.col(_V).isNotNull())
    distinct = base.groupBy(_G, _V).agg(*[F.sum(s).alias(s) for s in names])
    cuts = F.lit([i / n for i in range(1, n)])
    borders = base.groupBy(_G).agg(F.percentile_approx(_V, cuts, F.lit(max(1000, 4 * n))).alias("_borders"))
    if group is None:
        placed = distinct.withColumn("_borders", borders.select("_borders").scalar())
    else:
        # one row per group: fixed small size
        placed = distinct.join(F.broadcast(borders), _G)
    placed = _count_leading(placed, _R, F.col("_borders"), n - 1, lambda x: x < F.col(_V)).drop("_borders")
    per = placed.groupBy(_G, _R).agg(*[F.sum(s).alias(f"_s_{s}") for s in names])
    w = Window.partitionBy(_G)
    before = w.orderBy(_R).rowsBetween(_FIRST, -1)
    per = per.select(
        _G,
        _R,
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in names],
        *[F.sum(f"_s_{s}").over(w).alias(f"total_{s}") for s in names],
    )
    # at most groups x ranges rows
    placed = placed.join(F.broadcast(per), [_G, _R])
    inside = Window.partitionBy(_G, _R).orderBy(_V).rowsBetween(_FIRST, -1)
    out = placed.select(
        "*",
        *[(F.col(f"_b_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in names],
    )
    return out.drop(_R, *[f"_b_{s}" for s in names])


def exact_quantiles(
    df: DataFrame,
    value: Column,
    at: Sequence[float],
    group: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: rows ``(_group, q_index, q, value)``."""
    cum = cumulative(df, value, {"n": F.lit(1).cast("long")}, group, ranges)
    return quantiles_from(cum, at)


def quantiles_from(cum: DataFrame, at: Sequence[float]) -> DataFrame:
    """Quantiles of a ``cumulative`` table whose counter is ``n``, for a short list."""
    asks = F.array(*[F.struct(F.lit(i).alias("q_index"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)])
    return _pick(cum.withColumn("_a", F.explode(F.filter(asks, lambda a: _answers(a["q"])))))


def quantile_grid(cum: DataFrame, points: int) -> DataFrame:
    """Quantiles at ``points`` evenly spaced references from 0 to 1.

    The references that fall on a value follow from its ranks, whatever their number.
    """
    m = max(int(points) - 1, 1)
    last = F.greatest(F.col("total_n") - 1, F.lit(1))
    # one reference of slack on both sides, settled by the exact test
    lo = F.greatest(F.floor((F.col("before_n") - 1) * m / last) - 1, F.lit(0))
    hi = F.least(F.ceil((F.col("before_n") + F.col("n")) * m / last) + 1, F.lit(int(points) - 1))
    index = F.filter(F.sequence(lo.cast("int"), hi.cast("int")), lambda i: _answers(i / F.lit(float(m))))
    df = cum.withColumn("_i", F.explode(index))
    return _pick(df.withColumn("_a", F.struct(F.col("_i").alias("q_index"), (F.col("_i") / F.lit(float(m))).alias("q"))))


def _lower(q: Column) -> Column:
    return F.floor(q * (F.col("total_n") - 1))


def _upper(q: Column) -> Column:
    return F.least(_lower(q) + 1, F.col("total_n") - 1)


def _on(rank: Column) -> Column:
    return (rank >= F.col("before_n")) & (rank < F.col("before_n") + F.col("n"))


def _answers(q: Column) -> Column:
    return _on(_lower(q)) | _on(_upper(q))


def _pick(hits: DataFrame) -> DataFrame:
    hits = hits.select(_G, "_a.q_index", "_a.q", "total_n", "before_n", "n", _V)
    q = F.col("q")
    picked = hits.groupBy(_G, "q_index", "q", "total_n").agg(
        F.max(F.when(_on(_lower(q)), F.col(_V))).alias("_lo"), F.max(F.when(_on(_upper(q)), F.col(_V))).alias("_hi")
    )
    frac = q * (F.col("total_n") - 1) - _lower(q)
    return picked.select(
        _G, "q_index", "q", F.col("total_n").alias("n"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("value"),
    )


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Feature columns as (name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(F.explode(pairs).alias("_x")).select("_x.*")
