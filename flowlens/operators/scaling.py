"""Fit and apply feature scalers and score normalisers.

Fits return small tables (features x statistics); ``*_stats`` brings one to the
driver, and transforms use it as literals or as a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators.quantiles import cumulative, exact_quantiles, quantile_grid, quantiles_from, unpivot
from flowlens.policy import feature_weights

TINY = 1e-12


# --- robust ------------------------------------------------------------------------


def fit_robust(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median and inter-quartile range (0 becomes 1) of the signed logs."""
    long = unpivot(df.select(*[S.signed_log1p(S.finite_or(c)).alias(c) for c in cols]), cols)
    q = exact_quantiles(long, F.col("value"), [0.25, 0.5, 0.75], F.col("feature"))
    at = lambda i: F.max(F.when(F.col("q_index") == i, F.col("value")))
    out = q.groupBy(F.col("_group").alias("feature")).agg(at(1).alias("center"), (at(2) - at(0)).alias("scale"))
    return out.withColumn("scale", F.when(F.abs("scale") < TINY, 1.0).otherwise(F.col("scale")))


@dataclass(frozen=True)
class RobustStats:
    names: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]


def robust_stats(df: DataFrame, cols: Sequence[str]) -> RobustStats:
    """Collect a robust fit: two numbers per feature."""
    rows = {r["feature"]: r for r in fit_robust(df, cols).collect()}
    return RobustStats(
        tuple(cols), tuple(rows[c]["center"] for c in cols), tuple(rows[c]["scale"] for c in cols)
    )


def apply_robust(df: DataFrame, stats: RobustStats) -> DataFrame:
    """Scale feature columns in place."""
    return df.withColumns(
        {
            n: (S.signed_log1p(S.finite_or(n)) - F.lit(c)) / F.lit(s)
            for n, c, s in zip(stats.names, stats.center, stats.scale)
        }
    )


def robust_window(window: Column | str, stats: RobustStats) -> Column:
    """Scale an array of feature vectors."""
    center, scale = F.array(*map(F.lit, stats.center)), F.array(*map(F.lit, stats.scale))
    return F.transform(
        S.col_of(window),
        lambda v: F.transform(v, lambda x, i: (S.signed_log1p(S.finite_or(x)) - F.get(center, i)) / F.get(scale, i)),
    )


# --- quantile then standard ---------------------------------------------------------


@dataclass(frozen=True)
class QuantileStats:
    names: tuple[str, ...]
    references: tuple[float, ...]
    quantiles: tuple[tuple[float, ...], ...]  # per feature
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def fit_quantiles(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000) -> DataFrame:
    """Per feature the values at evenly spaced references: (feature, q_index, q, value)."""
    long = unpivot(df.select(*[S.finite_or(c).alias(c) for c in cols]), cols)
    cum = cumulative(long, F.col("value"), {"n": F.lit(1).cast("long")}, F.col("feature"))
    return quantile_grid(cum, n_quantiles).select(F.col("_group").alias("feature"), "q_index", "q", "value")


def fit_quantile(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000) -> QuantileStats:
    """Fit both steps; at most ``n_quantiles`` numbers per feature reach the driver."""
    n = max(1, min(int(n_quantiles), df.count()))
    table: dict[str, list[float]] = {c: [0.0] * n for c in cols}
    for r in fit_quantiles(df, cols, n).collect():
        table[r["feature"]][r["q_index"]] = r["value"]
    refs = tuple(float(x) for x in np.linspace(0.0, 1.0, n))
    raw = QuantileStats(tuple(cols), refs, tuple(tuple(table[c]) for c in cols), (0.0,) * len(cols), (1.0,) * len(cols))
    moments = apply_quantile(df, raw).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    scale = [moments[f"s_{c}"] for c in cols]
    return QuantileStats(
        raw.names, refs, raw.quantiles,
        tuple(moments[f"m_{c}"] for c in cols),
        tuple(1.0 if abs(s) < TINY else s for s in scale),
    )


def apply_quantile(df: DataFrame, stats: QuantileStats) -> DataFrame:
    """Piecewise linear to [0, 1] (0 below, 1 above the fit), then standardised.

    The place of a value among the quantiles is found by halving, all features in one
    projection per step, so the work is generated code.
    """
    n, at = len(stats.references), range(len(stats.names))
    refs = F.lit(np.asarray(stats.references, float))
    table = [F.lit(np.asarray(q, float)) for q in stats.quantiles]
    x, k = (lambda i: F.col(f"_x_{i}")), (lambda i: F.col(f"_k_{i}"))
    out = df.withColumns({f"_x_{i}": S.finite_or(c) for i, c in enumerate(stats.names)} | {f"_k_{i}": F.lit(0) for i in at})
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        out = out.withColumns({f"_k_{i}": k(i) + F.when(F.get(table[i], k(i) + F.lit(step - 1)) <= x(i), step).otherwise(0) for i in at})
        step >>= 1

    def unit(i: int) -> Column:
        low, high = F.get(table[i], k(i) - 1), F.get(table[i], k(i))
        r_low, r_high = F.get(refs, k(i) - 1), F.get(refs, k(i))
        inside = (r_high - r_low) / (high - low) * (x(i) - low) + r_low
        return F.when(k(i) == 0, 0.0).when(x(i) > F.lit(stats.quantiles[i][-1]), 1.0).when(k(i) == n, F.lit(stats.references[-1])).otherwise(inside)

    scaled = {c: (unit(i) - F.lit(stats.mean[i])) / F.lit(stats.scale[i]) for i, c in enumerate(stats.names)}
    return out.withColumns(scaled).drop(*[f"_{v}_{i}" for i in at for v in "xk"])


# --- scores --------------------------------------------------------------------------

# False-positive rates with a stored percentile.
STORED_FPRS = [0.01, 0.02, 0.05, 0.10, 0.15, 0.20]


def fit_score_normalizer(df: DataFrame, score: str = "score", points: int = 200) -> DataFrame:
    """Mean, deviation, stored percentiles and CDF of the normal scores.

    One row: ``normal_mean, normal_std, percentiles`` (array in the order of
    ``STORED_FPRS``) and ``cdf_scores`` over ``points`` even percentiles (all
    scores when there are fewer).
    """
    normal = df.filter((F.col("label") == "Normal") & F.col(score).isNotNull())
    moments = normal.agg(
        F.avg(score).alias("normal_mean"), (F.stddev_pop(score) + 1e-9).alias("normal_std")
    )
    cum = cumulative(normal, F.col(score), {"n": F.lit(1).cast("long")})

    def listed(q: DataFrame) -> Column:
        # a short list, ordered by position
        rows = F.array_sort(F.collect_list(F.struct("q_index", "value")))
        return q.agg(F.transform(rows, lambda x: x["value"]).alias("v")).scalar()

    return moments.withColumns(
        {
            "percentiles": listed(quantiles_from(cum, [1.0 - f for f in STORED_FPRS])),
            "cdf_scores": listed(quantile_grid(cum, points)),
        }
    )


def normalize_scores(df: DataFrame, fit: DataFrame, score: str = "score") -> DataFrame:
    """z-scores against the fitted normal distribution (one-row scalar)."""
    s = fit.select(F.struct("normal_mean", "normal_std")).scalar()
    return df.withColumn("z_score", (F.col(score) - s["normal_mean"]) / s["normal_std"])


def threshold_from_cdf(fit: DataFrame, fpr: float) -> DataFrame:
    """Threshold at an FPR: a stored percentile, else interpolated on the CDF."""
    if fpr in STORED_FPRS:
        return fit.select(F.get("percentiles", F.lit(STORED_FPRS.index(fpr))).alias("threshold"))
    pos = min(max(1.0 - float(fpr), 0.0), 1.0) * (F.size("cdf_scores") - 1)
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, F.size("cdf_scores") - 1)
    a, b = F.get("cdf_scores", lo), F.get("cdf_scores", hi)
    return fit.select((a + (b - a) * (pos - lo)).alias("threshold"))


def weighted_error(x: Column | str, y: Column | str, names: Sequence[str] | None = None) -> Column:
    """Mean squared difference of two vectors, weighted per feature (weights of mean 1).

    Vectors longer than the feature list are flattened windows.
    """
    a, b = S.col_of(x), S.col_of(y)
    sq = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    if names is not None:
        w = F.array(*[F.lit(float(v)) for v in feature_weights(list(names))])
        sq = F.transform(sq, lambda v, i: v * F.get(w, F.pmod(i, F.lit(len(names)))))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
