"""Thresholds and summaries from stored, mergeable score sketches.

A run writes one KLL sketch per day; thresholds over any set of runs and days come from
merging what is stored, without reading a score again. Sketches merge in any order and
in parts, so a hot run is combined before the shuffle like any sum.

A quantile read from a sketch of parameter ``k`` has a rank within ``rank_error(k)`` of the
asked one (in parts of all rows, with 99 % confidence), whatever the merges; up to ``k``
rows per sketch nothing is dropped and it is exact up to interpolation.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.metrics import HIGHER, LOWER, _normal, _usable
from flowlens.operators.scaling import STORED_FPRS

K = 2048


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch; the fit that its authors publish for one-sided queries."""
    return 2.446 / k**0.9433


def score_sketches(df: DataFrame, keys: Sequence[str] = ("run_id", "day"), score: str = "score", k: int = K) -> DataFrame:
    """One row per key: ``sketch``, ``n``, and the sums that give mean and deviation.

    ``day`` is the day of ``ts_us`` unless the rows have it. Null and NaN scores don't count.
    """
    if "day" in keys and "day" not in df.columns:
        df = df.withColumn("day", F.to_date(F.timestamp_micros("ts_us")))
    s = F.col(score).cast("double")
    return _usable(df, score).groupBy(*keys).agg(
        F.kll_sketch_agg_double(s, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.sum(s).alias("total"), F.sum(s * s).alias("squares")
    )


def normal_sketches(df: DataFrame, keys: Sequence[str] = ("run_id", "day"), score: str = "score", label: str = "label", k: int = K) -> DataFrame:
    """Sketches of the scores that a calibration treats as benign."""
    return score_sketches(df.filter(_normal(label)), keys, score, k)


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches brought together by fewer keys; without keys into one row (null without rows)."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")
    )


def _quantile(q: float | Column) -> Column:
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", q if isinstance(q, Column) else F.lit(float(q))))


def threshold_from_sketches(sketches: DataFrame, fpr: float = 0.01, direction: str = HIGHER, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """Per key ``threshold`` (the 1 - fpr quantile, mirrored when lower is attack), ``n`` and ``rank_error``."""
    q = min(max(1.0 - float(fpr), 0.0), 1.0)
    q = 1.0 - q if direction == LOWER else q
    return merged(sketches, keys).select(*keys, _quantile(q).alias("threshold"), "n", F.lit(rank_error(k)).alias("rank_error"))


def summary_from_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key rows, mean, p95 and p99 (the clean-subset summary)."""
    return merged(sketches, keys).select(*keys, "n", (F.col("total") / F.col("n")).alias("score_mean"), _quantile(0.95).alias("score_p95"), _quantile(0.99).alias("score_p99"))


def normalizer_from_sketches(sketches: DataFrame, keys: Sequence[str] = (), points: int = 200) -> DataFrame:
    """Per key mean, deviation, stored percentiles and CDF, as ``fit_score_normalizer`` has them."""
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))) + 1e-9
    grid = [i / (points - 1) for i in range(points)]
    return merged(sketches, keys).select(
        *keys, "n", mean.alias("normal_mean"), std.alias("normal_std"),
        F.array(*[_quantile(1.0 - f) for f in STORED_FPRS]).alias("percentiles"), F.array(*[_quantile(q) for q in grid]).alias("cdf_scores"),
    )
