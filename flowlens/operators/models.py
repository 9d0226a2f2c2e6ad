"""Window scoring with Spark ML: a classifier and a reconstruction detector."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators import metrics
from flowlens.operators.scaling import RobustStats, robust_window
from flowlens.policy import feature_weights


def _vector(df: DataFrame, window: str, stats: RobustStats | None) -> DataFrame:
    w: Column = F.col(window) if stats is None else robust_window(window, stats)
    return df.withColumn("_flat", F.flatten(w)).withColumn("features", array_to_vector("_flat"))


def fit_classifier(
    train: DataFrame, window: str = "window", stats: RobustStats | None = None, kind: str = "logistic", **params
) -> PipelineModel:
    """Attack classifier on flattened windows, weighted by class size."""
    df = metrics.with_class_weights(_vector(train, window, stats))
    df = df.select("features", F.col("is_attack").cast("double").alias("y"), (F.col("sample_weight") * 1000).alias("w"))
    cls = {"logistic": LogisticRegression, "gbt": GBTClassifier}[kind]
    defaults = {"logistic": {"maxIter": 50, "regParam": 1e-3}, "gbt": {"maxIter": 20, "maxDepth": 5}}[kind]
    model = cls(featuresCol="features", labelCol="y", weightCol="w", **{**defaults, **params}).fit(df)
    return PipelineModel([model])


def score_classifier(
    df: DataFrame, model: PipelineModel, window: str = "window", stats: RobustStats | None = None
) -> DataFrame:
    """``score``: probability of an attack."""
    out = model.transform(_vector(df, window, stats))
    score = vector_to_array("probability")[1]
    return out.withColumn("score", score).drop("features", "_flat", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class LinearModel:
    """Coefficients over a flattened, scaled window, as a bundle stores them."""

    coefficients: tuple[float, ...]
    intercept: float

    @staticmethod
    def of(model: PipelineModel) -> LinearModel:
        """The coefficients of a fitted logistic classifier."""
        last = model.stages[-1]
        return LinearModel(tuple(float(c) for c in last.coefficients), float(last.intercept))


def score_linear(df: DataFrame, model: LinearModel, window: str = "window", stats: RobustStats | None = None) -> DataFrame:
    """``score``: logistic probability of an attack by given coefficients, as plain expressions."""
    w: Column = F.col(window) if stats is None else robust_window(window, stats)
    terms = F.zip_with(F.flatten(w), F.lit(np.asarray(model.coefficients)), lambda x, c: x * c)
    return df.withColumn("score", 1.0 / (1.0 + F.exp(-F.aggregate(terms, F.lit(float(model.intercept)), lambda a, x: a + x))))


class Reconstructor:
    """Mean and principal components of normal windows (a few small arrays)."""

    def __init__(self, mean: Sequence[float], components: np.ndarray, weights: Sequence[float] | None):
        self.mean = np.asarray(mean)
        self.components = np.asarray(components)
        self.weights = None if weights is None else np.asarray(weights)

    def scorer(self):
        mean, comp, weights = self.mean, self.components, self.weights

        @F.pandas_udf("double")
        def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                if not len(s):
                    yield pd.Series([], dtype="float64")
                    continue
                x = np.stack(s.to_numpy()) - mean
                sq = (x - (x @ comp) @ comp.T) ** 2
                if weights is not None:
                    sq = sq * weights
                yield pd.Series(sq.mean(axis=1))

        return error


def fit_reconstructor(
    train: DataFrame,
    window: str = "window",
    stats: RobustStats | None = None,
    k: int = 8,
    names: Sequence[str] | None = None,
) -> Reconstructor:
    """Principal components of the centred normal windows.

    ``names`` turns on feature weights; fit and scoring then share one score.
    """
    df = _vector(train.filter(F.col("is_attack") == 0), window, stats).select("features", "_flat")
    size = df.select(F.size("_flat").alias("n")).first()["n"]
    mean_row = df.select(*[F.avg(F.get("_flat", F.lit(i))).alias(f"m{i}") for i in range(size)]).first()
    model: PCAModel = PCA(k=min(k, size), inputCol="features", outputCol="pc").fit(df.select("features"))
    weights = None
    if names is not None:
        one = feature_weights(list(names))
        weights = one * (size // len(one))
    return Reconstructor([mean_row[f"m{i}"] for i in range(size)], model.pc.toArray(), weights)


def score_reconstruction(
    df: DataFrame, model: Reconstructor, window: str = "window", stats: RobustStats | None = None
) -> DataFrame:
    """``score``: mean squared reconstruction error per window (higher is attack)."""
    fn = model.scorer()
    return _vector(df, window, stats).withColumn("score", fn("_flat")).drop("features", "_flat")


def calibrate_replay(windows: DataFrame, score, fpr: float = 0.01) -> DataFrame:
    """Threshold and quality from labelled replay windows.

    ``score`` adds a ``score`` column to the windows.  One row.
    """
    scored = score(windows)
    threshold = metrics.threshold_at_fpr(scored, fpr)
    summary = metrics.score_summary(scored, threshold.scalar())
    return summary.withColumn("recommended_threshold", threshold.scalar())
