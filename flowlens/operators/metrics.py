"""Thresholds and detection quality over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators.quantiles import cumulative, exact_quantiles

HIGHER = "higher_is_attack"
LOWER = "lower_is_attack"


def _normal(label: str) -> Column:
    """Labels a calibration treats as benign."""
    return F.coalesce(S.fold_text(label).isin("normal", "benign", "background"), F.lit(False))


def _usable(df: DataFrame, score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score))


def threshold_at_fpr(
    df: DataFrame,
    fpr: float = 0.01,
    direction: str = HIGHER,
    train: DataFrame | None = None,
    score: str = "score",
    label: str = "label",
    exact: bool = True,
) -> DataFrame:
    """One row ``threshold``: the (1 - fpr) quantile of the normal scores.

    Without normal rows the 0.995 (0.005) quantile of ``train`` is used, else 0.
    ``exact=False`` takes a sketch instead.
    """
    q = min(max(1.0 - float(fpr), 0.0), 1.0)
    fallback_q = 0.995
    if direction == LOWER:
        q, fallback_q = 1.0 - q, 0.005

    def one(rows: DataFrame, at: float) -> DataFrame:
        if exact:
            # an aggregate without keys, so that no input still gives one (null) row
            return exact_quantiles(rows, F.col(score), [at]).agg(F.max("value").alias("threshold"))
        return rows.agg(F.percentile_approx(score, at, 100_000).cast("double").alias("threshold"))

    main = one(_usable(df, score).filter(_normal(label)), q)
    default = F.lit(0.0)
    if train is not None:
        default = F.coalesce(one(_usable(train, score), fallback_q).scalar(), default)
    return main.select(F.coalesce("threshold", default).alias("threshold"))


def live_threshold(scores: DataFrame, quantile: float, score: str = "score") -> DataFrame:
    """Quantile of the clean NORMAL rows of a live run."""
    clean = scores.filter((F.upper("status") == "NORMAL") & (F.trim(F.coalesce("support_sources", F.lit(""))) == ""))
    return exact_quantiles(clean, F.col(score), [quantile]).agg(
        F.max("value").alias("threshold"), F.coalesce(F.max("n"), F.lit(0)).alias("n_rows_used")
    )


def score_summary(
    df: DataFrame, threshold: float | Column, direction: str = HIGHER, score: str = "score", label: str = "label"
) -> DataFrame:
    """Counts and means per class with the estimated FPR and TPR."""
    df = _usable(df, score).withColumns({"_n": _normal(label), "_hit": S.is_hit(score, threshold, direction == LOWER)})
    n, a, hit = F.col("_n"), ~F.col("_n"), F.col("_hit").cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(n).alias("n_normal"),
        F.count_if(a).alias("n_attack"),
        F.avg(F.when(n, F.col(score))).alias("normal_mean"),
        F.avg(F.when(a, F.col(score))).alias("attack_mean"),
        F.avg(F.when(n, hit)).alias("estimated_fpr"),
        F.avg(F.when(a, hit)).alias("estimated_tpr"),
    )


def _truth(df: DataFrame) -> Column:
    return F.col("is_attack").cast("long") if "is_attack" in df.columns else S.is_attack("label")


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, threshold: float | Column, direction: str = HIGHER, score: str = "score") -> DataFrame:
    """Precision, recall and F1 of the attack class over rows with a score; a zero division gives 0."""
    df = _usable(df, score)
    y, hit = _truth(df) == 1, S.is_hit(score, threshold, direction == LOWER)
    c = df.agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn")
    )
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def curve(df: DataFrame, direction: str = HIGHER, score: str = "score", ranges: int | None = None) -> DataFrame:
    """Points per distinct score, counted from the attack end.

    ``tp`` / ``fp`` include the score itself, ``tp0`` / ``fp0`` do not; ``pos`` /
    ``neg`` are the totals.
    """
    sign = -1.0 if direction == HIGHER else 1.0
    y = _truth(df)
    cum = cumulative(_usable(df, score), F.col(score) * sign, {"p": y, "n": 1 - y}, ranges=ranges)
    return cum.select(
        (F.col("_value") * sign).alias("score"),
        F.col("before_p").alias("tp0"),
        F.col("before_n").alias("fp0"),
        (F.col("before_p") + F.col("p")).alias("tp"),
        (F.col("before_n") + F.col("n")).alias("fp"),
        F.col("total_p").alias("pos"),
        F.col("total_n").alias("neg"),
    )


def roc_auc(df: DataFrame, direction: str = HIGHER) -> DataFrame:
    """Area under the ROC curve, ties as trapezoids; null with one class only."""
    c = curve(df, direction)
    area = (F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2.0
    total = F.max(F.col("pos").cast("double")) * F.max(F.col("neg").cast("double"))
    return c.agg(F.when(total > 0, F.sum(area) / total).alias("roc_auc"))


def average_precision(df: DataFrame, direction: str = HIGHER) -> DataFrame:
    """Sum of precision times recall steps; null with one class only."""
    c = curve(df, direction)
    step = (F.col("tp") - F.col("tp0")) / F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return c.agg(F.when(both, F.sum(F.when(F.col("pos") > 0, step))).alias("average_precision"))


def recall_at_fpr(df: DataFrame, fpr: float = 0.05, direction: str = HIGHER) -> DataFrame:
    """Highest recall among the curve points whose FPR stays within the bound."""
    c = curve(df, direction)
    ok = F.col("fp") <= F.lit(float(fpr)) * F.col("neg")
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    best = F.coalesce(F.max(F.when(ok & (F.col("pos") > 0), F.col("tp") / F.col("pos"))), F.lit(0.0))
    return c.agg(F.when(both, best).alias("recall_at_fpr"))


def best_f1_threshold(df: DataFrame, direction: str = HIGHER) -> DataFrame:
    """Score with the best F1; of equal ones the first from the attack end."""
    c = curve(df, direction)
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("pos"), F.lit(1))
    f1 = 2.0 * p * r / F.greatest(p + r, F.lit(1e-12))
    side = F.col("score") if direction == HIGHER else -F.col("score")
    best = F.max_by(F.struct(F.col("score"), f1.alias("f1")), F.struct(f1, side))
    return c.agg(best.alias("b")).select(
        F.coalesce("b.score", F.lit(0.0)).alias("threshold"), F.col("b.f1").alias("best_f1")
    )


def select_threshold(
    val: DataFrame, train: DataFrame | None = None, fpr: float = 0.01, strategy: str = "target_fpr", direction: str = HIGHER
) -> DataFrame:
    """Threshold by target FPR, or by best F1 where both classes occur."""
    by_fpr = threshold_at_fpr(val, fpr, direction, train)
    if strategy != "best_f1":
        return by_fpr
    y = _truth(val)
    both = val.agg(((F.max(y) == 1) & (F.min(y) == 0)).alias("b")).scalar()
    return best_f1_threshold(val, direction).select(
        F.when(both, F.col("threshold")).otherwise(by_fpr.scalar()).alias("threshold")
    )


def attack_breakdown(df: DataFrame, threshold: float | Column, direction: str = HIGHER, score: str = "score") -> DataFrame:
    """Count, mean score and recall per attack label."""
    hit = S.is_hit(score, threshold, direction == LOWER).cast("double")
    return (
        df.filter(F.col("label") != "Normal")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(hit).alias("recall"))
    )


def class_balance(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Class counts, positive share, positive weight and the balancing mode."""
    y = _truth(df)
    c = df.agg(
        F.greatest(F.count_if(y == 1), F.lit(1)).alias("pos_count"),
        F.greatest(F.count_if(y == 0), F.lit(1)).alias("neg_count"),
    )
    c = c.withColumns(
        {
            "pos_ratio": F.col("pos_count") / (F.col("pos_count") + F.col("neg_count")),
            "pos_weight": F.col("neg_count") / F.col("pos_count"),
        }
    )
    auto = (
        F.when(F.col("pos_ratio") < 0.10, "both").when(F.col("pos_ratio") < 0.25, "pos_weight").otherwise("none")
    )
    return c.withColumn("balance_mode", auto if mode == "auto" else F.lit(mode))


def with_class_weights(df: DataFrame) -> DataFrame:
    """``sample_weight``: one over the row count of the row's class (two scalars)."""
    y = _truth(df)
    totals = df.agg(
        F.struct(
            F.greatest(F.count_if(y == 1), F.lit(1)).alias("p"), F.greatest(F.count_if(y == 0), F.lit(1)).alias("n")
        ).alias("c")
    ).scalar()
    return df.withColumn("sample_weight", F.lit(1.0) / F.when(y == 1, totals["p"]).otherwise(totals["n"]))
