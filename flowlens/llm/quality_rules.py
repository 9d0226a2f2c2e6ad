"""Quality rules with thresholds that follow each language and source.

Four shares are taken of every text: symbols per word character, repeated lines, words in
repeated three-word windows, and word length. All documents go into mergeable quantile
sketches: counts of values kept to five significant bits (relative error at most 1/16),
for each language and source. Sketches merge by adding counts, so map-side sums, skewed
sources and later batches need nothing else; the sketch of a language is the sum of its
sources' sketches. The limit of a share is Tukey's outer fence, upper quartile plus three
interquartile ranges, plus a fixed margin for shares that hardly vary. A source with fewer
than ``least`` documents uses its language's sketch, a language with fewer the sum of all.
Documents are then joined with their limits and filtered.

Cases: null and empty texts have no words and fail the base rule; null language and source
are groups of their own; repeated rows each count and are all returned; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.session import stage

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A small floor, so that one repeated line or window is no outlier where none is usual; the quartiles do the rest.
#: Share (in thousandths): margin above the upper fence, margin below the lower fence (None: no lower limit).
MARGINS = {"symbols": (20, None), "dup_lines": (100, None), "repeats": (100, None), "length": (2000, 1500)}


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    m = len(number)
    pairs = ids[:-1] * m + ids[1:]
    if m >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= often
    return int(inside.sum())


def _counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeat_words(words),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def counts(text: Column | str) -> Column:
    """Struct of the counts that the rules use."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(v: pa.Array) -> pa.Array:
        got = [_counts(t.as_py()) for t in v]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))], list(COUNTS))

    return run(text)


def _shares() -> dict[str, Column]:
    share = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return {
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "length": share("word_chars", "n_words"),
    }


def sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, share, cell, n): level 0 language and source, 1 language, 3 all."""
    cell = F.expr("shiftleft(shiftright(value, cast(greatest(length(bin(value)) - 5, 0) AS INT)), cast(greatest(length(bin(value)) - 5, 0) AS INT))")
    each = F.array(*[F.struct(F.lit(k).alias("share"), v.alias("value")) for k, v in _shares().items()])
    one = stats.select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.share", "x.value")
    small = one.groupBy("lang", "source", "share", cell.alias("cell")).agg(F.count("*").alias("n"))
    up = small.groupingSets([("lang", "source", "share", "cell"), ("lang", "share", "cell"), ("share", "cell")], "lang", "source", "share", "cell")
    return up.agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).select(
        F.shiftrightunsigned("g", 2).alias("level"), "lang", "source", "share", "cell", "n"
    )


def limits(stats: DataFrame, fence: int = 3) -> DataFrame:
    """One row per level, language and source: rows and the limits of each share, from the sketches."""
    key = ["level", "lang", "source"]
    by = Window.partitionBy(*key, "share")
    run = sketches(stats).withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("cell"))})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("cell")))
    quart = run.groupBy(*key, "share").agg(F.max("total").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * fence
    out = [F.max("rows").alias("rows")]
    for name, (above, below) in MARGINS.items():
        own = lambda c: F.max(F.when(F.col("share") == name, c))  # noqa: B023, E731
        out.append(own(F.col("q3") + reach + above).alias(f"{name}_most"))
        if below is not None:
            out.append(own(F.col("q1") - reach - below).alias(f"{name}_least"))
    return quart.groupBy(*key).agg(*out)


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", least: int = 30) -> DataFrame:
    """One row per row of ``docs``: key, the counts, base_failed, kept, and the limits' level."""
    stats = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), counts(F.col(text)).alias("c"))
    stats = stage(stats.select("key", "lang", "source", "c.*"), "quality-counts")
    bounds = stage(limits(stats), "quality-limits")
    names = [c for c in bounds.columns if c not in ("level", "lang", "source")]
    level = lambda n, *cols: bounds.filter(F.col("level") == n).select(*[F.col(c).alias(f"{c}_{n}") for c in (*cols, *names)])
    own, wide, every = level(0, "lang", "source"), level(1, "lang"), level(3)
    df = stats.join(own, F.col("lang").eqNullSafe(F.col("lang_0")) & F.col("source").eqNullSafe(F.col("source_0")), "left")
    df = df.join(wide, F.col("lang").eqNullSafe(F.col("lang_1")), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    use = F.when(F.col("rows_0") >= least, 0).when(F.col("rows_1") >= least, 1).otherwise(3)
    df = df.withColumn("level", use)
    lim = lambda c: F.when(F.col("level") == 0, F.col(f"{c}_0")).when(F.col("level") == 1, F.col(f"{c}_1")).otherwise(F.col(f"{c}_3"))
    fits = F.lit(True)
    for name, value in _shares().items():
        fits = fits & (value <= lim(f"{name}_most"))
        if MARGINS[name][1] is not None:
            fits = fits & (value >= lim(f"{name}_least"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(fits, F.lit(True))).alias("kept"), F.col("level").cast("long").alias("level"),
    )
