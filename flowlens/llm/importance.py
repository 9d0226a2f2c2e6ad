"""Target-distribution importance resampling over hashed n-grams.

A 256-byte table lower-cases A-Z and blanks every separator of a text's UTF-8 bytes, and
``bytes.split`` yields its words. The crc32 of a word seeds the crc32 of the run that goes
one word further, so every n-gram costs one call; the crc32 modulo ``buckets`` is its
bucket. Counters reduce the words of a task to bucket counts, which Spark sums.

A bucket's gain is the logarithm of how much likelier the target is to show it, both sides
smoothed by one; a document's weight is the mean gain of its features. Weight plus Gumbel
noise, drawn from a hash of the document's key, is its score, and the highest scores are a
sample without replacement in proportion to exp(weight).

Ranks need no global sort: scores are whole thousandths, so rows are counted per score (the
logarithms of 64-bit counts and of 32-bit noise leave under 100,000 different ones), the counts
give the rank before each score, and only rows of drawn scores are ordered, score by score.
Rows equal in all columns are one row with a count there.

Cases: a null text has no words, a document without features has weight 0; a null key counts
as an empty one; repeated rows are all scored and drawn, and share the noise of their key;
ties go to the smaller key (null first), then to fewer features; without documents, target
texts or words every gain is that of the smoothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.textio import values
from flowlens.session import stage

BUCKETS = 10_000
#: Different words that a task keeps before it empties its memory; changes no result.
MEMORY = 200_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def longer(own: list[bytes], ngrams: int) -> Iterator[list[int]]:
    """crc32 of all runs of 2, 3 ... ``ngrams`` words, joined by one space."""
    state = [crc32(w) for w in own] if ngrams > 1 else []
    for n in range(1, ngrams):
        state = [crc32(w, crc32(b" ", s)) for s, w in zip(state, own[n:])]
        yield state


def _bytes(text: str) -> Column:
    return F.col(text).cast("string").cast("binary").alias("text")


def profile(docs: DataFrame, text: str = "text", ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Occurrences per bucket over all texts: columns bucket, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = np.zeros(buckets, np.int64)

        def empty() -> None:
            for w, n in seen.items():
                total[crc32(w) % buckets] += n
            seen.clear()

        for batch in batches:
            for t in values(batch.column(0)):
                own = words(t)
                seen.update(own)
                for run in longer(own, ngrams):
                    total[:] += np.bincount(np.array(run, np.int64) % buckets, minlength=buckets)
                if len(seen) > MEMORY:
                    empty()
        empty()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(_bytes(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket in thousandths, floored, from the profiles of all documents and of the target."""
    sides = []
    for side in (raw, target):
        n = [0] * buckets
        for r in side.collect():  # one row per bucket at most
            n[r["bucket"]] = r["n"]
        sides.append((n, float(sum(n) + buckets)))
    (s, all_s), (t, all_t) = sides
    return [math.floor(1000 * math.log((t[i] + 1.0) * all_s / ((s[i] + 1.0) * all_t))) for i in range(buckets)]


def weigh(text: str, gain: list[int], ngrams: int = 1) -> Column:
    """Struct of n_words, n_features and weight: the floored mean gain of the features."""
    buckets = len(gain)

    class Gains(dict):
        def __missing__(self, word: bytes) -> int:
            g = self[word] = gain[crc32(word) % buckets]
            return g

    @F.arrow_udf("n_words long, n_features long, weight long")
    def run(v: pa.Array) -> pa.Array:
        known, table = Gains(), np.array(gain, np.int64)
        sizes, features, weights = [], [], []
        for x in v:
            own = words(x.as_py())
            n, total = len(own), sum(map(known.__getitem__, own))
            for run in longer(own, ngrams):
                n += len(run)
                total += int(table[np.array(run, np.int64) % buckets].sum())
            sizes.append(len(own))
            features.append(n)
            weights.append(total // n if n else 0)
            if len(known) > MEMORY:
                known.clear()
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (sizes, features, weights)], ["n_words", "n_features", "weight"])

    return run(_bytes(text))


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from sha256 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", ngrams: int = 1, buckets: int = BUCKETS,
    percent: int = 10, least: int = 20, seed: str = "2024",
) -> DataFrame:
    """One row per document: key, n_features, weight, score, rank (null where not drawn).

    ``target``: table whose column ``text`` shows what is wanted. ``percent`` of the
    documents with ``least`` words or more are drawn.
    """
    gain = gains(profile(docs, text, ngrams, buckets), profile(target, "text", ngrams, buckets), buckets)
    rows = docs.select(F.col(key).alias("id"), weigh(text, gain, ngrams).alias("r")).select("id", "r.*")
    scored = stage(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "importance")
    able = F.col("n_words") >= least
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))  # under 100,000 rows
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = counts.select(
        F.col("score").alias("top"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above"), F.floor(F.sum("n").over(all_rows) * percent / 100).alias("drawn")
    ).filter("above < drawn")
    top = F.broadcast(top)
    drawn = able & (F.col("score") == F.col("top"))
    same = scored.join(top, drawn).groupBy("id", "n_words", "n_features", "weight", "score", "above", "drawn").agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy("id", "n_features", "n_words", "weight").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    each = same.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("rank", F.col("before") + F.col("i"))
    each = each.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = scored.join(top, drawn, "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return each.select(rest.columns).unionByName(rest).select(F.col("id").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
