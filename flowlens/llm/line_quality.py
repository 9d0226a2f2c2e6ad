"""Document quality from a linear-chain conditional random field over lines.

Every line gets binary features of its own (length, capitals, symbols, repeated words,
repeated lines, punctuation) and of its neighbours. The chain labels each line good or bad;
forward-backward gives each line's probability of good, and the document's score is their
mean weighted by line length.

``fit`` trains on a bounded sample of labelled documents (``SAMPLE`` rows, chosen by hash; of
each up to ``BLOCKS`` blocks of ``LINES`` lines, spread evenly over the text, which weigh as
one document): a line's training label is its document's label. The
likelihood is maximised by Adam with a fixed number of steps. ``score`` is a column that
works through whole texts of any length, line by line.

Cases: a text without a word (null, empty, blank) has no line and gets the training share of
good documents; without labels of both kinds every score is that share, or 0.5; repeated
rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import chain
from flowlens.llm.textio import values
from flowlens.llm.toxicity import bounded

SAMPLE, LINES, BLOCKS = 4_000, 200, 4
SYMBOLS = "#*$%&|<>"
#: Own features of a line, one bit each; those before ``SHARED`` are also seen by both neighbours.
FEATURES = (
    "capitals", "some_capitals", "symbols", "many_symbols", "shouts", "repeats", "many_repeats", "stutter", "same_as_before", "seen_before",
    "bars", "one_word", "short", "long", "very_long", "short_words", "long_words", "digits", "no_stop", "first", "last",
)
SHARED = 11
WIDTH = 1 + len(FEATURES) + 2 * SHARED


def line_bits(text: str | None) -> tuple[list[int], list[int]]:
    """Feature bits and length of every line with a word."""
    lines = [s for x in (text or "").split("\n") if (s := x.strip())]
    seen: set[str] = set()
    own, sizes = [], []
    before = None
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        kinds = len(set(words))
        upper = sum(map(str.isupper, words))
        symbols = sum(map(line.count, SYMBOLS))
        stutter = sum(map(str.__eq__, words, words[1:])) if kinds < n else 0
        flags = (
            upper > 0.6 * n, upper > 0.25 * n, symbols > 0.02 * size, symbols > 0.1 * size, line.count("!") > 0.3 * n,
            n > 4 and kinds < 0.6 * n, n > 4 and kinds < 0.3 * n, stutter > 0.2 * n, line == before, line in seen,
            line.count("|") > 0.3 * n, n == 1, n < 5, n > 30, n > 120, size < 3.5 * n, size > 9 * n,
            sum(map(str.isdigit, words)) > 0.2 * n, line[-1] not in ".!?\"')",
        )
        own.append(sum(1 << i for i, f in enumerate(flags) if f))
        sizes.append(size)
        seen.add(line)
        before = line
    if own:
        own[0] |= 1 << FEATURES.index("first")
        own[-1] |= 1 << FEATURES.index("last")
    mask, out = (1 << SHARED) - 1, []
    for i, bits in enumerate(own):
        left = own[i - 1] & mask if i else 0
        right = own[i + 1] & mask if i + 1 < len(own) else 0
        out.append(bits | left << len(FEATURES) | right << len(FEATURES) + SHARED)
    return out, sizes


def _matrix(bits: np.ndarray) -> np.ndarray:
    """Lines x features, the first always on."""
    on = (bits[:, None] >> np.arange(WIDTH - 1)) & 1
    return np.column_stack([np.ones(len(bits)), on]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    share: float
    weights: np.ndarray | None  # score of good minus bad, by feature
    steps: np.ndarray | None  # 2 x 2 scores of label pairs of neighbouring lines


def blocks_of(bits: list[int]) -> list[list[int]]:
    """Lines of a document in blocks of ``LINES``; of a longer one ``BLOCKS`` of them, spread evenly from its start to its end."""
    n = -(-len(bits) // LINES)
    at = range(n) if n <= BLOCKS else [round(i * (n - 1) / (BLOCKS - 1)) for i in range(BLOCKS)]
    return [bits[k * LINES : (k + 1) * LINES] for k in at]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Chain trained on a bounded sample of the labelled rows; ``labels``: key, quality."""
    given = labels.filter("quality IS NOT NULL").groupBy(key).agg(F.max("quality").cast("int").alias("quality"))
    sample = F.broadcast(bounded(given, key, SAMPLE).withColumnRenamed(key, "key_"))  # a bounded number of (id, label) pairs

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, owner, parts = [], [], []
            for i, t in enumerate(values(batch.column(0))):
                own = blocks_of(line_bits(t)[0])
                blocks += own
                owner += [i] * len(own)
                parts += [len(own)] * len(own)
            quality = batch.column(1).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.list_(pa.int64())), quality, pa.array(parts, pa.int32())], names=["bits", "quality", "parts"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(sample, F.col("key") == F.col("key_"))
    got = rows.select("text", "quality").mapInArrow(extract, "bits array<long>, quality int, parts int").orderBy("quality", "parts", "bits").collect()
    y, part = [r["quality"] for r in got], np.array([1 / r["parts"] for r in got])
    share = float(np.average(y, weights=part)) if y else 0.5
    if len(set(y)) < 2:
        return Model(share, None, None)
    balance = [p * (0.5 / share if q == 1 else 0.5 / (1 - share)) for q, p in zip(y, part)]  # neither class nor long documents outweigh the rest
    return Model(share, *chain.train([_matrix(np.array(r["bits"], dtype=np.int64)) for r in got], [np.full(len(r["bits"]), r["quality"]) for r in got], np.array(balance)))


def score(text: Column | str, model: Model) -> Column:
    """Length-weighted mean probability that a line is good."""
    share = model.share
    weights = None if model.weights is None else model.weights.tolist()
    steps = None if model.steps is None else model.steps.tolist()

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        out = []
        memory: dict[int, float] = {}  # score by feature bits
        for t in v:
            bits, sizes = line_bits(t.as_py()) if weights is not None else ([], [])
            for b in set(bits).difference(memory):
                memory[b] = weights[0] + sum(weights[i + 1] for i in range(WIDTH - 1) if b >> i & 1)
            good = chain.marginals([memory[b] for b in bits], steps) if bits else []
            out.append(round(sum(p * n for p, n in zip(good, sizes)) / sum(sizes), 6) if bits else share)
        return pa.array(out, pa.float64())

    return run(text)
