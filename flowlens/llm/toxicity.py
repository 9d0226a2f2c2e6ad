"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

``fit``
1. *Lexicon.* From a bounded sample of labelled documents (``SAMPLE`` rows, chosen by hash)
   it learns word beginnings that occur in many toxic and hardly any clean documents.
   Near-copies of one document count about once: support is counted over min-hash groups.
   A short general list of insults is a second lexicon.
2. *Voters.* Each voter looks at counts of lexicon hits or a pattern and says toxic, clean
   or nothing. Votes of all training documents are reduced to counts of vote patterns
   (at most 3^10 rows, in practice some hundred).
3. *Label model.* A mixture with a hidden label: expectation-maximisation estimates the
   class share and, for every voter, how it votes on each class. The given label is one
   more voter. Correlations of voters within the classes are estimated from the posterior
   and voters that repeat each other are discounted.
4. *Classifier.* Logistic regression on the counts, trained on the posterior labels of a
   bounded sample (``SAMPLE`` rows, chosen by a hash of key and text, so reruns agree).

``score`` is a column: one pass over the text, whatever its length. Labels, language,
source and id never enter a score.

Cases: null and empty texts have no hits and get the low score of such texts; documents
without labels or without any toxic label leave the general list alone to vote; repeated
rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textio import values
from flowlens.session import stage

#: General insults, as they are or as word beginnings.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "imbecil", "crétin", "dumm", "arschloch", "salaud", "cabrón")
SAMPLE = 20_000
SHORTEST, LONGEST = 4, 9
_WORD = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"\b(?:you|your|tu|toi|vous|du|dich|ihr|eres|usted)\b\W+(?:\w+\W+){0,2}$")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    """The word itself (with an end mark) and its beginnings of 4 to 9 letters."""
    return [word + "$"] + [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def _group(words: list[str]) -> int:
    """Min-hash of the five-word shingles: near-copies mostly share it."""
    n = max(1, len(words) - 4)
    return min(xxhash.xxh32_intdigest(" ".join(words[i : i + 5])) for i in range(n))


@dataclass
class Lexicon:
    """Word -> bits: 1 learned, 2 general. Filled as words come; emptied at a fixed size."""

    learned: frozenset[str]
    memory: dict[str, int] = field(default_factory=dict)

    def kind(self, word: str) -> int:
        k = 0
        if any(b in self.learned for b in beginnings(word)):
            k |= 1
        if word.startswith(INSULTS):
            k |= 2
        if len(self.memory) > 100_000:
            self.memory.clear()
        self.memory[word] = k
        return k


FEATURES = ("words", "learned", "learned_kinds", "general", "general_kinds", "lines", "addressed", "shouted")


def features(text: str | None, lexicon: Lexicon) -> tuple[int, ...]:
    """Counts that voters and classifier see; see ``FEATURES``."""
    text = text or ""
    words, memory = words_of(text), lexicon.memory
    kinds = [memory[w] if w in memory else lexicon.kind(w) for w in words]
    n = len(words)
    if not any(kinds):
        return (n, 0, 0, 0, 0, 0, 0, 0)
    learned = [w for w, k in zip(words, kinds) if k & 1]
    general = [w for w, k in zip(words, kinds) if k & 2]
    hit = {w for w, k in zip(words, kinds) if k}
    lines = addressed = shouted = 0
    for line in text.split("\n"):
        own = [m for m in _WORD.finditer(line) if m[0].lower() in hit]
        lines += bool(own)
        for m in own:
            addressed += bool(_ADDRESS.search(line[max(0, m.start() - 40) : m.start()].lower()))
            shouted += m[0].isupper() or line[m.end() : m.end() + 1] == "!"
    return (n, len(learned), len(set(learned)), len(general), len(set(general)), lines, addressed, shouted)


def _votes(f: np.ndarray) -> np.ndarray:
    """Votes (rows x voters): 1 toxic, 0 clean, 2 nothing."""
    n, learned, learned_kinds, general, general_kinds, lines, addressed, shouted = f.T
    most = np.maximum(learned, general)
    say = lambda yes, no: np.where(yes, 1, np.where(no, 0, 2))
    never = np.zeros(len(f), bool)
    return np.stack([
        say(learned >= 3, learned == 0), say(learned_kinds >= 2, learned_kinds == 0), say(learned >= 1, learned == 0),
        say(general >= 3, never), say(general_kinds >= 2, never), say(general == 1, never),
        say(most * 150 >= np.maximum(n, 1), most == 0), say(lines >= 2, lines == 0),
        say(addressed >= 1, never), say(shouted >= 1, never),
    ], axis=1)


def _inputs(f: np.ndarray) -> np.ndarray:
    """Classifier inputs: saturating counts, densities, length."""
    f = f.astype(float)
    n, learned, learned_kinds, general, general_kinds, lines, addressed, shouted = f.T
    most = np.maximum(learned, general)
    size = np.log1p(n)
    return np.stack([
        np.ones(len(f)), np.minimum(learned, 1), np.minimum(learned, 4), np.minimum(learned_kinds, 4), np.minimum(general, 4), np.minimum(general_kinds, 4),
        np.minimum(lines, 3), np.minimum(100 * most / np.maximum(n, 1), 5), np.minimum(addressed, 2), np.minimum(shouted, 2), (size - 5) / 3,
    ], axis=1)


@dataclass(frozen=True)
class LabelModel:
    """share: of the toxic class; table[voter][class][vote]; weight: of each voter after discount."""

    share: float
    table: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        score = np.log(self.share / (1 - self.share)) * np.ones(len(votes))
        for j in range(votes.shape[1]):
            p = self.table[j]
            score += self.weight[j] * (np.log(p[1]) - np.log(p[0]))[votes[:, j]]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """EM over counted vote patterns; the last voter is the given label and starts the classes."""
    patterns, voters = votes.shape
    total = counts.sum()
    start = np.where(votes[:, -1] < 2, votes[:, -1], np.where((votes[:, :-1] == 1).sum(1) >= 3, 0.9, 0.1))
    post, weight = np.clip(start.astype(float), 0.02, 0.98), np.ones(voters)
    model = None
    for turn in range(rounds):
        share = float(np.clip((post * counts).sum() / total, 1e-3, 0.6))
        table = np.empty((voters, 2, 3))
        for j in range(voters):
            for y, p in enumerate((1 - post, post)):
                table[j, y] = np.bincount(votes[:, j], weights=p * counts, minlength=3) + 0.5
            table[j] /= table[j].sum(axis=1, keepdims=True)
        x = np.where(votes == 2, 0.0, 2.0 * votes - 1)
        corr = np.zeros((voters, voters))
        for p in (1 - post, post):
            w = p * counts / max((p * counts).sum(), 1e-9)
            d = x - w @ x
            cov = (d * w[:, None]).T @ d
            sd = np.sqrt(np.diag(cov) + 1e-9)
            corr += np.abs(cov / np.outer(sd, sd)) / 2
        np.fill_diagonal(corr, 0)
        free = corr.copy()
        free[-1] = free[:, -1] = 0  # the given label isn't discounted
        weight = 1 / (1 + free.sum(axis=1))
        model = LabelModel(share, table, weight, corr)
        new = model.posterior(votes)
        if turn > 5 and np.abs(new - post).max() < 1e-4:
            break
        post = new
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    k = np.ones(len(x)) if weights is None else weights
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (k * (y - p)) - keep @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    learned: frozenset[str]
    weights: np.ndarray
    labels: LabelModel | None


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Word beginnings typical of toxic documents, from (text, toxic) rows of a bounded sample."""

    def count(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in values(batch.column(0)):
                    words = words_of(text)
                    if not words:
                        continue
                    found = {b for w in set(words) for b in beginnings(w)}
                    group = _group(words) % 1_000_003
                    seen.update((b, group) for b in (found if wanted is None else found & wanted))
                    if len(seen) > 200_000:
                        yield pack(seen)
                        seen.clear()
            yield pack(seen)

        return run

    def pack(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64())], names=["b", "g"])

    def groups(text: DataFrame) -> DataFrame:
        return text.select("text").mapInArrow(count_groups, "g long")

    def count_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_group(w) % 1_000_003 for t in values(batch.column(0)) if (w := words_of(t))], pa.int64())], names=["g"])

    toxic, clean = sample.filter("toxic = 1").select("text"), sample.filter("toxic = 0").select("text")
    n_toxic, n_clean = (groups(d).agg(F.countDistinct("g")).first()[0] for d in (toxic, clean))
    if not n_toxic:
        return frozenset()
    least = max(4, 2 + 0.012 * n_toxic)
    tally = lambda d, wanted: d.mapInArrow(count(wanted), "b string, g long").groupBy("b").agg(F.countDistinct("g").alias("n"))
    often = {r["b"]: r["n"] for r in tally(toxic, None).filter(F.col("n") >= least).collect()}  # bounded: the sample is, and so is each document's share of it
    rare = {r["b"]: r["n"] for r in tally(clean, frozenset(often)).collect()}
    lift = {b: ((n + 0.5) / (n_toxic + 1)) / ((rare.get(b, 0) + 0.5) / (n_clean + 1)) for b, n in often.items()}
    good = [b for b in often if lift[b] >= 12]
    finest = {b: b for b in good}  # the longest beginning that holds nearly all of a beginning's documents
    for b in sorted(good, key=lambda b: (len(b), b)):
        for n in range(SHORTEST, len(b)):
            if b[:n] in finest and often[b] >= 0.9 * often[b[:n]]:
                finest[b[:n]] = b
    chosen: set[str] = set()
    for b in sorted(set(finest.values()), key=lambda b: (len(b), b)):  # a longer beginning adds nothing to a chosen shorter one
        if not any(b[:n] in chosen for n in range(SHORTEST, len(b))):
            chosen.add(b)
    return frozenset(chosen)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Lexicon, label model and classifier from training rows; ``labels``: key, toxic."""
    given = labels.filter("toxic IS NOT NULL").groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(key, text).alias("th"))
    sample = F.broadcast(bounded(given, key, SAMPLE).withColumnRenamed(key, "key_"))  # a bounded number of (id, label) pairs
    learned = learn_lexicon(rows.join(sample, F.col("key") == F.col("key_")).select("text", "toxic"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned)
        for batch in batches:
            got = [features(t, lexicon) for t in values(batch.column(1))]
            cols = [pa.array([g[i] for g in got], pa.int32()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["key", "th", *FEATURES])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(extract, f"key {kind}, th long, " + ", ".join(f"{f} int" for f in FEATURES))
    named = found.join(given.withColumnRenamed(key, "key_"), F.col("key") == F.col("key_"), "left").select("th", *FEATURES, F.coalesce("toxic", F.lit(2)).alias("given"))
    named = stage(named, "toxicity-features")
    # what the voters can tell apart: counts are cut where no voter looks further
    cut = [F.least(F.col(f), F.lit(4)).alias(f) for f in FEATURES[1:]]
    dense = (F.greatest("learned", "general") * 150 >= F.greatest("words", F.lit(1))).alias("dense")
    patterns = named.groupBy(*cut, dense, "given").agg(F.count("*").alias("n")).orderBy(*FEATURES[1:], "dense", "given").collect()
    if not patterns:
        return Model(learned, np.zeros(11), None)
    f = np.array([[(1 if r["dense"] else 1_000_000), *[r[x] for x in FEATURES[1:]]] for r in patterns], dtype=np.int64)
    votes = np.column_stack([_votes(f), [r["given"] for r in patterns]])
    counts = np.array([r["n"] for r in patterns], float)
    model = fit_label_model(votes, counts)
    # chosen and ordered by key and text, so that a run on other partitions trains on the same rows
    few = bounded(named.filter("learned + general = 0"), "th", SAMPLE // 2)
    some = bounded(named.filter("learned + general > 0"), "th", SAMPLE // 2)
    sizes = named.groupBy((F.col("learned") + F.col("general") > 0).alias("hit")).count().collect()
    each = {r["hit"]: r["count"] for r in sizes}
    xs, ys, ks = [], [], []
    for hit, part in ((False, few), (True, some)):
        got = part.orderBy("th", *FEATURES, "given").select(*FEATURES, "given").collect()  # at most about SAMPLE rows of nine numbers
        if got:
            a = np.array(got, dtype=np.int64)
            xs.append(_inputs(a[:, :-1]))
            ys.append(model.posterior(np.column_stack([_votes(a[:, :-1]), a[:, -1]])))
            ks.append(np.full(len(a), each[hit] / len(a)))
    return Model(learned, fit_linear(np.concatenate(xs), np.concatenate(ys), np.concatenate(ks)), model)


def score(text: Column | str, model: Model) -> Column:
    """Probability that a text is toxic."""
    learned, weights = model.learned, model.weights

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        lexicon = _lexicon(learned)
        f = np.array([features(t.as_py(), lexicon) for t in v], dtype=np.int64).reshape(len(v), len(FEATURES))
        return pa.array(np.round(1 / (1 + np.exp(-np.clip(_inputs(f) @ weights, -30, 30))), 6), pa.float64())

    return run(text)


_LEXICONS: dict[frozenset[str], Lexicon] = {}


def _lexicon(learned: frozenset[str]) -> Lexicon:
    if learned not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[learned] = Lexicon(learned)
    return _LEXICONS[learned]
