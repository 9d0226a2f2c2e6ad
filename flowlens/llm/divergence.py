"""Audit of how far the sources of a language differ in their words.

Words are counted by sorting pointers. The texts of a shard lie one after the other in an
Arrow buffer; every word start is a pointer into it. Multikey quicksort orders the pointers:
by their first character, then each slice of equal characters by the next one. A character
is eight bytes wide here, and slices of one pointer are left alone. Equal runs are the terms;
a run yields in how many documents a term stands and how often each source has it. Shards are
bounded by bytes, so a task never holds more than one shard's pointers; Spark sums the shards.

A term is kept in a language if enough of its documents hold it. Every source of a language,
and the language itself, gives each kept term a probability in billionths with one added to
each count. The divergence of a source from another is the sum of (p - q) ** 2 / q over all
kept terms. Most terms are missing from most sources, so it is put together from what the
terms of either source add beside a source without any, and a correction for terms that both
have: no term is multiplied with sources that lack it.

Arithmetic is whole-numbered: a value stays under 4 * 10 ** 18.

Cases: null text, language and source count as empty strings; a source without terms has all
divergences like any other; without kept terms all are 0; repeated rows are documents of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.session import stage

#: Bytes of text in a shard; one longer text is a shard of its own.
SHARD = 4 << 20
#: Pairs of sources that a task looks at in one step.
STEP = 1 << 19
#: Parts of a join whose keys are languages or sources.
SALT = 32
UNIT = 1_000_000_000

#: A-Z lower-cased, other letters and all bytes of longer characters as they are, 0 for the rest.
_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)
_KEEP = np.array([0] + [(2**64 - 1) ^ (2 ** (64 - 8 * n) - 1) for n in range(1, 9)], np.uint64)


def pointers(chars: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every word; ``borders``: text starts and the end."""
    inside = chars != 0
    fresh = np.zeros(len(chars) + 1, bool)
    fresh[borders] = True
    after = np.concatenate([[False], inside[:-1]]) & ~fresh[:-1]
    before = np.concatenate([inside[1:], [False]]) & ~fresh[1:]
    start, end = np.flatnonzero(inside & ~after), np.flatnonzero(inside & ~before) + 1
    return start, end - start, np.searchsorted(borders, start, side="right") - 1


def multikey_sort(chars: np.ndarray, start: np.ndarray, length: np.ndarray, wide: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by word, and whether a place of it begins a run of equal words.

    Past ``wide`` characters the rest of a word is compared whole.
    """
    padded = np.concatenate([chars, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def character(which: np.ndarray, depth: int) -> np.ndarray:
        rest = np.clip(length[which] - depth, 0, 8)
        at = np.minimum(start[which] + depth, len(chars))
        return eight[at].copy().view(">u8").ravel().astype(np.uint64) & _KEEP[rest]

    first = character(np.arange(len(start)), 0)
    order = np.argsort(first, kind="quicksort")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(first[order]) != 0
    for depth in range(8, 8 * wide + 1, 8):
        run = np.cumsum(new)
        size = np.bincount(run)
        open_ = np.flatnonzero((size[run] > 1) & (length[order] >= depth))  # whole slices: their words fill all characters so far
        if not len(open_):
            break
        which, slice_ = order[open_], run[open_]
        if depth < 8 * wide:
            key = character(which, depth)
        else:
            texts = [chars[start[i] + depth : start[i] + length[i]].tobytes() for i in which]
            number = {t: k for k, t in enumerate(sorted(set(texts)))}
            key = np.array([number[t] for t in texts], np.uint64)
        by = np.lexsort((key, slice_))
        order[open_] = which[by]
        key, slice_ = key[by], slice_[by]
        new[open_] = np.concatenate([[True], (np.diff(slice_) != 0) | (key[1:] != key[:-1])])
    return order, new


def shard_counts(chars: np.ndarray, borders: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a shard: start and length of a term, its group, occurrences there, texts that hold it there.

    ``group``: the group of every text.
    """
    start, length, text = pointers(chars, borders)
    order, new = multikey_sort(chars, start, length)
    run = np.cumsum(new) - 1
    head = order[new]
    rank = np.empty(len(group), np.int64)
    by_group = np.argsort(group, kind="stable")
    rank[by_group] = np.arange(len(group))
    pair = np.sort(run * len(group) + rank[text[order]])  # by term, group, text
    at = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([at, [len(pair)]]))
    term, owner = pair[at] // max(len(group), 1), group[by_group][pair[at] % max(len(group), 1)]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(owner) != 0)])) if len(at) else at
    n = np.add.reduceat(times, cut) if len(cut) else cut
    texts = np.diff(np.concatenate([cut, [len(at)]]))
    return start[head[term[cut]]], length[head[term[cut]]], owner[cut], n, texts


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a column of strings without nulls."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def _shards(borders: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(borders) - 1:
        b = max(a + 1, int(np.searchsorted(borders, borders[a] + SHARD, side="right")) - 1)
        yield a, b
        a = b


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, texts by shard-wise pointer sort; one more row without a term for each group."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = (batch.column(i).dictionary_encode() for i in range(2))
            n_sources = len(sources.dictionary)
            pair, group = np.unique(langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy(), return_inverse=True)
            name = lambda g: (langs.dictionary.take(pa.array(pair[g] // n_sources)), sources.dictionary.take(pa.array(pair[g] % n_sources)))  # noqa: B023, E731
            every = np.arange(len(pair))
            none = pa.nulls(len(pair), pa.binary())
            yield pa.RecordBatch.from_arrays([*name(every), none, *[pa.array(np.zeros(len(pair), np.int64))] * 2], names=["lang", "source", "term", "n", "texts"])
            raw, borders = _strings(batch.column(2))
            for a, b in _shards(borders):
                chars = _TABLE[raw[borders[a] : borders[b]]]
                if not len(chars):
                    continue
                start, length, owner, n, texts = shard_counts(chars, borders[a : b + 1] - borders[a], group[a:b])
                flat = chars.tobytes()
                terms = pa.array([flat[s : s + k] for s, k in zip(start.tolist(), length.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*name(owner), terms, pa.array(n), pa.array(texts)], names=["lang", "source", "term", "n", "texts"])

    out = rows.mapInArrow(count, "lang string, source string, term binary, n long, texts long")
    return out.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def rate(n: Column, total: Column, terms: Column) -> Column:
    """Probability in billionths; counts may be as large as a long holds."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(n + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrections(shared: DataFrame) -> DataFrame:
    """lang, source, item, value: what terms that both sources have add beyond the sum of the parts.

    ``shared``: one row per lang and term with the arrays source, p and p0.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            sizes = np.diff(column("source").offsets.to_numpy()).astype(np.int64)
            if not sizes.sum():
                continue
            langs, sources = column("lang").dictionary_encode(), column("source").flatten().dictionary_encode()
            owner = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
            p, p0 = (column(n).flatten().to_numpy().astype(np.int64) for n in ("p", "p0"))
            mine = sources.indices.to_numpy().astype(np.int64)
            first, partners = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
            upto, a, count = np.cumsum(partners), 0, len(sources.dictionary)
            while a < len(mine):
                done = upto[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(upto, done + STEP, side="right")))
                left = np.repeat(np.arange(a, b), partners[a:b])
                right = np.repeat(first[a:b], partners[a:b]) + np.arange(len(left)) - np.repeat(upto[a:b] - partners[a:b] - done, partners[a:b])
                left, right = left[left != right], right[left != right]
                more = _distance(p[left], p[right]) - _distance(p[left], p0[right]) - _distance(p0[left], p[right]) + _distance(p0[left], p0[right])
                cell, at = np.unique((owner[left] * count + mine[left]) * count + mine[right], return_inverse=True)
                total = np.zeros(len(cell), np.int64)
                np.add.at(total, at, more)
                take = lambda d, i: d.dictionary.take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [take(langs, cell // (count * count)), take(sources, cell // count % count), take(sources, cell % count), pa.array(total)],
                    names=["lang", "source", "item", "value"],
                )
                a = b

    return shared.mapInArrow(add, "lang string, source string, item string, value long")


def _salted(rows: DataFrame, spread: list[str], groups: DataFrame, on: list[str]) -> DataFrame:
    """Join on few and uneven keys: rows are spread over parts by ``spread``, the groups stand in every part."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int"))
    return rows.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "_salt"]).drop("_salt")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language and the divergence from it. Part
    ``term``: the ``top`` terms that the source has more often than its language. A term
    is kept if ``least`` documents of the language hold it.
    """
    counts = term_counts(docs, text, lang, source)
    terms = counts.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("by"))
    terms = stage(terms.filter((F.col("texts") >= least) | F.col("term").isNull()), "divergence-terms")
    kept = terms.filter("term IS NOT NULL")
    each = kept.select("lang", "term", "n_lang", F.explode("by").alias("b")).select("lang", "term", "n_lang", "b.source", "b.n")
    groups = terms.filter("term IS NULL").select("lang", F.explode("by").alias("b")).select("lang", "b.source")
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    langs = kept.groupBy("lang").agg(F.sum("n_lang").alias("lang_total"), F.count("*").alias("terms"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    zero = F.lit(0).cast("long")
    groups = stage(groups.withColumn("p0", F.when(F.col("terms") > 0, rate(zero, F.col("total"), F.col("terms"))).otherwise(1)), "divergence-groups")
    rates = _salted(each, ["term"], groups, ["lang", "source"])
    rates = rates.select("lang", "source", "term", "p0", rate(F.col("n"), F.col("total"), F.col("terms")).alias("p"), rate(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    rates = stage(rates, "divergence-rates")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = rates.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)

    # what the terms of one source add beside a source that lacks them, in both directions
    same = rates.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o"), F.col("own_terms").alias("o_terms"))
    beside = _salted(same, ["source", "p"], others, ["lang"]).filter("source <> item")
    to, back = distance(F.col("p"), F.col("o")) * F.col("k"), distance(F.col("o"), F.col("p")) * F.col("k")
    beside = beside.groupBy("lang", "source", "item").agg(F.sum(to).alias("to"), F.sum(back).alias("back"))
    there = beside.select("lang", "source", "item", F.col("to").alias("value"))
    back_ = beside.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    neither = _salted(groups, ["source"], others, ["lang"]).filter("source <> item")
    neither = neither.select("lang", "source", "item", (distance(F.col("p0"), F.col("o")) * (F.col("terms") - F.col("own_terms") - F.col("o_terms"))).alias("value"))
    lists = rates.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("b"))
    shared = lists.filter(F.size("b") > 1).select("lang", F.col("b.source").alias("source"), F.col("b.p").alias("p"), F.col("b.p0").alias("p0"))
    parts = there.unionByName(back_).unionByName(neither).unionByName(_corrections(shared))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(cols).unionByName(told.withColumn("part", F.lit("term")).select(cols))
