"""Benchmark decontamination by greedy string tiling.

1. Every benchmark text is cut into words (lower case, letters and digits) and rolling
   grams of ``width`` words (all its words, if it has fewer), hashed as in Karp-Rabin.
2. A table of 2^24 bits tells, inside the task, which grams of a document can be seeds.
   Only runs of words under such grams leave the task. The table's size doesn't depend on
   the benchmark's; a fuller table lets more runs through and changes no result.
3. Tiles that cover ``share`` of an item hold at least a ``width``-th of that many of its
   grams. So as many of its grams, less one, may be left out of the join, and the ones that
   most documents have are: a phrase of every prompt pairs nothing. Seeds join the grams that
   are left on the hash; each (document, item) with a seed is a candidate.
4. For each candidate, greedy string tiling over the document's runs: the longest unmarked
   common stretch (ties: first in the item, then in the document) is marked, again and again,
   until none of ``width`` words is left. Its length is found by halving: Karp-Rabin hashes of
   all windows of a length, taken from running prefix hashes, are compared at once, and a hit
   is compared word by word. Tiles never overlap and keep no order, so reordered passages are
   covered as well.
5. The document is contaminated by an item if tiles cover at least ``share`` of its words.

Every tile of ``width`` words lies in a run, so step 2 loses none. With n words in the item and
m in the runs, a candidate takes at most n / width tiles of (n + m) log n steps each, however
repetitive both are.

Cases: null and empty texts and items match nothing; an item shorter than ``width`` words
is matched whole; repeated items each count, repeated documents are one result row each
distinct (key, text); an empty table gives an empty result; other columns are ignored. Keys of
documents and items may be of any type that Arrow carries, and null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.textio import values
from flowlens.session import stage

BITS = 24
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each ``width`` neighbouring words, mixed so that high bits can index."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _BASE + hashes[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29)) ^ np.uint64(width)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(self) < 100_000:
            self[word] = h
        return h


def _hash_words(words: list[str], memory: _Hashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def benchmark_grams(items: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """(item_id, words, width, grams) of every item with a word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column(0), values(batch.column(1))):
                words = words_of(t)
                if words:
                    w = min(width, len(words))
                    out.append((k.as_py(), words, w, grams_of(_hash_words(words, memory), w).view(np.int64).tolist()))
            cols = list(zip(*out)) or [[], [], [], []]
            types = [batch.column(0).type, pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "words", "width", "grams"])

    source = items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(cut, f"item_id {source.schema['item_id'].dataType.simpleString()}, words array<string>, width int, grams array<long>")


def seed_table(grams: DataFrame) -> np.ndarray:
    """Bit table of the grams' high bits, built by a distributed bit_or of 64-bit cells."""
    at = F.shiftrightunsigned("gram", 64 - BITS)
    cells = grams.select((F.shiftright(at, 6)).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 AS INT))").alias("bit"))
    out = np.zeros(1 << BITS - 6, np.uint64)
    for cell, bits in cells.groupBy("cell").agg(F.bit_or("bit")).collect():  # at most 2^18 rows
        out[cell] = np.int64(bits).view(np.uint64)
    return out


def _runs(cells: np.ndarray, widths: list[int]):
    """Arrow function: (key, th, text) rows to runs of words under possible seeds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memory, shift = cells.view(np.uint8), _Hashes(), np.uint64(64 - BITS)
        for batch in batches:
            out: list[tuple] = []
            for k, th, t in zip(batch.column(0), batch.column(1), values(batch.column(2))):
                words = words_of(t)
                hashes = _hash_words(words, memory)
                seeds, cover = [], None
                for w in widths:
                    grams = grams_of(hashes, w)
                    at = grams >> shift
                    hit = np.flatnonzero(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    if len(hit):
                        if cover is None:
                            cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + w, -1)
                        seeds.append((hit, grams[hit].view(np.int64)))
                if cover is None:
                    continue
                inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
                edges = np.diff(inside)
                for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
                    found = [int(g) for hit, grams in seeds for g in grams[(hit >= a) & (hit < b)]]
                    out.append((k.as_py(), th.as_py(), a, words[a:b], sorted(set(found))))
            cols = list(zip(*out)) or [[]] * 5
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "th", "at", "run", "grams"])

    return find


class _Windows:
    """Karp-Rabin hashes of all windows of any length of a sequence, and which windows are unmarked."""

    def __init__(self, ids: np.ndarray, power: np.ndarray):
        self.ids, self.power = ids, power
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        # running hash: sum of ids times powers, so that a window is a difference brought to a common power
        self.run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[: len(ids)], dtype=np.uint64)])
        self.marked = np.zeros(len(ids) + 1, np.int64)

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the unmarked windows of ``size`` words, in order."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.flatnonzero(self.marked[size : size + n] == self.marked[:n])
        top = len(self.power) - 1
        return start, (self.run[start + size] - self.run[start]) * self.power[top - start]

    def mark(self, start: int, size: int) -> None:
        self.marked[start + 1 :] += np.minimum(np.arange(1, len(self.marked) - start), size)


def _meet(a: _Windows, b: _Windows, size: int) -> tuple[int, int] | None:
    """First common unmarked window of ``size`` words: first in ``a``, then in ``b``."""
    at_a, hash_a = a.free(size)
    at_b, hash_b = b.free(size)
    if not len(at_a) or not len(at_b):
        return None
    for i in np.flatnonzero(np.isin(hash_a, hash_b)).tolist():
        for j in np.flatnonzero(hash_b == hash_a[i]).tolist():
            x, y = int(at_a[i]), int(at_b[j])
            if np.array_equal(a.ids[x : x + size], b.ids[y : y + size]):
                return x, y
    return None


def tile(item: list[str], runs: list[list[str]], least: int) -> list[tuple[int, int, int, int]]:
    """Tiles (item start, run number, run start, length), the longest first."""
    number: dict[str, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    known = len(number)
    flat, begins = [], []
    for r in runs:
        begins.append(len(flat))
        flat += [number.get(w, -1) for w in r] + [-1]  # a border matches nothing
    b = np.array(flat, np.int64)
    strange = np.flatnonzero(b < 0)
    b[strange] = known + np.arange(len(strange))
    least = max(1, min(least, len(a)))
    top = max(len(a), len(b), 1)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(top, _BASE)]), dtype=np.uint64)
    left, right = _Windows(a, power), _Windows(b, power)
    out: list[tuple[int, int, int, int]] = []
    most = min(len(a), max(map(len, runs), default=0))
    while most >= least:
        hit = _meet(left, right, most)
        if hit is None:  # the longest common stretch is shorter; a stretch holds all shorter ones
            low, high = least - 1, most
            while high - low > 1:
                size = (low + high) // 2
                found = _meet(left, right, size)
                if found is None:
                    high = size
                else:
                    low, hit = size, found
            most = low
            if hit is None:
                break
        i, j = hit
        left.mark(i, most)
        right.mark(j, most)
        run = int(np.searchsorted(begins, j, side="right")) - 1
        out.append((i, run, j - begins[run], most))
    return out


def _covered(item: list[str], runs: list[list[str]], least: int) -> tuple[int, int]:
    tiles = tile(item, runs, least)
    return sum(t[3] for t in tiles), len(tiles)


def _indexed(bench: DataFrame, seen: DataFrame, share: float) -> DataFrame:
    """(item_id, gram) that are enough to find every contaminated document: each item without its most common grams.

    ``seen``: documents per gram. Of an item's grams all are left but as many, less one, as
    tiles over ``share`` of its words must hold.
    """
    one = bench.dropDuplicates(["item_id", "words"]).select("item_id", "width", F.size("words").alias("n"), F.xxhash64("item_id", "words").alias("item"), "grams")
    at = one.select("item_id", "width", "n", "item", F.posexplode("grams").alias("pos", "gram"))
    must = F.greatest(F.ceil(F.ceil(F.col("n") * share - 1e-9) / F.col("width")), F.lit(1))
    by = Window.partitionBy("item_id", "item").orderBy(F.coalesce("docs", F.lit(0)), "pos")
    ranked = at.join(seen, "gram", "left").withColumns({"rank": F.row_number().over(by), "most": F.col("n") - F.col("width") + 1 - must + 1})
    return ranked.filter(F.col("rank") <= F.col("most")).select("item_id", "gram").distinct()


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", width: int = 5, share: float = 0.8) -> DataFrame:
    """Pairs (key, th, item_id, n_item_words, n_covered, n_tiles, coverage) of contaminated documents; th is the text's hash."""
    bench = stage(benchmark_grams(items, width, text, item_key), "benchmark")
    grams = bench.select(F.explode("grams").alias("gram")).distinct()
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # at most ``width`` values
    source = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    runs = source.mapInArrow(_runs(seed_table(grams), widths), f"key {kind}, th long, at long, run array<string>, grams array<long>")
    runs = stage(runs, "runs")
    seeds = runs.select("key", "th", F.explode("grams").alias("gram"))
    index = stage(_indexed(bench, seeds.groupBy("gram").agg(F.count("*").alias("docs")), share), "seed-index")
    pairs = seeds.join(index, "gram").select("key", "th", "item_id").distinct()
    text_of = runs.select("key", "th", "at", "run").dropDuplicates(["key", "th", "at"])
    both = pairs.alias("p").join(text_of.alias("t"), F.expr("p.key <=> t.key AND p.th = t.th")).select("p.key", "p.th", "p.item_id", "t.at", "t.run")
    each = both.groupBy("key", "th", "item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "run"))), lambda x: x["run"]).alias("runs"))
    items_ = bench.groupBy("item_id", "words").agg(F.count("*").alias("copies"))

    @F.arrow_udf("n_covered long, n_tiles long")
    def cover(item: pa.Array, run: pa.Array) -> pa.Array:
        got = [_covered(i, r, width) for i, r in zip(item.to_pylist(), run.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["n_covered", "n_tiles"])

    done = each.join(items_, each["item_id"].eqNullSafe(items_["item_id"])).select("key", "th", each["item_id"], "words", cover("words", "runs").alias("c"))
    part = F.col("c.n_covered") / F.size("words")
    done = done.select("key", "th", "item_id", F.size("words").cast("long").alias("n_item_words"), "c.n_covered", "c.n_tiles", F.round(part, 6).alias("coverage"))
    return done.filter(F.col("n_covered") >= share * F.col("n_item_words")).withColumnRenamed("key", key)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = leaks(docs, items, text, key, **how).select(F.col(key).alias("key"), "th").distinct().alias("leak")
    own = docs.alias("doc")
    hit = F.col(f"doc.`{key}`").eqNullSafe(F.col("leak.key")) & (F.xxhash64(F.coalesce(f"doc.`{text}`", F.lit(""))) == F.col("leak.th"))
    return own.join(bad, hit, "left_anti")
