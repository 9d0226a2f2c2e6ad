"""URL rules and a URL list behind a blocked Bloom filter.

``judge`` splits each URL into host and path, cuts the *candidate keys* that a list
entry could have (host suffixes at label borders x path prefixes of listed lengths),
asks a blocked Bloom filter about each key inside the task, and sends only the keys
that pass to an exact join with the list. The join removes false positives, so the
result doesn't depend on the filter's size.

The filter has at most 65,536 blocks of 512 bits (4 MB) whatever the list's length;
it is the only thing that is broadcast by hand.

Cases: a null URL or one without ``://`` has an empty host and path and gets the
default verdict; repeated rows are judged alike and all returned; an empty table gives
an empty result; other columns are kept, but host, path, rule and verdict are written anew. Of rules of equal length the one with the
longer host wins. A listed key that repeats counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textio import ascii_lower

MAX_BLOCKS, WORDS, BITS_PER_KEY = 1 << 16, 8, 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> np.ndarray:
    """Blocked Bloom filter: one block of eight words per key, one bit in each word.

    A 64-bit hash gives the block (its high 16 bits) and eight positions (six bits
    each). Built by a distributed bit_or; at most ``n_blocks`` rows reach the driver.
    """
    h = F.xxhash64(F.col(key))
    block = F.shiftrightunsigned(h, 48) % n_blocks
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63 AS INT))")).alias(f"w{i}") for i in range(WORDS)]
    out = np.zeros((n_blocks, WORDS), dtype=np.uint64)
    for r in keys.select(h.alias("h"), block.alias("block")).groupBy("block").agg(*bits).collect():
        out[r[0]] = np.array(r[1:], dtype=np.int64).view(np.uint64)
    return out


def _prober(filter_: np.ndarray, lengths: Sequence[int], max_labels: int):
    """Arrow function: (host, path) rows to (host, path, key) for keys that the filter passes."""
    n_blocks = len(filter_)
    rows = filter_.tolist()

    def passes(key: str) -> bool:
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        words = rows[(h >> 48) % n_blocks]
        return all(words[i] >> (h >> 6 * i & 63) & 1 for i in range(WORDS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, keys = [], [], []
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, at = [], len(host)
                while at >= 0 and len(starts) < max_labels:  # suffixes at label borders, shortest first
                    at = host.rfind(".", 0, at) if at else -1
                    starts.append(at + 1)
                prefixes = [path[:n] for n in lengths if n <= len(path)]
                for s in starts:
                    for p in prefixes:
                        if passes(key := host[s:] + p):
                            hosts.append(host)
                            paths.append(path)
                            keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (hosts, paths, keys)], names=["host", "path", "key"])

    return probe


def judge(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``listed``: host, path, verdict (allow or block), rank. Rank 1: a rule, whose key is
    returned; rank 0: an entry of the URL list, which counts where no rule fits. In a
    rank the longest key wins.
    """
    host, path = split_url(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    listed = listed.select(F.concat("host", "path").alias("key"), "host", F.length("path").alias("plen"), "verdict", "rank")
    size = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", "[.]"))).alias("labels")).first()
    lengths = sorted(r[0] for r in listed.select("plen").distinct().collect())  # as many as there are lengths of listed paths
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * WORDS * 64 < BITS_PER_KEY * size["n"]:
        n_blocks *= 2
    probe = _prober(bloom_blocks(listed, "key", n_blocks), lengths, size["labels"] or 0)
    possible = pages.select("host", "path").mapInArrow(probe, "host string, path string, key string")
    best = F.max(F.struct("rank", F.length("key").alias("n"), F.length("listed_host").alias("m"), "key", "verdict")).alias("url_filter_best")
    hits = possible.join(listed.withColumnRenamed("host", "listed_host"), "key").groupBy("host", "path").agg(best)
    return pages.join(hits, ["host", "path"], "left").withColumns(
        {"rule": F.when(F.col("url_filter_best.rank") == 1, F.col("url_filter_best.key")), "verdict": F.coalesce("url_filter_best.verdict", F.lit("allow"))}
    ).drop("url_filter_best")
