"""SimHash near-copies with a pigeonring filter, and components of linked fingerprints.

Two fingerprints of 64 bits link at 2 or fewer differing bits. Cut a fingerprint into 16
segments of 4 bits on a ring. If two fingerprints differ in at most 2 bits, some start on
the ring begins a chain whose first i segments hold at most 2 * i / 16 differences, for
every i: seven equal segments (28 bits), at most one difference in the next eight (32
bits), and at most two in all. Candidates share the 28 equal bits of a start and one
exactly equal half of the next 32 bits; candidates that break the chain are dropped before
the full Hamming check.

Only distinct fingerprints are compared, so exact copies cost nothing. A key held by two
fingerprints yields its pair straight from min and max. In a key held by more than
``SMALL`` fingerprints the 32 bits are cut finer: at most one difference leaves 3 of 4
quarters or 7 of 8 eighths equal, so the finer keys lose no pair; at the last level a key
fixes 56 bits and cannot hold more than 256 fingerprints.

Components come from alternating large-star and small-star steps, each written to the
shared folder; nothing about documents, links or components reaches the driver but counts.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other;
a null id never wins the smallest id (a component of null ids only has a null id); repeated
rows are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.session import stage

SMALL = 16
_CHUNK = 8192


def _fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: only ASCII case, only ASCII white space
    n = len(words)
    if not n:
        return 0
    line, xx = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        h = np.array([xx(line, 42)], dtype=np.uint64)
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0] + [e + 1 for e in ends]
        h = np.fromiter((xx(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :])), dtype=np.uint64, count=n - width + 1)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column | str, width: int = 3) -> Column:
    """SimHash over word shingles as a long."""

    @F.arrow_udf("long")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(t.as_py(), width) for t in v], pa.int64())

    return run(text)


def _rotated(r: int) -> Column:
    fp = F.col("fp")
    return fp if r == 0 else F.shiftleft(fp, 4 * r).bitwiseOR(F.shiftrightunsigned(fp, 64 - 4 * r))


def _keys(rows: DataFrame, parts: int) -> DataFrame:
    """(fp, r) to (key, fp, r): the 28 bits of a start and the next 32 bits without one of ``parts`` parts.

    With two parts a key is one equal half; the start and the part number go along.
    """
    low, width = F.shiftrightunsigned(F.col("rot"), 4).bitwiseAND(F.lit(0xFFFFFFFF)), 32 // parts
    masks = [0xFFFFFFFF ^ ((1 << width) - 1 << width * i) for i in range(parts)]
    key = F.array(*[
        F.struct(F.shiftrightunsigned("rot", 36).alias("head"), low.bitwiseAND(F.lit(m)).alias("body"), (F.col("r") * 8 + i).alias("part")) for i, m in enumerate(masks)
    ])
    return rows.withColumn("rot", F.col("rot")).select("fp", "r", F.explode(key).alias("key"))


def _starts(distinct: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(r).alias("r"), _rotated(r).alias("rot")) for r in range(16)])
    return distinct.select("fp", F.explode(each).alias("s")).select("fp", "s.r", "s.rot")


def _viable(pairs: DataFrame) -> DataFrame:
    """Chain condition, then the full check."""
    diff = F.col("a").bitwiseXOR(F.col("b"))
    turned = F.when(F.col("r") == 0, diff).otherwise(
        F.expr("shiftleft(a ^ b, cast(4 * r AS INT)) | shiftrightunsigned(a ^ b, cast(64 - 4 * r AS INT))")
    )
    chain = F.bit_count(F.shiftrightunsigned(turned, 4)) <= 1  # the first 15 segments; 7 are equal by the key
    return pairs.filter(chain).filter(F.bit_count(diff) <= 2).select("a", "b")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most 2 bits."""
    # spread first: each fingerprint becomes 32 rows, and a task should hold few
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out, rows = [], _starts(distinct)
    for parts in (2, 4, 8):
        keyed = _keys(rows, parts)
        held = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.first("r").alias("r"))
        held = stage(held.filter("n > 1"), "simhash-keys")
        out.append(_viable(held.filter("n = 2")))
        more = keyed.join(held.filter("n > 2").select("key", "n"), "key")
        more = stage(more, "simhash-crowded")
        few = more if parts == 8 else more.filter(F.col("n") <= SMALL)
        left, right = few.select("key", "r", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
        out.append(_viable(left.join(right, "key").filter("a < b")))
        crowd = more.filter(F.col("n") > SMALL).select("fp", "r").distinct()
        if parts == 8 or crowd.isEmpty():
            break
        rows = crowd.withColumn("rot", F.when(F.col("r") == 0, F.col("fp")).otherwise(
            F.expr("shiftleft(fp, cast(4 * r AS INT)) | shiftrightunsigned(fp, cast(64 - 4 * r AS INT))")
        ))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        after = print_of(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, component_id, keep_fp, copies) for every distinct fingerprint of (key, fp) rows.

    component_id: smallest key of the component; keep_fp: the smallest fingerprint that has it.
    """
    distinct = stage(prints.groupBy("fp").agg(F.min(key).alias("first_key"), F.count("*").alias("copies")), "fingerprints")
    joined = components(links(distinct.select("fp")))
    rooted = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first_key", "copies", "root")
    alone = rooted.filter(F.col("root").isNull()).select("fp", F.col("first_key").alias("component_id"), F.col("fp").alias("keep_fp"), "copies")
    best = F.min(F.struct(F.col("first_key").isNull().alias("none"), "first_key", "fp")).alias("best")
    linked = rooted.filter(F.col("root").isNotNull())
    named = linked.groupBy("root").agg(best)
    linked = linked.join(named, "root").select("fp", F.col("best.first_key").alias("component_id"), F.col("best.fp").alias("keep_fp"), "copies")
    return alone.unionByName(linked)


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id."""
    prints = stage(docs.select(key, fingerprint(F.col(text), width).alias("fp")), "prints")
    out = prints.join(classes(prints, key), "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with the smallest key.

    Repeated rows count as copies of each other. Columns are those of ``docs``.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    packed = stage(packed.withColumn("fp", fingerprint(F.col(f"row.`{text}`"), width)), "prints")
    prints = packed.select(F.col(f"row.`{key}`").alias("key"), "fp")
    chosen = classes(prints, "key").filter(F.col("fp") == F.col("keep_fp")).select(F.col("fp").alias("fp_"), F.col("component_id").alias("key_"))
    rows = packed.join(chosen, (F.col("fp") == F.col("fp_")) & F.col(f"row.`{key}`").eqNullSafe(F.col("key_")))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("fp_", "key_").orderBy("key_"))).filter("copy = 1")
    return rows.select("row.*")
