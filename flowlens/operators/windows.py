"""Sequence windows and leak-free splits."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import blocked
from flowlens.operators.features import with_feature_vector
from flowlens.operators.snapshots import vote_array
from flowlens.policy import DEFAULT_SCHEME
from flowlens.session import stage

KEYS = ["source_file", "conversation_key"]
ORDER = ["ts_us", "row_id"]
_META = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def sequence_windows(
    rows: DataFrame,
    seq_len: int = 4,
    stride: int = 1,
    mode: str = "any_attack_priority",
    keys: Sequence[str] = KEYS,
    scheme: str = DEFAULT_SCHEME,
    order: Sequence[str] = ORDER,
    block_us: int | None = blocked.DAY_US,
) -> DataFrame:
    """Windows of ``seq_len`` consecutive rows of a key, every ``stride`` rows.

    Identity columns come from the first row of the key.  ``window`` is an array of feature vectors, ``start_us`` / ``end_us`` its
    bounds; the label is voted and an attack row makes the window an attack.
    ``block_us`` None: no key has more than a few rows, as the replay steps of one flow.
    """
    keys = list(keys)
    row = F.struct(
        F.col("feature_vector").alias("v"),
        F.col("label").alias("label"),
        F.col("is_attack").alias("a"),
        F.col("ts_us").alias("t"),
    )
    df = rows if "feature_vector" in rows.columns else with_feature_vector(rows, scheme)
    meta = [c for c in _META if c in df.columns and c not in keys]
    if block_us is not None:
        # the rows of each key are counted first
        used = [*keys, *order, *meta, "ts_us", "label", "is_attack", "feature_vector"]
        df = stage(df.select(*dict.fromkeys(used)), "sequence-rows")
    df = blocked.with_recent(
        df, keys, order, row, seq_len, None if block_us is None else blocked.time_block(block_us),
        name="_rows", number="_rn", first=F.struct(*meta) if meta else None,
    )
    start = F.col("_rn") - seq_len
    df = df.filter((F.col("_rn") >= seq_len) & (F.pmod(start, F.lit(max(1, stride))) == 0))
    label = vote_array(F.transform("_rows", lambda x: x["label"]), mode)
    return df.select(
        *keys,
        *[F.col(f"first.{c}").alias(c) for c in meta],
        (start + 1).alias("window_start"),
        label.alias("label"),
        F.array_max(F.transform("_rows", lambda x: x["a"])).alias("is_attack"),
        F.element_at("_rows", 1)["t"].alias("start_us"),
        F.element_at("_rows", -1)["t"].alias("end_us"),
        F.transform("_rows", lambda x: x["v"]).alias("window"),
    ).withColumn("label_index", S.label_index("label"))


def flat_window(c: str = "window") -> Column:
    return F.flatten(F.col(c))


def split_chronological(
    rows: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    gap: int = 1,
    seq_len: int = 4,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block_us: int = blocked.DAY_US,
) -> DataFrame:
    """Assign each row of a key to train, val or test by time, with gaps between.

    Gap rows, keys shorter than ``seq_len`` and segments shorter than
    ``seq_len`` are dropped.  Add ``split`` to the window keys afterwards and no
    window can cross a border.
    """
    df = blocked.ranked(rows, list(keys), order, blocked.time_block(block_us), "_rn", "_n")
    n, i = F.col("_n"), F.col("_rn") - 1
    e1 = F.least(F.greatest(F.lit(1), F.floor(n * float(train))), n)
    e2 = F.least(F.greatest(e1 + 1, F.floor(n * float(train + val))), n)
    v0, t0 = F.least(e1 + gap, n), F.least(e2 + gap, n)
    size = (
        F.when(i < e1, e1)
        .when((i >= v0) & (i < e2), e2 - v0)
        .when(i >= t0, n - t0)
    )
    split = F.when(i < e1, "train").when((i >= v0) & (i < e2), "val").when(i >= t0, "test")
    df = df.withColumns({"split": split, "_size": size})
    return df.filter((F.col("_n") >= seq_len) & (F.col("_size") >= seq_len)).drop("_rn", "_n", "_size")


def window_groups(windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: voted label, window count, first and last time."""
    keys = list(keys)
    per = windows.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.min("start_us").alias("_s"), F.max("end_us").alias("_e")
    )
    text = F.col("label")
    vote = F.struct(F.when(text != "Normal", F.col("_n")).otherwise(F.lit(0)), text)
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("n_windows"),
        F.min("_s").alias("start_us"),
        F.max("_e").alias("end_us"),
        F.max_by(text, vote).alias("label"),
    )


def _counts_for_label(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Validation and test group counts of a label with ``n`` groups."""
    one = F.lit(1)
    # shares are rounded half to even; 1.0 - train - val as written, to the last bit
    test0 = F.greatest(one, F.bround(n * F.lit(max(0.0, 1.0 - train - val)), 0).cast("long"))
    val0 = F.greatest(one, F.bround(n * F.lit(val), 0).cast("long"))
    # train takes back from val, then from test, until it has one group
    lack = F.greatest(F.lit(0), one - (n - val0 - test0))
    from_val = F.least(lack, val0 - 1)
    from_test = F.least(lack - from_val, test0 - 1)
    v = F.when(n <= 2, 0).otherwise(val0 - from_val)
    t = F.when(n <= 1, 0).when(n == 2, 1).otherwise(test0 - from_test)
    return v.cast("long"), t.cast("long")


def _hash_block(h: str) -> Column:
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("long")


def split_groups(
    groups: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    mode: str = "temporal",
    seed: str = "42",
    keys: Sequence[str] = KEYS,
    block_us: int = blocked.DAY_US,
) -> DataFrame:
    """Assign whole groups to splits, label by label.

    ``temporal`` holds out the latest groups of each label as test;
    ``stratified`` picks them by hash.  The rest is ordered by hash: the first
    go to val, the others to train.
    """
    keys = list(keys)
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k) for k in keys]))
    # the ranks below read the groups four times; windows are built once
    df = stage(groups, "groups").withColumn("_h", h)
    if mode == "temporal":
        order, block = ["start_us", "end_us", *reversed(keys)], blocked.time_block(block_us, "start_us")
    elif mode == "stratified":
        df = df.withColumn("_h0", F.md5(F.concat(F.lit("test|"), F.col("_h"))))
        order, block = ["_h0", *keys], _hash_block("_h0")
    else:
        raise ValueError(f"unknown hold-out mode {mode!r}")
    df = blocked.ranked(df, ["label"], order, block, "_rn", "_n")
    n_val, n_test = _counts_for_label(F.col("_n"), train, val)
    df = df.withColumns({"_nv": n_val, "_nt": n_test})
    held = F.col("_rn") > F.col("_n") - F.col("_nt") if mode == "temporal" else F.col("_rn") <= F.col("_nt")
    df = df.withColumn("_test", held)
    df = blocked.ranked(df, ["label", "_test"], ["_h", *keys], _hash_block("_h"), "_rr", "_m")
    in_val = (F.col("_rr") <= F.col("_nv")) & ~((F.col("_m") <= F.col("_nv")) & (F.col("_rr") == F.col("_m")))
    split = F.when(F.col("_test"), "test").when(in_val, "val").otherwise("train")
    return df.withColumn("split", split).drop("_h", "_h0", "_rn", "_n", "_nv", "_nt", "_test", "_rr", "_m")


def split_report(groups: DataFrame) -> DataFrame:
    """Groups and windows per split and label."""
    return groups.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_windows").alias("n_windows")
    )


def split_files(groups: DataFrame) -> DataFrame:
    """Groups per split and source file."""
    return groups.groupBy("split", "source_file").agg(F.count(F.lit(1)).alias("n_groups"))


def coverage_warnings(report: DataFrame, min_val: int = 1, min_test: int = 1) -> DataFrame:
    """Attack labels of the train split that lack validation or test groups."""
    of = lambda s: F.sum(F.when(F.col("split") == s, F.col("n_groups")).otherwise(0))
    per = report.groupBy("label").agg(of("train").alias("tr"), of("val").alias("va"), of("test").alias("te"))
    per = per.filter((F.col("label") != "Normal") & (F.col("tr") > 0))
    short = per.select(
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("val").alias("split"), F.col("va").alias("n_groups"), F.lit(min_val).alias("target")),
                F.struct(F.lit("test").alias("split"), F.col("te").alias("n_groups"), F.lit(min_test).alias("target")),
            )
        ).alias("w"),
    ).select("label", "w.*")
    return short.filter(F.col("n_groups") < F.col("target"))


def tail_ratio(
    rows: DataFrame, ratio: float, keys: Sequence[str] = ("source_file",), block_us: int = blocked.DAY_US
) -> DataFrame:
    """The last ``ceil(n * ratio)`` rows of each file by time (0 or 1: all rows)."""
    r = min(max(float(ratio), 0.0), 1.0)
    if r <= 0.0 or r >= 1.0:
        return rows
    df = blocked.ranked(rows, list(keys), ORDER, blocked.time_block(block_us), "_rn", "_n")
    keep = F.greatest(F.lit(1), F.ceil(F.col("_n") * r))
    return df.filter(F.col("_rn") > F.col("_n") - keep).drop("_rn", "_n")


def cap_train_normals(
    rows: DataFrame, max_rows: int, key: str = "row_id", seed: str = "42", label: str = "label"
) -> DataFrame:
    """Normal rows, cut to ``max_rows`` by hash order when there are more.

    4,096 hash buckets are counted first; whole buckets are kept or dropped and
    only the bucket on the border is ranked.
    """
    normal = rows.filter(F.col(label) == "Normal")
    if max_rows is None or max_rows <= 0:
        return normal
    df = normal.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    df = df.withColumn("_b", _hash_block("_h"))
    counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"), "_c")
    # at most 4,096 rows
    df = df.join(F.broadcast(starts), "_b").filter(F.col("_s") < max_rows)
    whole = df.filter(F.col("_s") + F.col("_c") <= max_rows)
    border = df.filter(F.col("_s") + F.col("_c") > max_rows)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    border = border.withColumn("_r", rank).filter(F.col("_s") + F.col("_r") <= max_rows).drop("_r")
    return whole.unionByName(border).drop("_h", "_b", "_s", "_c")
