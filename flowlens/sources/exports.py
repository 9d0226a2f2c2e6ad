"""File sources and sinks: flow exports, replay tables, prepared splits, alerts."""

from __future__ import annotations

import csv
import json
import uuid
from contextlib import contextmanager
from functools import reduce
from typing import Callable, Iterator, Mapping, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions import scalars as S
from flowlens.operators import features
from flowlens.session import stage

# Columns a flow export must have, with our names.
EXPORT_COLUMNS = {
    "Flow ID": "flow_id",
    "Src IP": "src_ip",
    "Dst IP": "dst_ip",
    "Src Port": "src_port",
    "Dst Port": "dst_port",
    "Protocol": "protocol",
    "Timestamp": "timestamp",
    "Flow Duration": "duration_us",
    "Tot Fwd Pkts": "fwd_pkts",
    "Tot Bwd Pkts": "bwd_pkts",
    "TotLen Fwd Pkts": "fwd_bytes",
    "TotLen Bwd Pkts": "bwd_bytes",
    "Label": "label_raw",
}
# File names of the export.
DEFAULT_FILES = ["Normal_data.csv", "OVS.csv", "metasploitable-2.csv"]

# Header spellings of the alternate export, in order of preference.
ALTERNATE_ALIASES = {
    "src_port": ["Source Port", "Src Port", "source port"],
    "dst_port": ["Destination Port", "Dst Port", "destination port"],
    "protocol": ["Protocol", "protocol"],
    "duration_us": ["Flow Duration"],
    "fwd_pkts": ["Total Fwd Packets", "Tot Fwd Pkts"],
    "bwd_pkts": ["Total Backward Packets", "Tot Bwd Pkts"],
    "fwd_bytes": ["Total Length of Fwd Packets", "TotLen Fwd Pkts"],
    "bwd_bytes": ["Total Length of Bwd Packets", "TotLen Bwd Pkts"],
    "byte_rate_raw": ["Flow Bytes/s", "Flow Byts/s"],
    "packet_rate_raw": ["Flow Packets/s", "Flow Pkts/s"],
    "fwd_packet_rate": ["Fwd Packets/s", "Fwd Pkts/s"],
    "bwd_packet_rate": ["Bwd Packets/s"],
    "label_raw": ["Label", "label", "Class"],
}
_ALTERNATE_DEFAULTS = {"src_port": "-1", "dst_port": "-1", "protocol": "-1", "label_raw": "Normal"}


_PLACE = ["source_file", "_part", "_split", "_mid"]


@contextmanager
def _one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Each task reads one file (or one split of a large one), however small the files are."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a task; the rest of its file is left unread."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Data files under ``path`` by their header, read by the executors: one task and one line per file."""
    try:
        lines = spark.read.option("recursiveFileLookup", True).text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no CSV file with a header under {path}") from e
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    with _one_file_a_task(spark):
        heads = lines.mapInArrow(_first_line, "file string, at long, value string").filter("at = 0 AND value <> ''")
        # the reader of each group takes its list of files from the driver anyway
        by_line = heads.groupBy(F.regexp_replace("value", "^\ufeff", "").alias("line")).agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    found: dict[tuple[str, ...], list[str]] = {}
    for r in by_line:
        found.setdefault(tuple(c.strip() for c in next(csv.reader([r["line"]]))), []).extend(r["files"])
    if not found:
        raise FileNotFoundError(f"no CSV file with a header under {path}")
    return {header: sorted(files) for header, files in found.items()}


def _csv_groups(spark: SparkSession, path: str, tag: str | None = None) -> list[DataFrame]:
    """One all-text frame per header found under ``path``, with the place of each row.

    Files with another order or spelling of columns are never read under one header.
    """
    out = []
    for header, files in sorted(_headers(spark, path).items()):
        names = [c if c and c not in header[:i] else f"{c}#{i}" for i, c in enumerate(header)]
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])
        raw = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", quote='"', escape='"').csv(files)
        out.append(
            raw.select(
                *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)],
                (F.lit(tag) if tag else F.col("_metadata.file_name")).alias("source_file"),
                F.col("_metadata.file_path").alias("_part"),
                F.col("_metadata.file_block_start").alias("_split"),
                F.monotonically_increasing_id().alias("_mid"),
            )
        )
    return out


def _numbered(groups: Sequence[DataFrame]) -> DataFrame:
    """Union of the groups with ``row_id``: the row's number in its source, from 0.

    Rows of a file split keep their order and a table of one row per split supplies the offset.
    The rows are staged, so that numbers and offsets come from the same reading.
    """
    raw = stage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups), "raw-rows")
    place = _PLACE[:3]
    splits = raw.groupBy(*place).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_part", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        raw.join(offsets, place)
        .withColumn("row_id", F.col("_offset") + F.col("_mid") - F.col("_first"))
        .drop("_part", "_split", "_mid", "_first", "_offset")
    )


def _csv(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """CSV file or folder, all text, trimmed headers; ``source_file`` is ``tag`` or the file name."""
    return _numbered(_csv_groups(spark, path, tag))


def read_flow_export(
    spark: SparkSession, path: str, files: Sequence[str] | None = None, require: bool = True
) -> DataFrame:
    """Completed-flow CSVs of a folder as typed flow rows with features and labels."""
    parts = []
    for name in files or DEFAULT_FILES:
        raw = _csv(spark, f"{path}/{name}", name)
        missing = [c for c in EXPORT_COLUMNS if c not in raw.columns]
        if missing and require:
            raise ValueError(f"{name} is missing required columns: {missing}")
        parts.append(
            raw.select(
                *[F.col(f"`{c}`").alias(n) for c, n in EXPORT_COLUMNS.items() if c in raw.columns],
                "source_file",
                "row_id",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return typed_flows(out)


def typed_flows(raw: DataFrame) -> DataFrame:
    """All-text export columns to flow rows: types, time, features, labels, key."""
    ports, counts = ("src_port", "dst_port", "protocol"), ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration_us")
    text = {c: F.coalesce(S.strip(c), F.lit("")) for c in ("flow_id", "src_ip", "dst_ip")}
    df = S.with_numbers(raw, dict.fromkeys([*ports, *counts], 0.0))
    df = df.withColumns({**{c: F.col(c).cast("long") for c in ports}, **text})
    df = df.withColumn("parsed_timestamp", S.parse_ts("timestamp", "row_id"))
    df = df.withColumn("ts_us", F.unix_micros("parsed_timestamp"))
    df = features.with_label_columns(features.with_flow_features(df))
    return features.with_key(df, "service")


def _fold_header(name: str) -> str:
    return " ".join(name.strip().lower().replace("_", " ").replace("-", " ").split())


def resolve_aliases(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALTERNATE_ALIASES,
    defaults: Mapping[str, str] | None = None,
    keep: Sequence[str] = ("source_file", "row_id"),
) -> DataFrame:
    """Select canonical columns by the first header spelling that exists."""
    defaults = {**_ALTERNATE_DEFAULTS, **(defaults or {})}
    have = {_fold_header(c): c for c in df.columns}
    cols = []
    for key, names in aliases.items():
        hit = next((have[_fold_header(n)] for n in names if _fold_header(n) in have), None)
        default = F.lit(defaults.get(key, "0.0"))
        cols.append((F.col(f"`{hit}`") if hit is not None else default).alias(key))
    return df.select(*[F.col(c) for c in keep if c in df.columns], *cols)


def read_alternate_export(spark: SparkSession, path: str, scheme: str = "telemetry_v2") -> DataFrame:
    """Alternate flow export (no addresses) as telemetry rows; every file by its own header."""
    groups = [resolve_aliases(g, keep=_PLACE) for g in _csv_groups(spark, path)]
    return alternate_rows(_numbered(groups), scheme)


def alternate_rows(df: DataFrame, scheme: str = "telemetry_v2") -> DataFrame:
    ports = ("src_port", "dst_port", "protocol")
    rates = ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration_us", "packet_rate_raw", "byte_rate_raw")
    df = S.with_numbers(df, {**dict.fromkeys(ports, -1.0), **dict.fromkeys(rates, 0.0)})
    df = df.withColumns({c: F.col(c).cast("long") for c in ports})
    df = df.withColumn("source_file", F.regexp_replace("source_file", r"\.[^.]*$", ""))
    df = df.withColumn("ts_us", F.col("row_id") * 1000)
    df = features.with_label_columns(features.with_alt_flow_features(df, scheme))
    return features.with_key(df, "file_service")


# --- replay tables -----------------------------------------------------------


def replay_rows(df: DataFrame) -> DataFrame:
    """Observation columns of a replay table, absent ones defaulted.

    Zero ports and protocols stay zero.
    """
    have = set(df.columns)

    def text(name: str, default: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)

    def number(names: Sequence[str], default: float):
        picks = [S.col_of(n) for n in names if n in have]
        return S.num(F.coalesce(*picks), default) if picks else F.lit(default)

    src, dst = text("src_ip", "0.0.0.0"), text("dst_ip", "0.0.0.0")
    dport = number(["dst_port"], -1.0).cast("long")
    fallback = F.concat(src, F.lit("->"), dst, F.lit(":"), dport.cast("string"))
    keys = [F.col(c).cast("string") for c in ("flow_key", "conversation_key") if c in have]
    cols = {
        "flow_key": F.coalesce(*keys, fallback),
        "dpid": number(["switch_id", "dpid"], 0.0).cast("long"),
        "src_ip": src,
        "dst_ip": dst,
        "src_port": number(["src_port"], -1.0).cast("long"),
        "dst_port": dport,
        "protocol": number(["protocol"], -1.0).cast("long"),
        "flow_duration_s": number(["flow_duration_s", "duration_s"], 0.0),
        "has_history": number(["has_history"], 1.0) != 0,
        "label": text("label", "Normal"),
        "source_file": text("source_file", "unknown"),
    }
    for c in (
        "packet_count", "byte_count", "packet_rate", "byte_rate", "avg_packet_size",
        "packet_delta", "byte_delta", "packet_rate_delta", "byte_rate_delta",
        "src_port_norm", "dst_port_norm", "protocol_tcp", "protocol_udp", "protocol_icmp",
    ):
        cols[c] = number([c], 0.0)
    keep = [F.col(c).cast("long").alias(c) for c in ("row_id", "ts_us", "poll_step") if c in have]
    keep += [F.col("parsed_timestamp")] if "parsed_timestamp" in have else []
    out = df.select(*keep, *[v.alias(k) for k, v in cols.items()])
    if "ts_us" not in have and "parsed_timestamp" in have:
        out = out.withColumn("ts_us", F.unix_micros(F.col("parsed_timestamp").try_cast("timestamp")))
    return out


def replay_order(df: DataFrame) -> DataFrame:
    """Rows in time order (range-partitioned sort)."""
    return df.orderBy(*[c for c in ("ts_us", "row_id", "poll_step", "flow_key") if c in df.columns])


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    return replay_order(replay_rows(_csv(spark, path)))


# --- prepared splits -----------------------------------------------------------


_SIDECAR = "_prepared.json"


def write_prepared(
    df: DataFrame, path: str, keys: Sequence[str] = (), order: Sequence[str] = (), buckets: int = 8,
    stats: Mapping[str, Mapping[str, float]] | None = None, scheme: str | None = None, settings: Mapping[str, object] | None = None,
) -> None:
    """Splits as a table: a folder per split, bucketed by ``keys`` and sorted by ``order``.

    A sidecar holds what the rows were made with: scaler statistics per feature, feature
    scheme, settings, and the layout. It is written last, so a table without it is not whole.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != "split"]
    name = f"prepared_{uuid.uuid4().hex}"
    writer = df.select(*others, "split").write.partitionBy("split").format("parquet").option("path", path)
    if keys:
        writer = writer.bucketBy(buckets, *keys).sortBy(*[*keys, *order])
    writer.saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    about = {
        "schema": json.loads(df.select(*others, "split").schema.json()), "keys": list(keys), "order": list(order), "buckets": buckets if keys else 0,
        "scheme": scheme, "stats": {k: dict(v) for k, v in (stats or {}).items()}, "settings": dict(settings or {}),
    }
    write_text(spark, f"{path}/{_SIDECAR}", json.dumps(about, sort_keys=True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system of the session."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def prepared_metadata(spark: SparkSession, path: str) -> dict:
    """What a prepared table was made with: scheme, scaler statistics, settings, layout."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_SIDECAR}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} is not a whole prepared table: {_SIDECAR} is missing")
    file = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    finally:
        file.close()


def read_prepared(spark: SparkSession, path: str, split: str | None = None, scheme: str | None = None) -> DataFrame:
    """Prepared rows with their buckets known to Spark, so a window or join by the keys needs no exchange.

    ``split`` prunes to one folder. ``scheme`` must be that of the sidecar, and the files must
    have its columns.
    """
    about = prepared_metadata(spark, path)
    if scheme is not None and about["scheme"] != scheme:
        raise ValueError(f"{path} holds scheme {about['scheme']!r}, not {scheme!r}")
    schema = T.StructType.fromJson(about["schema"])
    kinds = lambda s: {f.name: f.dataType for f in s.fields if f.name != "split"}
    if kinds(spark.read.parquet(path).schema) != kinds(schema):
        raise ValueError(f"the files under {path} do not have the columns of their sidecar")
    name = f"prepared_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    layout = ""
    if about["buckets"]:
        layout = f"CLUSTERED BY ({quoted(about['keys'])}) SORTED BY ({quoted([*about['keys'], *about['order']])}) INTO {about['buckets']} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (split) {layout} LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    df = spark.table(name)
    return df.filter(F.col("split") == split) if split else df


# --- sinks ----------------------------------------------------------------------


def write_once(df: DataFrame, path: str) -> bool:
    """Write a folder that appears whole or not at all; one that is there is left as it is.

    Rows go to a hidden folder beside it, which is renamed when it is complete. So a repeated
    job or micro-batch adds nothing, and no reader sees a part. Needs a file system that
    renames a folder in one step.
    """
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    target = make(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    hidden = make(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    df.write.parquet(hidden.toString())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(hidden, target):  # another attempt was faster
        fs.delete(hidden, True)
        return False
    return True


def write_rows(df: DataFrame, path: str, run: str) -> bool:
    """Add the rows of a run to a table (partition ``run``), once however often it is called."""
    return write_once(df, f"{path}/run={quote(run, safe='')}")


write_alerts = write_rows
write_scores = write_rows


def stream_once(df: DataFrame, path: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Add each micro-batch to a table (partition ``batch``), after ``finish``; a repeated one adds nothing."""

    def on_batch(batch: DataFrame, n: int) -> None:
        write_once(finish(batch) if finish else batch, f"{path}/batch={n}")

    return df.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_rows(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exactly-once append of a stream to a table (alerts, scores, observations)."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# Columns of a telemetry sample.
TELEMETRY_COLUMNS = [
    "ts_us", "entity_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "packet_rate", "byte_rate", "packet_delta", "byte_delta",
    "packet_rate_delta", "byte_rate_delta", "has_history",
]


def sample_telemetry(df: DataFrame, n: int = 5, row_id: str = "row_id") -> DataFrame:
    """Every n-th observation, chosen by its row id so that reruns agree."""
    return df if n <= 1 else df.filter(F.pmod(F.col(row_id), F.lit(n)) == 0)


def export_alerts(alerts: DataFrame, run_id: str | None, path: str) -> None:
    """Alerts of one run as CSV with a header; quotes doubled."""
    if run_id is not None:
        alerts = alerts.filter(F.col("run_id") == run_id)
    alerts.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def conversion_manifest(df: DataFrame) -> DataFrame:
    """Rows, attack rows and normal rows per file, and in total (``file`` = ``TOTAL``)."""
    return (
        df.rollup("source_file")
        .agg(
            F.grouping("source_file").alias("_all"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("is_attack").alias("attack_rows"),
        )
        .select(
            F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("source_file")).alias("file"),
            "n_rows",
            "attack_rows",
            (F.col("n_rows") - F.col("attack_rows")).alias("normal_rows"),
        )
    )
