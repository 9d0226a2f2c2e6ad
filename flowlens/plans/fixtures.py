"""Reference-shaped input tables derived from the ``events`` table.

``SQL`` holds the derivations as one text for both engines (``{us}`` and
``{str}`` differ); the oracles prepend them as CTEs.  On Spark the cumulative
table ``poll_stats`` is built with the blocked running sums, so that a busy
user does not become one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import blocked

SPARK_US = "unix_micros(cast(ts AS TIMESTAMP))"
DUCK_US = "epoch_us(ts)"
PERIOD_US = 864_000_000_000

SQL = {
    "flow_export": """
SELECT event_id AS row_id, concat('f', cast(event_id AS STRING)) AS flow_id,
 concat('10.0.0.', cast(user_id % 20 AS STRING)) AS src_ip, concat('10.0.1.', cast(user_id % 3 AS STRING)) AS dst_ip,
 cast(CASE WHEN event_id % 17 = 0 THEN 443 ELSE 1024 + (user_id * 7919) % 50000 END AS BIGINT) AS src_port,
 cast(CASE WHEN event_id % 17 = 0 THEN 1024 + event_id % 5000 WHEN event_id % 5 = 0 THEN 22 ELSE cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT) END AS BIGINT) AS dst_port,
 cast(CASE WHEN event_id % 10 < 6 THEN 6 WHEN event_id % 10 < 9 THEN 17 ELSE 1 END AS BIGINT) AS protocol,
 ts, {us} AS ts_us,
 cast(floor(value * 100000) AS BIGINT) AS duration_us,
 cast(floor(value) AS BIGINT) + 1 AS fwd_pkts, event_id % 50 AS bwd_pkts,
 (cast(floor(value) AS BIGINT) + 1) * 60 AS fwd_bytes, (event_id % 50) * 500 AS bwd_bytes,
 CASE event_type WHEN 'click' THEN 'Normal' WHEN 'view' THEN 'BENIGN' WHEN 'purchase' THEN ' background ' WHEN 'error' THEN 'DDoS-LOIT'
   ELSE CASE event_id % 5 WHEN 0 THEN 'Port_Scan' WHEN 1 THEN 'Web Attack - XSS' WHEN 2 THEN 'SSH-Patator' WHEN 3 THEN 'DoS Hulk' ELSE 'Heartbleed' END END AS label_raw,
 CASE event_id % 3 WHEN 0 THEN 'Normal_data.csv' WHEN 1 THEN 'OVS.csv' ELSE 'metasploitable-2.csv' END AS source_file
FROM events""",
    "poll_stats": """
SELECT event_id AS row_id, user_id % 3 + 1 AS dpid, concat('10.0.0.', cast(user_id % 20 AS STRING)) AS src_ip,
 concat('10.0.1.', cast(user_id % 3 AS STRING)) AS dst_ip, 1024 + user_id AS src_port,
 CASE user_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 53 ELSE 8080 END AS dst_port,
 CASE user_id % 4 WHEN 2 THEN 17 ELSE 6 END AS protocol, ts, {us} AS ts_us,
 cast(sum(cast(floor(value / 20) AS BIGINT)) OVER w AS BIGINT) AS packet_count,
 cast(sum(cast(floor(value / 20) AS BIGINT) * (64 + event_id % 1000)) OVER w AS BIGINT) AS byte_count,
 cast({us} - min({us}) OVER w AS DOUBLE) / 100000000000.0 AS duration_s,
 {us} - (event_id % 200) * 1000 AS poll_request_us, {us} AS poll_reply_us
FROM events WINDOW w AS (PARTITION BY user_id, cast(floor({us} / 864000000000.0) AS BIGINT) ORDER BY ts, event_id)""",
    "scored": """
SELECT row_id, entity_key, ts, ts_us, round(x / (x + 50.0), 6) AS score, label,
 CASE WHEN x / (x + 50.0) >= 0.6 THEN 'ATTACK' ELSE 'NORMAL' END AS status,
 CASE WHEN row_id % 7 = 0 THEN 'scan_rule' ELSE 'model' END AS decision_source,
 CASE WHEN row_id % 7 = 0 THEN 'scan_rule' ELSE '' END AS support_sources,
 'scored' AS phase, CASE WHEN x / (x + 50.0) >= 0.6 THEN 'model threshold hit 1 times' ELSE 'score below threshold' END AS reason
FROM (SELECT event_id AS row_id, concat('k', cast(user_id AS STRING)) AS entity_key, ts, {us} AS ts_us,
  value + CASE event_type WHEN 'error' THEN 60.0 WHEN 'purchase' THEN 25.0 ELSE 0.0 END AS x,
  CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'purchase' THEN 'Probe' ELSE 'Normal' END AS label FROM events) t""",
    "poll_log": """
SELECT event_id AS poll_cycle_id, user_id % 5 + 1 AS dpid, {us} AS request_us,
 CASE WHEN event_id % 23 = 0 THEN NULL ELSE {us} + (event_id % 700) * 1000 END AS reply_us,
 cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS flows, 1 + event_id % 3 AS parts,
 CASE WHEN event_id % 11 = 0 THEN event_id % 40 ELSE 0 END AS trimmed
FROM events""",
    "run_metrics": """
SELECT concat('run', cast(d AS STRING)) AS run_id,
 concat('poll_interval_s=', CASE d % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '1.5' ELSE '2.0' END, ',hosts=', CASE d % 2 WHEN 0 THEN '4' ELSE '7' END,
  ',scenario=', CASE d % 4 WHEN 0 THEN 'udp' WHEN 1 THEN 'syn' WHEN 2 THEN 'probe' ELSE 'benign' END) AS meta,
 round(avg(value), 6) AS avg_total_e2e_ms, round(max(value), 6) AS max_reply_delay_ms,
 sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS timeout_total,
 sum(event_id % 3) AS trimmed_flows_total, count(*) / 100.0 AS throughput_obs_s, sum(event_id % 2) AS dropped_rows
FROM (SELECT *, cast(floor({us} / 86400000000.0) AS BIGINT) % 1000 AS d FROM events) t GROUP BY d""",
}


def duck_cte(name: str) -> str:
    return f"{name} AS ({SQL[name].format(us=DUCK_US).strip()})"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # events.ts has no zone; the microsecond columns are read as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    src = events(spark, sf_dir)
    if name == "poll_stats":
        return _poll_stats(src)
    text = SQL[name].format(us=SPARK_US)
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=src)


def _poll_stats(src: DataFrame) -> DataFrame:
    base = src.select(
        "*",
        F.expr(SPARK_US).alias("ts_us"),
        F.floor(F.col("value") / 20).cast("long").alias("_p"),
    ).withColumn("_period", F.floor(F.col("ts_us") / PERIOD_US).cast("long"))
    base = base.filter("user_id IS NOT NULL AND _period IS NOT NULL")
    summed = blocked.running_sums(
        base,
        ["user_id", "_period"],
        ["ts_us", "event_id"],
        {"packet_count": F.col("_p"), "byte_count": F.col("_p") * (64 + F.col("event_id") % 1000)},
        blocked.time_block(blocked.DAY_US),
        {"_start": F.col("ts_us")},
    )
    u = F.col("user_id")
    return summed.select(
        F.col("event_id").alias("row_id"),
        (u % 3 + 1).alias("dpid"),
        F.concat(F.lit("10.0.0."), (u % 20).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.1."), (u % 3).cast("string")).alias("dst_ip"),
        (1024 + u).alias("src_port"),
        F.when(u % 4 == 0, 22).when(u % 4 == 1, 80).when(u % 4 == 2, 53).otherwise(8080).cast("long").alias("dst_port"),
        F.when(u % 4 == 2, 17).otherwise(6).cast("long").alias("protocol"),
        "ts",
        "ts_us",
        "packet_count",
        "byte_count",
        ((F.col("ts_us") - F.col("_start")).cast("double") / 100000000000.0).alias("duration_s"),
        (F.col("ts_us") - (F.col("event_id") % 200) * 1000).alias("poll_request_us"),
        F.col("ts_us").alias("poll_reply_us"),
    )
