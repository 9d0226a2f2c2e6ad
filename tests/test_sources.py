"""CSV sources and sinks."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.sources import exports

HEADER = " Flow ID ,Src IP,Dst IP,Src Port,Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Label\n"


def test_read_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "f1, 1.1.1.1 ,2.2.2.2,10,22,6,5/2/2020 13:58,1000000,2,3,20,30,DoS Hulk\n" + "f2,1.1.1.1,2.2.2.2,x,22,6,junk,0,1,0,inf,0,\n")
    df = exports.read_flow_export(spark, str(tmp_path), ["a.csv"]).orderBy("row_id")
    a, b = df.collect()
    assert (a.row_id, b.row_id) == (0, 1) and a.source_file == "a.csv"
    assert (a.src_ip, a.label, a.is_attack, a.packet_rate) == ("1.1.1.1", "DoS", 1, 5.0)
    assert a.parsed_timestamp.strftime("%Y-%m-%d %H:%M") == "2020-02-05 13:58"
    assert (b.src_port, b.label, b.ts_us, b.byte_count) == (0, "Normal", 1000, 0.0)


def test_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Flow ID,Label\nf,Normal\n")
    with pytest.raises(ValueError, match="missing required columns"):
        exports.read_flow_export(spark, str(tmp_path), ["a.csv"])


def test_row_numbers_over_splits(spark, tmp_path):
    n = 4000
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"f{i},a,b,1,2,6,x,1,1,1,1,1,Normal\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = exports.read_flow_export(spark, str(tmp_path), ["a.csv"])
        assert df.filter(F.concat(F.lit("f"), F.col("row_id").cast("string")) != F.col("flow_id")).count() == 0
        assert df.select("row_id").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_alternate_export(spark, tmp_path):
    (tmp_path / "mon.csv").write_text("Source Port,destination_port,Protocol,Flow Duration,Total Fwd Packets,Flow Packets/s,Class\n1,80,6,0,4,Infinity,BENIGN\n")
    r = exports.read_alternate_export(spark, str(tmp_path / "mon.csv")).first()
    assert r.conversation_key == "mon__proto_6__dstport_80" and r.flow_duration_s == 0.001 and r.packet_rate == 4000.0


def test_prepared_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "x int, split string")
    exports.write_prepared(df, str(tmp_path / "p"))
    out = exports.read_prepared(spark, str(tmp_path / "p"), "val")
    assert [r.x for r in out.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in out._jdf.queryExecution().toString()


def test_folder_of_exports_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Source Port,Destination Port,Protocol,Flow Duration,Total Fwd Packets,Label\n1,80,6,10,4,BENIGN\n")
    (tmp_path / "b.csv").write_text("label,Tot Fwd Pkts, protocol ,Dst Port,Src Port,Flow Duration\nDDoS,9,17,53,2000,3\n")
    rows = {r.source_file: r for r in exports.read_alternate_export(spark, str(tmp_path)).collect()}
    assert (rows["a"].src_port, rows["a"].dst_port, rows["a"].protocol, rows["a"].fwd_pkts, rows["a"].label) == (1, 80, 6, 4.0, "Normal")
    assert (rows["b"].src_port, rows["b"].dst_port, rows["b"].protocol, rows["b"].fwd_pkts, rows["b"].label) == (2000, 53, 17, 9.0, "DDoS")
    with pytest.raises(FileNotFoundError):
        exports.read_alternate_export(spark, str(tmp_path / "none"))


def test_many_small_files_of_mixed_headers(spark, tmp_path):
    heads = ["Source Port,Destination Port,Protocol,Flow Duration,Total Fwd Packets,Label", "﻿Label,Dst Port,Src Port,Protocol"]
    for i in range(400):
        line = f"{i},80,6,10,4,BENIGN" if i % 2 == 0 else f"DDoS,53,{i},17"
        folder = tmp_path / f"d{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{i}.csv").write_text("" if i % 100 == 99 else f"{heads[i % 2]}\n{line}\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = exports._headers(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert {len(h): len(files) for h, files in found.items()} == {6: 200, 4: 196}
    rows = exports.read_alternate_export(spark, str(tmp_path)).select("source_file", "src_port", "label").collect()
    assert sorted((r.source_file, r.src_port, r.label) for r in rows) == sorted((f"f{i}", i, "DDoS" if i % 2 else "Normal") for i in range(400) if i % 100 != 99)


def test_prepared_tables_carry_what_made_them(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(i, f"k{i % 5}", 1.5 * i, ["train", "val"][i % 2]) for i in range(40)], "ts_us long, key string, x double, split string")
    exports.write_prepared(df, path, ["key"], ["ts_us"], buckets=4, stats={"x": {"center": 0.1, "scale": 2.0}}, scheme="s1", settings={"seq_len": 4})
    about = exports.prepared_metadata(spark, path)
    assert (about["scheme"], about["stats"], about["settings"]) == ("s1", {"x": {"center": 0.1, "scale": 2.0}}, {"seq_len": 4})
    back = exports.read_prepared(spark, path, scheme="s1")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    previous = back.withColumn("before", F.lag("x").over(Window.partitionBy("key").orderBy("ts_us")))
    assert "Exchange" not in previous._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="scheme"):
        exports.read_prepared(spark, path, scheme="s2")
    exports.write_text(spark, f"{path}/{exports._SIDECAR}", json.dumps(about).replace('"double"', '"long"'))
    with pytest.raises(ValueError, match="columns of their sidecar"):
        exports.read_prepared(spark, path)
    df.write.partitionBy("split").parquet(str(tmp_path / "q"))
    with pytest.raises(FileNotFoundError):
        exports.read_prepared(spark, str(tmp_path / "q"))
