import gzip
import os

import pytest
from pyspark.errors import PySparkException

from connlearn import (Quarantine, clear_staging, first_lines, format_records, head_sample, parse_records, parse_report, positional_frame, read_records,
                       scan_lines, stage_parquet, write_head_sample, write_lines)
from connlearn.schema import RecordSchema
from tests.fixtures import CONN_SCHEMA, MALFORMED_LINES, TRAIN_LINES, lines_df


def test_schema_roles():
    assert CONN_SCHEMA.categorical == ("protocol_type", "service", "flag")
    assert CONN_SCHEMA.label == "label"
    assert CONN_SCHEMA.numeric == ("duration", "src_bytes", "dst_bytes", "land", "urgent")
    pos = RecordSchema.positional(42)
    assert pos.categorical == ("_2", "_3", "_4") and pos.label == "_42" and len(pos.numeric) == 38


def test_parse_records_types_and_values(spark):
    df = parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA, keep=("id",))
    assert [f.dataType.simpleString() for f in df.schema.fields] == \
        ["bigint", "double", "string", "string", "string", "double", "double", "double", "double", "string"]
    rows = {r["id"]: r for r in df.collect()}
    assert rows[0]["src_bytes"] == 181.0 and rows[0]["service"] == "http" and rows[0]["label"] == "normal."
    assert rows[6]["protocol_type"] == "icmp" and rows[6]["duration"] == 5.0


def test_parse_failfast_raises(spark):
    for bad in MALFORMED_LINES:
        with pytest.raises(Exception):
            parse_records(lines_df(spark, [bad]), CONN_SCHEMA).collect()


def test_parse_drop_and_report(spark):
    df = lines_df(spark, TRAIN_LINES + MALFORMED_LINES)
    assert parse_records(df, CONN_SCHEMA, mode="drop").count() == len(TRAIN_LINES)
    rep = parse_report(df, CONN_SCHEMA).collect()[0]
    assert (rep["n_lines"], rep["n_parsed"], rep["n_dropped"]) == (11, 8, 3)


def test_positional_frame(spark):
    df = positional_frame(lines_df(spark, TRAIN_LINES[:1]), 9)
    assert df.columns == [f"_{i}" for i in range(1, 10)]
    assert tuple(df.collect()[0]) == ("0", "tcp", "http", "SF", "181", "5450", "0", "0", "normal.")


def test_gzip_round_trip_and_partitions(spark, tmp_dir):
    parsed = parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA)
    path = write_lines(format_records(parsed, CONN_SCHEMA), os.path.join(tmp_dir, "train"))
    back = read_records(spark, path, CONN_SCHEMA, min_partitions=4)
    assert back.rdd.getNumPartitions() >= 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, parsed.collect()))
    assert any(f.endswith(".gz") for f in os.listdir(path))


def test_read_records_parquet(spark, tmp_dir):
    parsed = parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA)
    parsed.write.parquet(os.path.join(tmp_dir, "p"))
    back = read_records(spark, os.path.join(tmp_dir, "p"), CONN_SCHEMA, fmt="parquet")
    assert back.count() == 8 and back.columns == list(CONN_SCHEMA.names)


def test_head_sample_shorter_than_n(spark, tmp_dir):
    df = lines_df(spark, TRAIN_LINES)
    assert head_sample(df, 100, ["id"]).count() == 8
    path = write_head_sample(df, 3, ["id"], os.path.join(tmp_dir, "head"))
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    got = []
    for f in sorted(files):
        with gzip.open(os.path.join(path, f), "rt") as fh:
            got += fh.read().splitlines()
    assert got == TRAIN_LINES[:3]


def test_sample_files_keep_file_order(spark, tmp_dir):
    from connlearn.sources import first_lines, write_sample_files

    lines = [f"{i},tcp,http,SF,{i},0,0,0,normal." for i in range(2500)]
    for name, body in (("train.gz", lines), ("test.gz", lines[:150])):
        with gzip.open(os.path.join(tmp_dir, name), "wt") as fh:
            fh.write("\n".join(body) + "\n")
    assert [r[0] for r in first_lines(spark, os.path.join(tmp_dir, "train.gz"), 5).collect()] == lines[:5]
    out = write_sample_files(spark, os.path.join(tmp_dir, "train.gz"), os.path.join(tmp_dir, "test.gz"),
                             os.path.join(tmp_dir, "samples"), n_train=2000)
    got = {}
    for src, target in out.items():
        rows = []
        for f in sorted(os.listdir(target)):
            if f.endswith(".gz"):
                with gzip.open(os.path.join(target, f), "rt") as fh:
                    rows += fh.read().splitlines()
        got[os.path.basename(target)] = rows
    assert got["train.2000.gz"] == lines[:2000]
    assert got["test.200.gz"] == lines[:150]            # shorter than N: what exists


def test_scan_with_many_partitions_is_left_alone(spark, tmp_dir):
    path = os.path.join(tmp_dir, "many")
    spark.range(800).selectExpr("cast(id as string) as value").repartition(80).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30")
    try:
        n = scan_lines(spark, path).rdd.getNumPartitions()
        assert n >= 80 and scan_lines(spark, path, min_partitions=2).rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_lines_follow_file_order(spark, tmp_dir):
    for name, n in (("a", 5), ("b", 5000), ("c", 50)):
        with open(os.path.join(tmp_dir, f"{name}.txt"), "w") as f:
            f.writelines(f"{name}{i}\n" for i in range(n))
    got = [r.value for r in first_lines(spark, tmp_dir, 8).collect()]
    assert sorted(got) == sorted([f"a{i}" for i in range(5)] + ["b0", "b1", "b2"])


def test_positional_frame_rejects_other_widths(spark):
    lines = spark.createDataFrame([("1,2,3",), ("1,2,3,4",)], "value string")
    with pytest.raises(Exception, match="expected 3 fields, got 4"):
        positional_frame(lines, 3).collect()


def test_clear_staging(spark):
    path = stage_parquet(spark.range(3)).inputFiles()[0]
    local = path.removeprefix("file://")
    assert os.path.exists(local)
    clear_staging(spark)
    assert not os.path.exists(local)


def test_first_lines_reads_the_leading_files_only(spark, tmp_dir):
    src = os.path.join(tmp_dir, "many {a}")
    os.makedirs(src)
    lines = []
    for i in range(40):
        part = [f"{i}-{k}" for k in range(0 if i == 1 else 30 if i == 0 else 5)]
        lines += part
        with open(os.path.join(src, f"f{i:02d}.txt"), "w") as fh:
            fh.writelines(f"{x}\n" for x in part)
    quoted = src.replace("{", "\\{").replace("}", "\\}")
    for n, files in ((30, 1), (1, 1), (31, 3), (45, 7), (1000, 40)):
        got = first_lines(spark, quoted, n)
        assert [r.value for r in got.collect()] == lines[:n]
        assert len(got.inputFiles()) == files
    assert first_lines(spark, quoted, 0).count() == 0


def test_quarantine_in_one_pass(spark, tmp_dir):
    lines = TRAIN_LINES + MALFORMED_LINES + ["0,tcp,http,SF,x,y,0,0,normal."]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)] + [(99, None)], "id long, value string")
    q = Quarantine(df, CONN_SCHEMA, keep=("id",), path=f"{tmp_dir}/q")
    faults = {r.id: r.fault for r in q.faults.collect()}
    assert faults == {8: "number: duration", 9: "fields: 3", 10: "fields: 1", 11: "number: src_bytes", 99: "null"}
    assert q.counts == {"n_lines": 13, "n_parsed": 8, "n_dropped": 5}
    want = parse_records(df, CONN_SCHEMA, mode="drop", keep=("id",))
    assert sorted(map(tuple, q.records.collect())) == sorted(map(tuple, want.collect()))
    none = Quarantine(df.filter("id < 0"), CONN_SCHEMA)
    assert none.counts == {"n_lines": 0, "n_parsed": 0, "n_dropped": 0} and none.faults.count() == 0


def test_lines_never_broadcast_orders(spark, tmp_path):
    """Orders grow with the input: their join passes nothing through the driver."""
    from connlearn.sources.adapters import lines_frame

    spark.createDataFrame([(1, 5.0, "O", 10.0, 0.1, 0.0, "N"), (2, 6.0, "F", 11.0, 0.0, 0.1, "A")],
                          "l_orderkey long, l_quantity double, l_linestatus string, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "5-LOW", "O"), (3, "1-URGENT", "F")], "o_orderkey long, o_orderpriority string, "
                          "o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    df = lines_frame(spark, str(tmp_path))
    assert [r["orderkey"] for r in df.collect()] == [1]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
