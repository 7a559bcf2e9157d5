import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from connlearn import category_rollup, last_n_host_window, order_blocks, same_host_window, same_service_window
from connlearn.operators.traffic import micros

BASE = dt.datetime(2024, 1, 1)
ROWS = [(1, 0, "a", "http", "SF"), (2, 1, "a", "dns", "S0"), (3, 2, "a", "http", "S0"),
        (4, 3, "b", "http", "SF"), (5, 3, "a", "http", "SF")]


def frame(spark, rows):
    data = [(i, BASE + dt.timedelta(seconds=s), h, sv, f) for i, s, h, sv, f in rows]
    return spark.createDataFrame(data, "id bigint, ts timestamp_ntz, host string, service string, flag string")


def test_fixture_same_host_and_service(spark):
    df = frame(spark, ROWS)
    host = {r["id"]: r for r in same_host_window(df, frame_seconds=2).collect()}
    srv = {r["id"]: r for r in same_service_window(df, frame_seconds=2).collect()}
    expect = {1: (1, 1, 1.0, 0.0, 0.0), 2: (2, 1, 0.5, 0.0, 0.5), 3: (3, 2, 2 / 3, 0.0, 2 / 3),
              4: (1, 3, 1.0, 2 / 3, 0.0), 5: (3, 3, 2 / 3, 1 / 3, 2 / 3)}
    for i, (cnt, scnt, same, diffhost, serr) in expect.items():
        assert host[i]["count"] == cnt and srv[i]["srv_count"] == scnt
        assert host[i]["same_srv_rate"] == pytest.approx(same)
        assert host[i]["diff_srv_rate"] == pytest.approx(1 - same)
        assert srv[i]["srv_diff_host_rate"] == pytest.approx(diffhost)
        assert host[i]["serror_rate"] == pytest.approx(serr)


def _plain(df, key, other, frame_us):
    w = Window.partitionBy(key).orderBy("__t").rangeBetween(-frame_us, 0)
    wp = Window.partitionBy(key, other).orderBy("__t").rangeBetween(-frame_us, 0)
    t = df.withColumn("__t", micros(df, "ts"))
    return {r["id"]: (r["n"], r["same"]) for r in
            t.select("id", F.count(F.lit(1)).over(w).alias("n"), F.count(F.lit(1)).over(wp).alias("same")).collect()}


def test_blocked_equals_plain_window(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 200), rng.choice("ab"), rng.choice(["http", "dns", "ftp"]),
             rng.choice(["SF", "S0", "REJ"])) for i in range(300)]
    df = frame(spark, rows)
    for block in (10, 40, 100_000):           # many block boundaries inside one key
        got = {r["id"]: (r["count"], round(r["same_srv_rate"] * r["count"]))
               for r in same_host_window(df, frame_seconds=3, block_rows=block).collect()}
        assert got == _plain(df, "host", "service", 3_000_000)


def test_last_n_equals_plain(spark):
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 50), rng.choice("abc"), rng.choice(["http", "dns"]), rng.choice(["SF", "S0"]))
            for i in range(200)]
    df = frame(spark, rows)
    n = 4
    t = df.withColumn("__t", micros(df, "ts"))
    rn = t.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("__t", "id")))
    w = Window.partitionBy("host").orderBy("rn").rowsBetween(-(n - 1), 0)
    wp = Window.partitionBy("host", "service").orderBy("rn").rangeBetween(-(n - 1), 0)
    plain = {r["id"]: (r["c"], r["s"]) for r in rn.select(
        "id", F.count(F.lit(1)).over(w).alias("c"), F.count(F.lit(1)).over(wp).alias("s")).collect()}
    for layout, block_rows in ((1, 4), (3, 10), (4, 100_000)):
        got = {r["id"]: (r["host_count"], round(r["host_same_srv_rate"] * r["host_count"]))
               for r in last_n_host_window(df.repartition(layout), n=n, block_rows=block_rows).collect()}
        assert got == plain


def test_category_rollup_dict_and_frame(spark):
    df = spark.createDataFrame([("smurf.",), ("neptune.",), ("normal.",), ("wormx.",), ("smurf.",)], "label string")
    mapping = {"smurf": "dos", "neptune": "dos", "normal": "normal"}
    got = {r["category"]: r["n"] for r in category_rollup(df, mapping).collect()}
    assert got == {"dos": 3, "normal": 1, "unknown": 1}
    mdf = spark.createDataFrame(list(mapping.items()), "label string, category string")
    assert {r["category"]: r["n"] for r in category_rollup(df, mdf).collect()} == got


def test_hot_host_is_split_across_blocks(spark):
    """One host holds half of all rows: its (host, time) order is cut into
    many blocks, and the features still equal the plain window."""
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 600), "hot" if i % 2 else rng.choice("bcdefg"), rng.choice(["http", "dns"]), "SF")
            for i in range(400)]
    df = frame(spark, rows)
    blocks = order_blocks(df.withColumn("t", micros(df, "ts")), ["host", "t"], block_rows=20)
    assert blocks.filter(F.col("host") == "hot").select("__block").distinct().count() >= 8
    got = {r["id"]: (r["count"], round(r["same_srv_rate"] * r["count"]))
           for r in same_host_window(df, frame_seconds=5, block_rows=20).collect()}
    assert got == _plain(df, "host", "service", 5_000_000)


def _plan_length(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_plan_does_not_grow_with_blocks(spark):
    """One service in 75 blocks: no filter on the block is pushed into the
    steps of its search, each of which would multiply it."""
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 2000), rng.choice("abc"), "all", rng.choice(["SF", "S0", "REJ"])) for i in range(300)]
    df = frame(spark, rows)
    whole = same_service_window(df, frame_seconds=90)
    many = same_service_window(df, frame_seconds=90, block_rows=4)
    assert _plan_length(many) < 2 * _plan_length(whole)
    got = {r["id"]: (r["srv_count"], round((1 - r["srv_diff_host_rate"]) * r["srv_count"])) for r in many.collect()}
    assert got == _plain(df, "service", "host", 90_000_000)


def test_plan_does_not_grow_with_blocks_of_nulls(spark):
    """The same with nulls among times, hosts and services."""
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 2000), rng.choice(["a", "b", None]), rng.choice(["http", None]),
             rng.choice(["SF", "S0", "REJ"])) for i in range(320)]
    df = frame(spark, rows).withColumn("ts", F.expr("if(id % 9 = 0, null, ts)"))
    whole = same_service_window(df, frame_seconds=40)
    many = same_service_window(df, frame_seconds=40, block_rows=4)
    assert _plan_length(many) < 2 * _plan_length(whole)
    got = {r["id"]: r["srv_count"] and (r["srv_count"], round((1 - r["srv_diff_host_rate"]) * r["srv_count"]))
           for r in many.collect()}
    assert got == {i: n if i % 9 else None for i, n in _plain(df, "service", "host", 40_000_000).items()}


def test_nulls_stay_rows(spark):
    rows = [(i, i % 9, "ab"[i % 2], "http", "SF") for i in range(40)]
    df = frame(spark, rows).withColumn("ts", F.expr("if(id % 4 = 0, null, ts)")).withColumn(
        "host", F.expr("if(id % 6 = 1, null, host)")).withColumn("service", F.expr("if(id % 5 = 1, null, service)"))
    for fn, col in ((same_host_window, "count"), (same_service_window, "srv_count")):
        got = {r["id"]: r[col] for r in fn(df, frame_seconds=3, block_rows=7).collect()}
        assert len(got) == 40 and all((got[i] is None) == (i % 4 == 0) for i in got)
    last = last_n_host_window(df, n=3, block_rows=5).collect()
    assert len(last) == 40 and all(1 <= r["host_count"] <= 3 for r in last)


def test_category_rollup_conflict_fails(spark):
    df = spark.createDataFrame([("smurf.",)], "label string")
    both = spark.createDataFrame([("smurf", "dos"), ("smurf", "r2l")], "label string, category string")
    with pytest.raises(Exception, match="two categories: smurf"):
        category_rollup(df, both).collect()
