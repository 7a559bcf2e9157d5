import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from connlearn import hash_split, merge_frames, order_blocks, random_split, row_id, split_union, zip_by_position
from connlearn.operators.sequence import expand_copies

SF = "/root/testdata/sf0.001"


def test_split_union_identity(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    a, b = random_split(ev, [7, 3], 10)
    back = split_union([a, b])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ev.collect()))


def test_hash_split_stable_under_repartition(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id")
    ids = []
    for n in (1, 4, 7):
        parts = hash_split(ev.repartition(n), ["event_id"], [7, 3], 10)
        ids.append([sorted(r[0] for r in p.collect()) for p in parts])
    assert ids[0] == ids[1] == ids[2]
    assert len(ids[0][0]) + len(ids[0][1]) == ev.count()


def test_row_id_matches_row_number_any_partitioning(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value")
    expect = {r["event_id"]: r["rn"] - 1 for r in
              ev.withColumn("rn", F.row_number().over(Window.orderBy("value", "event_id"))).collect()}
    for n in (1, 4, 7):
        got = {r["event_id"]: r["id"] for r in row_id(ev.repartition(n), ["value", "event_id"], block_rows=150).collect()}
        assert got == expect


def test_zip_by_position(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(20, "y"), (10, "x")], "k2 int, w string")
    got = sorted(tuple(r) for r in zip_by_position(a, b, ["k"], ["k2"]).select("pos", "v", "w").collect())
    assert got == [(0, "a", "x"), (1, "b", "y")]


def test_merge_frames_union_equals_join_chain(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, None), (None, "n"), (None, "m")], "id int, a string")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0), (None, 1.0)], "id int, b double")
    c = spark.createDataFrame([(1, True), (3, None), (5, False)], "id int, c boolean")
    fast = merge_frames([a.filter("a <> 'm' or a is null"), b, c], key="id", unique_keys=True)
    chain = merge_frames([a.filter("a <> 'm' or a is null"), b, c], key="id")
    norm = lambda df: sorted((tuple(r) for r in df.select("id", "a", "b", "c").collect()), key=str)
    assert norm(fast) == norm(chain)
    assert len(norm(fast)) == 7


def test_merge_frames_repeated_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "n")], "id int, a string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "id int, b double")
    got = sorted((tuple(r) for r in merge_frames([a, b]).collect()), key=str)
    assert got == sorted([(1, "x", 1.0), (1, "y", 1.0), (2, None, 2.0), (None, "n", None), (None, None, 3.0)], key=str)
    with pytest.raises(Exception, match="repeated key: 1"):
        merge_frames([a, b], unique_keys=True).collect()


def test_row_id_keeps_nulls_and_splits_ties(spark):
    rows = [(None if i % 10 == 0 else 7.0 if i % 10 < 9 else float(i), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "v double, i long").repartition(5)
    expect = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.i: r.id for r in row_id(df, ["v", "i"], block_rows=200).collect()} == expect
    sizes = [r["count"] for r in order_blocks(df, ["v", "i"], block_rows=200).groupBy("__block").count().collect()]
    assert max(sizes) <= 2 * 200 and sum(sizes) == 4000
    assert sorted(r.id for r in row_id(df, ["v"], block_rows=200).collect()) == list(range(4000))
    assert row_id(df.limit(0), ["v"]).count() == 0


def test_row_id_orders_strings_and_times(spark):
    df = spark.createDataFrame([('a"b', "2024-01-02"), ("é\\x", None), (None, "2024-01-01"), ("a,{}", "2023-01-01")] * 30,
                               "s string, d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    for cols in (["s", "t"], ["t", "s"]):
        got = [(r.s, r.d) for r in row_id(df, cols, block_rows=10).orderBy("id").collect()]
        want = [(r.s, r.d) for r in df.orderBy(*cols).collect()]
        assert got == want


def test_row_id_splits_rows_that_repeat(spark):
    values = [None, "a", "b", "b2", "c", "d", "e"]
    df = spark.range(500_000).select(F.get(F.array(*[F.lit(v) for v in values]), (F.col("id") % 7).cast("int")).alias("v"),
                                     F.lit(1.5).alias("x"))
    df = df.unionByName(spark.range(300).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("v"),
                                                F.lit(0.5).alias("x")))
    got = row_id(df, ["v"], block_rows=50_000)
    want = df.groupBy("v", "x").count().orderBy("v").collect()
    ranges = {(r.v, r.x): (r.lo, r.hi, r.n) for r in got.groupBy("v", "x").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("n")).collect()}
    by_value, at = {}, 0
    for r in want:
        lo, hi, n = ranges[(r.v, r.x)]
        assert n == r["count"] == hi - lo + 1
        by_value.setdefault(r.v, []).append((lo, hi))
    for v in sorted(by_value, key=lambda v: (v is not None, v or "")):
        for lo, hi in sorted(by_value[v]):
            assert lo == at
            at = hi + 1
    assert at == 500_300
    blocks = order_blocks(df, ["v"], block_rows=50_000).groupBy("__block").count().collect()
    assert len(blocks) == 11 and max(r["count"] for r in blocks) == 50_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2                       # the stored input: single rows and repeated rows


def test_row_id_of_an_input_that_changes(spark):
    df = spark.range(30_000).withColumn("v", (F.rand() * 1000).cast("int")).repartition(7).limit(20_000)
    got = row_id(df, ["v"], block_rows=3000)
    ids = [r.id for r in got.select(F.col("id")).collect()]
    assert sorted(ids) == list(range(20_000))
    rows = row_id(df.select("v"), ["v"], block_rows=3000).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.id)] == sorted(r.v for r in rows)


def test_expand_copies(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), (None, 25), ("a", 3)], "k string, n int")
    got = sorted(((r.k or "", r.c) for r in expand_copies(df, "n", "c", chunk_rows=4).collect()))
    assert got == sorted([("a", i) for i in range(3)] * 2 + [("", i) for i in range(25)])


def test_merge_unique_keeps_repeated_rows_without_a_key(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (None, "n"), (None, "n"), (None, None)], "id int, a string")
    b = spark.createDataFrame([(1, 1.0), (None, 3.0), (None, 3.0)], "id int, b double")
    merged = merge_frames([a, b], unique_keys=True)
    assert sorted((tuple(r) for r in merged.collect()), key=str) == sorted(
        [(1, "x", 1.0), (None, "n", None), (None, "n", None), (None, "n", None), (None, None, None), (None, None, 3.0),
         (None, None, 3.0)], key=str)
    assert "monotonically" not in merged._jdf.queryExecution().optimizedPlan().toString().lower()
