"""Live traffic features: streams equal batches, late rows, restarts."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from connlearn import last_n_host_window, same_host_window, same_service_window
from connlearn.operators.sequence import OrderBlocks
from connlearn.plans import catalog
from connlearn.streaming import LiveLastN, LiveTimeWindows

SCHEMA = "id int, ts timestamp, host string, service string, flag string"


def connections(spark, n=120, seed=3, nulls=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randint(0, 60_000)
        rows.append((i, None if nulls and i % 40 == 39 else t / 1000.0, rng.choice(["h1", "h1", "h1", "h2", None]),
                     rng.choice(["web", "dns", None]), rng.choice(["SF", "S0", "REJ"])))
    df = spark.createDataFrame(rows, "id int, t double, host string, service string, flag string")
    return df.select("id", F.timestamp_seconds("t").alias("ts"), "host", "service", "flag").cache()


def bag(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("features", [same_host_window, same_service_window])
def test_replayed_stream_equals_batch(spark, tmp_dir, features):
    df = connections(spark)
    src = os.path.join(tmp_dir, "in")
    late = "id % 11 = 0 AND ts < timestamp_seconds(15)"
    cuts = [F.expr(f"coalesce(ts < timestamp_seconds(20), true) AND NOT coalesce({late}, false)"),
            F.expr("ts >= timestamp_seconds(20) AND ts < timestamp_seconds(45)"),
            F.expr(f"ts >= timestamp_seconds(45) OR coalesce({late}, false)")]
    os.makedirs(src)
    live = LiveTimeWindows(spark, features, frame_seconds=2.0, delay_seconds=5.0, path=os.path.join(tmp_dir, "store"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for k, cut in enumerate(cuts):
        df.filter(cut).coalesce(1).write.mode("append").parquet(src)
        q = live.start(stream)
        q.processAllAvailable()
        q.stop()
    n_late = df.filter(late).count()
    assert n_late > 0 and live.counts() == {"rows": 120, "late": n_late}
    assert bag(live.late()) == bag(df.filter(late))
    kept = df.filter(f"NOT coalesce({late}, false)")
    want = features(kept, frame_seconds=2.0)
    got = live.results().unionByName(live.open())
    assert bag(got) == bag(want)
    assert live.open().filter("ts < timestamp_seconds(54)").count() == 0 and live.open().count() > 0


def test_rows_out_of_order_within_the_delay(spark, tmp_dir):
    df = connections(spark, seed=8, nulls=False)
    live = LiveTimeWindows(spark, frame_seconds=3.0, delay_seconds=120.0, path=tmp_dir + "/s")
    for k in range(3):
        live.process(df.filter(F.col("id") % 3 == k), k)
    assert live.counts()["late"] == 0 and live.results().count() == 0
    assert bag(live.open()) == bag(same_host_window(df, frame_seconds=3.0))


def test_batches_of_last_n_equal_one_batch(spark, tmp_dir):
    df = connections(spark, seed=5)
    for n in (1, 4):
        live = LiveLastN(spark, n=n, path=f"{tmp_dir}/n{n}")
        parts = [df.filter("ts IS NULL OR ts < timestamp_seconds(17)"),
                 df.filter("ts >= timestamp_seconds(17) AND ts < timestamp_seconds(40)"),
                 df.filter("ts >= timestamp_seconds(40)")]
        for k, part in enumerate(parts):
            live.process(part, k)
        want = bag(last_n_host_window(df, n=n))
        assert bag(live.results()) == want and live.counts() == {"rows": 120, "late": 0}
        live.process(parts[1], 1)                                 # a committed batch again
        assert bag(live.results()) == want
        early = df.filter("host = 'h1' AND id < 60")
        live.process(early, 3)
        assert live.counts()["late"] == early.count() and bag(live.late()) == bag(early)


def test_a_batch_that_was_cut_off_is_done_anew(spark, tmp_dir, monkeypatch):
    df = connections(spark, seed=6)
    parts = [df.filter("ts < timestamp_seconds(30)"), df.filter("ts >= timestamp_seconds(30)")]
    live = LiveLastN(spark, n=3, path=f"{tmp_dir}/s")
    live.process(parts[0], 0)
    write = live.store.commit

    def cut_off(batch_id, tables, meta):
        tables["results"].write.mode("overwrite").parquet(live.store.folder(batch_id, "results"))
        raise RuntimeError("lost")
    monkeypatch.setattr(live.store, "commit", cut_off)
    with pytest.raises(RuntimeError, match="lost"):
        live.process(parts[1], 1)
    assert live.results().count() == parts[0].count()             # what was cut off is not read
    again = LiveLastN(spark, n=3, path=f"{tmp_dir}/s")            # a new process on the same store
    again.process(parts[1], 1)
    assert bag(again.results()) == bag(last_n_host_window(df.filter("ts IS NOT NULL"), n=3))


def test_empty_batches(spark, tmp_dir):
    df = connections(spark, seed=7)
    live = LiveTimeWindows(spark, path=f"{tmp_dir}/a", frame_seconds=2.0, delay_seconds=0.0)
    live.process(df.limit(0), 0)
    live.process(df, 1)
    live.process(df.limit(0), 2)
    assert bag(live.results().unionByName(live.open())) == bag(same_host_window(df, frame_seconds=2.0))
    with pytest.raises(ValueError, match="no batch"):
        LiveLastN(spark, path=f"{tmp_dir}/b").results()


def test_replay_deals_every_connection_to_many_files(spark, tmp_path):
    """A batch of the replay is written by all tasks, not by one, and the
    batches together are the connections with a time."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i) if i % 50 else None, i % 7, "view", 5.0) for i in range(900)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    schema, folder = catalog._replayed(spark, str(tmp_path), stray=False)
    seen = []

    class Counted:
        def start(self, stream):
            return (stream.writeStream.foreachBatch(lambda df, i: seen.append((df.count(), df.rdd.getNumPartitions())))
                    .option("checkpointLocation", f"{tmp_path}/checkpoint").start())

    catalog._run_live(spark, Counted(), schema, folder)
    assert [n for n, _ in seen] == [294, 294, 294]
    assert min(parts for _, parts in seen) > 1


def test_block_search_is_compiled(spark):
    """Blocks are found without a lambda per row, and number the order."""
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    cut = OrderBlocks(df, ["x"], 50, False)
    placed = cut.place(df)
    assert "lambdafunction" not in placed._jdf.queryExecution().optimizedPlan().toString()
    got = [r["__block"] for r in placed.orderBy("x").collect()]
    assert got == sorted(got) and set(got) == set(range(cut.n_bounds + 1))
