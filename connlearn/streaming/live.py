"""Traffic features of connections as they arrive (Structured Streaming).

Each micro-batch is merged with the rows that later connections still need
(the state), the batch operators of :mod:`connlearn.operators.traffic` compute
the features of that small table, and what is new is committed: results, late
rows, next state and counts as one folder per batch, valid once its ``meta``
is written. A batch that was committed is not done again, and one that was cut
off is done anew over the same previous state, so every connection has its
features once, whatever fails. State and results are Parquet; nothing of a
batch reaches the driver but counts and the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.traffic import last_n_host_window, micros, same_host_window, same_service_window
from ..session import staged, staging_path


class BatchStore:
    """Committed batches below one folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def folder(self, batch_id: int, name: str) -> str:
        return f"{self.path}/batch-{batch_id:09d}/{name}"

    def is_committed(self, batch_id: int) -> bool:
        fs, p = self._fs(self.folder(batch_id, "meta/_SUCCESS"))
        return fs.exists(p)

    def committed(self) -> list[int]:
        """Numbers of the committed batches, ascending."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        ids = sorted(int(n[6:]) for n in names if n.startswith("batch-"))
        return [i for i in ids if self.is_committed(i)]

    def meta(self, batch_id: int) -> dict:
        return json.loads(self.spark.read.text(self.folder(batch_id, "meta")).first()[0])

    def read(self, name: str, batch_id: int | None = None) -> DataFrame:
        """A table of one batch, or of all committed ones together."""
        ids = self.committed() if batch_id is None else [batch_id]
        if not ids:
            raise ValueError(f"no batch is committed in {self.path}")
        return self.spark.read.parquet(*[self.folder(i, name) for i in ids])

    def commit(self, batch_id: int, tables: dict[str, DataFrame], meta: dict) -> None:
        """Write the tables, then ``meta``, which makes them valid."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.folder(batch_id, name))
        line = self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(self.folder(batch_id, "meta"))

    def drop(self, batch_id: int, name: str) -> None:
        fs, p = self._fs(self.folder(batch_id, name))
        fs.delete(p, True)


class _Live:
    """What both kinds share: the store, the previous batch, the stream."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.store = BatchStore(spark, path or staging_path(spark, "live"))

    def _previous(self, batch_id: int) -> int | None:
        return max((i for i in self.store.committed() if i < batch_id), default=None)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch; nothing if it is committed already."""
        if self.store.is_committed(batch_id):
            return
        before = self._previous(batch_id)
        tables, meta = self._merge(staged(batch, "live"), before)
        self.store.commit(batch_id, tables, meta)
        for old in self.store.committed():
            if before is not None and old < before:
                self.store.drop(old, "state")

    def _merge(self, batch: DataFrame, before: int | None) -> tuple[dict[str, DataFrame], dict]:
        raise NotImplementedError

    def results(self) -> DataFrame:
        """Connections with their features, of all committed batches."""
        return self.store.read("results")

    def late(self) -> DataFrame:
        """Connections that came too late to be counted."""
        return self.store.read("late")

    def counts(self) -> dict[str, int]:
        """Rows read and rows late so far, as committed."""
        metas = [self.store.meta(i) for i in self.store.committed()]
        return {k: sum(m[k] for m in metas) for k in ("rows", "late")}

    def start(self, stream: DataFrame, trigger_seconds: float | None = None) -> StreamingQuery:
        """Run on a stream. The stream's checkpoint is kept in the store, as
        its batch numbers belong to it."""
        writer = stream.writeStream.foreachBatch(lambda df, i: self.process(df, i)).option(
            "checkpointLocation", f"{self.store.path}/checkpoint")
        if trigger_seconds:
            writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
        return writer.start()


class LiveTimeWindows(_Live):
    """``same_host_window`` or ``same_service_window`` over a stream.

    The watermark is the latest time seen less ``delay_seconds``. When a batch
    ends, the connections before the watermark are closed: all that belongs in
    their windows has come, and their features are results. Connections that
    come from before the watermark of the previous batches are late: they are
    kept in a table of their own, counted, and in no window. The state is the
    open connections and one frame of closed ones. A connection without a time
    is closed at once, without features, as in the batch operators.
    """

    def __init__(self, spark: SparkSession, features: Callable[..., DataFrame] = same_host_window, ts: str = "ts",
                 frame_seconds: float = 2.0, delay_seconds: float = 10.0, path: str | None = None, **options):
        super().__init__(spark, path)
        if features not in (same_host_window, same_service_window):
            raise ValueError("features must be same_host_window or same_service_window")
        self.features, self.ts, self.frame_seconds, self.options = features, ts, frame_seconds, options
        self.frame, self.delay = int(round(frame_seconds * 1_000_000)), int(round(delay_seconds * 1_000_000))

    def _computed(self, rows: DataFrame) -> DataFrame:
        return self.features(rows, ts=self.ts, frame_seconds=self.frame_seconds, **self.options)

    def _merge(self, batch, before):
        mark = None if before is None else self.store.meta(before)["watermark"]
        rows = batch.withColumn("__us", micros(batch, self.ts))
        late = F.lit(False) if mark is None else F.coalesce(F.col("__us") < mark, F.lit(False))
        top, n, n_late = rows.agg(F.max("__us"), F.count(F.lit(1)), F.count(F.when(late, 1))).first()
        seen = [x for x in (mark, None if top is None else top - self.delay) if x is not None]
        now = max(seen, default=None)
        fresh = rows.filter(~late)
        pool = fresh if before is None else self.store.read("state", before).unionByName(fresh)
        closed = F.col("__us").isNull() if now is None else F.col("__us").isNull() | (F.col("__us") < now)
        results = self._computed(pool.filter(closed))
        if mark is not None:
            results = results.filter(F.col("__us").isNull() | (F.col("__us") >= mark))
        needed = F.col("__us").isNotNull() if now is None else F.col("__us") >= now - self.frame
        return ({"results": results.drop("__us"), "late": rows.filter(late).drop("__us"), "state": pool.filter(needed)},
                {"watermark": now, "rows": n, "late": n_late})

    def open(self) -> DataFrame:
        """Features, so far, of the connections that are not closed yet."""
        last = max(self.store.committed())
        mark = self.store.meta(last)["watermark"]
        out = self._computed(self.store.read("state", last))
        return (out if mark is None else out.filter(F.col("__us") >= mark)).drop("__us")


class LiveLastN(_Live):
    """``last_n_host_window`` over batches: the state is the last ``n - 1``
    connections of each host (one at least).

    Connections are ordered by (time, key), null times first, within a host.
    One that does not come after the host's last connection of earlier batches
    is late: kept apart, counted, in no frame. So the results of in-order
    batches are those of all rows at once, however they are cut.
    """

    def __init__(self, spark: SparkSession, n: int = 100, host: str = "host", ts: str = "ts", key: str = "id",
                 path: str | None = None, **options):
        super().__init__(spark, path)
        if n < 1:
            raise ValueError("n must be >= 1")
        self.n, self.host, self.ts, self.key, self.options = n, host, ts, key, options

    def _merge(self, batch, before):
        rows = batch.withColumn("__order", F.struct(micros(batch, self.ts).alias("us"), F.col(self.key).alias("key")))
        late, fresh = rows.limit(0), rows
        pool = rows.withColumn("__new", F.lit(True))
        if before is not None:
            state = self.store.read("state", before)
            last = state.groupBy(F.col(self.host).alias("__host")).agg(F.max("__order").alias("__last"))
            judged = rows.join(last, F.col(self.host).eqNullSafe(F.col("__host")), "left").withColumn(
                "__late", F.coalesce(F.col("__order") <= F.col("__last"), F.lit(False))).drop("__host", "__last")
            judged = staged(judged, "live")
            late, fresh = judged.filter("__late").drop("__late"), judged.filter("NOT __late").drop("__late")
            pool = fresh.withColumn("__new", F.lit(True)).unionByName(state.withColumn("__new", F.lit(False)))
        out = last_n_host_window(pool, host=self.host, ts=self.ts, key=self.key, n=self.n, **self.options)
        newest = Window.partitionBy(self.host).orderBy(F.col("__order").desc())
        state = pool.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= max(1, self.n - 1))
        n, n_late = rows.count(), late.count()
        return ({"results": out.filter("__new").drop("__new", "__order"), "late": late.drop("__order"),
                 "state": state.drop("__rank", "__new")}, {"rows": n, "late": n_late})
