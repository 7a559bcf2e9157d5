"""Traffic features of connection records.

* time-based: statistics over the connections of the past ``frame`` seconds
  to the same host (``same_host_window``) or the same service
  (``same_service_window``);
* host-based: the same statistics over the last ``n`` connections to the
  host (``last_n_host_window``);
* attack-category roll-up.

Time windows are linear in the rows: connections are first counted per (key,
other, time), once, into a stored table; each count is added at its time and taken away one microsecond
after it leaves the frame, so a running sum is the window's value, however
many rows a frame holds. Running sums are cut into blocks of the (key, time)
order with about equal rows, shifted by the totals of earlier blocks, so a
popular host or service, or a flood within seconds, is never one task.
Last-N windows run on global positions in (host, time, id) order, in blocks of
positions; the last rows of a block are copied into the next as context.

Every input row is an output row. A null time has no time features (nulls) and
comes first in the last-N order; null hosts and services are values of their
own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import epoch_micros, strip_terminator
from ..session import staged
from .sequence import BLOCK_ROWS, OrderBlocks, block_offsets, row_id

# Connection flags counted as SYN errors and as REJ errors.
SYN_ERROR_FLAGS = ("S0", "S1", "S2", "S3")
REJ_ERROR_FLAGS = ("REJ",)
# Last-N blocks hold at least this many frames: 1/32 of the rows are copied at most.
FRAMES_PER_BLOCK = 32
UNKNOWN_CATEGORY = "unknown"


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike
    (no time-zone dependence)."""
    dt = df.schema[ts].dataType
    if isinstance(dt, T.TimestampNTZType):
        return epoch_micros(ts, ntz=True)
    if isinstance(dt, T.TimestampType):
        return epoch_micros(ts, ntz=False)
    if isinstance(dt, T.NumericType):
        return (F.col(ts).cast("double") * 1_000_000).cast("bigint")
    raise TypeError(f"{ts} must be a timestamp or a number of seconds")


def _flag_share(flag: str, flags: Sequence[str]) -> Column:
    return F.when(F.col(flag).isin(*flags), F.lit(1)).otherwise(F.lit(0))


def _time_features(df: DataFrame, key: str, other: str, flag: str, ts: str, frame_seconds: float,
                   block_rows: int, serror_flags, rerror_flags) -> DataFrame:
    """``df`` plus ``__n, __s, __r, __same`` over the rows of the same key
    (``__same``: and the same other) in ``[ts - frame, ts]``."""
    frame = int(round(frame_seconds * 1_000_000))
    rows = df.withColumn("__pos", micros(df, ts))
    base = rows.filter(F.col("__pos").isNotNull()).select(
        F.col(key).alias("key"), F.col(other).alias("other"), F.col("__pos").alias("pos"),
        _flag_share(flag, serror_flags).alias("s"), _flag_share(flag, rerror_flags).alias("r"))
    cells = staged(base.groupBy("key", "other", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum("r").alias("r")), "cells")
    change = F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.lit(1).alias("sign")),
                               F.struct((F.col("pos") + F.lit(frame + 1)).alias("pos"), F.lit(-1).alias("sign"))))
    signed = cells.select("key", "other", "n", "s", "r", change.alias("c")).select(
        "key", "other", "c.pos", "c.sign", *[(F.col(m) * F.col("c.sign")).alias(m) for m in ("n", "s", "r")])
    # Stored with their blocks: the joins below filter on the block, and each step of
    # its search that such a filter passes multiplies the filter's size in the plan.
    signed = staged(OrderBlocks(cells.select("key", "pos"), ["key", "pos"], block_rows, False).place(signed), "placed")
    # one shuffle on the block serves both running sums and both offsets
    signed = signed.repartition("__block")

    by_key, same_key = block_offsets(signed, ["key"], "__block", ["n", "s", "r"], "__k_")
    by_pair, same_pair = block_offsets(signed, ["key", "other"], "__block", ["n"], "__p_")
    upto = (Window.unboundedPreceding, Window.currentRow)
    of_key = Window.partitionBy("key", "__block").orderBy("pos").rangeBetween(*upto)
    of_pair = Window.partitionBy("key", "other", "__block").orderBy("pos").rangeBetween(*upto)
    run = signed.select("*", *[F.sum(m).over(of_key).alias(f"__{m}") for m in ("n", "s", "r")])
    run = run.select("*", F.sum("n").over(of_pair).alias("__same")).filter("sign = 1")
    run = run.join(by_key, same_key).join(by_pair, same_pair).select(
        F.col("key").alias("__key"), F.col("other").alias("__other"), F.col("pos").alias("__at"),
        *[(F.col(f"__{m}") + F.col(f"__k_{m}")).alias(f"__{m}") for m in ("n", "s", "r")],
        (F.col("__same") + F.col("__p_n")).alias("__same"))
    return rows.join(run, F.col(key).eqNullSafe(F.col("__key")) & F.col(other).eqNullSafe(F.col("__other"))
                     & (F.col("__pos") == F.col("__at")), "left").drop("__key", "__other", "__at", "__pos")


def _shares(df: DataFrame, count: str, serror: str, rerror: str, same: str | None, diff: str) -> DataFrame:
    same_rate = F.col("__same") / F.col("__n")
    out = (df.withColumn(count, F.col("__n").cast("bigint")).withColumn(serror, F.col("__s") / F.col("__n"))
           .withColumn(rerror, F.col("__r") / F.col("__n")))
    out = out.withColumn(same, same_rate) if same else out
    return out.withColumn(diff, F.lit(1.0) - same_rate).drop("__n", "__s", "__r", "__same")


def same_host_window(df: DataFrame, host: str = "host", service: str = "service", flag: str = "flag",
                     ts: str = "ts", frame_seconds: float = 2.0, block_rows: int = BLOCK_ROWS,
                     serror_flags: Sequence[str] = SYN_ERROR_FLAGS,
                     rerror_flags: Sequence[str] = REJ_ERROR_FLAGS) -> DataFrame:
    """Add ``count, serror_rate, rerror_rate, same_srv_rate, diff_srv_rate``
    over the connections to the same host in ``[ts - frame, ts]`` (the row
    itself and equal timestamps included)."""
    res = _time_features(df, host, service, flag, ts, frame_seconds, block_rows, serror_flags, rerror_flags)
    return _shares(res, "count", "serror_rate", "rerror_rate", "same_srv_rate", "diff_srv_rate")


def same_service_window(df: DataFrame, host: str = "host", service: str = "service", flag: str = "flag",
                        ts: str = "ts", frame_seconds: float = 2.0, block_rows: int = BLOCK_ROWS,
                        serror_flags: Sequence[str] = SYN_ERROR_FLAGS,
                        rerror_flags: Sequence[str] = REJ_ERROR_FLAGS) -> DataFrame:
    """Add ``srv_count, srv_serror_rate, srv_rerror_rate, srv_diff_host_rate``
    over the connections to the same service in ``[ts - frame, ts]``."""
    res = _time_features(df, service, host, flag, ts, frame_seconds, block_rows, serror_flags, rerror_flags)
    return _shares(res, "srv_count", "srv_serror_rate", "srv_rerror_rate", None, "srv_diff_host_rate")


def last_n_host_window(df: DataFrame, host: str = "host", service: str = "service", flag: str = "flag",
                       ts: str = "ts", key: str = "id", n: int = 100, block_rows: int = BLOCK_ROWS,
                       serror_flags: Sequence[str] = SYN_ERROR_FLAGS,
                       rerror_flags: Sequence[str] = REJ_ERROR_FLAGS) -> DataFrame:
    """Add ``host_count, host_serror_rate, host_rerror_rate,
    host_same_srv_rate, host_diff_srv_rate`` over the last ``n`` connections
    to the host (ordered by ``ts``, then ``key``; the row itself included).

    Rows are numbered once over (host, time, key). The rows of a host are then
    consecutive, so the frame is ``n`` positions back within the host, and
    blocks of positions bound the work of a task whatever a host's share.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    block = max(block_rows, FRAMES_PER_BLOCK * n)
    placed = df.withColumn("__t", micros(df, ts))
    placed = row_id(placed, [host, "__t", key], out="__at", block_rows=block_rows).drop("__t")
    own = F.floor(F.col("__at") / F.lit(block)).cast("bigint")
    late = F.col("__at") >= (own + 1) * F.lit(block) - F.lit(n - 1)
    copies = (placed.withColumn("__own", own).withColumn("__blk", F.explode(
        F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("__se", _flag_share(flag, serror_flags)).withColumn("__re", _flag_share(flag, rerror_flags)))
    of_host = Window.partitionBy(host, "__blk").orderBy("__at").rangeBetween(-(n - 1), 0)
    of_pair = Window.partitionBy(host, service, "__blk").orderBy("__at").rangeBetween(-(n - 1), 0)
    run = copies.select("*", F.count(F.lit(1)).over(of_host).alias("__n"), F.sum("__se").over(of_host).alias("__s"),
                        F.sum("__re").over(of_host).alias("__r"))
    run = run.select("*", F.count(F.lit(1)).over(of_pair).alias("__same")).filter("__own = __blk")
    return _shares(run.drop("__own", "__blk", "__at", "__se", "__re"), "host_count", "host_serror_rate",
                   "host_rerror_rate", "host_same_srv_rate", "host_diff_srv_rate")


def attack_category(label: str | Column, mapping: Mapping[str, str], strip: bool = True,
                    unknown: str = UNKNOWN_CATEGORY) -> Column:
    """Category of a label from a literal mapping (no join)."""
    c = F.col(label) if isinstance(label, str) else label
    key = strip_terminator(c) if strip else c
    lookup = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(lookup, key), F.lit(unknown))


def category_rollup(df: DataFrame, mapping: Mapping[str, str] | DataFrame, label_col: str = "label",
                    strip: bool = True, unknown: str = UNKNOWN_CATEGORY) -> DataFrame:
    """``category, n``: rows per attack category; unmapped labels count as
    ``unknown``.

    A dict mapping is inlined as a literal map. A DataFrame mapping
    (``label, category``) is joined to the rows per label, the join strategy
    left to the runtime sizes; a label mapped to two categories is an error.
    """
    key = strip_terminator(label_col) if strip else F.col(label_col)
    per_label = df.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if not isinstance(mapping, DataFrame):
        named = per_label.select(attack_category("label", mapping, strip=False, unknown=unknown).alias("category"), "n")
    else:
        conflict = F.raise_error(F.concat(F.lit("label with two categories: "), F.col("label"))).cast("string")
        one = mapping.groupBy("label").agg(F.min("category").alias("lo"), F.max("category").alias("hi"))
        one = one.select("label", F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(conflict)
                         .alias("category"))
        named = per_label.join(one, on="label", how="left").select(
            F.coalesce("category", F.lit(unknown)).alias("category"), "n")
    return named.groupBy("category").agg(F.sum("n").cast("bigint").alias("n"))
