"""Distributed sequential numbering.

``row_number()`` over a whole frame (or over one hot key) runs in a single
task. Here rows are first cut into *blocks* that are contiguous in the sort
order; each block is numbered on its own and shifted by the number of rows in
the blocks before it. The bounds are weighted cut points over (distinct key,
count), where the key is all order columns and a hash of the whole row, so
neither ties in the leading column nor a hot key make a large block. A row
with more copies than a block holds is a block of its own: it is counted, its
ids are one range, and the range is expanded in two steps. Null order values
come first, as in Spark's sort; every input row is an output row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import epoch_micros
from ..session import staged

#: Rows per block, until that would need more than MOST_BLOCKS blocks; keys
#: sampled per block. At most 2 * MOST_BLOCKS * KEYS_PER_BLOCK keys reach the driver.
BLOCK_ROWS, MOST_BLOCKS, KEYS_PER_BLOCK = 200_000, 20_000, 16
#: Copies of one row that a single row of the first expansion step stands for.
CHUNK_ROWS = 10_000
_SHARES = 1 << 20


def order_value(df: DataFrame, name: str) -> Column:
    """A column as a value of the same order that JSON carries exactly."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(name, ntz=isinstance(dt, T.TimestampNTZType))
    if isinstance(dt, T.DateType):
        return F.datediff(F.col(name), F.lit("1970-01-01").cast("date"))
    if isinstance(dt, (T.NumericType, T.StringType, T.BooleanType)):
        return F.col(name)
    raise TypeError(f"cannot order by a column of type {dt}")


def row_hash(df: DataFrame) -> Column:
    """Non-negative 63-bit hash of a whole row (it decides the order of ties)."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in df.columns]), 1)


def _order_key(df: DataFrame, cols: Sequence[str], whole_row: bool) -> Column:
    fields = [order_value(df, c).alias(f"k{i}") for i, c in enumerate(cols)]
    if whole_row:
        fields.append(row_hash(df).alias("tie"))
    return F.struct(*fields)


class OrderBlocks:
    """Bounds that cut the order of some columns into blocks of about
    ``block_rows`` rows, taken from the rows of ``df`` (a stored table: it is
    read twice).

    The rows are counted per distinct key; keys are sampled with a share in
    proportion to their count (by hash, so a recomputation samples the same)
    and cut where the counts add up to a block. The bounds become a literal
    that each row searches in log2(blocks) steps. With ``whole_row``, a key
    with more rows than a block starts one and ends it (``single``).
    """

    def __init__(self, df: DataFrame, cols: Sequence[str], block_rows: int, whole_row: bool):
        self.cols, self.whole_row, self.bounds, self.n_bounds = cols, whole_row, None, 0
        self.single: list[int] = []
        n = df.count()
        blocks = max(1, min(MOST_BLOCKS, math.ceil(n / max(1, block_rows))))
        if blocks == 1:
            return
        size = math.ceil(n / blocks)
        step = max(1, size // KEYS_PER_BLOCK)
        keyed = df.select(_order_key(df, cols, whole_row).alias("key"))
        counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        share = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(_SHARES)) * F.lit(step) < F.col("n") * F.lit(_SHARES)
        sample = counted.filter(share).orderBy("key").select(
            F.to_json("key", {"ignoreNullFields": "false"}).alias("j"), "n").collect()
        chosen, gathered = [], 0
        for r in sample:
            alone = whole_row and r.n > size
            if gathered and (alone or gathered >= size):
                chosen.append(r.j)
                gathered = 0
            if alone:
                self.single.append(len(chosen))
                head, tie = r.j[:-1].rsplit(":", 1)         # "tie" is the last field
                chosen.append(f"{head}:{int(tie) + 1}}}")
            else:
                gathered += max(r.n, step)
        if chosen:
            kind = T.ArrayType(keyed.schema["key"].dataType)
            self.bounds = F.from_json(F.lit("[" + ",".join(chosen) + "]"), kind)
            self.n_bounds = len(chosen)

    def place(self, df: DataFrame, cols: Sequence[str] | None = None, out: str = "__block") -> DataFrame:
        """Add ``out``: block number, ascending in the order of ``cols`` (nulls
        first), never splitting rows equal in ``cols`` (and, with
        ``whole_row``, in every other column)."""
        if self.bounds is None:
            return df.withColumn(out, F.lit(0))
        # a column per step, not a lambda: the key is made once a row, and the
        # search is compiled
        keyed = df.withColumn("__key", _order_key(df, cols or self.cols, self.whole_row)).withColumn(out, F.lit(0))
        for i in reversed(range(self.n_bounds.bit_length())):
            at = F.col(out) + F.lit(1 << i)
            after = (at <= self.n_bounds) & (F.get(self.bounds, at - 1) <= F.col("__key"))
            keyed = keyed.withColumn(out, F.when(after, at).otherwise(F.col(out)))
        return keyed.drop("__key")


def order_blocks(df: DataFrame, cols: Sequence[str], out: str = "__block",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with a block number, ascending in the order of ``cols``: each
    block but the last has exactly ``block_rows`` rows, whatever repeats."""
    at = row_id(df, cols, out="__at", block_rows=block_rows)
    return at.withColumn(out, F.floor(F.col("__at") / F.lit(block_rows)).cast("bigint")).drop("__at")


def block_offsets(df: DataFrame, groups: Sequence[str], block: str, measures: Sequence[str],
                  prefix: str) -> tuple[DataFrame, Column]:
    """(offsets, join condition): for every group and block the sums of
    ``measures`` (named ``prefix + measure``) over the group's earlier blocks.
    One row per group and block; null groups are groups."""
    totals = df.groupBy(*groups, block).agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"{prefix}g{i}" for i in range(len(groups))]
    offsets = totals.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col(block).alias(f"{prefix}b"),
                            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(prefix + m) for m in measures])
    same = F.col(block) == F.col(f"{prefix}b")
    for g, n in zip(groups, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return offsets, same


def expand_copies(df: DataFrame, copies: str, out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with each row repeated ``copies`` times and ``out`` = 0, 1, ...
    per row (none for 0 copies).

    In two steps: a row becomes one row per ``chunk_rows`` copies, these are
    dealt to all tasks, and each is expanded there. No task builds more than
    a chunk at once, however often a row repeats.
    """
    chunks = F.when(F.col(copies) > 0, F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / F.lit(chunk_rows)).cast("bigint")))
    dealt = df.withColumn("__chunk", F.explode(chunks))
    dealt = dealt.repartition(*[F.col(c) for c in df.columns], F.col("__chunk"))
    first = F.col("__chunk") * F.lit(chunk_rows)
    last = F.least(first + F.lit(chunk_rows), F.col(copies).cast("bigint")) - F.lit(1)
    return dealt.withColumn(out, F.explode(F.sequence(first, last))).drop("__chunk")


def row_id(df: DataFrame, order_cols: Sequence[str], out: str = "id", base: int = 0,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive ids ``base, base+1, ...`` in ``order_cols`` order.

    Replaces ``monotonically_increasing_id`` (whose values depend on the
    partition layout) wherever ids must line up across frames. Nulls come
    first; ties are ordered by a hash of the row, so the ids of rows that
    differ are the same on every run.

    The input is read once, into a stored table from which the counts and the
    ids both come, so they agree also where the input is not deterministic.
    The counts per block (at most 40,000 numbers) become a literal; the rows
    are shuffled once. Rows with more copies than a block are counted instead
    and their ids expanded in two steps (:func:`expand_copies`).
    """
    df = staged(df, "rows")
    tie = row_hash(df)
    cut = OrderBlocks(df, order_cols, block_rows, True)
    order = [*[F.col(c) for c in order_cols], tie]
    if not cut.n_bounds:
        whole = Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(whole) - 1 + F.lit(base)).cast("bigint"))
    blocked = cut.place(df)
    counts = {r["__block"]: r["count"] for r in blocked.groupBy("__block").count().collect()}
    at, starts = 0, [0]
    for b in range(cut.n_bounds):
        at += counts.get(b, 0)
        starts.append(at)
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col("__block"))
    inside = Window.partitionBy("__block").orderBy(*order)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, (start + F.row_number().over(inside) - 1 + F.lit(base)).cast("bigint"))
    if not cut.single:
        return numbered(blocked).drop("__block")
    alone = F.col("__block").isin(cut.single)
    copies = blocked.filter(alone).groupBy(*df.columns, "__block").agg(F.count(F.lit(1)).alias("__n"))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("__from", start + F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    ranges = expand_copies(copies, "__n", "__copy").withColumn(
        out, (F.col("__from") + F.col("__copy") + F.lit(base)).cast("bigint"))
    return numbered(blocked.filter(~alone)).drop("__block").unionByName(
        ranges.drop("__block", "__n", "__from", "__copy"))
