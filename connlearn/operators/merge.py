"""Joining frames by key or by position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import expand_copies, row_id


def merge_frames(frames: Sequence[DataFrame], key: str | Sequence[str] = "id",
                 how: str = "full_outer", unique_keys: bool = False) -> DataFrame:
    """Merge frames that share a key column and carry different other columns.

    A chain of equi-joins (duplicate keys multiply, null keys match nothing).
    ``unique_keys=True`` states that no key repeats within a frame, which
    allows one ``unionByName`` and one aggregation by key in place of a chain
    of full outer joins: a single shuffle however many frames. The statement
    is checked in the same aggregation: a repeated key is an error. Rows with
    a null key stay rows of their own, however often they repeat.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not (unique_keys and how in ("full_outer", "outer", "full") and len(frames) > 1):
        return reduce(lambda a, b: a.join(b, on=keys, how=how), frames)
    value_cols = [c for f in frames for c in f.columns if c not in keys]
    if len(value_cols) != len(set(value_cols)):
        raise ValueError("unique_keys needs frames whose other columns have different names")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # a row without a key stands for itself: its identity is all its values, so
    # a repeated stage groups it alike; equal ones are counted and put back
    tagged = [f.withColumn("__frame", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    stacked = stacked.withColumn("__alone", F.when(no_key, F.struct("__frame", *keys, *value_cols)))
    repeats = (F.count(F.lit(1)) != F.count_distinct("__frame")) & F.col("__alone").isNull()
    merged = stacked.groupBy(*keys, "__alone").agg(
        repeats.alias("__repeats"), F.count(F.lit(1)).alias("__n"),
        *[F.first(c, ignorenulls=True).alias(c) for c in value_cols])
    named = F.concat(F.lit("repeated key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.col("__repeats"), F.raise_error(named)).otherwise(F.lit(True))
    merged = merged.filter(checked)
    several = F.col("__alone").isNotNull() & (F.col("__n") > 1)
    copies = expand_copies(merged.filter(several).select(*keys, *value_cols, "__n"), "__n", "__copy")
    return merged.filter(~several).select(*keys, *value_cols).unionByName(copies.select(*keys, *value_cols))


def merge_features(left: DataFrame, right: DataFrame, key: str = "id", how: str = "full_outer") -> DataFrame:
    """Join on ``key`` and drop it afterwards."""
    return left.join(right, on=key, how=how).drop(key)


def zip_by_position(left: DataFrame, right: DataFrame, left_order: Sequence[str],
                    right_order: Sequence[str], key: str = "pos") -> DataFrame:
    """Pair row *i* of ``left`` with row *i* of ``right`` under stated orders.

    Each side is numbered with :func:`row_id` (distributed), then inner-joined
    on the position; rows beyond the shorter side have no partner.
    """
    lpos = row_id(left, left_order, out=key)
    rpos = row_id(right, right_order, out=key)
    return lpos.join(rpos, on=key, how="inner")
