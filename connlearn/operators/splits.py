"""Train/test splits and bag union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket
from ..session import staged
from .sequence import expand_copies


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Seeded Bernoulli split (weights are normalised), like ``randomSplit``.

    Which part a row lands in depends on the layout of the input.
    :func:`hash_split` (rows with a key) and :func:`row_split` (rows without)
    give the same parts for any layout.
    """
    return df.randomSplit([float(w) for w in weights], seed=seed)


def hash_split(df: DataFrame, key_cols: Sequence[str], weights: Sequence[int], seed: int,
               bucket_col: str | None = None) -> list[DataFrame]:
    """Deterministic split by an md5 bucket of a key.

    Each row lands in exactly one part whatever the partitioning, and a
    recomputed task puts it in the same part again (unlike a sampler whose
    output depends on row order within a partition).
    """
    ints = [int(w) for w in weights]
    if any(w <= 0 for w in ints) or any(float(w) != float(x) for w, x in zip(ints, weights)):
        raise ValueError("hash_split weights must be positive integers")
    total = sum(ints)
    bucket = hash_bucket(key_cols, total, seed)
    tagged = df.withColumn("__bucket", bucket)
    parts, lo = [], 0
    for w in ints:
        part = tagged.filter((F.col("__bucket") >= lo) & (F.col("__bucket") < lo + w))
        parts.append(part.withColumnRenamed("__bucket", bucket_col) if bucket_col else part.drop("__bucket"))
        lo += w
    return parts


def row_split(df: DataFrame, weights: Sequence[int], seed: int) -> list[DataFrame]:
    """Seeded split of rows that have no key, the same for any layout.

    The frame is taken as what it is, a multiset: equal rows are counted, and
    copy ``i`` of a row goes where an md5 of (row, i, seed) puts it, so the
    copies are dealt independently in the ratio of the weights (positive
    integers). The counted rows are stored, so all parts come from the same
    rows; copies are expanded in two steps, so no task holds all copies of a
    row. Nulls equal nulls; columns are taken as text.
    """
    ints = [int(w) for w in weights]
    if any(w <= 0 for w in ints) or any(float(w) != float(x) for w, x in zip(ints, weights)):
        raise ValueError("row_split weights must be positive integers")
    cols = df.columns
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.md5(F.col(c).cast("string"))), F.lit("-"))
                                   for c in cols]))
    counted = staged(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")), "rows")
    dealt = counted.withColumn("__key", key)
    one = dealt.filter("__n = 1").withColumn("__copy", F.lit(0).cast("bigint"))
    more = expand_copies(dealt.filter("__n > 1"), "__n", "__copy")
    placed = one.unionByName(more).withColumn("__bucket", hash_bucket(["__key", "__copy"], sum(ints), seed))
    parts, lo = [], 0
    for w in ints:
        parts.append(placed.filter((F.col("__bucket") >= lo) & (F.col("__bucket") < lo + w)).select(*cols))
        lo += w
    return parts


def split_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of frames with the same columns (no shuffle)."""
    return reduce(lambda a, b: a.unionByName(b), parts)
