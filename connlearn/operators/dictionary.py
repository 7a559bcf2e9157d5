"""Categorical columns with many values: a dictionary table, and hashed slots.

The indexer of :mod:`.encode` holds its value lists in the driver. Here the
values of any number of columns are counted and numbered as one distributed
table, stored as Parquet, and joined back; nothing of the size of a domain
reaches the driver. The hashed form needs no dictionary, and its collisions
are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket
from ..session import staging_path
from .sequence import row_id

DICTIONARY_SCHEMA = "column string, value string, n long, index long"


def _values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, value`` of every cell, in one pass over ``df``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("v")).select("v.*")


def category_dictionary(df: DataFrame, cols: Sequence[str], path: str | None = None) -> DataFrame:
    """``column, value, n, index`` of all non-null values, written to ``path``
    (a new folder below the shared staging folder by default).

    The index counts from 0 per column, by frequency descending, ties by
    value, as the indexer does. One aggregation, one distributed numbering
    over (column, frequency, value).
    """
    if not cols:
        raise ValueError("name at least one column")
    counted = _values(df, cols).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    placed = row_id(counted.withColumn("__less", -F.col("n")), ["column", "__less", "value"], out="__at").drop("__less")
    first = placed.groupBy("column").agg(F.min("__at").alias("__first"))          # one row per column name
    target = path or staging_path(df.sparkSession, "dictionary")
    (placed.join(F.broadcast(first), "column").select("column", "value", "n", (F.col("__at") - F.col("__first")).alias("index"))
     .write.mode("overwrite").parquet(target))
    return read_dictionary(df.sparkSession, target)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)


def dictionary_widths(dictionary: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Slots per column: its values and the slot of unseen ones."""
    known = {r["column"]: r["n"] for r in dictionary.filter(F.col("column").isin(*cols)).groupBy("column").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    return {c: known.get(c, 0) + 1 for c in cols}


def dictionary_index(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], suffix: str = "_index") -> DataFrame:
    """``df`` plus ``<col><suffix>`` (long) per column: the value's index;
    null and unseen values get the index after the last. One join per
    column; every input row is an output row."""
    widths = dictionary_widths(dictionary, cols)
    for c in cols:
        own = dictionary.filter(F.col("column") == c).select(F.col("value").alias("__value"), F.col("index").alias("__index"))
        df = df.join(own, F.col(c).cast("string") == F.col("__value"), "left").withColumn(
            c + suffix, F.coalesce("__index", F.lit(widths[c] - 1).cast("long"))).drop("__value", "__index")
    return df


def sparse_slots(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], out: str = "slots", base: int = 0) -> DataFrame:
    """``df`` plus ``out``: the positions (ascending longs) of the ones in the
    one-hot encoding of ``cols`` side by side, from ``base``. A row has one
    per column, however wide the encoding is."""
    widths = dictionary_widths(dictionary, cols)
    indexed, at, parts = dictionary_index(df, dictionary, cols, suffix="__ix"), base, []
    for c in cols:
        parts.append(F.col(f"{c}__ix") + F.lit(at).cast("long"))
        at += widths[c]
    return indexed.withColumn(out, F.array(*parts)).drop(*[f"{c}__ix" for c in cols])


def hashed_slot(column: str, value: Column, buckets: int, seed: int = 0) -> Column:
    """Slot of a value in ``[0, buckets)``; null for null."""
    return F.when(value.isNotNull(), hash_bucket([F.lit(column), value.cast("string")], buckets, seed))


def hashed_slots(df: DataFrame, cols: Sequence[str], buckets: int, out: str = "slots", seed: int = 0) -> DataFrame:
    """``df`` plus ``out``: distinct hashed positions (ascending longs) of its
    values, all columns in the same ``buckets``; nulls set none. No
    dictionary, no join, no shuffle."""
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    found = F.filter(F.array(*[hashed_slot(c, F.col(c), buckets, seed) for c in cols]), lambda x: x.isNotNull())
    return df.withColumn(out, F.array_sort(F.array_distinct(found)))


def hash_collisions(dictionary: DataFrame, buckets: int, seed: int = 0) -> DataFrame:
    """``column, n_values, n_slots, n_shared, rows_shared`` per column: its
    values, the slots they take, and the values (and the rows that hold them)
    whose slot another value, of any column, takes too."""
    key = F.concat_ws(":", F.col("column"), F.col("value"), F.lit(str(seed)))
    slot = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
    placed = dictionary.select("column", "value", "n", slot.alias("slot"))
    crowd = placed.groupBy("slot").agg(F.count(F.lit(1)).alias("k"))
    shared = F.col("k") > 1
    return placed.join(crowd, "slot").groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_distinct("slot").alias("n_slots"),
        F.count(F.when(shared, 1)).alias("n_shared"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("rows_shared"))
