"""Shared expressions and small Spark helpers of the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staging_path, table_path

#: ASCII white space: the separators of words everywhere in this subpackage.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Hash blocks per group in :func:`prefix_sums` (three hexadecimal digits).
BLOCK_DIGITS = 3


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` whose Python workers can import this package from
    where the driver has it (a cluster has it installed or at the same path)."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    return df.mapInArrow(run, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below ``spark.checkpoint.dir`` and read
    it back: lineage ends there, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; empty for a null text."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def key_hash(*parts: Column | str) -> Column:
    """MD5 (hex) of the parts; null is told apart from every text."""
    cols = [F.lit(p) if isinstance(p, str) else
            F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], measure: Column, out: str) -> DataFrame:
    """``out`` = sum of ``measure`` over the rows of the same group that come
    earlier by ``order``, whose first column must be a uniform hex hash.

    No group is ever one task: the hash's leading digits cut it into 4096
    ordered blocks of near equal size; block totals (one row per block) give
    each block's offset, and the running sum stays inside the block. Group
    columns must not be null.
    """
    block = df.withColumn("_block", F.substring(order[0], 1, BLOCK_DIGITS)).withColumn("_m", measure)
    totals = block.groupBy(*groups, "_block").agg(F.sum("_m").alias("_t"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*groups, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (block.withColumn("_in", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
            .join(offsets, [*groups, "_block"])
            .withColumn(out, (F.col("_off") + F.col("_in")).cast("long"))
            .drop("_block", "_m", "_off", "_in"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list, root = the
    smallest node of its component.

    Alternating large-star / small-star rounds: each is one aggregation (with
    map-side minimum) and one join back, so a node of any degree is a
    splittable join side, never one group in memory. Rounds are written to
    the shared folder; the loop ends when the edge set no longer changes,
    after O(log^2 n) rounds at most. Only two numbers per round reach the
    driver.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    cur, seen = staged(cur, "edges"), None
    while True:
        sym = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = star.filter("u <> v").distinct()
        big = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        cur = staged(small, "edges")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
