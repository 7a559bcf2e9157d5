"""Weighted rendezvous hashing of stable record keys over shards, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import expand_copies
from .common import key_hash, prefix_sums, read

SHARDS = 8


def unit(hash_hex: Column) -> Column:
    """A hex hash's first 52 bits as a double strictly between 0 and 1."""
    return (F.conv(F.substring(hash_hex, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the largest ``-weight / ln(u(key, shard))``; equal scores
    go to the smaller number. A shard's score depends on the key and that
    shard alone, so one more shard (or more weight) only takes rows into
    itself. A null key is a key of its own; weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(-float(w)) / F.log(unit(key_hash(key, str(s))))).alias("score"),
                       F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["minus"]).cast("int")


def shard_rows(df: DataFrame, key: str, attributes: list[str], weights: list[float],
               grown: list[float] | None = None) -> DataFrame:
    """(key, *attributes, shard, slot[, grown_shard]) for every row of ``df``.

    ``slot`` counts the rows of a shard from 0 without gaps, ordered by the
    key's hash, the key and the attributes. Equal rows are counted first and
    expanded last, in two steps, so a key with any number of equal rows is one row in the
    shuffle; the numbering of a shard is cut into hash blocks. Null keys are
    placed like any key; an empty frame gives an empty frame; other columns
    of ``df`` (whatever their names) are left out.
    """
    attrs = [F.col(c).alias(f"a{i}") for i, c in enumerate(attributes)]
    names = [f"a{i}" for i in range(len(attributes))]
    rows = df.select(F.col(key).alias("k"), *attrs).groupBy("k", *names).agg(F.count("*").alias("n"))
    rows = rows.withColumn("shard", rendezvous(F.col("k"), weights))
    if grown:
        rows = rows.withColumn("grown_shard", rendezvous(F.col("k"), grown))
    rows = rows.withColumn("h", key_hash(F.col("k"), *[F.col(c) for c in names]))
    rows = prefix_sums(rows, ["shard"], ["h", "k", *names], F.col("n"), "first")
    rows = expand_copies(rows.drop("h"), "n", "j").withColumn("slot", F.col("first") + F.col("j"))
    return rows.select(F.col("k").alias(key), *[F.col(n).alias(c) for n, c in zip(names, attributes)],
                       "shard", "slot", *(["grown_shard"] if grown else []))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards by the key law, one row per row.

    A null text has size 1 and the crc of nothing; a null doc_id is a key of its own;
    rows with equal ids share a shard, equal rows get slots each; an empty table gives
    no rows."""
    docs = read(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
                        F.crc32(body).alias("text_crc32"))
    out = shard_rows(sized, "doc_id", ["size", "text_crc32"], [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _score(s: int) -> str:
    return (f"struct_pack(score := -1.0::double / ln((('0x' || substr(md5(k || '|{s}'), 1, 13))::ubigint::double + 0.5)"
            f" / 4503599627370496.0::double), m := {-s})")


#: crc32 by table lookup, folded over the UTF-8 bytes of the text.
_CRC = """
bits AS (SELECT i, 0 AS step, i::ubigint AS v FROM range(256) r(i)),
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    WITH RECURSIVE s AS (
      SELECT i, step, v FROM bits
      UNION ALL
      SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::ubigint) ELSE v >> 1 END FROM s WHERE step < 8)
    SELECT i, v FROM s WHERE step = 8))"""

ORACLE = {"op3_rendezvous_sharding": f"""
WITH {_CRC},
raw AS (
  SELECT doc_id, coalesce('=' || doc_id::varchar, '-') AS k, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (
  SELECT doc_id, k, octet_length(b)::bigint + 1 AS size, hex(b) AS x FROM raw),
crc AS (
  SELECT doc_id, k, size,
    xor(list_reduce(list_prepend(4294967295::ubigint,
          list_transform(range(0, length(x) // 2),
                         lambda i: ('0x' || substr(x, (2 * i + 1)::bigint, 2))::ubigint)),
        lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::bigint + 1])),
        4294967295::ubigint)::bigint AS text_crc32
  FROM bytes, crc_table),
placed AS (
  SELECT *, -(list_max([{', '.join(_score(s) for s in range(SHARDS))}]).m) AS shard,
         -(list_max([{', '.join(_score(s) for s in range(SHARDS + 1))}]).m) AS grown_shard,
         md5(k || '|=' || size || '|=' || text_crc32) AS h
  FROM crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::int AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown_shard::int AS grown_shard
FROM placed"""}

QUERIES = {"op3_rendezvous_sharding": op3_rendezvous_sharding}
