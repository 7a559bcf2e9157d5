"""SimHash near-duplicates: fingerprints linked through multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, read, staged

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SEGMENT_BITS = 32
#: Distinct fingerprints that share a table key beyond which the key is
#: linked through ball points instead of candidate pairs (both are exact).
DENSE = 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included. Words are split
    at ASCII white space after lower-casing A-Z; fewer words than ``width``
    make one shingle; no word gives 0. A bit is set if it is set in more than
    half of the shingles' XXH64 values."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= width:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(w) - width + 1
    h = np.fromiter((digest(join(s), SEED) for s in zip(*(w[i:] for i in range(width)))), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key, fp long) for every row; the long holds the 64 bits, signed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(F.col(key).alias("key"), text), run, f"key {kind}, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments() -> list[tuple[int, Column]]:
    mask = F.lit((1 << SEGMENT_BITS) - 1).cast("long")
    return [(0, F.col("fp").bitwiseAND(mask)), (1, F.shiftrightunsigned("fp", SEGMENT_BITS))]


def _flips(value: Column, bits: int) -> Column:
    """The Hamming ball of radius 1 around ``value`` over ``bits`` bits."""
    def one(i: int) -> int:
        return (1 << i) - (1 << 64 if i == 63 else 0)
    return F.array(value, *[value.bitwiseXOR(F.lit(one(i)).cast("long")) for i in range(bits)])


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b) edges whose components are those of "at most 2 differing bits"
    over the distinct fingerprints ``nodes`` (column fp).

    Two 32-bit segments: a pair within 2 bits has a segment within 1 bit, so
    each fingerprint is stored once per segment table and looked up under the
    33 values of its segment's radius-1 ball; matches are verified on all 64
    bits. A table key with more than ``dense`` fingerprints is not paired:
    all fingerprints that touch it are joined to the 65 points of their
    64-bit radius-1 balls instead, because two fingerprints are within 2 bits
    exactly if their balls share a point. Points may appear as nodes. Both
    ways are linear in the fingerprints for any skew, and lose no link.
    """
    table = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).cast("byte").alias("s"), v.alias("v")) for s, v in _segments()])).alias("k")
    ).select("fp", "k.s", "k.v")
    probes = table.select("fp", "s", F.explode(_flips(F.col("v"), SEGMENT_BITS)).alias("v"))
    crowded = table.groupBy("s", "v").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("s", "v")
    crowded = staged(crowded, "crowded")

    thin = table.join(crowded, ["s", "v"], "left_anti").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = (probes.withColumnRenamed("fp", "a").join(thin, ["s", "v"]).filter((F.col("a") < F.col("b")) & near)
             .select("a", "b"))

    touch = probes.join(crowded, ["s", "v"], "left_semi").select("fp").distinct()
    points = touch.select(F.col("fp").alias("a"), F.explode(_flips(F.col("fp"), 64)).alias("b"))
    shared = points.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
    return pairs.unionAll(points.join(shared, "b").filter("a <> b").select("a", "b"))


def components(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """(key, fp, component_id) for every row of (key, fp): the smallest key
    reachable over links of at most 2 bits, itself included.

    Equal fingerprints are one node from the first aggregation on. A null key
    never names a component that has another key; a component of null keys
    only has a null id. Repeated rows stay repeated; no rows give no rows.
    """
    nodes = staged(prints.groupBy("fp").agg(F.min("key").alias("low")), "nodes")
    roots = connected_components(links(nodes.select("fp"), dense))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["n_fp"]).select("key", "fp", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key, fingerprint hex, component_id) for every row of ``df``. The
    fingerprints are written once; texts are read once and never shuffled."""
    prints = staged(fingerprints(df, key, text, width), "prints")
    return components(prints).select(F.col("key").alias(key), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every whole text of ``documents``, one row per row.

    Texts without words have fingerprint 0 and link to each other; equal fingerprints are
    one node, however many rows have them; an empty table gives no rows."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component the document with its smallest id
    (null ids last, then by text hash). Rows are told apart by id and text, so
    different texts under one id are different documents; rows equal in both
    are one, the first by its other columns. Column names may be any."""
    me = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"),
                  F.xxhash64("text").alias("h"))
    prints = staged(fingerprints(docs.select(me.alias("key"), "text"), "key"), "prints")
    keep = components(prints).filter(F.col("key") == F.col("component_id")).groupBy("key").agg(
        F.count("*").alias("n"))
    keep = keep.select(F.col("key.n").alias("kn"), F.col("key.i").alias("ki"), F.col("key.h").alias("kh"), "n")
    rows = docs.select(F.struct(*docs.columns).alias("row"), me.alias("me"))
    kept = rows.join(keep, (F.col("me.n") == F.col("kn")) & (F.col("me.i") == F.col("ki"))
                     & (F.col("me.h") == F.col("kh")))
    repeated = kept.filter("n > 1").groupBy("me").agg(F.min("row").alias("row"))
    return kept.filter("n = 1").select("row.*").unionAll(repeated.select("row.*"))


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
