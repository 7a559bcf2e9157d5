"""SpotSigs fingerprints: chains of content words after common-word anchors."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read

#: The anchors, common words of English, German, French and Spanish.
ANCHORS = frozenset("""
a an and are as at be by for from in is it of on or that the this to was what with
auch auf das dem den der des die ein eine für im in ist mit nicht sich und von zu
au avec dans de des du elle en est et la le les ne par pas pour que qui sur un une
al con de del el en es la las lo los no para por que se su un una y
""".split())
#: Content words in a chain, and the distance between them.
CHAIN, DISTANCE = 2, 1
THRESHOLD = 0.8
_WORD = re.compile(r"[^\W\d_]+")


def signatures(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> list[int]:
    """Sorted 32-bit signatures of a text, repeats included.

    Words are runs of letters in lower case. Each anchor starts a chain of
    ``chain`` content (non-anchor) words, every ``distance``-th after it; a
    chain that the text cuts off is none. A text without any chain is
    represented by its single words; one without words has no signature.
    """
    content, spots = [], []
    for w in _WORD.findall(text.lower()):
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last, crc = (chain - 1) * distance, zlib.crc32
    if chain == 2:
        n = len(content) - distance
        found = [f"{a} {content[i]} {content[i + distance]}" for a, i in spots if i < n]
    else:
        found = [" ".join((a, *content[i:i + last + 1:distance])) for a, i in spots if i + last < len(content)]
    if not found:
        found = content + [a for a, _ in spots]
    return sorted([crc(s.encode()) for s in found])


def fingerprint(sigs: list[int]) -> str:
    """Eight hex digits per signature, in order: the whole set, so that
    likeness can be computed from fingerprints alone."""
    return b"".join([s.to_bytes(4, "big") for s in sigs]).hex()


def likeness(a: list[int], b: list[int], least: float = 0.0) -> float:
    """Multiset Jaccard of two sorted signature lists (1 if both are empty),
    pruned: when the sizes, or the part still unread, cannot reach ``least``,
    the answer is 0. Bounds are quotients, as the likeness is: a product
    with ``least`` may be rounded above a pair that just reaches it."""
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) / max(len(a), len(b)) < least:
        return 0.0
    if a == b:
        return 1.0
    small, large = (a, b) if len(a) < len(b) else (b, a)
    total = len(a) + len(b)
    count, both = Counter(large), 0
    for i, s in enumerate(small):
        most = both + len(small) - i
        if most / (total - most) < least:
            return 0.0
        if count.get(s, 0) > 0:
            count[s] -= 1
            both += 1
    return both / (total - both)


# ---- neighbours in document order, without a global sort task

ROWS_PER_BLOCK, MOST_BLOCKS, KEYS_PER_BLOCK = 2048, 20_000, 16


def _search(bounds: Column, n: int, beyond) -> Column:
    """How many of ``n`` ascending bounds are not ``beyond`` the key."""
    steps = [1 << i for i in reversed(range(max(1, n.bit_length())))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(
        (lo + s <= n) & ~beyond(lo + s - 1), lo + s).otherwise(lo))


def ordered_blocks(df: DataFrame, key: str, text: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(block, ghost, k1, k2, key, text): the rows in descending key order
    (null keys last, equal keys by text hash), cut into blocks; the first row
    of each block also stands at the end of the block before it as a ghost,
    and the very first at the end of the last.

    The bounds are sampled keys of real rows, so they shape the layout but
    not the result, and each bound is the first row of its block: no second
    pass is needed to find it. At most 16 keys of 16 bytes for each of at
    most 20,000 blocks reach the driver. Equal keys with different texts are
    split between blocks.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"),
                     F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1)).alias("k1"),
                     F.xxhash64(text).alias("k2"))
    n = df.count()
    blocks = max(1, min(MOST_BLOCKS, n // rows_per_block))
    share = int(min(1.0, KEYS_PER_BLOCK * blocks / max(1, n)) * (1 << 20))
    pick = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 20)) < share
    got = rows.agg(F.min(F.struct("k1", "k2")).alias("low"),
                   F.collect_set(F.when(pick, F.struct("k1", "k2"))).alias("keys")).first()
    low = tuple(got.low) if n else (0, 0)
    keys = sorted(tuple(k) for k in got["keys"] if tuple(k) != low)
    step = max(1, math.ceil(len(keys) / blocks))
    bounds = keys[step - 1::step]

    def literal(i: int) -> Column:
        return F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>")

    if bounds:
        b1, b2 = literal(0), literal(1)

        def beyond(i):
            return (F.get(b1, i) > F.col("k1")) | ((F.get(b1, i) == F.col("k1")) & (F.get(b2, i) > F.col("k2")))

        block = _search(b1, len(bounds), beyond)
        placed = rows.withColumn("block", block)
        is_bound = (F.get(b1, F.col("block") - 1) == F.col("k1")) & (F.get(b2, F.col("block") - 1) == F.col("k2"))
        ghost = F.when(F.coalesce(is_bound, F.lit(False)), F.col("block") - 1)
    else:
        placed = rows.withColumn("block", F.lit(0))
        ghost = F.lit(None).cast("int")
    wrap = F.when((F.col("k1") == low[0]) & (F.col("k2") == low[1]), F.lit(len(bounds)))
    stands = F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("g")),
                     F.struct(F.coalesce(wrap, ghost).alias("b"), F.lit(True).alias("g")))
    return (placed.withColumn("s", F.explode(F.filter(stands, lambda x: x["b"].isNotNull())))
            .select(F.col("s.b").alias("block"), F.col("s.g").alias("ghost"), "k1", "k2", "key", "text")
            .repartition(len(bounds) + 1, "block").sortWithinPartitions("block", "ghost", "k1", "k2"))


OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text",
                      rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half
    is the beginning of the next document, with both likenesses.

    A null text is empty; a lone document is its own successor; equal rows
    stay separate rows; an empty frame gives an empty frame. One shuffle of
    the texts; blocks are streamed, one pair of texts at a time.
    """
    ordered = ordered_blocks(df, key, text, rows_per_block)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def edit(me: tuple, follower: tuple) -> tuple:
        name, t, sigs = me
        half = len(t) // 2
        edited = t[:len(t) - half] + follower[1][:half]
        other = signatures(edited)
        return (name, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(sigs), fingerprint(other),
                likeness(sigs, other), likeness(sigs, follower[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, at = None, None
        for b in batches:
            rows = []
            for block, ghost, name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if ghost and (prev is None or block != at):
                    continue
                t = t.as_py() or ""
                me = (name, t, signatures(t))
                if prev is not None and block == at:
                    rows.append(edit(prev, me))
                prev, at = (None if ghost else me), block
                if len(rows) >= 1000:
                    yield _batch(rows, names, b.schema.field(2).type)
                    rows = []
            if rows:
                yield _batch(rows, names, b.schema.field(2).type)

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(ordered.select("block", "ghost", "key", "text"), run, f"`{key}` {kind}, {OUT}")


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], kind),
                                       *[pa.array(c, t) for c, t in zip(cols[1:], types)]], names=names)


# ---- near-duplicates among all documents

def signature_sets(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sigs array<long>) for every row; null texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [signatures(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.list_(pa.int64()))], names=["key", "sigs"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(F.col(key).alias("key"), text), run, f"key {kind}, sigs array<long>")


def partition_starts(longest: int, threshold: float) -> list[int]:
    """Set lengths at which the length partitions start: a set can only be
    near enough to sets of its own and the neighbouring partitions."""
    out, at = [1], 1
    while at <= longest:
        at = max(at + 1, math.ceil(at / threshold))
        out.append(at)
    return out


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes) of the signature sets (key, sigs).

    ``classes`` has (key, rep) for every row: rows with equal sets form one
    class named by its smallest key, so copies are never expanded. ``pairs``
    has (a, b, likeness) for every two classes with multiset Jaccard of at
    least ``threshold``. Sets are dealt into length partitions; a pair meets
    in the partition of the shorter set on a signature among the rarest few
    of both (those that any near enough pair must share), is pruned by
    length, and then compared whole. Empty sets form a class without pairs.
    """
    classes = sets.groupBy("sigs").agg(F.min("key").alias("rep"))
    member = sets.join(classes, "sigs").select("key", "rep")
    full = classes.filter(F.size("sigs") > 0).withColumn("n", F.size("sigs"))
    longest = full.agg(F.max("n")).first()[0] or 1
    starts = F.split(F.lit(",".join(map(str, partition_starts(longest, threshold)))), ",").cast("array<int>")
    full = full.withColumn("p", F.size(F.filter(starts, lambda s: s <= F.col("n"))))
    # a repeated signature counts as several: (signature, how many before it)
    token = full.select("rep", "n", "p", F.posexplode("sigs").alias("i", "sig"))
    nth = F.row_number().over(Window.partitionBy("rep", "sig").orderBy("i"))
    token = token.withColumn("tok", F.xxhash64("sig", nth))
    rare = token.groupBy("tok").agg(F.count("*").alias("df"))
    token = token.join(rare, "tok").filter("df > 1")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "tok"))
    lone = F.count("*").over(Window.partitionBy("rep"))
    # signatures of one class only come first in the order and join nothing
    prefix = (token.withColumn("place", place + F.col("n") - lone)
              .filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6) + 1))
    left = prefix.select("tok", "p", F.col("rep").alias("a"), F.col("n").alias("an"))
    right = prefix.select("tok", F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("p"),
                          F.col("rep").alias("b"), F.col("n").alias("bn"))
    short = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))
    cand = left.join(right, ["tok", "p"]).filter(short & (F.col("an") / F.col("bn") >= F.lit(threshold)))
    cand = cand.select("a", "b").distinct()
    whole = full.select("rep", "sigs")
    both = (cand.join(whole.select(F.col("rep").alias("a"), F.col("sigs").alias("x")), "a")
            .join(whole.select(F.col("rep").alias("b"), F.col("sigs").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [likeness(x.as_py(), y.as_py(), threshold) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.float64())],
                                             names=["a", "b", "likeness"])

    kind = sets.schema["key"].dataType.simpleString()
    pairs = map_arrow(both, run, f"a {kind}, b {kind}, likeness double").filter(F.col("likeness") >= threshold)
    return pairs, member


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likeness of every whole text, its edit and the next document.

    A null text is empty; rows are ordered by doc_id descending, null ids last; equal ids
    are ordered by their content; an empty table gives no rows."""
    return fingerprint_edits(read(spark, sf_dir, "documents"))


QUERIES = {"op7_spotsigs": op7_spotsigs}
