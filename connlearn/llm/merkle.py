"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf. The children of a parent are spread by conditional
aggregates into one column per slot; the concatenated columns hash to the
parent, and leaving out the own slot's column gives a child's siblings. One
tree per group (source) is built over the leaves, one over the group roots.

Proofs come from the same pivots, top down: a parent's row hands each of its
slots the siblings left and right of it, in front of what the parent got from
above. So siblings are never shuffled per leaf: a level moves one row per
parent. Groups of any size are cut by position, 16 rows meet at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import row_id
from .common import read, staged
from .sharding import _CRC

#: Children of a parent.
FANOUT = 16
#: Rows of a block in numbering the leaves.
BLOCK = 2048
#: Documents whose unsigned crc32 of the id this number divides are tampered with.
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_bytes(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lower-case hex SHA-256 over the fields, each told apart by its length."""
    return F.sha2(F.concat(*[field_bytes(v) for v in values]).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, big, big.lower())


def parent_hash(slots: list[str]) -> Column:
    return F.expr(f"sha2(concat_ws('', {', '.join(slots)}), 256)")


def slot_names(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


def pivot(nodes: DataFrame, fanout: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(g, pos, n, c0.., and one column per slot and ``carried`` column):
    ``nodes`` (g, pos, n, digest) by parent; ``n`` becomes the group's number
    of parents."""
    own = F.pmod("pos", F.lit(fanout))

    def spread(col: str, prefix: str) -> list[Column]:
        return [F.expr(f"max(CASE WHEN slot = {k} THEN {col} END) AS {prefix}{k}") for k in range(fanout)]
    parents = nodes.select("g", F.floor(F.col("pos") / F.lit(fanout)).cast("bigint").alias("up"), own.alias("slot"),
                           F.ceil(F.col("n") / F.lit(fanout)).cast("bigint").alias("n"), "digest", *carried)
    return parents.groupBy("g", F.col("up").alias("pos")).agg(
        F.max("n").alias("n"), *spread("digest", "c"), *[x for c in carried for x in spread(c, f"{c}_")])


def build(nodes: DataFrame, depth: int, fanout: int, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots (g, digest, level)) of the trees of all groups in
    ``nodes`` (g, pos from 0, n of the group, digest). ``depth`` levels at
    most; a group with one node left is done. Each level is a stored table."""
    done = nodes.filter("n = 1").select("g", "digest", F.lit(0).alias("level"))
    levels, todo = [], nodes.filter("n > 1")
    for i in range(depth):
        level = staged(pivot(todo, fanout, carried if i == 0 else ()), "merkle")
        levels.append(level)
        up = level.select("g", "pos", "n", parent_hash(slot_names(fanout)).alias("digest"))
        done = done.unionByName(up.filter("n = 1").select("g", "digest", F.lit(i + 1).alias("level")))
        todo = up.filter("n > 1")
    return levels, staged(done, "merkle")


def _slots(fanout: int, carried: tuple[str, ...]) -> Column:
    """Per filled slot: its number, the digests left and right of it, and its
    carried columns."""
    names = slot_names(fanout)

    def joined(part: list[str]) -> str:
        return f"concat_ws('', {', '.join(part)})" if part else "''"
    slots = [f"CASE WHEN {c} IS NOT NULL THEN named_struct('slot', {k}L, 'l', {joined(names[:k])}, "
             f"'r', {joined(names[k + 1:])}{''.join(f', {x!r}, {x}_{k}' for x in carried)}) END"
             for k, c in enumerate(names)]
    return F.expr(f"filter(array({', '.join(slots)}), x -> x IS NOT NULL)")


def hand_down(levels: list[DataFrame], tops: DataFrame, fanout: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(g, pos, path, mark, carried columns) of every leaf: ``path`` holds,
    from the leaf's level up, the digests left and right of the path's node.
    ``tops`` (g, level, path, mark): what each group's root got from above.
    Groups without a level (a lone leaf) are not in the result."""
    kept = None
    for i in reversed(range(len(levels))):
        got = tops.filter(F.col("level") == i + 1).select("g", F.lit(0).cast("bigint").alias("pos"), "path", "mark")
        got = got if kept is None else got.unionByName(kept)
        got = got.select(F.col("g").alias("_g"), F.col("pos").alias("_p"), F.col("path").alias("_up"), "mark")
        below = carried if i == 0 else ()
        level = levels[i].join(got, (F.col("g") == F.col("_g")) & (F.col("pos") == F.col("_p")))
        out = level.select("g", "pos", "_up", "mark", F.explode(_slots(fanout, below)).alias("s"))
        own = F.array(F.struct(F.col("s.l").alias("l"), F.col("s.r").alias("r")))
        kept = out.select("g", (F.col("pos") * F.lit(fanout) + F.col("s.slot")).alias("pos"),
                          F.concat(own, F.col("_up")).alias("path"), "mark", *[F.col(f"s.{c}").alias(c) for c in below])
        if i:
            kept = staged(kept, "merkle")
    return kept


def levels_needed(n: int, fanout: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // fanout), depth + 1
    return depth


def fold(digest: Column, path: Column) -> Column:
    """Root recomputed from a leaf digest and its siblings."""
    return F.aggregate(path, digest, lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 over the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)


def positions(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` plus ``pos`` (from 0 in the group, by ``order``) and ``n``
    (rows of the group). ``group`` must not be null.

    Rows are numbered over (group, order) in blocks that no group, key or
    repeated row outgrows; then the place of the group's first row is joined
    by (group, block of positions)."""
    at = staged(row_id(leaves, [group, *order], out="_at", block_rows=BLOCK), "merkle")
    cells = at.withColumn("_blk", F.floor(F.col("_at") / F.lit(BLOCK)).cast("bigint"))
    per = cells.groupBy(group, "_blk").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    size = per.groupBy(group).agg(F.min("_lo").alias("_first"), F.sum("_c").alias("n"))
    per = per.join(size, group).select(F.col(group).alias("_grp"), F.col("_blk").alias("_b"), "_first", "n")
    return cells.join(per, (F.col(group) == F.col("_grp")) & (F.col("_blk") == F.col("_b"))).withColumn(
        "pos", F.col("_at") - F.col("_first")).drop("_at", "_blk", "_grp", "_b", "_first")


def manifest(rows: DataFrame, group: str, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``rows`` (with a digest in ``leaf``): its columns
    plus ``subroot, root, path``.

    Groups ascend with null first, then by UTF-8 bytes; leaves by ``order``
    (nulls first), ties in an order that their content fixes, so equal rows
    are neighbours. An empty frame gives no rows; a lone leaf is its own root
    and has an empty path. Only sizes and the root reach the driver.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))   # "-" sorts before "="
    row = F.struct(*[F.col(c).alias(c) for c in rows.columns]).alias("row")
    keyed = rows.select(key.alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], row)
    slim = positions(keyed, "g", [f"o{i}" for i in range(len(order))])
    nodes = staged(slim.select("g", "pos", "n", F.col("row.leaf").alias("digest"), "row"), "merkle")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = build(nodes, levels_needed(most, fanout), fanout, ("row",))

    groups = roots.count()
    mark = F.struct(F.col("g").alias("g"), F.col("digest").alias("subroot"), F.col("level").alias("level")).alias("row")
    tops = staged(row_id(roots, ["g"], out="pos").select(
        F.lit("").alias("g"), "pos", F.lit(groups).cast("bigint").alias("n"), "digest", mark), "merkle")
    top_levels, root = build(tops, levels_needed(groups, fanout), fanout, ("row",))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    if top_levels:
        whole = root.select(F.lit("").alias("g"), "level", nothing.alias("path"), F.lit("").alias("mark"))
        above = hand_down(top_levels, whole, fanout, ("row",))
    else:
        above = tops.withColumn("path", nothing)
    above = staged(above.select("row.g", "row.level", "path", F.col("row.subroot").alias("mark")), "merkle")
    out = nodes.filter("n = 1").join(above.select("g", "path", "mark"), "g").select("row", "path", "mark")
    if levels:
        out = out.unionByName(hand_down(levels, above, fanout, ("row",)).select("row", "path", "mark"))
    top = root.first()
    return out.select(*[F.col(f"row.{c}").alias(c) for c in rows.columns], F.col("mark").alias("subroot"),
                      F.lit(top["digest"] if top else None).cast("string").alias("root"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by source, the proofs checked against rows of
    which some are tampered with.

    Null fields are hashed as ``-``; a null doc_id comes first in its source
    and is not tampered with; empty and long texts are hashed whole; repeated
    rows are leaves each. An empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    rows = docs.select("doc_id", "source", leaf_hash(*[F.col(c) for c in FIELDS]).alias("leaf"),
                       F.when(hit, leaf_hash(*[F.col(c) for c in FIELDS[:-1]], ascii_lower(F.col("text")))).alias("changed"))
    tree = manifest(rows, "source", ["doc_id"])
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    return tree.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"


def _walk_sql(name: str, nodes: str) -> str:
    """``name``: all nodes of the trees over ``nodes`` (g, pos, n, digest);
    ``name_sib``: per node with a parent, the digests left and right of it."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, pos, n, digest FROM {nodes}
  UNION ALL
  SELECT g, lvl + 1, pos // {FANOUT}, (max(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // {FANOUT}),
{name}_sib AS (
  SELECT g, lvl, pos,
         coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY g, lvl, pos // {FANOUT} ORDER BY pos))"""


ORACLE = {"op13_merkle_manifest": f"""
WITH RECURSIVE {_CRC.strip()},
ids AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(
      range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, (2 * i - 1)::bigint, 2))::ubigint)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::bigint + 1])), 4294967295::ubigint) AS crc
  FROM (SELECT DISTINCT doc_id, hex(encode(doc_id::varchar)) AS x FROM documents WHERE doc_id IS NOT NULL), crc_table),
hashed AS (
  SELECT coalesce('=' || source, '-') AS g, doc_id,
    sha256({' || '.join(_field_sql(c) for c in FIELDS)}) AS leaf,
    sha256({' || '.join(_field_sql(c) for c in FIELDS[:-1])} || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed
  FROM documents),
leaves AS (
  SELECT g, hashed.doc_id, leaf AS digest, leaf, CASE WHEN crc % {TAMPER_EVERY} = 0 THEN changed ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY g ORDER BY hashed.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM hashed LEFT JOIN ids ON hashed.doc_id = ids.doc_id),{_walk_sql("tree", "leaves")},
subroots AS (
  SELECT '' AS g, g AS source, lvl AS depth, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),{_walk_sql("top", "subroots")},
walk AS (
  SELECT g, doc_id, leaf, pos AS id, 0 AS lvl, pos, shown AS dig, '' AS proof FROM leaves
  UNION ALL
  SELECT w.g, doc_id, leaf, id, w.lvl + 1, w.pos // {FANOUT}, sha256(s.l || dig || s.r), proof || s.l || s.r
  FROM walk w JOIN tree_sib s ON w.g = s.g AND w.lvl = s.lvl AND w.pos = s.pos),
risen AS (
  SELECT doc_id, leaf, s.digest AS subroot, id, w.g AS source, 0 AS lvl, s.pos, dig, proof
  FROM walk w JOIN subroots s ON w.g = s.source AND w.lvl = s.depth
  UNION ALL
  SELECT doc_id, leaf, subroot, id, source, r.lvl + 1, r.pos // {FANOUT}, sha256(s.l || dig || s.r), proof || s.l || s.r
  FROM risen r JOIN top_sib s ON r.lvl = s.lvl AND r.pos = s.pos)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, risen.dig AS folded_root, risen.dig = digest AS verified
FROM risen JOIN top ON top.lvl = risen.lvl AND top.n = 1"""}

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
