"""Mixing sources to target weights by exact word budgets, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import expand_copies
from .common import SPACE_RUN, key_hash, prefix_sums, read, staged, word_count, words

#: Source weights by rank (code point order, null last), repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5       # of the words of all sources
MOST = 2.0        # times a source's own words
SEED = "mix"


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Word target of every source: ``share`` of all words dealt by weight,
    no target above ``most`` times its source, the excess dealt again by
    weight until none is above.

    ``sizes`` has one row per source (source, source_size). In the order of
    ``most * size / weight`` the capped sources come first, so one running
    sum finds them all: a source is capped when an equal deal of what is left
    among it and all later ones reaches its cap. One row per source is the
    only thing that a single task sees here.
    """
    deal = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(deal, ((F.row_number().over(by_name) - 1) % len(weights)) + 1))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    capped = capped.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything, earlier = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = (capped.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("cut", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
            .withColumn("rest_w", F.sum("w").over(later))
            .withColumn("is_cap", (F.col("total") - F.col("cut")) / F.col("rest_w") >= F.col("ratio")))
    full = (full.withColumn("cap_sum", F.sum(F.when(F.col("is_cap"), F.col("cap")).otherwise(0.0)).over(everything))
            .withColumn("free_w", F.sum(F.when(~F.col("is_cap"), F.col("w")).otherwise(0.0)).over(everything)))
    share_of = (F.col("total") - F.col("cap_sum")) / F.when(F.col("free_w") > 0, F.col("free_w")) * F.col("w")
    return full.select("source", "source_size",
                       F.when(F.col("is_cap"), F.col("cap")).otherwise(share_of).alias("target"))


def mix(df: DataFrame, key: str, source: str, size: Column, seed: str = SEED, **targets) -> DataFrame:
    """(key, source, size, nth, equal, source_size, target, epochs, part,
    taken): how much of every row the mix takes. ``nth`` counts the ``equal``
    rows of one key, source and size from 0.

    Rows get hash-random keys; within a source they are sorted by key range
    and a distributed prefix sum of sizes finds the cut. ``epochs`` whole
    passes are taken, then the first words in key order up to the source's
    exact budget ``floor(target)``: ``part`` words of a row, so that only one
    row per source is taken in part. ``taken = epochs * size + part``.

    A null source is a source of its own, ranked last; null keys are ordered
    by their size; equal rows are counted before the shuffle and expanded at
    the end, in two steps (a group of copies is one row on the way). A source without words
    has target 0; an empty frame gives an empty frame.
    """
    rows = df.select(F.col(key).alias("k"), F.col(source).alias("source"), size.alias("size"))
    rows = rows.groupBy("k", "source", "size").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = (source_targets(sizes, **targets)
            .withColumn("budget", F.floor("target"))
            .withColumn("epochs", F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0)).cast("long"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
            .select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "rest"))
    rows = (rows.withColumn("g", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
            .withColumn("h", key_hash(seed, F.col("k"), F.col("size"))))
    rows = prefix_sums(rows, ["g"], ["h", "k", "size"], F.col("size") * F.col("n"), "before")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    out = expand_copies(out.drop("g", "h", "p_source"), "n", "j")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.col("j") * F.col("size")))
    out = out.withColumn("part", part.cast("long"))
    return out.select(F.col("k").alias(key), F.col("source").alias(source), "size", F.col("j").alias("nth"),
                      F.col("n").alias("equal"), "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each of ``documents``, one row per row.

    A null text has size 0; null is a source of its own, the last; repeated rows are drawn
    each; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents")
    out = mix(docs, "doc_id", "source", word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with the
    columns of ``docs``. A copy taken in part (one per source) keeps its first
    words, joined by one space, and its own n_chars. Column names may be any.

    The plan of ids and sizes is stored, then each text is shuffled once to
    its row of the plan. Only rows that share id, source and size with others
    are numbered: equal rows are counted to one, and the different ones stand
    in hash blocks by their content, so that neither a frequent id nor a
    repeated row is one task. No documents give no rows."""
    size = word_count(F.col("text"))
    plan = mix(docs, "doc_id", "source", size).filter("taken > 0").select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "nth",
        "equal", "epochs", "part")
    plan = staged(plan, "mix-plan")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                       F.col("source").alias("src"), size.alias("size"))
    same = (F.col("id").eqNullSafe(F.col("p_id")) & F.col("src").eqNullSafe(F.col("p_source"))
            & (F.col("size") == F.col("p_size")))
    taken = rows.join(plan.filter("equal = 1"), same).select("row", "p_size", "epochs", "part")
    repeated = plan.filter("equal > 1")
    if not repeated.isEmpty():
        keys = repeated.select("p_id", "p_source", "p_size").distinct()
        many = (rows.join(keys, same, "left_semi").withColumn("h", F.md5(F.to_json("row").cast("binary")))
                .groupBy("id", "src", "size", "h").agg(F.first("row").alias("row"), F.count("*").alias("n"))
                .withColumn("g", key_hash(F.col("id"), F.col("src"), F.col("size"))))
        many = prefix_sums(staged(many, "mix-repeated"), ["g"], ["h"], F.col("n"), "before")
        many = expand_copies(many, "n", "j").withColumn("j", F.col("before") + F.col("j"))
        taken = taken.unionAll(many.join(repeated, same & (F.col("j") == F.col("nth")))
                               .select("row", "p_size", "epochs", "part"))
    copies = F.concat(F.expr("array_repeat(-1L, int(epochs))"),
                      F.when(F.col("part") == F.col("p_size"), F.array(F.lit(-1).cast("long")))
                      .when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    taken = taken.select("row", F.explode(copies).alias("first"))
    whole, text = F.col("first") < 0, F.col("row.text")
    cut = F.concat_ws(" ", F.slice(words(text), 1, F.col("first").cast("int")))
    new = {"text": F.when(whole, text).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(
            F.char_length(cut).cast(docs.schema["n_chars"].dataType))
    return taken.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = {"op8_source_mixing": f"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN coalesce(text, '') = '' THEN 0
              ELSE len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END::bigint AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::bigint AS source_size,
         [5.0::double, 2.0::double, 1.0::double][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
capped AS (
  SELECT *, source_size * 2.0::double AS cap, source_size * 2.0::double / w AS ratio,
         (sum(source_size) OVER ())::double * 1.5::double AS total FROM src),
cut AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= ratio AS is_cap
  FROM capped WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
tgt AS (
  SELECT source, source_size,
         CASE WHEN is_cap THEN cap ELSE
           (total - sum(CASE WHEN is_cap THEN cap ELSE 0 END) OVER ())
           / sum(CASE WHEN is_cap THEN 0 ELSE w END) OVER () * w END AS target
  FROM cut),
plan AS (
  SELECT *, coalesce(floor(target)::bigint // nullif(source_size, 0), 0) AS epochs FROM tgt),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs,
         floor(p.target)::bigint - p.epochs * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
           ORDER BY md5('{SEED}|' || coalesce('=' || s.doc_id, '-') || '|=' || s.size), s.doc_id NULLS FIRST, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, rest - before)))::bigint AS taken
FROM run"""}

QUERIES = {"op8_source_mixing": op8_source_mixing}
