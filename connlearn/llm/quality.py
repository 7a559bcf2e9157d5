"""Quality rules as a bitmask ledger, native: every rule is evaluated once per
document; policies, verdicts and ablations are bit operations on the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read, staged, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for all uses in ``body`` (inside lambdas, a plain
    expression would be evaluated again for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(w: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more.

    Windows are compared as texts. Only a document with a repeated window
    sorts (window, position) pairs; the covered words are then counted from
    the sorted start positions, so the cost is n log n in the words.
    """
    def window(i):
        return F.concat_ws(" ", F.slice(w, i, width))

    def covered(pairs):
        def twin(x, i):
            before = F.when(i > 0, F.get(pairs, i - 1)["t"] == x["t"]).otherwise(False)
            after = F.coalesce(F.get(pairs, i + 1)["t"] == x["t"], F.lit(False))
            return before | after

        starts = F.array_sort(F.transform(F.filter(pairs, twin), lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.coalesce(F.least(F.lit(width), F.get(s, i + 1) - p), F.lit(width))),
            F.lit(0).cast("long"), lambda acc, x: acc + x))

    def measure(texts):
        pairs = F.sort_array(F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(texts)) == F.size(texts), F.lit(0).cast("long")).otherwise(
            let(pairs, covered))

    texts = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), window)
    return F.when(F.size(w) < width + 1, F.lit(0).cast("long")).otherwise(let(texts, measure))


def without(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are not among ``characters``."""
    return F.char_length(F.translate(text, characters, "")).cast("long")


def measurements(text: Column) -> Column:
    """The struct of all measurements of a text; null counts as empty."""
    def measure(t):
        def of_words(w):
            def of_lines(lines):
                chars = F.char_length(t).cast("long")
                return F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    without(t, SPACE).alias("word_chars"),
                    (chars - without(t, SYMBOLS)).alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    F.size(lines).cast("long").alias("n_lines"),
                    (chars - without(t, CAPITALS)).alias("n_capitals"),
                    repeated_window_words(w).alias("n_repeat_words"))
            return let(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), of_lines)
        return let(words(t), of_words)
    return let(F.coalesce(text, F.lit("")), measure)


@dataclass(frozen=True)
class Rule:
    """A named failure test over the measurement struct. Its place in
    :data:`RULES` is its bit for ever: rules are only ever appended."""
    name: str
    fails: object


RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("capitals", lambda m: 100 * m["n_capitals"] > 40 * m["word_chars"]),
    Rule("word_length", lambda m: (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols"),
    "v2": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "capitals", "word_length"),
}
POLICY = "v2"


def policy_mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def failure_bits(m: Column) -> Column:
    """Bit i is set if rule i fails; every rule is evaluated once."""
    mask = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(r.fails(m), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def entry(text: Column) -> Column:
    """A ledger entry: struct(m, mask), with the measurements bound once, so
    that a filter on the mask does not evaluate them again."""
    return let(measurements(text), lambda m: F.struct(m.alias("m"), failure_bits(m).alias("mask")))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its measurements ``m`` (struct) and failure bits ``mask``
    (long), replacing columns of these names.

    Null and empty texts have zero words and fail ``too_few_words``; repeated
    rows get equal bits; all other columns are kept as they are.
    """
    led = df.withColumn("_entry", entry(F.col(text)))
    return led.withColumn("m", F.col("_entry.m")).withColumn("mask", F.col("_entry.mask")).drop("_entry")


def rejected(mask: Column, policy: str) -> Column:
    return mask.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) != 0


def ablations(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """(rule, failing, sole, kept_without) per rule of the policy: documents
    that fail it, that fail it alone, and that would be kept without it. One
    pass: the ledger is first reduced to one row per distinct mask."""
    by_mask = led.groupBy("mask").agg(F.count("*").alias("n"))
    pm = policy_mask(policy)
    zero = F.lit(0).cast("long")
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit"))
                                for n in POLICIES[policy]])).alias("r")
    each = by_mask.select(F.col("mask").bitwiseAND(F.lit(pm).cast("long")).alias("hit"), "n", rules)
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("hit").bitwiseAND(bit) != 0, F.col("n")).otherwise(zero)).alias("failing"),
        F.sum(F.when(F.col("hit") == bit, F.col("n")).otherwise(zero)).alias("sole"),
        F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(zero))
        .alias("kept_without"))


def sole_rule(mask: Column, policy: str = POLICY) -> Column:
    """Name of the rule that alone rejects a document, null if none or several do."""
    hit = mask.bitwiseAND(F.lit(policy_mask(policy)).cast("long"))
    return F.coalesce(*[F.when(hit == BIT[n], F.lit(n)) for n in POLICIES[policy]])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every whole text of ``documents``, one row per row,
    from a stored ledger: every rule is evaluated once, policies and ablations read bits.

    ``sole_rule`` is the rule that alone rejects the document, ``sole_docs`` how many
    documents that rule alone rejects and ``kept_without`` how many the policy would keep
    without it; null for documents that no or several rules reject.

    A null or empty text has no words and fails; repeated rows and null ids are judged
    each; an empty table gives no rows; further columns are not read."""
    led = staged(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-ledger")
    # one row per rule of the policy
    per_rule = ablations(led).select(F.col("rule").alias("sole_rule"), F.col("sole").alias("sole_docs"), "kept_without")
    m = [F.col("m")[c].alias(c) for c in
         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = led.select("doc_id", *m, rejected(F.col("mask"), "base").alias("base_failed"),
                     (~rejected(F.col("mask"), POLICY)).alias("kept"), "mask",
                     (~rejected(F.col("mask"), "v1")).alias("kept_v1"), sole_rule(F.col("mask")).alias("sole_rule"))
    return out.join(F.broadcast(per_rule), "sole_rule", "left").select(*out.columns, "sole_docs", "kept_without")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the current policy keeps."""
    return docs.filter(~rejected(entry(F.col("text"))["mask"], POLICY))


ORACLE = {"op5_quality_rules": """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
pos AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (
  SELECT rid, i FROM pos QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
rep AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
lin AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(w.ws)::bigint AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, len(ls)::bigint AS n_lines,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint AS n_capitals,
         coalesce(rep.n, 0)::bigint AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN lin USING (rid) LEFT JOIN rep USING (rid)),
mask AS (
  SELECT *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
    + 4 * (100 * n_symbols > 20 * n_words)::bigint + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint
    + 16 * (100 * n_capitals > 40 * word_chars)::bigint
    + 32 * (word_chars > 20 * n_words OR word_chars < 2 * n_words)::bigint AS mask
  FROM m),
rules AS (
  SELECT * FROM (VALUES (1, 'too_few_words'), (2, 'repeated_windows'), (4, 'symbols'),
                        (8, 'duplicate_lines'), (16, 'capitals'), (32, 'word_length')) v(bit, sole_rule)),
per_rule AS (
  SELECT bit, sole_rule, count(*) FILTER (mask & 63 = bit)::bigint AS sole_docs,
         count(*) FILTER (mask & (63 - bit) = 0)::bigint AS kept_without
  FROM mask, rules GROUP BY bit, sole_rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       mask & 3 <> 0 AS base_failed, mask & 63 = 0 AS kept, mask, mask & 7 = 0 AS kept_v1,
       sole_rule, sole_docs, kept_without
FROM mask LEFT JOIN per_rule ON mask & 63 = bit"""}

QUERIES = {"op5_quality_rules": op5_quality_rules}
