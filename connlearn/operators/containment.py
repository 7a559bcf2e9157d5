"""Containment of vocabulary entries in labels, for vocabularies of any size.

A literal vocabulary is tested entry by entry on every row. Here the entries
are indexed by a character q-gram: an entry can only be contained in a label
that has all its q-grams, so each entry is filed under its rarest one, and
only entries filed under a gram of the label are compared. Labels are compared
once per distinct value, and the class is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram. Entries shorter than that are filed whole.
GRAM = 3


def grams(text: Column, q: int) -> Column:
    """Distinct substrings of ``q`` characters; empty if there is none."""
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(q))))


def gram_index(vocabulary: DataFrame, q: int = GRAM, entry_col: str = "label", id_col: str = "class_id") -> DataFrame:
    """``gram, entry, id``: one row per distinct entry, under its rarest q-gram
    in the vocabulary (ties: the smallest). A repeated entry keeps its largest
    id; null entries are left out."""
    entries = (vocabulary.filter(F.col(entry_col).isNotNull()).groupBy(F.col(entry_col).alias("entry"))
               .agg(F.max(id_col).alias("id")))
    long = entries.filter(F.length("entry") >= q).select("entry", "id", F.explode(grams(F.col("entry"), q)).alias("gram"))
    counts = long.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = long.join(counts, "gram").groupBy("entry").agg(
        F.min(F.struct("n", "gram")).alias("g"), F.max("id").alias("id"))
    short = entries.filter(F.length("entry") < q)
    return rarest.select(F.col("g.gram").alias("gram"), "entry", "id").unionByName(
        short.select(F.col("entry").alias("gram"), "entry", "id"))


def contained_entries(labels: DataFrame, index: DataFrame, q: int = GRAM, label_col: str = "label") -> DataFrame:
    """``label, entry, id`` of every index entry contained in a distinct label
    (the empty entry in each). Null labels contain nothing."""
    distinct = labels.select(F.col(label_col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    every = F.concat(F.array(F.lit("")), *[grams(F.col("label"), k) for k in range(1, q + 1)])
    asked = distinct.select("label", F.explode(every).alias("gram"))
    return asked.join(index, "gram").filter(F.contains("label", "entry")).select("label", "entry", "id")


def vocabulary_class_join(df: DataFrame, vocabulary: DataFrame, label_col: str = "label", out: str = "class",
                          match: str = "contains", q: int = GRAM) -> DataFrame:
    """``df`` plus ``out``: as :func:`connlearn.vocabulary_class`, with the
    vocabulary a table (``label, class_id``) that may be of any size.

    ``contains``: the largest id of the entries contained in the raw label;
    ``exact``: the id of the entry equal to the label without its terminator.
    -1.0 where nothing matches, for null labels and for an empty vocabulary.
    Every input row is an output row.
    """
    if match == "contains":
        found = contained_entries(df, gram_index(vocabulary, q), q, label_col)
        best = found.groupBy("label").agg(F.max("id").alias("__class"))
        key = F.col(label_col)
    elif match == "exact":
        best = vocabulary.filter(F.col("label").isNotNull()).groupBy("label").agg(F.max("class_id").alias("__class"))
        key = F.left(F.col(label_col), F.greatest(F.length(label_col) - 1, F.lit(0)))
    else:
        raise ValueError("match must be 'contains' or 'exact'")
    best = best.select(F.col("label").alias("__label"), "__class")
    return df.join(best, key == F.col("__label"), "left").drop("__label").withColumn(
        out, F.coalesce(F.col("__class").cast("double"), F.lit(-1.0))).drop("__class")


def class_frequency_join(df: DataFrame, vocabulary: DataFrame, class_col: str = "class") -> DataFrame:
    """``label, n``: frequency of class names, the names from a vocabulary
    table. Classes outside the vocabulary have a null name."""
    counts = df.groupBy(F.col(class_col).cast("long").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(vocabulary.select("class_id", "label"), "class_id", "left").select("label", "n")
