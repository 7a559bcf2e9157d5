"""Label profiling and label -> class encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_TOKEN, binary_class, class_name, strip_terminator, vocabulary_class
from .containment import class_frequency_join, vocabulary_class_join
from .sequence import row_id

DEFAULT_MAX_CLASSES = 10_000


def label_frequency(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, n``: rows per raw label (partial + final hash aggregate)."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def label_vocabulary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, n, class_id``: labels without their terminator, by frequency
    descending, ties by name; the rank (0-based) is the class id.

    The rank is a distributed numbering of the frequency table, which is
    computed once.
    """
    freq = (df.select(strip_terminator(label_col).alias("label"))
              .groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    ranked = row_id(freq.withColumn("__rank", -F.col("n")), ["__rank", "label"], out="class_id")
    return ranked.select("label", "n", "class_id")


def collect_vocabulary(vocab: DataFrame, max_classes: int = DEFAULT_MAX_CLASSES) -> list[str]:
    """The vocabulary as a driver-side list (a fitted model parameter).

    Planned as a top-n on the frequency table (the ranking is not run). Its
    size is the number of distinct labels; it is checked before it is pulled, and an error (not a truncation) is raised above ``max_classes``.
    """
    head = vocab.orderBy(F.col("n").desc(), F.col("label").asc()).select("label").limit(max_classes + 1).collect()
    if len(head) > max_classes:
        raise ValueError(f"more than {max_classes} distinct labels; raise max_classes "
                         "if the label domain really is that large")
    return [r["label"] for r in head]


def binary_label(df: DataFrame, label_col: str = "label", out: str = "class",
                 normal_token: str = NORMAL_TOKEN) -> DataFrame:
    """Add ``out`` = 0.0 for normal connections, 1.0 for any attack."""
    return df.withColumn(out, binary_class(label_col, normal_token))


def multinomial_label(df: DataFrame, vocabulary: Sequence[str] | DataFrame, label_col: str = "label",
                      out: str = "class", match: str = "contains", drop_unknown: bool = True) -> DataFrame:
    """Add ``out`` = class id of the label; unknown labels get -1 and are
    dropped unless ``drop_unknown`` is False.

    A vocabulary in a list is inlined and tested on every row; one in a table
    (``label, class_id``, as :func:`label_vocabulary` gives) may be of any
    size and is found through an index of its character grams."""
    if isinstance(vocabulary, DataFrame):
        res = vocabulary_class_join(df, vocabulary, label_col, out, match)
    else:
        res = df.withColumn(out, vocabulary_class(label_col, vocabulary, match))
    return known_classes(res, out) if drop_unknown else res


def known_classes(df: DataFrame, class_col: str = "class") -> DataFrame:
    """Keep rows whose class matched a vocabulary entry."""
    return df.filter(F.col(class_col) >= 0)


def binary_label_frequency(df: DataFrame, class_col: str = "class") -> DataFrame:
    """``is_attack, n``: frequency of the boolean ``class > 0``."""
    return df.groupBy((F.col(class_col) > 0).alias("is_attack")).agg(F.count(F.lit(1)).alias("n"))


def class_frequency(df: DataFrame, vocabulary: Sequence[str] | DataFrame, class_col: str = "class") -> DataFrame:
    """``label, n``: frequency of class names after the class mapping.

    Aggregates on the numeric id first, names the (few) groups afterwards,
    by a join where the vocabulary is a table.
    """
    if isinstance(vocabulary, DataFrame):
        return class_frequency_join(df, vocabulary, class_col)
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(class_name(class_col, vocabulary).alias("label"), "n")
