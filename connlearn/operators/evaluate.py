"""Evaluation of (actual, predicted) pairs: OK/KO counts, error rate,
confusion counts and the dense k x k confusion matrix."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ok_ko, pair_key, pair_key_part

OFF_GRID = ("raise", "extra")


def prediction_pairs(scored: DataFrame, label_col: str = "class", prediction_col: str = "prediction") -> DataFrame:
    return scored.select(F.col(label_col).cast("double").alias("label"),
                         F.col(prediction_col).cast("double").alias("prediction"))


def ok_ko_counts(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                 sort: bool = True) -> DataFrame:
    """``result, n`` with result OK / KO; sorted descending (OK first)."""
    res = pairs.groupBy(ok_ko(label, prediction).alias("result")).agg(F.count(F.lit(1)).alias("n"))
    return res.orderBy(F.col("result").desc()) if sort else res


def error_rate(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``n, n_ko, error_pct``; error is 0.0 when all are right, 100.0
    when all are wrong, null on empty input."""
    miss = (F.col(label) != F.col(prediction)).cast("long")
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.coalesce(F.sum(miss), F.lit(0)).alias("n_ko"),
                     (F.avg(miss.cast("double")) * 100.0).alias("error_pct"))


def evaluate(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``n, n_ok, n_ko, error_pct, accuracy`` (one aggregation pass)."""
    miss = (F.col(label) != F.col(prediction)).cast("long")
    return (pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(miss), F.lit(0)).alias("n_ko"),
                      F.avg(miss.cast("double")).alias("__miss"))
            .select("n", (F.col("n") - F.col("n_ko")).alias("n_ok"), "n_ko",
                    (F.col("__miss") * 100.0).alias("error_pct"), (F.lit(1.0) - F.col("__miss")).alias("accuracy")))


def evaluator_accuracy(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """Accuracy from Spark ML's evaluator (a cross-check of :func:`evaluate`)."""
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="accuracy")
    return ev.evaluate(pairs)


def confusion_counts(pairs: DataFrame, label: str = "label", prediction: str = "prediction",
                     sort: bool = True) -> DataFrame:
    """``actual, predicted, key, n`` for every pair that occurs; pairs stay
    together and are ordered by class ids."""
    res = (pairs.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted"))
           .agg(F.count(F.lit(1)).alias("n"))
           .withColumn("key", pair_key("actual", "predicted")))
    res = res.select("actual", "predicted", "key", "n")
    return res.orderBy("actual", "predicted") if sort else res


def _on_grid(c: Column, k: int, off_grid: str) -> Column:
    """The class id, or what ``off_grid`` makes of one outside 0 .. k-1."""
    if off_grid not in OFF_GRID:
        raise ValueError(f"off_grid must be one of {OFF_GRID}")
    other = F.lit(k) if off_grid == "extra" else F.raise_error(
        F.concat(F.lit(f"class outside 0..{k - 1}: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int")
    return F.when(c.isNotNull() & (c >= 0) & (c < k), c).otherwise(other)


def _dense(counts: DataFrame, k: int, off_grid: str) -> DataFrame:
    """All cells of (actual, predicted, n) counts; every row counts in one."""
    cells = (counts.select(_on_grid(F.col("actual"), k, off_grid).alias("actual"),
                           _on_grid(F.col("predicted"), k, off_grid).alias("predicted"), "n")
             .groupBy("actual", "predicted").agg(F.sum("n").alias("n")))
    side = k + (off_grid == "extra")
    grid = counts.sparkSession.range(side * side).select(
        F.expr(f"cast(id div {side} as int)").alias("actual"), F.expr(f"cast(id % {side} as int)").alias("predicted"))
    return (grid.join(cells, on=["actual", "predicted"], how="left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_matrix(pairs: DataFrame, num_classes: int, label: str = "label", prediction: str = "prediction",
                     form: str = "long", off_grid: str = "raise") -> DataFrame:
    """Dense confusion matrix, rows = actual, columns = predicted, absent
    pairs 0. Its cells always sum to the number of pairs.

    ``long``: ``actual, predicted, n`` for all k*k cells; ``wide``: one row
    per actual class with columns ``p_0 .. p_{k-1}`` (for k that a table can
    have as columns). A class outside ``0 .. k-1`` (-1 for an unknown label, a
    null) is an error, or with ``off_grid='extra'`` counts in an extra row or
    column numbered k. The grid comes from ``range`` (no cross join).
    """
    k = int(num_classes)
    if k < 1:
        raise ValueError("num_classes must be >= 1")
    cells = _dense(confusion_counts(pairs, label, prediction, sort=False), k, off_grid)
    if form == "long":
        return cells
    if form != "wide":
        raise ValueError("form must be 'long' or 'wide'")
    side = k + (off_grid == "extra")
    wide = cells.groupBy("actual").pivot("predicted", list(range(side))).agg(F.sum("n"))
    return wide.select("actual", *[F.col(str(j)).cast("bigint").alias(f"p_{j}") for j in range(side)])


def matrix_error(cells: DataFrame) -> DataFrame:
    """Off-diagonal share (in %) of a long-form matrix; equals the error rate."""
    off = F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    return cells.agg((F.sum(off) * 100.0 / F.sum("n")).alias("error_pct"))


def matrix_from_keys(counts: DataFrame, num_classes: int, key: str = "key", n: str = "n",
                     off_grid: str = "raise") -> DataFrame:
    """Dense ``actual, predicted, n`` grid from ``'<actual>_<predicted>'``
    keyed counts (the composite-key form); repeated keys add up, absent cells
    are 0, keys off the grid as in :func:`confusion_matrix`."""
    parsed = counts.select(pair_key_part(key, 0).alias("actual"), pair_key_part(key, 1).alias("predicted"),
                           F.col(n).cast("bigint").alias("n"))
    return _dense(parsed, int(num_classes), off_grid)
