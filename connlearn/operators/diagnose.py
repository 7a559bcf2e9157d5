"""Checks of a fitted no-intercept logistic model on its training rows.

* The score equations: at the optimum of the likelihood, every feature has the
  same sum over the rows of a class as it has over all rows weighted by the
  class's predicted probability. One aggregation gives both sides.
* Separation: where the fitted margins put every row on its own class's side,
  the likelihood has no finite optimum and the weights only grow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_equations(scored: DataFrame, num_classes: int, feature_names: Sequence[str], features_col: str = "features",
                    label_col: str = "class", probability_col: str = "probability") -> DataFrame:
    """``class, feature, n, observed, expected, residual, relative`` of scored
    training rows.

    observed: mean of the feature over all rows, counted where the row is of
    the class; expected: the same weighted by the class's probability;
    relative: their difference over the mean absolute feature (0 for a feature
    that is 0 throughout). Null without rows. One aggregation: a row becomes
    one narrow row per feature, summed in the map tasks.
    """
    names = F.array(*[F.lit(x) for x in feature_names])
    long = scored.select(F.posexplode(vector_to_array(features_col)).alias("__j", "__x"), F.col(label_col).alias("__y"),
                         vector_to_array(probability_col).alias("__p"))
    sums = long.groupBy("__j").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("__x")).alias("scale"),
        F.array(*[F.struct(F.lit(c).alias("class"),
                           F.sum(F.when(F.col("__y") == c, F.col("__x")).otherwise(F.lit(0.0))).alias("observed"),
                           F.sum(F.get("__p", F.lit(c)) * F.col("__x")).alias("expected"))
                  for c in range(num_classes)]).alias("s"))
    flat = sums.select("__j", "n", "scale", F.explode("s").alias("s"))
    residual = F.col("s.expected") - F.col("s.observed")
    return flat.select(
        F.col("s.class").alias("class"), F.get(names, F.col("__j")).alias("feature"), "n",
        (F.col("s.observed") / F.col("n")).alias("observed"), (F.col("s.expected") / F.col("n")).alias("expected"),
        (residual / F.col("n")).alias("residual"),
        F.when(F.col("scale") == 0, F.lit(0.0)).otherwise(F.abs(residual) / F.col("scale")).alias("relative"))


@dataclass(frozen=True)
class Separation:
    rows: int
    wrong: int
    least_margin: float | None

    @property
    def separable(self) -> bool:
        """Every row has a positive margin for its own class."""
        return self.rows > 0 and self.wrong == 0


def separation(scored: DataFrame, label_col: str = "class", raw_col: str = "rawPrediction") -> Separation:
    """Rows, rows without a positive margin, and the least margin: the raw
    score of the row's class less the best of the other classes. One
    aggregation to one row; labels outside the model's classes are wrong."""
    raw = vector_to_array(raw_col)
    own = F.get(raw, F.col(label_col).cast("int"))
    rest = F.array_max(F.filter(F.transform(raw, lambda x, i: F.when(i != F.col(label_col).cast("int"), x)),
                                lambda x: x.isNotNull()))
    margin = own - rest
    row = scored.select(margin.alias("m")).agg(
        F.count(F.lit(1)), F.count(F.when(F.coalesce(F.col("m") > 0, F.lit(False)), 1)), F.min("m")).first()
    return Separation(row[0], row[0] - row[1], row[2])


class SeparableError(ValueError):
    """The training rows are separable: the fit has no finite optimum."""
