"""No-intercept logistic regression: pipeline assembly, fit, score, weights,
save / load."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_TOKEN, sigmoid
from ..schema import RecordSchema
from .diagnose import SeparableError, Separation, separation
from .encode import category_stages, onehot_col, scaler
from .stages import ClassLabeler, ClassLabelerModel

# Optimiser settings of the reference trainer (library defaults,
# no intercept, no regularisation).
MAX_ITER = 100
TOLERANCE = 1e-6
# Iterations after which a fit that goes on is checked for separable rows.
PROBE_ITER = 15


def logistic(features_col: str = "features", label_col: str = "class", max_iter: int = MAX_ITER,
             tol: float = TOLERANCE, family: str = "auto") -> LogisticRegression:
    """L-BFGS logistic regression without intercept or penalty. ``auto``
    picks binomial for two classes, multinomial above."""
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, fitIntercept=False,
                              regParam=0.0, elasticNetParam=0.0, maxIter=max_iter, tol=tol, family=family,
                              standardization=True)


def build_pipeline(schema: RecordSchema, categorical: bool = True, classes: str = "binary",
                   normal_token: str = NORMAL_TOKEN, match: str = "contains",
                   max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> Pipeline:
    """labels -> [indexers -> one-hot] -> assembler -> scaler -> logistic.

    The scaler is fitted on the assembled vector (numeric and one-hot
    columns together) from the training data only, and centres it: with no
    intercept the centring is part of the model.
    """
    stages = [ClassLabeler(inputCol=schema.label, outputCol="class", classes=classes,
                           normalToken=normal_token, match=match)]
    inputs = list(schema.numeric)
    if categorical and schema.categorical:
        stages += category_stages(schema.categorical)
        inputs += [onehot_col(c) for c in schema.categorical]
    stages += [VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="error"),
               scaler("raw_features", "features"),
               logistic("features", "class", max_iter=max_iter, tol=tol)]
    return Pipeline(stages=stages)


def fit_logistic(df: DataFrame, features_col: str = "features", label_col: str = "class",
                 max_iter: int = MAX_ITER, tol: float = TOLERANCE, family: str = "auto",
                 aggregate_duplicates: bool = False) -> LogisticRegressionModel:
    """Fit on an already prepared ``features`` / ``label`` frame.

    ``aggregate_duplicates``: first collapse identical ``(features, label)``
    rows into one row weighted by its count (a partial + final hash
    aggregate). The weighted likelihood has the same optimum, and every
    optimiser pass then reads the distinct rows only - for purely
    categorical features a handful of rows instead of the whole table.
    """
    lr = logistic(features_col, label_col, max_iter, tol, family)
    if not aggregate_duplicates:
        return lr.fit(df)
    grouped = (df.groupBy(vector_to_array(features_col).alias("__x"), F.col(label_col))
               .agg(F.count(F.lit(1)).cast("double").alias("__w"))
               .select(array_to_vector("__x").alias(features_col), label_col, "__w"))
    return lr.setWeightCol("__w").fit(grouped)


def fit_checked(lr: LogisticRegression, df: DataFrame, on_separable: str = "error",
                probe_iter: int = PROBE_ITER) -> tuple[LogisticRegressionModel, Separation | None]:
    """Fit ``lr``, but not on after its weights when there is no optimum.

    The optimiser first runs ``probe_iter`` iterations. If it has converged by
    then, that is the fit. If not, one pass over the margins tells whether the
    rows are separable; then ``error`` raises :class:`SeparableError`, ``flag``
    returns the model as far as it is (the second value tells), and otherwise
    the fit runs to its end. ``ignore`` fits without a look.
    """
    if on_separable not in ("error", "flag", "ignore"):
        raise ValueError("on_separable must be 'error', 'flag' or 'ignore'")
    full = lr.getMaxIter()
    if on_separable == "ignore" or full <= probe_iter:
        return lr.fit(df), None
    probe = lr.copy({lr.maxIter: probe_iter}).fit(df)
    if probe.summary.totalIterations < probe_iter:
        return probe, None
    found = separation(probe.transform(df), lr.getLabelCol())
    if not found.separable:
        return lr.fit(df), found
    if on_separable == "error":
        raise SeparableError(f"all {found.rows} training rows are separable (least margin {found.least_margin:.3g}): "
                             "the weights have no finite optimum")
    return probe, found


def score(model, df: DataFrame) -> DataFrame:
    """``transform`` only: no action, so it also accepts a streaming frame."""
    return model.transform(df)


def labeler_of(model: PipelineModel) -> ClassLabelerModel:
    return next(s for s in model.stages if isinstance(s, ClassLabelerModel))


def logistic_of(model: PipelineModel) -> LogisticRegressionModel:
    return next(s for s in model.stages if isinstance(s, LogisticRegressionModel))


def lr_weights(model, spark: SparkSession, feature_names: Sequence[str] | None = None,
               form: str = "pivoted") -> DataFrame:
    """``class, feature, weight`` of a fitted logistic model.

    ``pivoted`` reports k-1 rows for k classes relative to class 0 (the
    classic multinomial parametrisation; for two classes this is the binary
    weight vector), ``full`` all k rows as fitted.
    """
    lr = logistic_of(model) if isinstance(model, PipelineModel) else model
    coef = lr.coefficientMatrix.toArray()
    k, d = coef.shape
    names = list(feature_names) if feature_names is not None else [f"f{j}" for j in range(d)]
    rows = []
    if form == "full" or k == 1:
        first = 1 if (k == 1 and form != "full") else 0
        rows = [(c + first, names[j], float(coef[c, j])) for c in range(k) for j in range(d)]
    elif form == "pivoted":
        rows = [(c, names[j], float(coef[c, j] - coef[0, j])) for c in range(1, k) for j in range(d)]
    else:
        raise ValueError("form must be 'pivoted' or 'full'")
    return spark.createDataFrame(rows, "class int, feature string, weight double")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def model_versions(path: str) -> list[int]:
    """Committed versions at ``path``, ascending."""
    spark = SparkSession.getActiveSession()
    fs, root = _files(spark, f"{path.rstrip('/')}/versions")
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.isdigit() and fs.exists(_files(spark, f"{path.rstrip('/')}/versions/{n}/_committed")[1])]
    return sorted(int(n) for n in done)


def save_model(model: PipelineModel, path: str) -> str:
    """Write the whole fitted pipeline (vocabulary, encoders, scaler, weights)
    as the next version at ``path``.

    A version has a folder of its own, taken by creating it, and counts once
    an empty ``_committed`` file ends it. So a save that is cut off leaves the
    versions before it as they are, and two saves at once make two versions.
    """
    spark = SparkSession.getActiveSession()
    root = path.rstrip("/")
    fs, versions = _files(spark, f"{root}/versions")
    taken = [int(s.getPath().getName()) for s in fs.listStatus(versions)] if fs.exists(versions) else []
    number = max(taken, default=0) + 1
    while True:
        claim = _files(spark, f"{root}/versions/{number:06d}/_claimed")[1]
        if not fs.exists(claim.getParent()) and fs.createNewFile(claim):
            break
        number += 1
    model.write().save(f"{root}/versions/{number:06d}/model")
    fs.createNewFile(_files(spark, f"{root}/versions/{number:06d}/_committed")[1])
    return path


def load_model(path: str, version: int | None = None) -> PipelineModel:
    """The latest committed version at ``path``, or the one asked for; a
    folder without versions is read as one plain saved pipeline."""
    known = model_versions(path)
    if version is None and not known:
        return PipelineModel.load(path)
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not at {path}: there are {known}")
    return PipelineModel.load(f"{path.rstrip('/')}/versions/{version or known[-1]:06d}/model")


def drop_versions(path: str, keep: int = 1) -> list[int]:
    """Delete all but the latest ``keep`` committed versions; returns them."""
    if keep < 1:
        raise ValueError("keep must be >= 1")
    spark, old = SparkSession.getActiveSession(), model_versions(path)[:-keep]
    for v in old:
        fs, p = _files(spark, f"{path.rstrip('/')}/versions/{v:06d}")
        fs.delete(p, True)
    return old


def weight_margins(feature_cols: Sequence[str], weights) -> list:
    """Margin columns ``w_c . x`` for each row of a (pivoted) weight matrix,
    summed left to right over plain feature columns."""
    w = np.atleast_2d(np.asarray(weights, dtype=float))
    if w.shape[1] != len(feature_cols):
        raise ValueError(f"{w.shape[1]} weights per class for {len(feature_cols)} features")
    margins = []
    for row in w:
        m = None
        for wj, col in zip(row, feature_cols):
            term = F.lit(float(wj)) * F.col(col)
            m = term if m is None else m + term
        margins.append(m)
    return margins


def score_with_weights(df: DataFrame, feature_cols: Sequence[str], weights,
                       prediction_col: str = "prediction", probability_col: str | None = "probability") -> DataFrame:
    """Score with an exported weight table instead of a fitted model.

    One weight row: binary, prediction 1 when the margin is positive (the
    probability exceeds 0.5). ``k - 1`` rows: multinomial pivoted on class 0
    (margin 0), prediction = largest margin, ties to the lowest class.
    Column arithmetic only, so it also runs on streams.
    """
    margins = weight_margins(feature_cols, weights)
    if len(margins) == 1:
        out = df.withColumn(prediction_col, F.when(margins[0] > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        return out.withColumn(probability_col, sigmoid(margins[0])) if probability_col else out
    staged = df
    names = [f"__m{c}" for c in range(1, len(margins) + 1)]
    for name, m in zip(names, margins):
        staged = staged.withColumn(name, m)
    best = F.greatest(F.lit(0.0), *[F.col(n) for n in names])
    # first class (in id order) whose margin equals the best one
    pred = F.lit(float(len(names)))
    for c in range(len(names) - 1, 0, -1):
        pred = F.when(F.col(names[c - 1]) == best, F.lit(float(c))).otherwise(pred)
    pred = F.when(best == F.lit(0.0), F.lit(0.0)).otherwise(pred)
    return staged.withColumn(prediction_col, pred).drop(*names)
