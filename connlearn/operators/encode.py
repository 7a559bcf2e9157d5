"""Categorical indexing, one-hot encoding, vector assembly and scaling,
all as Spark ML stages (JVM aggregates and column transforms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_col(c: str) -> str:
    return f"{c}_index"


def onehot_col(c: str) -> str:
    return f"{c}_onehot"


def category_stages(cols: Sequence[str]) -> list:
    """One multi-column ``StringIndexer`` (frequency descending, ties by
    value; unseen and null values go to the extra index ``n``) and a
    ``OneHotEncoder`` keeping every slot (width ``n + 1``: the indexer's
    unseen slot is already part of its output domain)."""
    cols = list(cols)
    indexer = StringIndexer(inputCols=cols, outputCols=[index_col(c) for c in cols],
                            handleInvalid="keep", stringOrderType="frequencyDesc")
    encoder = OneHotEncoder(inputCols=[index_col(c) for c in cols], outputCols=[onehot_col(c) for c in cols],
                            dropLast=False, handleInvalid="error")
    return [indexer, encoder]


def fit_category_encoders(df: DataFrame, cols: Sequence[str]) -> PipelineModel:
    """Fit the indexer + encoder on (training) data: one aggregation job."""
    return Pipeline(stages=category_stages(cols)).fit(df.select(*cols))


def encode_categories(df: DataFrame, cols: Sequence[str] | None = None, encoders: PipelineModel | None = None,
                      fit_on: DataFrame | None = None) -> tuple[PipelineModel, DataFrame]:
    """Index + one-hot ``cols`` of ``df``; the encoders are fitted on
    ``fit_on`` (the training data; default ``df``) unless given."""
    if encoders is None:
        if cols is None:
            raise ValueError("give the categorical columns or fitted encoders")
        encoders = fit_category_encoders(fit_on if fit_on is not None else df, cols)
    return encoders, encoders.transform(df)


def category_labels(encoders: PipelineModel) -> list[list[str]]:
    """Known values per column, in index order (a fitted parameter)."""
    return [list(x) for x in encoders.stages[0].labelsArray]


def category_widths(encoders: PipelineModel) -> list[int]:
    """One-hot width per column: known values plus the unseen slot."""
    return [len(x) + 1 for x in category_labels(encoders)]


def one_hot_columns(df: DataFrame, vector_cols: Sequence[str], widths: Sequence[int],
                    keep: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Expand one-hot vectors into 0/1 INT columns ``<name>_1 .. <name>_w``."""
    names = list(names or vector_cols)
    exprs = []
    for c, w, name in zip(vector_cols, widths, names):
        arr = vector_to_array(F.col(c))
        exprs += [arr[j].cast("int").alias(f"{name}_{j + 1}") for j in range(w)]
    return df.select(*keep, *exprs)


def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features") -> DataFrame:
    """Dense/sparse feature vector; a null input raises (``handleInvalid='error'``)."""
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid="error").transform(df)


def scaler(input_col: str = "raw_features", output_col: str = "features") -> StandardScaler:
    """Mean 0 / std 1 with sample std; a zero-variance column scales to 0.0."""
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)


def fit_scaler(df: DataFrame, input_col: str = "raw_features", output_col: str = "features") -> StandardScalerModel:
    """Statistics come from ``df`` only (the training data)."""
    return scaler(input_col, output_col).fit(df)


def scale(train: DataFrame, *others: DataFrame, input_col: str = "raw_features",
          output_col: str = "features") -> tuple[StandardScalerModel, list[DataFrame]]:
    """Fit the scaler on ``train`` only and apply it to ``train`` and every
    other frame (test sets)."""
    model = fit_scaler(train, input_col, output_col)
    return model, [model.transform(d) for d in (train, *others)]


def scaler_stats(model: StandardScalerModel, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """``feature, mean, std`` of a fitted scaler (a d-row table)."""
    mean, std = model.mean.toArray().tolist(), model.std.toArray().tolist()
    return spark.createDataFrame(list(zip(names, mean, std)), "feature string, mean double, std double")


def vector_columns(df: DataFrame, vector_col: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpack a vector column into named DOUBLE columns (no UDF)."""
    arr = vector_to_array(F.col(vector_col))
    return df.select(*keep, *[arr[i].alias(n) for i, n in enumerate(names)])
