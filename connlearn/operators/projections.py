"""Projections by role: numeric, label, categorical; dropping columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RecordSchema


def project_numeric(df: DataFrame, schema: RecordSchema, keep: Sequence[str] = ()) -> DataFrame:
    """Every field except the categorical ones and the label."""
    return df.select(*keep, *schema.numeric)


def project_label(df: DataFrame, schema: RecordSchema, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.col(schema.label))


def project_categorical(df: DataFrame, schema: RecordSchema, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *schema.categorical)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Drop columns by 0-based position (``df.columns[1:4]`` style)."""
    names = df.columns
    return df.drop(*[names[i] for i in positions])
