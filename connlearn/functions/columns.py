"""Scalar column functions (JVM expressions, no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token that marks a normal (non-attack) connection label,
# and the logistic curve drawn by the reference (slope, points, range).
NORMAL_TOKEN = "normal"
CURVE_SLOPE = 0.5
CURVE_POINTS = 1000
CURVE_RANGE = (-10.0, 10.0)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_terminator(col: str | Column) -> Column:
    """Drop the last character of a label (``'smurf.'`` -> ``'smurf'``)."""
    c = _c(col)
    return F.left(c, F.greatest(F.length(c) - 1, F.lit(0)))


def binary_class(label: str | Column, normal_token: str = NORMAL_TOKEN) -> Column:
    """0.0 when the label contains the normal token, else 1.0 (unseen attacks too)."""
    return F.when(_c(label).contains(normal_token), F.lit(0.0)).otherwise(F.lit(1.0))


def vocabulary_class(label: str | Column, vocabulary: Sequence[str], match: str = "contains") -> Column:
    """Class id of ``label`` under a vocabulary (list position = class id).

    ``contains``: the **last** vocabulary entry contained in the raw label;
    ``exact``: the entry equal to the label without its terminator.
    No match gives -1.0. The vocabulary is a fitted model parameter; it is
    inlined as a literal array / map, so the lookup needs no join.
    """
    c = _c(label)
    if not vocabulary:
        return F.lit(-1.0)
    if match == "contains":
        vocab = F.array(*[F.lit(v) for v in vocabulary])
        hits = F.transform(vocab, lambda v, i: F.when(c.contains(v), i))
        last = F.array_max(F.filter(hits, lambda x: x.isNotNull()))
        return F.coalesce(last, F.lit(-1)).cast("double")
    if match == "exact":
        lookup = F.create_map(*[x for i, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(i))])
        return F.coalesce(F.try_element_at(lookup, strip_terminator(c)), F.lit(-1)).cast("double")
    raise ValueError("match must be 'contains' or 'exact'")


def class_name(class_id: str | Column, vocabulary: Sequence[str]) -> Column:
    """Vocabulary entry of a class id (null when out of range)."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return F.try_element_at(vocab, _c(class_id).cast("int") + 1)


def sigmoid(col: str | Column, slope: float = 1.0) -> Column:
    """Logistic function ``1 / (1 + exp(-slope * x))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(slope)) * _c(col)))


def ok_ko(actual: str | Column, predicted: str | Column) -> Column:
    return F.when(_c(actual) == _c(predicted), F.lit("OK")).otherwise(F.lit("KO"))


def pair_key(actual: str | Column, predicted: str | Column) -> Column:
    """``'<actual>_<predicted>'`` with both parts as integers."""
    return F.concat_ws("_", _c(actual).cast("int").cast("string"), _c(predicted).cast("int").cast("string"))


def pair_key_part(key: str | Column, i: int) -> Column:
    """Integer part ``i`` (0 = actual, 1 = predicted) of a pair key."""
    return F.split(_c(key), "_")[i].cast("int")


def hash_bucket(key_cols: Sequence[str | Column], modulus: int, seed: int) -> Column:
    """Stable bucket in ``[0, modulus)`` from an md5 of ``key:seed``.

    Independent of partitioning and recomputation, and reproducible in SQL
    engines as ``('0x' || substr(md5(k || ':' || seed), 1, 8))::bigint % m``.
    """
    key = F.concat_ws(":", *[_c(k).cast("string") for k in key_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(modulus)


def epoch_micros(col: str | Column, ntz: bool = True) -> Column:
    """Microseconds since 1970-01-01 00:00:00.

    For TIMESTAMP_NTZ this is plain calendar arithmetic (days, hours,
    minutes, fractional seconds), independent of the session time zone; a
    zone-aware TIMESTAMP is an instant already (``unix_micros``).
    """
    c = _c(col)
    if not ntz:
        return F.unix_micros(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.date_part(F.lit("SECOND"), c)                  # decimal(8,6): seconds with fraction
    return (days * F.lit(86_400_000_000) + F.hour(c).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(c).cast("bigint") * F.lit(60_000_000) + (secs * F.lit(1_000_000)).cast("bigint"))


def logistic_curve(spark, points: int = CURVE_POINTS, lo: float = CURVE_RANGE[0], hi: float = CURVE_RANGE[1],
                   slope: float = CURVE_SLOPE):
    """``x, y``: the logistic curve at ``points`` evenly spaced x in
    ``[lo, hi]`` (both ends included), as a table for plotting."""
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    x = F.lit(float(lo)) + F.col("id").cast("double") * F.lit(step)
    return spark.range(points).select(x.alias("x")).select("x", sigmoid("x", slope).alias("y"))
