"""The driver's tables seen as connection records.

* ``lines``: ``lineitem JOIN orders`` - the bulk table (numeric, three
  categorical columns, a label with a terminator). It has no unique key;
  ``orderkey`` is carried for splitting.
* ``events``: one row per event - unique ``event_id`` and ``ts``; used for
  keyed operators, labels, saturated models and traffic windows
  (host = ``user_id``, service = ``event_type``, flag derived from ``value``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RecordSchema
from ..session import read_table
from .records import format_records

# Adapter layouts. Record fields in file order.
LINES_FIELDS = ("quantity", "linestatus", "orderpriority", "orderstatus",
                "extendedprice", "discount", "tax", "label")
LINES_SCHEMA = RecordSchema.from_names(LINES_FIELDS)           # 1-3 categorical, last label
LINES_NUMBER_FORMAT = "%.2f"

EVENTS_FIELDS = ("value", "event_kind", "user_group", "user_band", "user_id", "label")
EVENTS_SCHEMA = RecordSchema.from_names(EVENTS_FIELDS)
EVENTS_NORMAL_TOKEN = "view"          # the event type treated as "normal" traffic
USER_GROUPS = 5                       # user_group = 'g' || user_id % 5
USER_BANDS = 3                        # user_band = 'b' || user_id % 3
# Flags derived from the event value: below 1 -> S0 (SYN error), 100 and
# above -> REJ (rejected), otherwise SF (normal).
FLAG_S0_BELOW = 1.0
FLAG_REJ_FROM = 100.0


def lines_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ``lines`` records plus ``orderkey`` (inner join on the order key;
    a shuffled join of two large tables: orders grow with the input, so they
    are never collected by the driver for a broadcast)."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_quantity", "l_linestatus", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"],
        spread_by=["l_orderkey"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"],
                    spread_by=["o_orderkey"])
    j = li.join(od.hint("merge"), li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("o_orderpriority").alias("orderpriority"),
        F.col("o_orderstatus").alias("orderstatus"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.concat(F.col("l_returnflag"), F.lit(".")).alias("label"),
    )


def lines_text(spark: SparkSession, sf_dir: str, keep_key: bool = False) -> DataFrame:
    """``lines`` as delimited text (``value``), numbers with two decimals."""
    df = lines_frame(spark, sf_dir)
    if keep_key:
        parts = [F.col(n) if LINES_SCHEMA.is_string(n) else F.format_string(LINES_NUMBER_FORMAT, F.col(n))
                 for n in LINES_SCHEMA.names]
        return df.select("orderkey", F.concat_ws(LINES_SCHEMA.sep, *parts).alias("value"))
    return format_records(df, LINES_SCHEMA, LINES_NUMBER_FORMAT)


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ``events`` records keyed by ``event_id`` (with ``ts``)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"],
                    spread_by=["event_id"])
    return ev.select(
        "event_id", "ts",
        F.col("value"),
        F.col("event_type").alias("event_kind"),
        F.concat(F.lit("g"), (F.col("user_id") % USER_GROUPS).cast("string")).alias("user_group"),
        F.concat(F.lit("b"), (F.col("user_id") % USER_BANDS).cast("string")).alias("user_band"),
        F.col("user_id").cast("double").alias("user_id"),
        F.concat(F.col("event_type"), F.lit(".")).alias("label"),
    )


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` records as text lines, with ``event_id`` kept."""
    df = events_frame(spark, sf_dir)
    parts = [F.col(n) if EVENTS_SCHEMA.is_string(n) else F.col(n).cast("string") for n in EVENTS_SCHEMA.names]
    return df.select("event_id", F.concat_ws(",", *parts).alias("value"))


def traffic_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ts, host, service, flag`` connections from ``events``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"],
                    spread_by=["event_id"])
    flag = (F.when(F.col("value") < FLAG_S0_BELOW, F.lit("S0"))
            .when(F.col("value") >= FLAG_REJ_FROM, F.lit("REJ")).otherwise(F.lit("SF")))
    return ev.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("host"),
                     F.col("event_type").alias("service"), flag.alias("flag"))
