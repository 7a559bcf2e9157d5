import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from connlearn import (assemble, category_labels, category_widths, encode_categories, fit_category_encoders,
                       fit_scaler, one_hot_columns, parse_records, scale, vector_columns)
from connlearn.operators.encode import onehot_col
from tests.fixtures import CONN_SCHEMA, TEST_LINES, TRAIN_LINES, lines_df

CATS = list(CONN_SCHEMA.categorical)


def _frames(spark):
    tr = parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA, keep=("id",))
    ts = parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA, keep=("id",))
    return tr, ts


def test_indexer_order_and_widths(spark):
    tr, _ = _frames(spark)
    enc = fit_category_encoders(tr, CATS)
    assert category_labels(enc) == [["tcp", "icmp", "udp"], ["http", "eco", "dns"], ["SF", "S0"]]
    assert category_widths(enc) == [4, 4, 3]


def test_unseen_category_goes_to_last_slot(spark):
    tr, ts = _frames(spark)
    enc = fit_category_encoders(tr, CATS)
    out = one_hot_columns(enc.transform(ts), [onehot_col(c) for c in CATS], category_widths(enc),
                          keep=["id"], names=CATS)
    row = out.filter(F.col("id") == 2).collect()[0]          # service 'ftp' unseen
    assert (row["service_1"], row["service_2"], row["service_3"], row["service_4"]) == (0, 0, 0, 1)
    # every one-hot block sums to one
    for r in out.collect():
        for c, w in zip(CATS, category_widths(enc)):
            assert sum(r[f"{c}_{j}"] for j in range(1, w + 1)) == 1


def test_null_category_goes_to_unseen_slot(spark):
    tr, _ = _frames(spark)
    enc = fit_category_encoders(tr, ["flag"])
    df = spark.createDataFrame([(None,)], "flag string")
    arr = enc.transform(df).select(vector_to_array(onehot_col("flag")).alias("a")).collect()[0]["a"]
    assert arr == [0.0, 0.0, 1.0]


def test_scaler_train_statistics_only(spark):
    tr, ts = _frames(spark)
    num = list(CONN_SCHEMA.numeric)
    model = fit_scaler(assemble(tr, num, "raw_features"))
    scaled_tr = vector_columns(model.transform(assemble(tr, num, "raw_features")), "features", num)
    stats = scaled_tr.agg(*[F.avg(c).alias(f"m_{c}") for c in num],
                          *[F.stddev_samp(c).alias(f"s_{c}") for c in num]).collect()[0]
    for c in num:
        if c == "urgent":                                   # constant in training
            assert stats[f"m_{c}"] == 0.0 and stats[f"s_{c}"] == 0.0
        else:
            assert abs(stats[f"m_{c}"]) < 1e-12 and abs(stats[f"s_{c}"] - 1.0) < 1e-12
    scaled_ts = vector_columns(model.transform(assemble(ts, num, "raw_features")), "features", num, keep=["id"])
    assert scaled_ts.filter(F.col("id") == 3).collect()[0]["urgent"] == 0.0   # urgent = 9 in test


def test_hypothesis_scaled_columns(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 3)), min_size=2, max_size=30))
    def check(rows):
        df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
        model = fit_scaler(assemble(df, ["a", "b"], "raw_features"))
        out = vector_columns(model.transform(assemble(df, ["a", "b"], "raw_features")), "features", ["a", "b"])
        agg = out.agg(F.avg("a"), F.stddev_samp("a"), F.avg("b"), F.stddev_samp("b")).collect()[0]
        for m, s in ((agg[0], agg[1]), (agg[2], agg[3])):
            assert abs(m) < 1e-9
            assert abs(s - 1.0) < 1e-9 or abs(s) < 1e-12

    check()


def test_encode_categories_and_scale_fit_on_train_only(spark):
    tr, ts = _frames(spark)
    enc, out = encode_categories(ts, CATS, fit_on=tr)
    assert category_widths(enc) == [4, 4, 3] and out.count() == 6
    num = list(CONN_SCHEMA.numeric)
    model, (a, b) = scale(assemble(tr, num, "raw_features"), assemble(ts, num, "raw_features"))
    assert a.count() == 8 and b.count() == 6
    assert model.mean.toArray()[num.index("src_bytes")] == pytest.approx((181 + 239 + 44 + 0 + 0 + 10 + 8 + 18) / 8)
