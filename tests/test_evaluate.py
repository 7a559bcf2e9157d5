import pytest

from connlearn import (confusion_counts, confusion_matrix, error_rate, evaluate, evaluator_accuracy, matrix_error,
                       matrix_from_keys, ok_ko_counts)


def pairs(spark, spec):
    rows = [(float(a), float(p)) for (a, p), n in spec for _ in range(n)]
    return spark.createDataFrame(rows, "label double, prediction double")


MIXED = [((0, 0), 900), ((0, 1), 5), ((1, 0), 20), ((1, 1), 250)]


def test_mixed(spark):
    df = pairs(spark, MIXED)
    e = error_rate(df).collect()[0]
    assert e["n"] == 1175 and e["n_ko"] == 25 and e["error_pct"] == pytest.approx(2500 / 1175)
    assert [tuple(r) for r in ok_ko_counts(df).collect()] == [("OK", 1150), ("KO", 25)]
    cc = [tuple(r) for r in confusion_counts(df).collect()]
    assert cc == [(0, 0, "0_0", 900), (0, 1, "0_1", 5), (1, 0, "1_0", 20), (1, 1, "1_1", 250)]
    wide = [tuple(r) for r in confusion_matrix(df, 2, form="wide").orderBy("actual").collect()]
    assert wide == [(0, 900, 5), (1, 20, 250)]
    assert matrix_error(confusion_matrix(df, 2)).collect()[0][0] == pytest.approx(e["error_pct"])


def test_all_ok_all_ko(spark):
    assert error_rate(pairs(spark, [((0, 0), 3), ((1, 1), 2)])).collect()[0]["error_pct"] == 0.0
    assert error_rate(pairs(spark, [((0, 1), 2)])).collect()[0]["error_pct"] == 100.0


def test_absent_class_and_many_classes(spark):
    df = pairs(spark, [((0, 0), 2), ((2, 1), 1), ((1, 1), 3)])
    wide = {r["actual"]: r for r in confusion_matrix(df, 3, form="wide").collect()}
    assert [wide[a]["p_2"] for a in range(3)] == [0, 0, 0]
    many = pairs(spark, [((2, 2), 1), ((10, 10), 1), ((10, 2), 1)])
    long = confusion_matrix(many, 12).collect()
    assert len(long) == 144 and sum(r["n"] for r in long) == 3
    keys = [r["key"] for r in confusion_counts(many).collect()]
    assert keys == ["2_2", "10_2", "10_10"]                      # numeric order, not text


def test_empty(spark):
    df = spark.createDataFrame([], "label double, prediction double")
    e = error_rate(df).collect()[0]
    assert e["n"] == 0 and e["error_pct"] is None
    assert sum(r["n"] for r in confusion_matrix(df, 2).collect()) == 0


def test_property_matrix_sums_and_error(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
    def check(rows):
        df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "label double, prediction double")
        cells = confusion_matrix(df, 4)
        assert sum(r["n"] for r in cells.collect()) == len(rows)
        err = error_rate(df).collect()[0]["error_pct"]
        assert matrix_error(cells).collect()[0][0] == pytest.approx(err)

    check()


def test_evaluate_matches_spark_evaluator(spark):
    df = pairs(spark, MIXED)
    row = evaluate(df).collect()[0]
    assert (row["n"], row["n_ok"], row["n_ko"]) == (1175, 1150, 25)
    assert row["accuracy"] == pytest.approx(evaluator_accuracy(df))
    assert row["error_pct"] == pytest.approx(100.0 * (1 - row["accuracy"]))


def test_matrix_counts_every_pair(spark):
    rows = [(0.0, 0.0), (1.0, 0.0), (-1.0, 1.0), (0.0, 5.0), (None, 1.0)]
    pairs = spark.createDataFrame(rows, "label double, prediction double")
    with pytest.raises(Exception, match="class outside 0..1"):
        confusion_matrix(pairs, 2).collect()
    got = {(r.actual, r.predicted): r.n for r in confusion_matrix(pairs, 2, off_grid="extra").collect()}
    assert len(got) == 9 and sum(got.values()) == 5
    assert got[0, 0] == got[1, 0] == got[0, 2] == 1 and got[2, 1] == 2
    keys = spark.createDataFrame([("0_1", 2), ("0_1", 3), ("1_1", 4)], "key string, n long")
    cells = {(r.actual, r.predicted): r.n for r in matrix_from_keys(keys, 2).collect()}
    assert cells == {(0, 0): 0, (0, 1): 5, (1, 0): 0, (1, 1): 4}
