from pyspark.sql import functions as F

from connlearn import (ClassLabeler, binary_label, collect_vocabulary, label_frequency, label_vocabulary,
                       multinomial_label, parse_records)
from tests.fixtures import CONN_SCHEMA, TEST_LINES, TRAIN_LINES, lines_df


def _train(spark):
    return parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA, keep=("id",))


def _test(spark):
    return parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA, keep=("id",))


def test_label_frequency(spark):
    got = {r["label"]: r["n"] for r in label_frequency(_train(spark)).collect()}
    assert got == {"normal.": 3, "synflood.": 3, "scan.": 2}


def test_vocabulary_order(spark):
    vocab = label_vocabulary(_train(spark))
    assert [(r["label"], r["n"], r["class_id"]) for r in vocab.orderBy("class_id").collect()] == \
        [("normal", 3, 0), ("synflood", 3, 1), ("scan", 2, 2)]
    assert collect_vocabulary(vocab) == ["normal", "synflood", "scan"]


def test_binary_label_unseen_attack(spark):
    got = {r["id"]: r["class"] for r in binary_label(_test(spark)).collect()}
    assert got[0] == 0.0 and got[1] == 1.0 and got[4] == 1.0 and got[5] == 1.0


def test_multinomial_contains_and_exact(spark):
    vocab = ["normal", "synflood", "scan"]
    cont = {r["id"]: r["class"] for r in multinomial_label(_test(spark), vocab, drop_unknown=False).collect()}
    assert cont[1] == 1.0 and cont[4] == -1.0 and cont[5] == 2.0      # 'portscan.' contains 'scan'
    exact = {r["id"]: r["class"] for r in
             multinomial_label(_test(spark), vocab, match="exact", drop_unknown=False).collect()}
    assert exact[5] == -1.0 and exact[1] == 1.0
    kept = multinomial_label(_test(spark), vocab).select("id").collect()
    assert sorted(r["id"] for r in kept) == [0, 1, 2, 3, 5]


def test_contains_last_match_wins(spark):
    df = spark.createDataFrame([("normal.",), ("abnormal.",)], "label string")
    got = [r["class"] for r in multinomial_label(df, ["normal", "abnormal"], drop_unknown=False)
           .orderBy(F.length("label")).collect()]
    assert got == [0.0, 1.0]


def test_labeler_one_class_guard(spark):
    df = _train(spark).filter(F.col("label") == "normal.")
    import pytest
    with pytest.raises(ValueError, match="single class: normal"):
        ClassLabeler(classes="binary").fit(df)
    with pytest.raises(ValueError, match="single class"):
        ClassLabeler(classes="all").fit(df)


def test_labeler_model_vocabulary(spark):
    model = ClassLabeler(classes="all").fit(_train(spark))
    assert model.getVocabulary() == ["normal", "synflood", "scan"]
    out = model.transform(_test(spark))
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 5]
    # unlabelled records pass through untouched
    assert model.transform(_test(spark).drop("label")).count() == 6
