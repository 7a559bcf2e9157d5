import pytest
from pyspark.sql import functions as F

from connlearn import Workflow, parse_records
from tests.fixtures import CONN_SCHEMA, TEST_LINES, TRAIN_LINES, lines_df


@pytest.mark.parametrize("categorical", [False, True])
@pytest.mark.parametrize("classes", ["binary", "all"])
def test_four_workflows_invariants(spark, categorical, classes, tmp_dir):
    tr = parse_records(lines_df(spark, TRAIN_LINES * 3), CONN_SCHEMA)
    ts = parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA)
    res = Workflow(CONN_SCHEMA, categorical=categorical, classes=classes).run(tr, ts, model_path=f"{tmp_dir}/m")
    k = res.num_classes
    assert k == (2 if classes == "binary" else 3)
    n_test = res.pairs.count()
    assert n_test == (6 if classes == "binary" else 5)
    cells = res.confusion_matrix().collect()
    assert len(cells) == k * k and sum(r["n"] for r in cells) == n_test
    err = res.error().collect()[0]["error_pct"]
    off = sum(r["n"] for r in cells if r["actual"] != r["predicted"])
    assert err == pytest.approx(100.0 * off / n_test)
    ok = {r["result"]: r["n"] for r in res.ok_ko().collect()}
    assert sum(ok.values()) == n_test
    w = res.weights().collect()
    assert len(w) == (k - 1) * len(res.feature_names)


def test_planted_signal_is_learned(spark):
    """Attacks have large src_bytes: the numeric binary model separates them."""
    train = [f"0,tcp,http,SF,{100 + i},10,0,0,normal." for i in range(30)] + \
            [f"0,tcp,http,S0,{5000 + i * 7},10,0,0,smurf." for i in range(30)]
    test = [f"0,tcp,http,SF,{120 + i},10,0,0,normal." for i in range(10)] + \
           [f"0,tcp,http,S0,{6000 + i},10,0,0,neptune." for i in range(10)]
    tr = parse_records(lines_df(spark, train), CONN_SCHEMA)
    ts = parse_records(lines_df(spark, test), CONN_SCHEMA)
    res = Workflow(CONN_SCHEMA, categorical=False, classes="binary").run(tr, ts)
    assert res.error().collect()[0]["error_pct"] == 0.0
    assert res.pairs.filter(F.col("label") == 1.0).count() == 10     # unseen attack counted as attack


def test_durable_fit_and_staged_records(spark, tmp_dir):
    from connlearn import stage_parquet

    tr = stage_parquet(parse_records(lines_df(spark, TRAIN_LINES * 3), CONN_SCHEMA), f"{tmp_dir}/staged")
    ts = parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA)
    plain = Workflow(CONN_SCHEMA, categorical=True, classes="all").run(tr, ts)
    durable = Workflow(CONN_SCHEMA, categorical=True, classes="all", durable=True).run(tr, ts).persist()
    uncached = Workflow(CONN_SCHEMA, categorical=True, classes="all", cache=False).run(tr, ts)
    a = sorted(map(tuple, plain.confusion_matrix().collect()))
    b = sorted(map(tuple, durable.confusion_matrix().collect()))
    c = sorted(map(tuple, uncached.confusion_matrix().collect()))
    assert a == b == c
    assert durable.error().collect()[0]["n"] == 5
    durable.unpersist()


def test_report_from_gzip_files(spark, tmp_dir):
    from connlearn import format_records, write_lines
    from connlearn.plans.report import run_report
    from connlearn.schema import RecordSchema

    schema = RecordSchema.positional(9)
    tr = parse_records(lines_df(spark, TRAIN_LINES * 4), CONN_SCHEMA).toDF(*schema.names)
    ts = parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA).toDF(*schema.names)
    a = write_lines(format_records(tr, schema), f"{tmp_dir}/train")
    b = write_lines(format_records(ts, schema), f"{tmp_dir}/test")
    reps = run_report(spark, a, b, schema, categorical=True, classes="all", model_path=f"{tmp_dir}/model")
    counts = {r["file"]: r["n"] for r in reps["record_counts"].collect()}
    assert counts == {"train": 32, "test": 6}
    assert [r["label"] for r in reps["vocabulary"].orderBy("class_id").collect()] == ["normal", "synflood", "scan"]
    assert reps["error"].collect()[0]["n"] == 5
    assert len(reps["confusion_matrix"].collect()) == 3


def test_report_cli(spark, tmp_dir, capsys):
    import gzip
    import os

    from connlearn.plans.report import main

    for name, body in (("train.gz", TRAIN_LINES * 3), ("test.gz", TEST_LINES)):
        with gzip.open(os.path.join(tmp_dir, name), "wt") as fh:
            fh.write("\n".join(body) + "\n")
    main(["--train", os.path.join(tmp_dir, "train.gz"), "--test", os.path.join(tmp_dir, "test.gz"),
          "--fields", "9", "--classes", "binary", "--show"])
    out = capsys.readouterr().out
    assert "== confusion_matrix" in out and "== error" in out and "== weights" in out
