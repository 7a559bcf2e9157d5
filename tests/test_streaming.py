import os

from connlearn import parse_records
from connlearn.operators.model import build_pipeline
from connlearn.streaming import read_record_stream, running_confusion, score_stream, start_scoring
from tests.fixtures import CONN_SCHEMA, MALFORMED_LINES, TEST_LINES, TRAIN_LINES, lines_df


def test_stream_scoring_equals_batch(spark, tmp_dir):
    tr = parse_records(lines_df(spark, TRAIN_LINES * 2), CONN_SCHEMA)
    model = build_pipeline(CONN_SCHEMA, categorical=True, classes="binary").fit(tr)
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.txt"), "w") as fh:
        fh.write("\n".join(TEST_LINES + MALFORMED_LINES[:2]) + "\n")
    stream = read_record_stream(spark, src, CONN_SCHEMA)
    scored = score_stream(model, stream, keep=("label",))
    q = start_scoring(scored, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    batch = score_stream(model, parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA), keep=("label",))
    assert got == sorted(tuple(r) for r in batch.collect())

    conf = running_confusion(score_stream(model, read_record_stream(spark, src, CONN_SCHEMA)))
    q2 = (conf.writeStream.format("memory").queryName("conf_counts").outputMode("complete")
          .option("checkpointLocation", os.path.join(tmp_dir, "ckpt2")).start())
    q2.processAllAvailable()
    q2.stop()
    assert sum(r["n"] for r in spark.sql("SELECT * FROM conf_counts").collect()) == len(TEST_LINES)


def test_stream_from_parquet_records(spark, tmp_dir):
    tr = parse_records(lines_df(spark, TRAIN_LINES * 2), CONN_SCHEMA)
    model = build_pipeline(CONN_SCHEMA, categorical=False, classes="all").fit(tr)
    src = os.path.join(tmp_dir, "pq")
    parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA).write.parquet(src)
    scored = score_stream(model, read_record_stream(spark, src, CONN_SCHEMA, fmt="parquet"), keep=("label",))
    q = (scored.writeStream.format("memory").queryName("pq_scores").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt_pq")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM pq_scores").collect())
    batch = score_stream(model, parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA), keep=("label",))
    assert got == sorted(tuple(r) for r in batch.collect())
    assert len(got) == 5                       # the unseen label is dropped by the label stage
