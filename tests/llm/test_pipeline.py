"""The corpus pipeline against its stages' definitions, and the entry guard."""

import importlib
import re

import corpus_pipeline
from connlearn.llm import bpe, mixing, quality, secrets, simhash


def test_stage_order_and_registration():
    entry = importlib.import_module("__spark_entry__")
    q = entry.queries()
    assert "pipeline" in q and sorted(int(re.match(r"op(\d+)_", k)[1]) for k in q if re.match(r"op\d+_", k)) == list(
        range(1, 14))
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage, simhash.stage, secrets.stage, mixing.stage, bpe.stage]


def test_pipeline_decisions(spark, make_docs, tables):
    def body(seed, n=80):
        return " ".join(f"w{seed}x{i * seed}" for i in range(n))

    secret = body(11) + " token = 0123456789abcdef0123456789abcdef01234567"
    rows = [(1, body(3), "a"), (2, body(3), "b"), (3, "too short", "a"), (4, secret, "b"), (5, body(7), None),
            (6, body(5), "a"), (7, None, "a"), (None, body(9), "c")]
    docs = make_docs(rows, clash=True)
    sf = tables(documents=docs)
    frame, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.staged(stage(spark, frame, sf), name)
        seen[name] = frame.collect()
        if name != "byte_bpe":
            assert frame.columns == docs.columns
    ids = {k: sorted((r.doc_id is None, r.doc_id) for r in v) for k, v in seen.items()}
    keep = [(False, i) for i in (1, 4, 5, 6)] + [(True, None)]
    assert sorted(ids["simhash_near_dedup"], key=str) == sorted(keep, key=str)
    assert all("0123456789abcdef" not in r.text for r in seen["secret_scan"])
    assert len(seen["byte_bpe"]) == len(seen["source_mixing"])
    got = corpus_pipeline.run(spark, sf)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got.collect()) == sorted(
        (str(r.doc_id), tuple(r.ids)) for r in seen["byte_bpe"])


def test_pipeline_on_no_documents(spark, make_docs, tables):
    assert corpus_pipeline.run(spark, tables(documents=make_docs([]))).count() == 0
