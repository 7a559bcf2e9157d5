"""End-to-end run over record files, with every report as a DataFrame.

    python -m connlearn.plans.report --train train.gz --test test.gz \
        --fields 42 [--categorical] [--classes binary|all] [--model-path P] [--show]

The same steps as a classic script run: read both files, profile the labels,
fit the workflow on the training file, score the test file once, then
weights, OK/KO counts, error and the confusion matrix. (The script's split
and re-union of each file is the identity on its rows and is left out.) Nothing is collected except what
``--show`` prints (each table is a small aggregate).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_TOKEN
from ..operators.labels import binary_label_frequency, class_frequency, label_frequency, label_vocabulary
from ..operators.model import labeler_of
from ..schema import RecordSchema
from ..session import ensure_checkpoint_dir
from ..sources.records import read_records
from .workflow import Workflow


def run_report(spark: SparkSession, train_path: str, test_path: str, schema: RecordSchema,
               categorical: bool = False, classes: str = "binary", normal_token: str = NORMAL_TOKEN,
               model_path: str | None = None, min_partitions: int | None = None,
               durable: bool = False) -> dict[str, DataFrame]:
    ensure_checkpoint_dir(spark)
    train = read_records(spark, train_path, schema, min_partitions=min_partitions)
    test = read_records(spark, test_path, schema, min_partitions=min_partitions)
    flow = Workflow(schema, categorical=categorical, classes=classes, normal_token=normal_token, durable=durable)
    res = flow.run(train, test, model_path=model_path).persist()
    labelled = labeler_of(res.model).transform(train)
    return {
        "record_counts": train.agg(F.count(F.lit(1)).alias("n")).withColumn("file", F.lit("train")).unionByName(
            test.agg(F.count(F.lit(1)).alias("n")).withColumn("file", F.lit("test"))),
        "train_label_frequency": label_frequency(train, schema.label),
        "test_label_frequency": label_frequency(test, schema.label),
        "vocabulary": label_vocabulary(train, schema.label),
        "train_class_frequency": class_frequency(labelled, res.vocabulary, "class"),
        "train_binary_frequency": binary_label_frequency(labelled, "class"),
        "test_binary_frequency": binary_label_frequency(res.scored, "class"),
        "test_class_frequency": res.class_frequency(),
        "weights": res.weights(),
        "ok_ko": res.ok_ko(),
        "error": res.error(),
        "confusion_counts": res.confusion_counts(),
        "confusion_matrix": res.confusion_matrix("wide"),
    }


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--train", required=True)
    ap.add_argument("--test", required=True)
    ap.add_argument("--fields", type=int, required=True, help="number of comma-separated fields per record")
    ap.add_argument("--categorical", action="store_true", help="add one-hot categorical features")
    ap.add_argument("--classes", choices=["binary", "all"], default="binary")
    ap.add_argument("--normal-token", default=NORMAL_TOKEN)
    ap.add_argument("--model-path")
    ap.add_argument("--partitions", type=int)
    ap.add_argument("--durable", action="store_true", help="checkpoint the training frame")
    ap.add_argument("--show", action="store_true")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    reports = run_report(spark, args.train, args.test, RecordSchema.positional(args.fields), args.categorical,
                         args.classes, args.normal_token, args.model_path, args.partitions, args.durable)
    for name, df in reports.items():
        if args.show:
            print(f"== {name}")
            df.show(200, truncate=False)


if __name__ == "__main__":
    main()
