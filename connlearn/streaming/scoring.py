"""Scoring connection records as they arrive (Structured Streaming).

A fitted pipeline (label stage, encoders, scaler, logistic model) is a chain
of column transforms, so ``model.transform`` applies unchanged to a
streaming frame. Evaluation keeps a running (actual, predicted) count table
in Spark state. Checkpoints go below the session's ``spark.checkpoint.dir``
unless a location is given.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import ok_ko
from ..schema import RecordSchema
from ..session import staging_path
from ..sources.records import parse_records


def read_record_stream(spark: SparkSession, path: str, schema: RecordSchema, fmt: str = "text",
                       mode: str = "drop", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parsed records from files landing in ``path``.

    Text lines are parsed with :func:`parse_records` (``drop`` by default: a
    long-running stream should not die on one bad line). Parquet files are
    read with the record schema.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "parquet":
        return reader.schema(schema.struct_type()).parquet(path)
    if fmt != "text":
        raise ValueError("fmt must be 'text' or 'parquet'")
    return parse_records(reader.text(path), schema, mode=mode)


def score_stream(model: PipelineModel, records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scored stream: ``keep`` columns, ``class`` (when labelled) and
    ``prediction``; no action is run."""
    scored = model.transform(records)
    cols = [*keep, *(["class"] if "class" in scored.columns else []), "prediction"]
    return scored.select(*cols)


def running_confusion(scored: DataFrame) -> DataFrame:
    """Running ``actual, predicted, n`` and OK/KO tag over a scored,
    labelled stream (stateful aggregate; use output mode ``update`` or
    ``complete``)."""
    return (scored.groupBy(F.col("class").cast("int").alias("actual"),
                           F.col("prediction").cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("result", ok_ko("actual", "predicted")))


def start_scoring(scored: DataFrame, sink_path: str, checkpoint_location: str | None = None,
                  trigger_seconds: float | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Append scored records to files (exactly-once via the checkpoint)."""
    spark = scored.sparkSession
    writer = (scored.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint_location or staging_path(spark, "scoring-ckpt")))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start(sink_path)
