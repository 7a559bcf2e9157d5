"""Delimited connection records: scan, parse, positional frames, head samples.

All parsing is column expressions (``split`` + element access + casts), so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RecordSchema
from ..session import spread, staging_path

PARSE_MODES = ("failfast", "drop")


def scan_lines(spark: SparkSession, path: str | list[str], min_partitions: int | None = None) -> DataFrame:
    """One row (``value STRING``) per line of text files (gzip or plain).

    A gzip file is not splittable and arrives as one partition; pass
    ``min_partitions`` to spread such an input before any wide work. A scan
    that already has as many partitions is left alone.
    """
    df = spark.read.text(path)
    return spread(df, min_partitions) if min_partitions else df


def _fields(line: Column, sep: str) -> Column:
    # limit -1 keeps trailing empty fields, so a short line is detected
    return F.split(line, _regex_literal(sep), -1)


def _regex_literal(sep: str) -> str:
    return "".join("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch for ch in sep)


def parse_records(lines: DataFrame, schema: RecordSchema, mode: str = "failfast",
                  line_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse ``line_col`` into the typed columns of ``schema``.

    ``failfast`` (the reference behaviour) raises on a line with the wrong
    number of fields or a non-numeric token in a numeric position. ``drop``
    silently removes such lines; count them with :func:`parse_report`.
    ``keep`` lists extra input columns carried through (e.g. a key).
    """
    if mode not in PARSE_MODES:
        raise ValueError(f"mode must be one of {PARSE_MODES}")
    n = len(schema.names)
    arr = _fields(F.col(line_col), schema.sep)
    parts = lines.select(*keep, arr.alias("__f"))
    size_ok = F.size("__f") == n
    if mode == "failfast":
        bad_len = F.raise_error(F.concat(
            F.lit(f"malformed record: expected {n} fields, got "),
            F.size("__f").cast("string")))
        checked = parts.select(*keep, F.when(size_ok, F.col("__f")).otherwise(bad_len).alias("__f"))
        # try_cast + explicit error: fails the same way whether or not the
        # session runs in ANSI mode
        cols = [
            (F.col("__f")[i] if schema.is_string(name)
             else F.coalesce(F.col("__f")[i].try_cast("double"),
                             F.raise_error(F.concat(F.lit(f"malformed number in field {name}: '"),
                                                    F.col("__f")[i], F.lit("'"))).cast("double"))).alias(name)
            for i, name in enumerate(schema.names)
        ]
        return checked.select(*keep, *cols)
    cols = [
        (F.when(size_ok, F.col("__f")[i]) if schema.is_string(name)
         else F.when(size_ok, F.col("__f")[i].try_cast("double"))).alias(name)
        for i, name in enumerate(schema.names)
    ]
    valid = F.lit(True)
    for name in schema.names:
        valid = valid & F.col(name).isNotNull()
    return parts.select(*keep, *cols).filter(valid)


def parse_report(lines: DataFrame, schema: RecordSchema, line_col: str = "value") -> DataFrame:
    """One row ``n_lines, n_parsed, n_dropped`` for ``mode='drop'`` parsing."""
    flagged = parse_records_flags(lines, schema, line_col)
    return flagged.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.sum(F.col("__ok").cast("long")), F.lit(0)).alias("n_parsed"),
        F.coalesce(F.sum((~F.col("__ok")).cast("long")), F.lit(0)).alias("n_dropped"),
    )


def parse_records_flags(lines: DataFrame, schema: RecordSchema, line_col: str = "value") -> DataFrame:
    """Input lines with a boolean ``__ok`` telling whether they parse."""
    n = len(schema.names)
    arr = _fields(F.col(line_col), schema.sep)
    ok = F.size(arr) == n
    for i, name in enumerate(schema.names):
        if not schema.is_string(name):
            ok = ok & F.when(F.size(arr) == n, arr[i].try_cast("double").isNotNull()).otherwise(False)
    return lines.select(F.col(line_col), ok.alias("__ok"))


def line_fault(line: Column, schema: RecordSchema) -> Column:
    """Why a line is no record: ``null``, ``fields: <n>`` or ``number: <name>``
    (the first such field); null for a record."""
    n = len(schema.names)
    arr = _fields(line, schema.sep)
    fault = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(schema.names))):
        if not schema.is_string(name):
            fault = F.when(F.get(arr, F.lit(i)).try_cast("double").isNull(), F.lit(f"number: {name}")).otherwise(fault)
    return F.when(line.isNull(), F.lit("null")).when(
        F.size(arr) != n, F.concat(F.lit("fields: "), F.size(arr).cast("string"))).otherwise(fault)


class Quarantine:
    """Records and faulty lines of one pass over text, both stored.

    ``records``: the typed records; ``faults``: ``value, fault`` and the
    columns in ``keep`` (a file name, a key) of the lines that are none;
    ``counts``: ``n_lines, n_parsed, n_dropped``, from the stored table; the text is
    read once.
    """

    def __init__(self, lines: DataFrame, schema: RecordSchema, line_col: str = "value", keep: tuple[str, ...] = (),
                 path: str | None = None):
        spark = lines.sparkSession
        target = path or staging_path(spark, "quarantine")
        judged = lines.select(*keep, F.col(line_col).alias("value"), line_fault(F.col(line_col), schema).alias("fault"))
        bad = F.col("fault").isNotNull()
        judged.withColumn("is_bad", bad).write.mode("overwrite").partitionBy("is_bad").parquet(target)
        table = spark.read.schema(judged.withColumn("is_bad", bad).schema).parquet(target)
        self.path = target
        self.records = parse_records(table.filter("NOT is_bad"), schema, keep=keep)
        self.faults = table.filter("is_bad").select(*keep, "value", "fault")
        # counted on the stored flags, not with an Observation: a session that
        # has used one can no longer ship a fitted model with its summary
        n = {r["is_bad"]: r["count"] for r in table.groupBy("is_bad").count().collect()}
        good, dropped = n.get(False, 0), n.get(True, 0)
        self.counts = {"n_lines": good + dropped, "n_parsed": good, "n_dropped": dropped}


def read_records(spark: SparkSession, path: str | list[str], schema: RecordSchema,
                 fmt: str = "text", mode: str = "failfast",
                 min_partitions: int | None = None) -> DataFrame:
    """Read connection records from delimited text (gzip or plain) or Parquet."""
    if fmt == "parquet":
        return spark.read.schema(schema.struct_type()).parquet(*([path] if isinstance(path, str) else path))
    if fmt != "text":
        raise ValueError("fmt must be 'text' or 'parquet'")
    return parse_records(scan_lines(spark, path, min_partitions), schema, mode=mode)


def positional_frame(lines: DataFrame, n_fields: int, sep: str = ",", line_col: str = "value",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Split lines into string columns ``_1 .. _n`` (no typing, like ``toDF``).
    A line with fewer or more fields is an error; a null line gives nulls."""
    arr = _fields(F.col(line_col), sep)
    wrong = F.raise_error(F.concat(F.lit(f"malformed record: expected {n_fields} fields, got "),
                                   F.size(arr).cast("string")))
    checked = lines.select(*keep, F.when(arr.isNull() | (F.size(arr) == n_fields), arr).otherwise(wrong).alias("__f"))
    return checked.select(*keep, *[F.col("__f")[i].alias(f"_{i + 1}") for i in range(n_fields)])


def format_records(df: DataFrame, schema: RecordSchema, number_format: str | None = None) -> DataFrame:
    """Inverse of :func:`parse_records`: one delimited ``value`` line per row."""
    parts = []
    for name in schema.names:
        c = F.col(name)
        if not schema.is_string(name):
            c = F.format_string(number_format, c) if number_format else c.cast("string")
        parts.append(c)
    return df.select(F.concat_ws(schema.sep, *parts).alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str = "gzip") -> str:
    lines.write.mode("overwrite").option("compression", compression).text(path)
    return path


def head_sample(df: DataFrame, n: int, order_by: list[str] | tuple[str, ...]) -> DataFrame:
    """The first ``n`` rows under an explicit order (all rows if fewer exist).

    Planned as TakeOrderedAndProject: each task keeps its own top ``n``, the
    final merge sees at most ``n x partitions`` rows.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    return df.orderBy(*order_by).limit(n)


def write_head_sample(df: DataFrame, n: int, order_by, path: str, line_col: str = "value") -> str:
    """Write the first ``n`` lines as gzip text, like ``<file>.<n>.gz`` samples."""
    sample = head_sample(df, n, order_by).select(line_col)
    return write_lines(sample.coalesce(1), path)


def stage_parquet(df: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet (under the shared staging folder by default)
    and return a frame reading it back.

    Parse text once, then every later pass reads columnar data with pushed
    filters and pruned columns; the lineage to the (possibly unsplittable)
    text input is cut, so a lost executor never re-runs the parse.
    """
    spark = df.sparkSession
    target = path or staging_path(spark, "records")
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def prefix_files(spark: SparkSession, path: str | list[str], n: int) -> list[str]:
    """The leading files, in order of their path, that hold ``n`` lines
    together (all files if there are fewer).

    Files are counted in path order, one, two, four, ... at a time, each
    count ending at the lines still missing; the rest are only listed.
    """
    files = [_literal_path(f) for f in sorted(spark.read.text(path).inputFiles())]
    if not files:
        return [path] if isinstance(path, str) else list(path)
    if n <= 0:
        return files[:1]
    at, found, step = 0, 0, 1
    while at < len(files) and found < n:
        found += spark.read.text(files[at:at + step]).limit(n - found).count()
        at, step = at + step, step * 2
    return files[:at]


def _literal_path(uri: str) -> str:
    """A listed file's URI as a path that names it alone."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in unquote(uri))


def first_lines(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """The first ``n`` lines of text files, files in order of their path.

    Only the leading files that hold them are read (:func:`prefix_files`).
    Spark packs files into tasks by size, so the order is taken from the file
    path, the split's offset in the file and the position within the split
    (``monotonically_increasing_id`` grows along a split). Planned as a top-n:
    each task keeps n rows at most.
    """
    lines = spark.read.text(prefix_files(spark, path, n)).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__pos"))
    return lines.orderBy("__file", "__start", "__pos").limit(n).select("value")


def write_sample_files(spark: SparkSession, train_path: str, test_path: str, out_dir: str,
                       n_train: int = 10_000) -> dict[str, str]:
    """Sample files ``<name>.<N>.gz`` with the first ``n_train`` training
    lines and the first ``n_train // 10`` test lines."""
    out = {}
    for path, n in ((train_path, n_train), (test_path, n_train // 10)):
        name = os.path.basename(path.rstrip("/"))
        name = name[:-3] if name.endswith(".gz") else name
        target = f"{out_dir.rstrip('/')}/{name}.{n}.gz"
        write_lines(first_lines(spark, path, n).coalesce(1), target)
        out[path] = target
    return out
