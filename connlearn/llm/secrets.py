"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path
from .common import map_arrow, read, staged

#: Base kinds in rank order: (kind, pattern, group that must be long enough, least length).
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    ("assign", re.compile(r"(" + _KEY + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: Kinds that the method adds, ranked after the base kinds.
ADDED = (
    # with its headers, up to its END line or, if that is missing, the end of the text
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S), 0, 27),
    ("forge", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    ("chat", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    # of any length, with or without a user; runs between "://" do not overlap, so this is linear
    ("url", re.compile(r"://[^\s/:@]*:([^\s/:@]{6,})@"), 1, 6),
)
KINDS = BASE + ADDED
#: Changes with the patterns, so that blobs of older rules are scanned again.
RULE_VERSION = 3
#: Cheap literal tests: a kind's pattern runs only on texts that pass.
_HINTS = {"access": ("AKIA",), "pem": ("PRIVATE KEY-----",), "forge": ("gh",), "chat": ("xox",), "url": ("://",)}
_ASSIGN_HINTS = ("passw", "secret", "token", "api")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind rank, end) of every secret, in order of start, then kind.
    Offsets are code points, the end exclusive. Matches of a kind are leftmost
    and do not overlap; one whose value is too short is dropped."""
    low = text.lower()
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign":
            if not any(h in low for h in _ASSIGN_HINTS):
                continue
        elif kind in _HINTS and not any(h in text for h in _HINTS[kind]):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def spans_text(found: list[tuple[int, int, int]], base_only: bool = False) -> str:
    return ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in found if not base_only or k < len(BASE))


FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(blobs: DataFrame) -> DataFrame:
    """Findings of every (blob, text) row, one row per blob."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob, text in zip(b.column(0), b.column(1)):
                found = find(text.as_py() or "")
                count = [sum(k == rank for _, k, _ in found) for rank in range(len(BASE))]
                base = hashlib.sha256(spans_text(found, True).encode()).hexdigest()
                rows.append((blob.as_py(), *count, base, spans_text(found)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(blobs.select("blob", "text"), run, FINDINGS)


def address(text: Column) -> Column:
    """Content address of a blob: SHA-256 of its UTF-8 bytes; null is empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class BlobLedger:
    """A growing Parquet ledger of scanned blobs in a shared folder.

    One row per (blob, rule version): the blob's address, its findings and the
    version of the rules that made them. ``update`` scans only blobs that have
    no row under the current version; each update writes one folder of its own
    name, which counts once its ``_SUCCESS`` file is there. A failed update
    leaves nothing behind that is read, and a ledger opened on the same path,
    by any session, has all committed batches. Updates that run at the same
    time may both scan a blob; its findings are equal and are read once.
    """

    def __init__(self, spark: SparkSession, path: str, rule_version: int = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path, rule_version

    @property
    def batches(self) -> list[str]:
        """Folders of the committed updates, oldest first."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [(f.getModificationTime(), f.getPath()) for f in fs.listStatus(at) if f.isDirectory()]
        done = [(t, str(p.toString())) for t, p in found
                if p.getName().startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [p for _, p in sorted(done)]

    def rows(self) -> DataFrame:
        schema = FINDINGS + ", rule_version int"
        batches = self.batches
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*batches)

    def findings(self) -> DataFrame:
        """One row per blob that the current rules have seen. The rows of
        several batches are staged, so that a join with them can be split
        where one blob has many paths; blobs of one batch differ already."""
        rows = self.rows().filter(F.col("rule_version") == self.rule_version).drop("rule_version")
        return rows if len(self.batches) < 2 else staged(rows.dropDuplicates(["blob"]), "blob-findings")

    def update(self, versions: DataFrame, text: str = "text") -> "BlobLedger":
        """Scan the unseen blobs among all ``versions`` (any columns, one text
        column). Copies meet as equal addresses, first within a map task, so
        a group of copies of any size sends one text per task."""
        blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        seen = self.rows().filter(F.col("rule_version") == self.rule_version).select("blob")
        # copies meet before the join, which Spark moves below them where the ledger is small enough to broadcast
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
        scan(unseen).withColumn("rule_version", F.lit(self.rule_version)).write.parquet(
            f"{self.path}/batch-{uuid.uuid4().hex}")
        return self

    def paths(self, versions: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """Findings joined back to every path: one row per row of
        ``versions``, with the columns ``keep`` and the findings."""
        found = self.findings().withColumnRenamed("blob", "_blob")
        addressed = versions.select(*keep, address(F.col(text)).alias("_address"))
        return addressed.join(found, F.col("_address") == F.col("_blob")).drop("_address").withColumnRenamed(
            "_blob", "blob")


def scan_all(spark: SparkSession, versions: DataFrame, keep: list[str], text: str = "text",
             deliveries: int = 1) -> DataFrame:
    """Findings of all ``versions`` through a new ledger, one row per row. They
    come in ``deliveries``, parted by a hash of the ``keep`` columns; each is
    an update that skips the blobs of those before it. Null texts are empty;
    repeated rows stay; no rows give no rows."""
    ledger = BlobLedger(spark, staging_path(spark, "blob-ledger"))
    part = F.pmod(F.xxhash64(*keep), F.lit(deliveries))
    for i in range(deliveries):
        ledger.update(versions.filter(part == i) if deliveries > 1 else versions, text)
    return ledger.paths(versions, keep, text)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``, one row per row. The rows
    come to the ledger in two deliveries; blobs of the second that the first
    had are not scanned again.

    A null text is empty; equal texts are one blob, scanned once; repeated rows and null
    ids are kept; an empty table gives no rows; further columns are not read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_all(spark, docs, ["doc_id"], deliveries=2).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by ``[kind]``; overlapping spans
    become one, named by the first."""
    out, at, end, kind = [], 0, -1, ""
    for s in spans.split(",") if spans else []:
        k, a, b = s.split(":")
        if int(a) >= end:
            if end >= 0:
                out.append(f"[{kind}]")
                at = end
            out.append(text[at:int(a)])
            at, end, kind = int(a), int(b), k
        else:
            end = max(end, int(b))
    if end >= 0:
        out.append(f"[{kind}]")
        at = end
    return "".join(out) + text[at:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, every secret replaced by its kind in
    brackets. Only blobs with findings travel back to the documents, as
    (address, spans); texts are redacted where they are read. Null texts stay
    null; repeated rows stay; extra columns are kept as they are."""
    ledger = BlobLedger(spark, staging_path(spark, "blob-ledger")).update(docs)
    hits = ledger.findings().filter("spans <> ''").select("blob", "spans")
    tagged = docs.select(F.struct(*docs.columns).alias("row"), address(F.col("text")).alias("address"))
    tagged = tagged.join(hits, F.col("address") == F.col("blob"), "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(names)}
            spans = b.column(len(names))
            texts = [t.as_py() if not s.is_valid else redact(t.as_py(), s.as_py())
                     for t, s in zip(cols["text"], spans)]
            cols["text"] = pa.array(texts, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n.as_py() if not s.is_valid else len(t)
                                            for n, s, t in zip(cols["n_chars"], spans, texts)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return map_arrow(tagged.select(*[F.col("row")[c].alias(c) for c in names], F.col("spans").alias("_spans")), run,
                     docs.schema)


QUERIES = {"op4_secret_scan": op4_secret_scan}
