"""WARC archives: writing, streaming reads, and transaction assembly through
concurrent-to identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path
from .common import key_hash, map_arrow, read, staged

END = "\r\n\r\n"
#: Smallest payload (bytes) that may be recorded as a revisit.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
#: Records attached to a capture beyond which its nested row is continued in
#: further rows (``part`` 1, 2, ...), so that no row grows without bound.
PART = 1000


def record_id(kind: str, *parts: Column) -> Column:
    h = key_hash(kind, *parts)
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def record_text(kind: Column | str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its final END; a null field is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), kind), *lines, length),
                    F.lit(END), block)


def page_records(pages: DataFrame) -> DataFrame:
    """One string column ``value``: a response or revisit, a request and a
    metadata record for every row of pages(page_id, url, html).

    A null html is an empty payload; a null url has no target; line breaks in
    a url are percent-encoded. Of the rows with equal payloads of at least
    100 bytes, the one with the smallest page_id is a response (all its rows
    if that id repeats; a null id is never the smallest unless all are null)
    and the others revisit it. Payload groups are reduced to their smallest
    id first, and only groups of two or more meet the pages again.
    """
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"), body.alias("body"),
                        F.octet_length(body).cast("long").alias("size"),
                        F.sha2(body.cast("binary"), 256).alias("digest"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    shared = (rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(first, F.count("*").alias("n"))
              .filter("n > 1").select(F.col("digest").alias("s_digest"), "first"))
    rows = rows.join(shared, (F.col("digest") == F.col("s_digest")) & (F.col("size") >= LEAST_REVISIT), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    me = [F.col("page_id"), F.col("url"), F.col("digest")]
    capture = record_id("response", *me)
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    target = record_id("response", F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    main = record_text(
        F.when(revisit, "revisit").otherwise("response"),
        [("WARC-Record-ID", capture), *common, ("WARC-Payload-Digest", digest),
         ("WARC-Refers-To", F.when(revisit, target)),
         ("WARC-Profile", F.when(revisit, F.lit(
             "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, "body")))
    asked = record_id("request", *me)
    request = record_text("request", [
        ("WARC-Record-ID", asked), ("WARC-Concurrent-To", capture), *common,
        ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + END)))
    metadata = record_text("metadata", [
        ("WARC-Record-ID", record_id("metadata", *me)), ("WARC-Concurrent-To", asked), *common,
        ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("\r\n")))
    return rows.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Gzip archives, one per task, through Spark's own writer (any file
    system that Spark writes): records, each followed by an empty line pair."""
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


class Parser:
    """Cuts a byte stream into records by their Content-Length."""

    def __init__(self, source: str):
        self.source, self.buffer, self.head, self.need = source, bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        self.buffer += data
        while True:
            if self.head is None:
                start = 0
                while self.buffer[start:start + 1] in (b"\r", b"\n"):
                    start += 1
                del self.buffer[:start]
                stop = self.buffer.find(b"\r\n\r\n")
                if stop < 0:
                    return
                lines = self.buffer[:stop].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record where one should start in {self.source}")
                self.head = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
                self.need = int(dict(self.head).get("content-length", 0))
                del self.buffer[:stop + 4]
            if len(self.buffer) < self.need:
                return
            yield self.head, bytes(self.buffer[:self.need])
            del self.buffer[:self.need]
            self.head = None

    def close(self) -> None:
        if self.head is not None or self.buffer.strip(b"\r\n"):
            raise ValueError(f"truncated record in {self.source}")


RECORD = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
    ("http_head", pa.string()), ("payload", pa.binary())])
RECORD_DDL = ("warc_type string, record_id string, concurrent_to array<string>, refers_to string, "
              "target_uri string, payload_digest string, http_head string, payload binary")


def _row(head: list[tuple[str, str]], block: bytes) -> tuple:
    h = dict(reversed(head))
    http = b""
    if h.get("content-type", "").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
    return (h.get("warc-type"), h.get("warc-record-id"), [v for k, v in head if k == "warc-concurrent-to"],
            h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"),
            http.decode("utf-8", "replace"), block)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives under ``path``, byte exact.

    Spark's text source streams each file in order (cut at END, which may
    also occur inside a record); the parser puts records together again by
    their length, holding one record at a time. A truncated record, and an
    archive that is not compressed and so arrives in pieces, is an error.
    """
    chunks = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, held = None, [], 0
        for b in batches:
            for file, at, chunk in zip(b.column(0), b.column(1), b.column(2)):
                name = file.as_py()
                if parser is None or parser.source != name:
                    if parser:
                        parser.close()
                    if at.as_py():
                        raise ValueError(f"{name} is not compressed and was split")
                    parser = Parser(name)
                for head, block in parser.feed(chunk.as_py() + b"\r\n\r\n"):
                    rows.append(_row(head, block))
                    held += len(block)
                if held > 4_000_000 or len(rows) > 5_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if parser:
            parser.close()
        if rows:
            yield _batch(rows)

    return map_arrow(chunks, run, RECORD_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit record): its own
    record, the requests and the metadata records that belong to it.

    ``records`` has warc_type, record_id, concurrent_to and any other columns.
    A record belongs to a capture that it names as concurrent, that names it,
    or that belongs (either way) to a record it is concurrent with: requests
    name their response, metadata may name either. Records of equal id are
    one record with a count of ``copies``; records that reach no capture give
    no row. A capture with more than 1000 attached records is continued in
    rows with part > 0. Columns: record_id, record, copies, part, requests,
    metadata (arrays of structs, ordered by record_id).
    """
    cols = records.columns
    one = (records.filter(F.col("record_id").isNotNull()).groupBy("record_id")
           .agg(F.first(F.struct(*cols)).alias("record"), F.count("*").alias("copies")))
    capture = F.col("record.warc_type").isin("response", "revisit")
    named = one.select(F.col("record_id").alias("x"), capture.alias("xc"), F.explode("record.concurrent_to").alias("y"))
    ids = one.select(F.col("record_id").alias("y"), capture.alias("yc"))
    pairs = named.join(ids, "y").select("x", "xc", "y", "yc")
    both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("yc").alias("xc"),
                                       F.col("x").alias("y"), F.col("xc").alias("yc")))
    first = both.filter("not xc and yc").select("x", F.col("y").alias("capture")).distinct()
    far = both.filter("not xc and not yc").select(F.col("x").alias("far"), F.col("y").alias("x"))
    second = far.join(first, "x").select(F.col("far").alias("x"), "capture")
    owned = first.unionAll(second).distinct()
    parts = owned.groupBy("capture").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    attached = (owned.join(parts, "capture")
                .join(one.filter(~capture).select(F.col("record_id").alias("x"), "record"), "x")
                .withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts"))))

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("record.warc_type") == kind, F.col("record"))),
                            lambda a, b: F.when(a["record_id"] < b["record_id"], -1)
                            .when(a["record_id"] > b["record_id"], 1).otherwise(0))

    nested = attached.groupBy(F.col("capture").alias("n_id"), "part").agg(
        of("request").alias("requests"), of("metadata").alias("metadata"))
    main = one.filter(capture)
    out = main.join(nested, main["record_id"] == nested["n_id"], "left")
    none = F.array().cast(out.schema["requests"].dataType)
    return out.select("record_id", "record", "copies", F.coalesce("part", F.lit(0)).cast("int").alias("part"),
                      F.coalesce("requests", none).alias("requests"),
                      F.coalesce("metadata", none).alias("metadata"))


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` row written as a WARC record and read back, one row per page.

    A null html is an empty payload; equal payloads of at least 100 bytes are revisits
    of the smallest page_id; repeated rows give a row each; an empty table gives
    no rows; further columns of ``pages`` are not read."""
    path = staging_path(spark, "warc")
    write_archives(page_records(read(spark, sf_dir, "pages")), path)
    records = read_archives(spark, path)
    response = F.col("warc_type") == "response"
    size = F.when(response, F.octet_length("payload").cast("long")).otherwise(
        F.regexp_extract("http_head", r"(?i)content-length: *(\d+)", 1).try_cast("long"))
    digest = F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1))
    page = F.regexp_extract(F.col("payload").cast("string"), r"page-id: *(-?\d+)", 1).try_cast("long")
    slim = records.select("warc_type", "record_id", "concurrent_to", "refers_to", size.alias("size"),
                          digest.alias("digest"), F.when(F.col("warc_type") == "metadata", page).alias("page_id"))
    # a response refers to nothing: a value of its own keeps the join's nulls apart
    to = F.coalesce("record.refers_to", F.concat(F.lit("-"), "record_id"))
    captures = assemble(staged(slim, "warc-records")).select(
        F.col("record_id"), to.alias("to"), F.col("record.size").alias("payload_bytes"),
        F.col("record.digest").alias("payload_digest"), F.col("record.warc_type").alias("record_type"),
        F.get("metadata.page_id", F.lit(0)).alias("page_id"), "copies")
    pages = captures.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"))
    out = captures.join(pages, "to", "left").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_transactions": op1_warc_transactions}
