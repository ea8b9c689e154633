"""WARC archives as chunked record tables (operator 4).

A payload becomes rows (record, chunk number, chunk) of at most `chunk_bytes` bytes (or one character), cut out of the bytes
of its input row where they lie, each with the digest of the payload so far; every row is a WARC record of its own: the first chunk of a response, and continuation records with a
segment number for the rest. Spark's text writer puts the rows, in order, into gzip-compressed files in the shared folder,
and the reader streams the lines of a file back through one parser, which never holds more than a line and updates the
payload digest as chunks come in. Beside the input row itself no record is ever put together in memory. A payload that another page has already
is written as a revisit record without body.

The page that a payload's copies refer to is found over (page_id, digest) rows alone, pre-aggregated by digest, so a
digest that a third of all pages share is no hot key for the payloads: those are shuffled by page.

Defined results: a null html is an empty payload; null ids are never referred to; pages with the same id and payload as
the referred one are responses like it, as only larger ids revisit; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.llm.common import arrow_schema, slices, table
from concord.session import shared_dir

#: Bytes of payload in one chunk.
CHUNK_BYTES = 1 << 16
#: Bytes of chunks that leave a task at once.
BATCH_BYTES = 4 << 20
#: Payloads below this many bytes are always responses.
REVISIT_BYTES = 100
#: What every revisit record of this kind has to name (fixed by the WARC standard).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def with_references(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest id with the same payload where that is smaller."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col else F.lit("")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest = F.sha2("html", 256).alias("digest")
    slim = rows.where(F.octet_length("html") >= least).select("page_id", digest)
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    revisits = slim.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))).distinct()
    rows = rows.withColumn("digest", digest)
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["digest"] == revisits["digest"])
    return rows.join(revisits, same, "left").select(rows["page_id"], "url", "html", rows["digest"], "refers_to")


def pieces(raw: memoryview, size: int) -> Iterator[memoryview]:
    """Views of at most `size` bytes (or one character) of a UTF-8 text; an empty text is one empty piece."""
    at, n = 0, len(raw)
    while at < n or not n:
        end = min(at + size, n)
        while end < n and end > at and raw[end] & 0xC0 == 0x80:  # inside a character
            end -= 1
        if end == at:
            end = min(at + 1, n)
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
        yield raw[at:end]
        if end >= n:
            return
        at = end


def texts_of(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text of an Arrow column without nulls, as views of its buffer."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).tolist()
    data = memoryview(column.buffers()[2] or b"").cast("B")
    return (data[x:y] for x, y in zip(offsets, offsets[1:]))


def chunk_rows(pages: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The record table: (record, page_id, chunk_no, last, kind, url, refers_to, digest, running_digest, total_bytes, chunk).

    Rows of a record follow each other; a revisit has one row without chunk.
    """
    schema = "record string, page_id long, chunk_no int, last boolean, kind string, url string, refers_to long, digest string, running_digest string, total_bytes long, chunk string"
    arrow = arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            *columns, chunk = zip(*out)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(chunk, pa.binary()).cast(pa.string())], schema=arrow)

        for part in slices(batches, "html"):
            out, held = [], 0
            for page, url, raw, total, digest, refers in zip(
                *(part.column(c).to_pylist() for c in ("page_id", "url")), texts_of(part.column("html")), *(part.column(c).to_pylist() for c in ("total_bytes", "digest", "refers_to"))
            ):
                name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {digest} {url}"))
                if refers is not None:
                    out.append((name, page, 1, True, "revisit", url, refers, digest, digest, total, None))
                    continue
                running, left = hashlib.sha256(), total
                for no, piece in enumerate(pieces(raw, chunk_bytes), 1):
                    running.update(piece)
                    left -= len(piece)
                    out.append((name, page, no, left == 0, "response" if no == 1 else "continuation", url, None, digest, running.hexdigest(), total, bytes(piece)))
                    held += len(piece)
                    if held > BATCH_BYTES:  # the chunks of a large payload leave in several batches
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    return pages.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("total_bytes"), "digest", "refers_to").mapInArrow(run, schema)


def record_text(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column: each row as a WARC record, head and body, without the two line ends that close it."""
    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)))

    segmented = (F.col("chunk_no") > 1) | ~F.col("last")
    more = F.col("kind") == "continuation"
    head = [
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record", F.when(more, F.concat(F.lit("-"), "chunk_no")).otherwise(F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.when(F.col("url") != "", F.regexp_replace("url", r"[\r\n]+", " "))),
        line("WARC-Page-ID", F.col("page_id")),
        line("WARC-Segment-Number", F.when(segmented, F.col("chunk_no"))),
        line("WARC-Segment-Origin-ID", F.when(more, F.concat(F.lit("<urn:uuid:"), "record", F.lit(">")))),
        line("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), F.col("total_bytes"))),
        line("WARC-Profile", F.when(F.col("kind") == "revisit", F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        line("WARC-Payload-Digest", F.when(~more, F.concat(F.lit("sha256:"), "digest"))),
        line("WARC-Payload-Length", F.when(~more, F.col("total_bytes"))),
        line("WARC-Running-Digest", F.concat(F.lit("sha256:"), "running_digest")),
        line("Content-Length", F.octet_length(F.coalesce("chunk", F.lit("")))),
        F.lit(_END),
        F.coalesce("chunk", F.lit("")),
    ]
    return rows.select(F.concat(*[F.coalesce(h, F.lit("")) for h in head]).alias("value"))


def write_archives(pages: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, **how) -> None:
    """WARC files (*.txt.gz as Spark names them) of all pages under `folder`, one per task."""
    rows = chunk_rows(with_references(pages, **how), chunk_bytes=chunk_bytes)
    record_text(rows).write.option("lineSep", _END + _END).option("compression", "gzip").mode("overwrite").text(folder)


class Parser:
    """Reads records from the lines of a WARC file; holds a head, or the digest of the payload so far."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.left = 0
        self.open: dict | None = None
        self.done: list[tuple] = []

    def line(self, raw: bytes) -> None:
        """A line without its line feed."""
        if self.left:
            body = (raw + b"\n")[: self.left]
            self.left -= len(body)
            self.open["digest"].update(body)
            self.open["bytes"] += len(body)
            if not self.left:
                self._body_read()
            return
        text = raw.decode().removesuffix("\r")
        if self.head is None:
            if text.startswith("WARC/"):
                self.head = {}
            elif text:
                raise ValueError(f"no record starts with {text[:40]!r}")
        elif text:
            name, _, value = text.partition(": ")
            self.head[name] = value
        else:
            self._head_read()

    def _head_read(self) -> None:
        kind = self.head["WARC-Type"]
        if kind == "continuation":
            if self.open is None or int(self.head["WARC-Segment-Number"]) != self.open["segment"] + 1:
                raise ValueError("a continuation without the segment before it")
            self.open["segment"] += 1
        else:
            self.open = {"head": self.head, "digest": hashlib.sha256(), "bytes": 0, "segment": 1}
        self.open["last"] = "WARC-Segment-Number" not in self.head or "WARC-Segment-Total-Length" in self.head
        self.left = int(self.head["Content-Length"])
        self.running = self.head["WARC-Running-Digest"]
        self.head = None
        if not self.left:
            self._body_read()

    def _body_read(self) -> None:
        head = self.open["head"]
        kind, page, refers = head["WARC-Type"], head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
        if kind == "response" and f"sha256:{self.open['digest'].hexdigest()}" != self.running:
            raise ValueError(f"the payload of page {page} is damaged")
        if not self.open["last"]:
            return
        if kind == "response":
            size, digest = self.open["bytes"], self.open["digest"].hexdigest()
        else:  # a revisit stands for the payload that its head describes
            size, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
        self.done.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
        self.open = None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; damaged payloads raise."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("value"))
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for b in batches:
            for raw in b.column("value").to_pylist():
                parser.line(raw)
            if parser.done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parser.done), arrow)], schema=arrow)
                parser.done = []
        if parser.left or parser.open is not None:
            raise ValueError("an archive ends inside a record")

    return lines.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, f"warc/{uuid.uuid4().hex}")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


QUERIES = {"op4_chunked_warc": op4_chunked_warc}
ORACLES = {
    "op4_chunked_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
}
