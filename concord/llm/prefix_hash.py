"""Document fingerprints from prefix polynomial hashes (operator 2).

The prefix array of a text holds the sums of (code + 1) * base^i modulo a prime; the hash of any span is the difference of
two entries times an inverse power, so the equality of any two spans costs two subtractions, and the longest common
extension of two places is a binary search over its length. A fingerprint is the length, the hash of the whole text under
two primes, and the smallest hashes of all its spans of `WIDTH` code points; the likeness of two fingerprints is the share
of such spans that they have in common, estimated from those.

The text that follows a document is found without sorting the table in one place: ids are cut into ranges by quantiles,
each range is sorted where it lies, and the first document of a range also goes to the range before it. Texts are shuffled
once; a task holds two texts at a time.

Defined results: a null text is empty; an empty text has no spans, and two empty texts are alike in full; a text shorter
than a span is one span; null ids come first; rows with the same id follow each other by text; one row alone is followed by
itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import id_and_text, sha256, table

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525017)
WIDTH = 24
SKETCH = 32
#: Documents in one id range on average.
RANGE_ROWS = 5_000

_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; grown by doubling and kept in the worker."""
    p, base = PRIMES[which], BASES[which]
    tables = _TABLES.get(which, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    while len(tables[0]) < n:
        size = len(tables[0])
        steps = (pow(base, size, p), pow(base, -size, p))
        tables = tuple(np.concatenate((t, t * np.uint64(s) % np.uint64(p))) for t, s in zip(tables, steps))
    _TABLES[which] = tables
    return tables


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix array of a text under one prime."""

    def __init__(self, codes: np.ndarray, which: int = 0) -> None:
        self.p, self.n = np.uint64(PRIMES[which]), len(codes)
        power, self.inverse = _powers(which, self.n + 1)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * power[: self.n] % self.p, out=sums[1:])
        self.sums = sums % self.p

    def span(self, start, length):
        """Hash of the code points start .. start+length-1, for numbers or arrays of them."""
        start = np.asarray(start)
        return (self.sums[start + length] + self.p - self.sums[start]) % self.p * self.inverse[start] % self.p

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of `width` code points; of the whole text if it is shorter."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, np.uint64)
        count = self.n - width + 1
        return (self.sums[width:] + self.p - self.sums[:count]) % self.p * self.inverse[:count] % self.p


def common_extension(a: list[PrefixHash], i: int, b: list[PrefixHash], j: int) -> int:
    """Longest length at which the spans from i of the one text and from j of the other are equal, under every prime."""
    low, high = 0, min(a[0].n - i, b[0].n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if all(x.span(i, mid) == y.span(j, mid) for x, y in zip(a, b)):
            low = mid
        else:
            high = mid - 1
    return low


def _smallest(hashes: np.ndarray, k: int = SKETCH) -> list[int]:
    """The k smallest distinct values after a mix of the bits."""
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    limit = (1 << 32) * 4 * k // max(1, len(mixed))
    while limit < 1 << 32:
        found = np.unique(mixed[mixed < np.uint64(limit)])
        if len(found) >= k:
            return found[:k].tolist()
        limit *= 8
    return np.unique(mixed)[:k].tolist()


class Print:
    """A fingerprint with what it was made of."""

    def __init__(self, text: str) -> None:
        self.text = text
        codes = code_points(text)
        self.hashes = [PrefixHash(codes, k) for k in range(len(PRIMES))]
        self.n = len(codes)
        self.sketch = _smallest(self.hashes[0].windows(WIDTH))
        whole = "".join(f"{int(h.span(0, self.n)):08x}" for h in self.hashes)
        self.value = f"{self.n:x}.{whole}.{''.join(f'{v:08x}' for v in self.sketch)}"


def sketch_likeness(a: list[int], b: list[int], k: int = SKETCH) -> float:
    """Share of common spans, 2c / (a + b), from the smallest hashes of both."""
    if not a and not b:
        return 1.0
    both = sorted({*a, *b})[:k]
    c = len(set(a) & set(b) & set(both)) / len(both)
    return 2 * c / (1 + c)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; equal fingerprints give 1."""
    parts = [[int(x[i : i + 8], 16) for i in range(0, len(x), 8)] for x in (a.rpartition(".")[2], b.rpartition(".")[2])]
    return 1.0 if a == b else sketch_likeness(*parts)


def followed(docs: DataFrame, fn, schema: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """fn((doc_id, text), (doc_id, text) of the next) for every row of docs (doc_id, text), the last followed by the first.

    fn gets what `Print` makes of a text once per text and gives one output row.
    """
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n, first = docs.agg(F.count(F.lit(1)), F.min("key")).first()
    ranges = max(1, -(-n // range_rows))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("key", shares, max(10_000, 10 * ranges))).first()[0] if shares and n else []
    bounds = np.unique(np.array(bounds, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            bucket = np.searchsorted(bounds, key, "right")
            for rows, to, edge in (
                (np.arange(len(key)), bucket, 0),
                (np.flatnonzero(np.isin(key, bounds)), bucket - 1, 1),
                (np.flatnonzero(key == first), np.full(len(key), len(bounds)), 1),
            ):
                if len(rows):
                    part = b.take(pa.array(rows)) if edge else b
                    yield pa.RecordBatch.from_arrays([pa.array(to[rows].astype(np.int64)), pa.array(np.full(len(rows), edge, np.int32)), *part.columns], names=["bucket", "edge", *b.schema.names])

    dealt = docs.mapInArrow(deal, "bucket long, edge int, doc_id long, text string, key long")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "edge", "key", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_bucket = None, None
        arrow = None
        for b in batches:
            out = []
            for bucket, edge, doc, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "edge", "doc_id", "text"))):
                if bucket != open_bucket:
                    last, open_bucket = None, bucket
                if edge and last is None:
                    continue
                own = Print(text)
                if last is not None:
                    out.append(fn(last, (doc, own)))
                last = None if edge else (doc, own)
            if out:
                arrow = arrow or _arrow(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return dealt.mapInArrow(pairs, schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(","))])


def _row(this: tuple, following: tuple) -> tuple:
    doc, a = this
    _, b = following
    half = a.n // 2
    edited = Print(a.text[: a.n - half] + b.text[:half])
    return (
        doc, a.n, sha256(edited.text.encode("utf-8", "surrogatepass")), a.value, edited.value,
        1.0 if a.value == edited.value else sketch_likeness(a.sketch, edited.sketch),
        1.0 if a.value == b.value else sketch_likeness(a.sketch, b.sketch),
        common_extension(a.hashes, 0, edited.hashes, 0), common_extension(a.hashes, 0, b.hashes, 0),
    )


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document against its edited text (second half taken from the start of the next) and the next document.

    edited_extension and next_extension are the code points that the texts share from their starts.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_extension long, next_extension long"
    return followed(id_and_text(docs, id_col, text_col), _row, schema, range_rows=range_rows)


def op2_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op2_prefix_hash": op2_prefix_hash}
ORACLES: dict[str, str] = {}
