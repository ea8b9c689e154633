"""Helpers shared by the operators: tables in, whole texts through Arrow in slices of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.session import ensure_checkpoints

#: Bytes of text that a Python function sees at once; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: One pass over UTF-8: A-Z to a-z, the characters that end a word (ASCII other than letters and digits) to a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text after A-Z are lower-cased."""
    return raw.translate(WORD_TABLE).split()


def tokens(raw: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text after A-Z are lower-cased."""
    return raw.lower().split()


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def staged(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; later reads survive the loss of the executor that computed it."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold at most `limit` bytes, or a single row."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.binary())
        sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int32, len(sizes) + 1, sizes.offset * 4)) if len(sizes) else np.zeros(0, int)
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


def map_text(
    df: DataFrame, fn: Callable[[list[bytes]], dict[str, Sequence]], fields: str, *, text_col: str = "text", keep_text: bool = False, limit: int = SLICE_BYTES
) -> DataFrame:
    """Append the columns `fields` (a DDL string) that fn computes from the UTF-8 texts of a slice.

    Works partition by partition without a shuffle; every other column passes through untouched.
    """
    added = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    order = [f.name for f in kept]
    clash = {f.name for f in added} & set(order)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the input already")
    arrow = arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, limit):
            texts = [x if x is not None else b"" for x in part.column(text_col).cast(pa.binary()).to_pylist()]
            got = fn(texts)
            arrays = [part.column(n) for n in order] + [pa.array(got[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=order + [f.name for f in arrow])

    return df.mapInArrow(run, T.StructType(kept + added.fields))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def spans_text(spans: Sequence[tuple[int, str, int]]) -> str:
    """kind:start:end of (start, kind, end) in the given order, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def boxed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text): the whole row out of the way of clashing names, and the text that an operator reads of it."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unboxed(df: DataFrame, names: Sequence[str], **changed) -> DataFrame:
    """The columns of the boxed rows, in order; `changed` gives new values for some of them."""
    return df.select(*[changed[n].alias(n) if n in changed else F.col("row").getField(n).alias(n) for n in names])
