"""Message and attachment sources, format sniffing, text decoding, word boxes to rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concord.functions.regex import first_of
from concord.operators.extract import box_around, location

# the file layout of an inbox (fixed): one JSON object per message
MESSAGE_JSON = "email_id string, `from` string, subject string, body string, attachments array<string>"
MESSAGE_GLOB = "inbox/email_*.json"


def _named(raw: DataFrame) -> DataFrame:
    more = [c for c in ("arrived_at",) if c in raw.columns]
    return raw.select(F.col("email_id").alias("case_id"), F.col("from").alias("sender"), "subject", "body", F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments"), *more)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Every message of an inbox folder."""
    return _named(spark.read.schema(MESSAGE_JSON).option("multiLine", True).json(f"{path}/{MESSAGE_GLOB}"))


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """S1 as a stream: files that arrive later come through once, with the time of their file as `arrived_at`."""
    reader = spark.readStream.schema(MESSAGE_JSON).option("multiLine", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.json(f"{path}/{MESSAGE_GLOB}")
    return _named(raw.withColumn("arrived_at", F.col("_metadata.file_modification_time")))


def attachment_list(messages: DataFrame) -> DataFrame:
    """One row per listed attachment."""
    rows = messages.select("case_id", F.posexplode("attachments").alias("attachment_no", "name"))
    return rows.withColumn("doc_id", F.concat_ws("#", "case_id", "attachment_no"))


def read_attachments(spark: SparkSession, messages: DataFrame, path: str) -> DataFrame:
    """S2 for a folder small enough to list: the bytes of each attachment; a file that is not there gives an unreadable
    document. Tables of attachments (`sources/attachments.py`) are for the rest: they also take oversized files."""
    listed = attachment_list(messages)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    marker = path.rstrip("/") + "/"
    files = files.select(F.substring_index(F.col("path"), marker, -1).alias("name"), "content")
    docs = listed.join(files, "name", "left")
    return docs.withColumn("error", F.when(F.col("content").isNull(), F.lit("the attachment is not in the folder")))


def sniff_format(content: Column, name: Column) -> Column:
    """The format from the first bytes, then from the extension."""
    head = F.hex(F.substring(content, 1, 4))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = first_of(
        [(ext.isin("text", "csv", ""), F.lit("txt")), (ext.isin("jpg", "jpeg", "png"), F.lit("image"))], ext
    )
    return first_of(
        [
            (F.startswith(head, F.lit("25504446")), F.lit("pdf")),
            (F.startswith(head, F.lit("504B")) & ext.isin("xlsx", "docx"), ext),
            (F.startswith(head, F.lit("504B")), F.lit("unknown")),
            (F.startswith(head, F.lit("89504E47")) | F.startswith(head, F.lit("FFD8")), F.lit("image")),
        ],
        by_ext,
    )


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for encoding in ("utf-16", "cp1252"):
            try:
                return bytes(data).decode(encoding)
            except UnicodeError:
                continue
        return bytes(data).decode("utf-8", errors="replace")

    return content.map(one)


def decode_text(content: Column) -> Column:
    """S3: UTF-8 natively; only the rest goes through the Arrow helper (UTF-16, then Windows-1252)."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    plain = F.regexp_replace(content.cast("string"), "^﻿", "")
    return F.coalesce(F.when(utf8, plain), _decode_other(F.when(~utf8, content)))


def text_documents(attachments: DataFrame) -> DataFrame:
    """Documents with format, text and readability. Formats without a text reader here stay unreadable
    unless rows or word boxes are supplied for them."""
    df = attachments.withColumn("fmt", sniff_format(F.col("content"), F.col("name")))
    is_text = ~F.col("fmt").isin("pdf", "xlsx", "docx", "image")
    return df.withColumn("text", F.when(is_text, decode_text(F.col("content")))).drop("content")


# ---------------------------------------------------------------- S5


def layout_rows(words: DataFrame, seg_gap: float = 10.0) -> DataFrame:
    """Form rows from word boxes (doc_id, page, word_no, x0, y0, x1, y1, text).

    A word opens a new line when its centre lies further below the line's *first* word than its tolerance, so the
    lines of a run depend on each other. But a word further below its predecessor than that always opens one: the
    page is cut at those sure breaks with window functions, and only the words between two breaks are folded.
    Each row has the box of its words as `loc`, that of its value as `value_loc` where it has two parts or more, and its words.
    """
    page, run = ["doc_id", "page"], ["doc_id", "page", "run"]
    yc, tol = (F.col("y0") + F.col("y1")) / 2, F.greatest(F.lit(3.0), (F.col("y1") - F.col("y0")) * 0.45)
    df = words.withColumns({"yc": yc, "tol": tol})
    down = W.partitionBy(*page).orderBy("yc", "x0", "word_no")
    breaks = F.coalesce(F.col("yc") - F.lag("yc").over(down) > F.col("tol"), F.lit(True))
    df = df.withColumn("_b", breaks.cast("int")).withColumn("run", F.sum("_b").over(down)).withColumn("margin", F.min("x0").over(W.partitionBy(*page)))
    word = F.struct("yc", "x0", "word_no", "tol", "y0", "x1", "y1", "text")
    runs = df.groupBy(*run).agg(F.array_sort(F.collect_list(word)).alias("ws"), F.first("margin").alias("margin"))
    start = F.struct(F.lit(-1e300).alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        fresh = w["yc"] - acc["anchor"] > w["tol"]
        line = F.when(fresh, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(F.when(fresh, w["yc"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(line)).alias("out"))

    numbers = F.aggregate("ws", start, step, lambda acc: acc["out"])
    placed = runs.select(*run, "margin", F.explode(F.arrays_zip(F.col("ws"), numbers.alias("line"))).alias("z")).select(*run, "margin", "z.ws.*", "z.line")
    line = [*run, "line"]
    across = W.partitionBy(*line).orderBy("x0", "word_no")
    gap = F.coalesce((F.col("x0") - F.lag("x1").over(across) > seg_gap).cast("int"), F.lit(0))
    placed = placed.withColumn("_g", gap).withColumn("seg", F.sum("_g").over(across))
    letters = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    placed = placed.withColumn("at", F.coalesce(F.sum(letters).over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    piece = F.struct("x0", "word_no", "seg", "text", "at", "y0", "x1", "y1")
    rows = placed.groupBy(*line).agg(
        F.array_sort(F.collect_list(piece)).alias("ws"), F.min("x0").alias("x0"),
        F.first("margin").alias("margin"), F.max("seg").alias("last"),
    )
    cells = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda s: F.array_join(F.transform(F.filter("ws", lambda w: w["seg"] == s), lambda w: w["text"]), " "))
    rows = rows.withColumn("cells", cells)
    in_page = F.row_number().over(W.partitionBy(*page).orderBy("run", "line"))
    rows = rows.withColumn("_n", in_page)
    sizes = rows.groupBy(*page).agg(F.count(F.lit(1)).alias("_rows"))
    offset = F.coalesce(F.sum("_rows").over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_offset", offset).drop("_rows")
    out = rows.join(offsets, page).withColumn("row_index", (F.col("_offset") + F.col("_n") - 1).cast("int"))
    two = F.size("cells") >= 2
    return out.select(
        "doc_id",
        "row_index",
        F.col("row_index").alias("text_no"),
        F.array_join("cells", "   ").alias("text"),
        F.when(two, F.element_at("cells", 1)).alias("label"),
        F.when(two, F.array_join(F.slice("cells", 2, F.size("cells")), " ")).alias("value"),
        (F.col("x0") > F.col("margin") + 40).alias("indent"),
        location("bbox", page=F.col("page"), bbox=box_around(F.col("ws"))).alias("loc"),
        F.when(two, location("bbox", page=F.col("page"), bbox=box_around(F.filter("ws", lambda w: w["seg"] > 0)))).alias("value_loc"),
        F.transform("ws", lambda w: F.struct(*[w[n].alias(n) for n in ("at", "text", "x0", "y0", "x1", "y1")])).alias("words"),
    )
