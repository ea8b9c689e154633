"""An attachment table, filled by a file stream and read by pruned partitions.

Files land in a folder at any time. A stream notices new ones by name alone; each micro-batch then reads just those
files and writes them into a table partitioned by a hash of the attachment's name. Reading the attachments of a few
messages joins on that bucket too, so Spark prunes the partitions at run time, and the folder is never listed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.sources.inbox import attachment_list

BUCKETS = 64
#: Larger files are listed without their bytes and give unreadable documents.
MAX_BYTES = 64 << 20
TABLE = "name string, length long, modified timestamp, content binary, bucket int"


def bucket_of(name: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def start_attachments(
    spark: SparkSession, folder: str, table: str, checkpoint: str, *, max_bytes: int = MAX_BYTES, max_files: int = 10_000, buckets: int = BUCKETS
) -> StreamingQuery:
    """Take every new file below `folder` into the table once; `max_files` bounds a micro-batch.

    A batch writes under its own number, so a repeated batch overwrites what it wrote. A file is known by its path: one
    that is overwritten in place later is not read again, a new version comes under a new name.
    """
    marker = folder.rstrip("/") + "/"
    noticed = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder).select("path", "modificationTime", "length")
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        paths = [r["path"] for r in batch.select("path").collect()]  # at most max_files names
        if not paths:
            return
        # the filter on the length reaches the reader, which then never opens a larger file
        files = session.read.format("binaryFile").load([_escaped(p) for p in paths])
        small = files.where(F.col("length") <= max_bytes).select("path", "modificationTime", "length", "content")
        large = files.where(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
        name = F.substring_index("path", marker, -1)
        rows = small.unionByName(large).select(name.alias("name"), "length", F.col("modificationTime").alias("modified"), "content", bucket_of(name, buckets).alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={batch_id:012d}")

    return noticed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _escaped(path: str) -> str:
    """A path as a pattern that means only itself."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def stored_attachments(spark: SparkSession, table: str) -> DataFrame:
    """(name, length, modified, content, batch, bucket); batch and bucket are partition columns."""
    return spark.read.schema(f"{TABLE.replace(', bucket int', '')}, batch string, bucket int").option("basePath", table).parquet(f"{table}/batch=*")


def read_stored_attachments(spark: SparkSession, messages: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """The bytes of each listed attachment: case_id, attachment_no, name, doc_id, content, error.

    A missing or oversized file gives an unreadable document. A file taken twice (a new checkpoint) counts once, as last read.
    """
    listed = attachment_list(messages).withColumn("bucket", bucket_of(F.col("name"), buckets))
    wanted = listed.select("bucket", "name").distinct()
    # bytes are moved for wanted files only; the newest version is chosen among them
    found = stored_attachments(spark, table).join(wanted, ["bucket", "name"], "left_semi")
    newest = found.groupBy("bucket", "name").agg(F.max_by(F.struct("length", "content"), F.struct("modified", "batch")).alias("f"))
    docs = listed.join(newest, ["bucket", "name"], "left")
    error = F.when(F.col("f").isNull(), F.lit("the attachment is not in the store")).when(F.col("f.content").isNull(), F.lit("the attachment is too large to read"))
    return docs.select("case_id", "attachment_no", "name", "doc_id", F.col("f.content").alias("content"), error.alias("error"))
