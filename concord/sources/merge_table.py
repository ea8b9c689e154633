"""Keyed tables that grow by batches: a base with one row a key, and deltas that are merged on read.

    <table>/delta/batch=000000000007   what a batch wrote; a repeated batch overwrites its own folder
    <table>/base/bucket=12             the newest row of every key up to the last compaction, by hash of the key
    <table>/marks                      one row a compaction: every batch up to `upto` is in the base

A compaction rewrites only the buckets that the open deltas touch (dynamic partition overwrite) and then sets its mark.
Reading merges the base with the deltas beyond the last mark. Merging is the newest row of a key, which does not mind
seeing a row twice: a compaction that broke off between two buckets, or before its mark, leaves a table that reads the
same, and is simply run again. Deltas are removed by the compaction after the one that took them in, so a reader that
began before a compaction still finds its files.

One writer compacts at a time. Reads touch the base (one row a key) and the deltas since the last compaction, however
many versions were ever written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass(frozen=True)
class MergeTable:
    """A table at `path`; of the rows of a key that with the largest `newest` columns counts."""

    path: str
    schema: StructType
    key: str = "case_id"
    newest: tuple[str, ...] = ("processed_at", "run_id")
    buckets: int = 64

    @property
    def _base(self) -> str:
        return f"{self.path}/base"

    @property
    def _marks(self) -> str:
        return f"{self.path}/marks"

    def _delta(self, batch_id: int) -> str:
        return f"{self.path}/delta/batch={batch_id:012d}"

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write the rows of a batch."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._delta(batch_id))

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the deltas that are there; a folder without its success mark is a write that broke off."""
        fs, path = _file_system(spark, f"{self.path}/delta")
        if not fs.exists(path):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(_path(spark, f"{s.getPath()}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def marked(self, spark: SparkSession) -> list[int]:
        """The batch numbers up to which compactions went, in order; -1 before the first."""
        fs, path = _file_system(spark, self._marks)
        rows = spark.read.schema("upto long").parquet(self._marks).distinct().collect() if fs.exists(path) else []
        return sorted([-1, *(r["upto"] for r in rows)])

    def open_deltas(self, spark: SparkSession, batches: Sequence[int]) -> DataFrame:
        paths = [self._delta(b) for b in batches]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def base(self, spark: SparkSession) -> DataFrame:
        """The compacted rows with their bucket, a partition column."""
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        fs, path = _file_system(spark, self._base)
        return spark.read.schema(schema).parquet(self._base) if fs.exists(path) else spark.createDataFrame([], schema)

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row a key: an aggregate with map-side combine, so a key written very often is reduced before the shuffle."""
        rest = [c for c in self.schema.names if c != self.key]
        best = F.max_by(F.struct(*rest), F.struct(*self.newest)).alias("v")
        return rows.groupBy(self.key).agg(best).select(self.key, *[F.col("v").getField(c).alias(c) for c in rest]).select(*self.schema.names)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key."""
        last = self.marked(spark)[-1]
        fresh = self.open_deltas(spark, [b for b in self.batches(spark) if b > last])
        return self.merged(self.base(spark).drop("bucket").unionByName(fresh))

    def read_keys(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """The newest rows of the given keys only. The base is joined on its bucket too, so that Spark prunes its
        partitions at run time to those of the keys."""
        wanted = keys.select(self.key).distinct().withColumn("bucket", self.bucket_of(F.col(self.key)))
        last = self.marked(spark)[-1]
        fresh = self.open_deltas(spark, [b for b in self.batches(spark) if b > last]).join(wanted.select(self.key), self.key, "left_semi")
        old = self.base(spark).join(wanted, ["bucket", self.key], "left_semi").drop("bucket")
        return self.merged(old.unionByName(fresh))

    def compact(self, spark: SparkSession) -> int | None:
        """Take the open deltas into the base; the number of the last batch taken in, or None if there was nothing to do."""
        marks = self.marked(spark)
        there = self.batches(spark)
        taken = [b for b in there if b > marks[-1]]
        if taken:
            fresh = self.open_deltas(spark, taken).withColumn("bucket", self.bucket_of(F.col(self.key)))
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
            old = self.base(spark).where(F.col("bucket").isin(touched))
            rows = self.merged(old.drop("bucket").unionByName(fresh.drop("bucket"))).withColumn("bucket", self.bucket_of(F.col(self.key)))
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._base)
            spark.createDataFrame([(taken[-1],)], "upto long").coalesce(1).write.mode("append").parquet(self._marks)
        fs, _ = _file_system(spark, self.path)
        for old_batch in (b for b in there if b <= marks[-1]):  # taken in by an earlier compaction
            fs.delete(_path(spark, self._delta(old_batch)), True)
        return taken[-1] if taken else None


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    """(file system, path) on whatever store the table lies."""
    where = _path(spark, path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
