"""Dimension lookups as left joins that neither force a broadcast nor pile nulls onto one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def look_up_in(df: DataFrame, key: Column, dim: DataFrame, dim_key: str, value: str, out: str, spread: str) -> DataFrame:
    """Add `out` = dim[value] where dim[dim_key] = key; `dim` holds each key once.

    No broadcast hint: Spark broadcasts when the measured size allows and otherwise splits skewed keys at run time.
    Rows without a key get a key of their own that cannot match, spread by the `spread` column, so that a shuffled
    join has no partition of nulls.
    """
    small = dim.select(F.col(dim_key).alias("_dim_key"), F.col(value).alias(out))
    probe = F.coalesce(key, F.concat(F.lit("\x00"), F.col(spread).cast("string")))
    return df.withColumn("_probe", probe).join(small, F.col("_probe") == F.col("_dim_key"), "left").drop("_probe", "_dim_key")
