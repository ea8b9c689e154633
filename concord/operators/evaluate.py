"""Scoring against labelled truth (V1-V5). `truth` and `predicted`: case_id, category, status, review_reason, defect_fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import specs

SPLIT_SALT = "split-v1:"  # fixed value: decides which ids are held out


def is_held_out(case_id: Column) -> Column:
    """V1: md5 of the salted id, modulo 5. 16 is 1 modulo 5, so the digest modulo 5 is the sum of its hex digits modulo 5."""
    digits = F.md5(F.concat(F.lit(SPLIT_SALT), case_id))
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda acc, d: acc + F.conv(d, 16, 10).cast("int")) % 5 == 0


def split_holdout(ids: DataFrame) -> DataFrame:
    """V1: add `split`: TEST for the held-out fifth, else TUNE."""
    return ids.withColumn("split", F.when(is_held_out(F.col("case_id")), F.lit("TEST")).otherwise(F.lit("TUNE")))


def _both(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    cols = ["category", "status", "review_reason", "defect_fields"]
    t = truth.select("case_id", *[F.col(c).alias(f"t_{c}") for c in cols])
    p = predicted.select("case_id", *[F.col(c).alias(f"p_{c}") for c in cols], F.lit(True).alias("_has"))
    df = t.join(p, "case_id", "left")
    return df.withColumn("p_category", F.when(F.col("_has"), F.col("p_category")).otherwise(F.lit("GENERAL"))).withColumn(
        "p_status", F.when(F.col("_has"), F.col("p_status")).otherwise(F.lit("OK"))
    ).drop("_has")


def confusion(truth: DataFrame, predicted: DataFrame, col: str, by_split: bool = False) -> DataFrame:
    """V2: per class tp, fp, fn; a case without a prediction counts as GENERAL / OK.

    Every case is counted once as a (truth, prediction) pair, then the few pairs are turned into classes.
    """
    df = _both(truth, predicted).select("case_id", F.col(f"t_{col}").alias("t"), F.col(f"p_{col}").alias("p"))
    keys = ["split"] if by_split else []
    if by_split:
        df = split_holdout(df).withColumn("split", F.explode(F.array(F.lit("ALL"), F.col("split"))))
    pairs = df.groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("t").eqNullSafe(F.col("p"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(~same, F.col("n")).otherwise(zero).alias("fn")),
        F.struct(F.col("p").alias("class"), zero.alias("tp"), F.when(~same, F.col("n")).otherwise(zero).alias("fp"), zero.alias("fn")),
    )
    rows = pairs.select(*keys, F.inline(sides)).where(F.col("class").isNotNull())
    return rows.groupBy(*keys, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def multilabel_confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """V3: per defect field tp, fp, fn by membership."""
    df = _both(truth, predicted)
    none = F.array().cast("array<string>")
    t, p = F.coalesce("t_defect_fields", none), F.coalesce("p_defect_fields", none)
    fields = F.array(*[F.lit(f) for f in specs.FIELDS])
    rows = df.select(F.explode(F.filter(fields, lambda f: F.array_contains(t, f) | F.array_contains(p, f))).alias("class"), t.alias("t"), p.alias("p"))
    in_t, in_p = F.expr("array_contains(t, class)"), F.expr("array_contains(p, class)")
    return rows.groupBy("class").agg(F.count_if(in_t & in_p).alias("tp"), F.count_if(~in_t & in_p).alias("fp"), F.count_if(in_t & ~in_p).alias("fn"))


def prf(conf: DataFrame) -> DataFrame:
    """V4: precision, recall, F1; 0 for an empty denominator."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    df = conf.withColumn("p", p).withColumn("r", r)
    return df.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def scores(truth: DataFrame, predicted: DataFrame, col: str = "category") -> DataFrame:
    """V4: macro-F1 and accuracy per split (ALL, TUNE, TEST)."""
    per = prf(confusion(truth, predicted, col, by_split=True))
    return per.groupBy("split").agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))), 6).alias("accuracy"), F.sum(F.col("tp") + F.col("fn")).alias("n")
    )


def wrong_cases(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """V5: cases that differ in category, status, reason or defect set, with their split."""
    df = _both(truth, predicted)
    none = F.array().cast("array<string>")
    same = F.lit(True)
    for c in ("category", "status", "review_reason"):
        same = same & F.col(f"t_{c}").eqNullSafe(F.col(f"p_{c}"))
    same = same & (F.array_sort(F.array_distinct(F.coalesce("t_defect_fields", none))) == F.array_sort(F.array_distinct(F.coalesce("p_defect_fields", none))))
    return split_holdout(df.where(~same))
