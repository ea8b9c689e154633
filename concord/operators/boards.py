"""Message and case snapshots: timeline, upsert, current versions, export, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import specs
from concord.functions.regex import first_of

TIMELINE_END = "2026-09-18 17:30:00"  # fixed value: the newest slot of the rendered timeline


def received_at(case_id: Column, total: Column) -> Column:
    """A stable received time from a numeric id: 45 a day, 11-minute slots, newest = highest id."""
    n = F.coalesce(F.regexp_replace(case_id, r"\D", "").try_cast("long"), F.lit(0).cast("long"))
    back = total.cast("long") - n
    day = F.floor(back / 45).cast("long")
    minutes = F.pmod(back, F.lit(45).cast("long")) * 11 + F.pmod(n * 7, F.lit(9).cast("long"))
    seconds = day * 86400 + minutes * 60
    base = F.lit(TIMELINE_END).cast("timestamp")
    return F.timestamp_seconds(F.unix_timestamp(base) - seconds)


def make_timeline(messages: DataFrame, total: int | None = None) -> DataFrame:
    """S6. Without a total it is counted in the same job as a scalar subquery."""
    if total is not None:
        return messages.withColumn("received_at", received_at(F.col("case_id"), F.lit(total)))
    count = messages.agg(F.count(F.lit(1)).alias("_n")).scalar()
    return messages.withColumn("received_at", received_at(F.col("case_id"), count))


MESSAGE_COLUMNS = ["sender", "subject", "body", "attachments"]


def upsert_messages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot: incoming message columns win, everything else of a known message is kept; new ids are marked."""
    new = incoming.select("case_id", *[F.col(c).alias(f"_{c}") for c in MESSAGE_COLUMNS if c in incoming.columns], F.lit(True).alias("_in"))
    old = existing.withColumn("_old", F.lit(True))
    df = old.join(new, "case_id", "full")
    for c in MESSAGE_COLUMNS:
        if f"_{c}" in new.columns:
            df = df.withColumn(c, F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)))
    return df.withColumn("is_new", F.col("_old").isNull()).drop("_in", "_old", *[f"_{c}" for c in MESSAGE_COLUMNS])


def pending_cases(upserted: DataFrame) -> DataFrame:
    """The empty case every new message starts with."""
    return upserted.where("is_new").select("case_id", F.lit("PENDING").alias("status"))


def latest_case(versions: DataFrame) -> DataFrame:
    """The current row of every case out of append-only run output. An aggregate, so a case that was run very often
    is reduced on the map side."""
    columns = [c for c in versions.columns if c != "case_id"]
    newest = F.max_by(F.struct(*columns), F.struct("processed_at", "run_id")).alias("v")
    return versions.groupBy("case_id").agg(newest).select("case_id", "v.*")


def to_submission(cases: DataFrame) -> DataFrame:
    """One export row per case; sort only when writing a report."""
    check = F.col("category").eqNullSafe(F.lit(specs.CHECK))
    status = F.when(F.col("status").isin("OK", "MISMATCH", "NEEDS_REVIEW"), F.col("status")).otherwise(F.lit("NEEDS_REVIEW"))
    final = F.when(check, status).otherwise(F.lit("OK"))
    defect = check & (final == "MISMATCH")
    return cases.select(
        "case_id",
        F.when(check, F.lit(specs.CHECK)).otherwise(F.coalesce("category", F.lit("GENERAL"))).alias("category"),
        final.alias("status"),
        F.when(check & (final == "NEEDS_REVIEW"), F.coalesce(F.nullif("review_reason", F.lit("")), F.lit("unreadable"))).alias("review_reason"),
        defect.alias("has_defect"),
        F.when(defect, F.col("defect_fields")).otherwise(F.array().cast("array<string>")).alias("defect_fields"),
    )


def write_submission(cases: DataFrame, path: str) -> None:
    """Sorted JSON lines; a range partitioning keeps the global order over many files."""
    to_submission(cases).sort("case_id").write.mode("overwrite").json(path)


def run_summary(versions: DataFrame) -> DataFrame:
    """Totals of every run."""
    finished = F.col("status") != "PENDING"
    return versions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(finished).alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )


def run_breakdown(versions: DataFrame) -> DataFrame:
    """(run_id, kind, name, n) by category and by status, in one aggregate."""
    pairs = F.array(F.struct(F.lit("category").alias("kind"), F.coalesce("category", F.lit("none")).alias("name")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")))
    return versions.select("run_id", F.inline(pairs)).groupBy("run_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


def select_for_run(messages: DataFrame, ids: DataFrame | None = None, failed_of: DataFrame | None = None) -> DataFrame:
    """The messages a run covers: all, those listed, or those whose case failed. An empty list selects nothing."""
    if ids is not None:
        return messages.join(ids.select("case_id"), "case_id", "left_semi")
    if failed_of is not None:
        return messages.join(failed_of.where(F.col("status") == "FAILED").select("case_id"), "case_id", "left_semi")
    return messages
