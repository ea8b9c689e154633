"""Streaming ingest of messages and late documents.

A micro-batch runs the batch functions over the cases it touches and appends the result to the board, a keyed table of
versions (`sources/merge_table.py`); a repeated batch overwrites what it wrote, so a restart never counts anything twice.
`compact_board` keeps the reading of the board bounded by its cases and the batches since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from concord.operators.reconcile import apply_verdicts
from concord.plans.checks import Settings, check_cases
from concord.sources.merge_table import MergeTable

VERSION_COLUMNS = ["case_id", "category", "category_confidence", "status", "review_reason", "defect_fields", "confidence", "needs_human", "carrier", "customer", "bl_no"]
_VERSION = (
    "case_id string, category string, category_confidence double, status string, review_reason string, defect_fields array<string>, confidence double, "
    "needs_human boolean, carrier string, customer string, bl_no string, ai_status string, ai_defects array<string>, resolved boolean, run_id long, processed_at timestamp"
)


def board_table(board: str) -> MergeTable:
    """The versions of all cases at a path."""
    return MergeTable(board, StructType.fromDDL(_VERSION))


def check_batch(messages: DataFrame, docs: DataFrame, board: str, batch_id: int, *, knowledge: DataFrame | None = None, overrides: DataFrame | Callable[[], DataFrame] | None = None,
                settings: Settings = Settings(), folder: str | None = None) -> None:
    """Check one batch of messages with all their documents and append it as versions of their cases."""
    wanted = docs.join(messages.select("case_id"), "case_id", "left_semi")
    cases = check_cases(messages, wanted, knowledge=knowledge, settings=settings, folder=folder).cases.select(*VERSION_COLUMNS)
    if overrides is not None:  # a function is asked anew for every batch, so decisions made meanwhile count
        cases = apply_verdicts(cases, overrides() if callable(overrides) else overrides)
    else:
        cases = cases.withColumns({"ai_status": F.lit(None).cast("string"), "ai_defects": F.lit(None).cast("array<string>"), "resolved": F.lit(False)})
    stamped = cases.withColumns({"run_id": F.lit(batch_id).cast("long"), "processed_at": F.current_timestamp()})
    board_table(board).append(stamped, batch_id)


def current_board(spark: SparkSession, board: str) -> DataFrame:
    return board_table(board).read(spark)


def compact_board(spark: SparkSession, board: str) -> int | None:
    """Take the versions written since the last compaction into the base of the board; safe to repeat."""
    return board_table(board).compact(spark)


def start_ingest(messages: DataFrame, load_docs, board: str, checkpoint: str, **options) -> StreamingQuery:
    """New messages flow through the check as they arrive. `load_docs(batch)` returns the documents of a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # of several versions of a message in one batch the one that arrived last counts; of equal times always the same
        # one, also when the batch is run again
        rest = [c for c in batch.columns if c != "case_id"]
        order = [c for c in ("arrived_at",) if c in rest] + [c for c in rest if c != "arrived_at"]
        batch = batch.groupBy("case_id").agg(F.max(F.struct(*order)).alias("m")).select("case_id", *[F.col(f"m.{c}").alias(c) for c in rest])
        check_batch(batch, load_docs(batch), board, batch_id, **options)

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_late_documents(arrivals: DataFrame, all_messages: DataFrame | MergeTable, load_docs, board: str, checkpoint: str, **options) -> StreamingQuery:
    """A document that arrives later re-decides its case; reviewers' overrides keep a case settled while its answer
    stays the same and re-open it when the answer changes.

    Messages kept as a keyed table are read by the buckets of the touched cases; a plain DataFrame is scanned whole by
    every batch. `streaming/cases.py` keeps open cases as state and reads no messages at all.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if isinstance(all_messages, MergeTable):
            touched = all_messages.read_keys(batch.sparkSession, batch.select("case_id"))
        else:
            touched = all_messages.join(batch.select("case_id").distinct(), "case_id", "left_semi")
        # batches of late documents are numbered after those of the ingest
        check_batch(touched, load_docs(touched), board, 10**9 + batch_id, **options)

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
