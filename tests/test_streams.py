"""Late documents and live counts as streams."""

import datetime as dt

from pyspark.sql import functions as F

from concord.sources.merge_table import MergeTable
from concord.streaming.activity import live_counts
from concord.streaming.ingest import check_batch, compact_board, current_board, start_late_documents
from tests.test_checks import BL, BODY, SI

OVERRIDE = "case_id string, verdict_status string, verdict_defects array<string>, verdict_reason string, confirmed_status string, confirmed_reason string, review_requested_by string, was_resolved boolean"


def test_a_late_document_decides_the_case_again(spark, tmp_path):
    mail = spark.createDataFrame([("c", "a@b.com", "s", BODY), ("other", "a@b.com", "s", BODY)], "case_id string, sender string, subject string, body string")
    stored = MergeTable(str(tmp_path / "mail"), mail.schema, newest=("subject",))
    stored.append(mail, 0)
    stored.compact(spark)
    schema = "case_id string, doc_id string, attachment_no int, name string, text string"
    files = [("c", "c/0", 0, "e_SI.txt", SI)]
    board, arrivals = str(tmp_path / "board"), str(tmp_path / "arrivals")
    confirmed = {"status": "NEEDS_REVIEW"}
    overrides = lambda: spark.createDataFrame([("c", None, None, None, confirmed["status"], "missing_attachment", None, True)], OVERRIDE)
    load = lambda batch: spark.createDataFrame(files, schema)
    check_batch(mail, load(mail), board, 0, overrides=overrides)
    row = {r["case_id"]: r for r in current_board(spark, board).collect()}["c"]
    assert row["status"] == "NEEDS_REVIEW" and row["resolved"] and not row["needs_human"]  # a person agreed with this answer

    def arrive(k):
        spark.createDataFrame([("c", k)], "case_id string, k int").write.mode("append").parquet(arrivals)
        start_late_documents(spark.readStream.schema("case_id string, k int").parquet(arrivals), stored, load, board, str(tmp_path / "cp"), overrides=overrides).awaitTermination()
        return {r["case_id"]: r for r in current_board(spark, board).collect()}["c"]

    row = arrive(1)  # the same answer: the confirmation survives
    assert row["status"] == "NEEDS_REVIEW" and row["resolved"]
    files.append(("c", "c/1", 1, "e_BL.txt", BL.replace("THREE (3)", "4 x 40'HC")))
    row = arrive(2)  # another answer: the case is as the check found it
    assert row["status"] == "MISMATCH" and row["defect_fields"] == ["container_count"]
    assert current_board(spark, board).count() == 2
    before = sorted(map(str, current_board(spark, board).collect()))
    assert compact_board(spark, board) == 10**9 + 1 and sorted(map(str, current_board(spark, board).collect())) == before


def test_live_counts_drop_repeats_and_take_late_events(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute)
    schema, path = "id long, at timestamp, action string", str(tmp_path / "in")
    batches = [[(1, at(1), "open"), (1, at(1), "open"), (2, at(12), "open")], [(3, at(3), "open"), (1, at(1), "open")], [(4, at(200), "open")], [(5, at(300), "open")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = live_counts(spark.readStream.schema(schema).parquet(path))
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").select(F.minute("window_start").alias("m"), "n").limit(2).collect()
    assert [tuple(r) for r in got] == [(0, 2), (10, 1)]
