"""Keyed tables with deltas, the attachment table, open cases as state."""

import datetime as dt
import json

from pyspark.sql.types import LongType, StructType, TimestampType

from concord.operators.boards import latest_case
from concord.sources.attachments import read_stored_attachments, start_attachments, stored_attachments
from concord.sources.inbox import text_documents
from concord.sources.merge_table import MergeTable
from concord.streaming import cases as C
from concord.streaming.ingest import current_board
from tests.test_checks import BL, BODY, SI
from tests.test_streams import OVERRIDE

VERSION = StructType().add("case_id", "string").add("status", "string").add("run_id", LongType()).add("processed_at", TimestampType())


def _rows(table):
    return sorted(tuple(r) for r in table.select(*VERSION.names).collect())


def test_merge_table_reads_like_the_latest_versions(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), VERSION, buckets=8)
    at = dt.datetime(2024, 1, 1)
    written = []
    assert _rows(table.read(spark)) == [] and table.compact(spark) is None
    for batch in range(6):
        rows = [(f"c{i}", f"s{batch}", batch, at + dt.timedelta(minutes=batch if i % 5 else -batch)) for i in range(0, 40, batch + 1)]
        if batch == 3:
            rows = [r for r in rows if r[0] == "c4"]  # touches one bucket
        df = spark.createDataFrame(rows, VERSION)
        written += rows
        table.append(df, batch)
        table.append(df, batch)  # a repeated batch
        want = _rows(latest_case(spark.createDataFrame(written, VERSION)))
        assert _rows(table.read(spark)) == want
        if batch in (1, 2, 3):
            before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / "base").rglob("*.parquet")} if batch == 3 else {}
            assert table.compact(spark) == batch and _rows(table.read(spark)) == want
            kept = [p for p in before if (tmp_path / "t" / "base").joinpath(p).exists()]
            assert batch < 3 or len(kept) >= len(before) - 2  # only touched buckets were written anew
    assert table.batches(spark) == [3, 4, 5] and table.marked(spark) == [-1, 1, 2, 3]


def test_a_compaction_that_broke_off_is_run_again(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), VERSION, buckets=4)
    at = dt.datetime(2024, 1, 1)
    for batch in range(3):
        table.append(spark.createDataFrame([(f"c{i}", f"s{batch}", batch, at + dt.timedelta(minutes=batch)) for i in range(batch, 20)], VERSION), batch)
    want = _rows(table.read(spark))
    table.compact(spark)
    # as if it had ended before its mark was set, with one bucket not yet written
    for p in (tmp_path / "t" / "marks").glob("*"):
        p.unlink()
    (tmp_path / "t" / "marks").rmdir()
    for p in (tmp_path / "t" / "base").glob("bucket=2/*"):
        p.unlink()
    assert _rows(table.read(spark)) == want
    assert table.compact(spark) == 2 and _rows(table.read(spark)) == want
    assert table.compact(spark) is None and table.batches(spark) == [] and _rows(table.read(spark)) == want
    # a delta without its success mark is a write that broke off
    table.append(spark.createDataFrame([("c1", "half", 9, at + dt.timedelta(days=9))], VERSION), 9)
    (tmp_path / "t" / "delta" / "batch=000000000009" / "_SUCCESS").unlink()
    assert _rows(table.read(spark)) == want


def test_keys_prune_the_base(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), VERSION, buckets=16)
    rows = [(f"c{i}", "s", 1, dt.datetime(2024, 1, 1)) for i in range(200)]
    table.append(spark.createDataFrame(rows, VERSION), 0)
    table.compact(spark)
    table.append(spark.createDataFrame([("c7", "new", 2, dt.datetime(2024, 1, 2)), ("c8", "new", 2, dt.datetime(2024, 1, 2))], VERSION), 1)
    keys = spark.createDataFrame([("c7",), ("c9",), ("none",)], "case_id string")
    assert [(r[0], r[1]) for r in _rows(table.read_keys(spark, keys))] == [("c7", "new"), ("c9", "s")]


def test_attachment_table(spark, tmp_path):
    folder, table, cp = tmp_path / "files", str(tmp_path / "table"), str(tmp_path / "cp")
    (folder / "attachments").mkdir(parents=True)
    for i in range(20):
        (folder / "attachments" / f"{i} [x].txt").write_text(f"text {i}")
    (folder / "attachments" / "big.txt").write_text("x" * 5000)

    def take():
        start_attachments(spark, str(folder), table, cp, max_bytes=1000, max_files=8).awaitTermination()

    take()
    assert stored_attachments(spark, table).count() == 21
    (folder / "attachments" / "late.txt").write_text("late")
    take()
    assert stored_attachments(spark, table).count() == 22
    names = ["attachments/3 [x].txt", "attachments/big.txt", "attachments/gone.txt", "attachments/late.txt"]
    mail = spark.createDataFrame([("m1", names), ("m2", ["attachments/5 [x].txt"]), ("m3", [])], "case_id string, attachments array<string>")
    docs = read_stored_attachments(spark, mail.where("case_id = 'm1'"), table)
    got = {r["name"]: (r["text"], r["error"]) for r in text_documents(docs).collect()}
    assert got[names[0]] == ("text 3", None) and got[names[3]] == ("late", None)
    assert got[names[1]][0] is None and "large" in got[names[1]][1] and "not in the store" in got[names[2]][1]
    mail.write.parquet(str(tmp_path / "mail"))
    few = read_stored_attachments(spark, spark.read.parquet(str(tmp_path / "mail")).where("case_id = 'm1'"), table)
    plan = few._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert read_stored_attachments(spark, mail, table).count() == 5


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_open_cases_are_state(spark, tmp_path, monkeypatch):
    """Documents before and after their message; a batch checks its own cases only; a confirmation holds while the answer stays."""
    mail_schema = "case_id string, at timestamp, sender string, subject string, body string"
    doc_schema = "case_id string, at timestamp, doc_id string, attachment_no int, name string, text string"
    mail_path, doc_path, board = str(tmp_path / "mail"), str(tmp_path / "docs"), str(tmp_path / "board")
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spark.createDataFrame([], mail_schema).write.parquet(mail_path)
    spark.createDataFrame([], doc_schema).write.parquet(doc_path)
    seen = []
    from concord.streaming import cases as module

    real = module.check_batch
    monkeypatch.setattr(module, "check_batch", lambda mail, docs, *a, **k: (seen.append((sorted(r[0] for r in mail.select("case_id").collect()), docs.count())), real(mail, docs, *a, **k)))
    confirmed = spark.createDataFrame([("c", None, None, None, "NEEDS_REVIEW", "missing_attachment", None, True)], OVERRIDE)

    def arrive(mail=(), docs=()):
        seen.clear()
        if mail:
            spark.createDataFrame(mail, mail_schema).coalesce(1).write.mode("append").parquet(mail_path)
        if docs:
            spark.createDataFrame(docs, doc_schema).coalesce(1).write.mode("append").parquet(doc_path)
        C.start_cases(_stream(spark, mail_path, mail_schema), _stream(spark, doc_path, doc_schema), board, str(tmp_path / "cp"), overrides=lambda: confirmed).awaitTermination()
        return {r["case_id"]: r for r in current_board(spark, board).collect()}

    cases = arrive([("c", at(2), "a@b.com", "s", BODY), ("c", at(1), "z@z.com", "older", "hello"), ("other", at(1), "a@b.com", "s", BODY)], [("early", at(1), "early/0", 0, "e_SI.txt", SI)])
    assert set(cases) == {"c", "other"} and cases["c"]["status"] == "NEEDS_REVIEW" and cases["c"]["resolved"] and cases["c"]["category"] == "BL_COMPARISON"
    cases = arrive(docs=[("c", at(3), "c/0", 0, "e_SI.txt", SI)])  # the same answer: the confirmation survives
    assert seen == [(["c"], 1)] and cases["c"]["status"] == "NEEDS_REVIEW" and cases["c"]["resolved"]
    cases = arrive(docs=[("c", at(4), "c/1", 1, "e_BL.txt", BL.replace("THREE (3)", "4 x 40'HC"))])  # another answer
    assert seen == [(["c"], 2)] and cases["c"]["status"] == "MISMATCH" and cases["c"]["defect_fields"] == ["container_count"]
    cases = arrive([("early", at(5), "a@b.com", "s", BODY)], [("early", at(5), "early/1", 1, "e_BL.txt", BL)])  # its first document waited
    assert seen == [(["early"], 2)] and cases["early"]["status"] == "OK" and len(cases) == 3
    cases = arrive(docs=[("c", at(6), "c/1", 1, "e_BL.txt", BL)])  # a corrected draft replaces the first
    assert cases["c"]["status"] == "OK"


def test_merging_takes_the_latest_version():
    import pandas as pd

    at = pd.Timestamp("2024-01-01")
    part = {"sender": None, "subject": None, "body": None, "doc_id": None, "attachment_no": None, "name": None, "text": None, "error": None}
    rows = pd.DataFrame([{**part, "at": at + pd.Timedelta(h, "h"), **x} for h, x in ((2, {"subject": "new"}), (1, {"subject": "old"}), (3, {"doc_id": "d", "text": "b"}), (2, {"doc_id": "d", "text": "a"}))])
    case = C._merge({"docs": {}}, rows.astype(object).where(rows.notna(), None))
    assert case["subject"] == "new" and case["docs"]["d"]["text"] == "b" and json.dumps(case)


def test_column_names_of_state(spark):
    opened = spark.createDataFrame([("c", json.dumps({"at": 1.0, "sender": "s", "subject": None, "body": "b", "docs": []}))], "case_id string, case string")
    mail, docs = C.split_cases(opened)
    assert [tuple(r) for r in mail.collect()] == [("c", "s", None, "b")] and docs.count() == 0 and docs.columns == ["case_id", *C.DOCUMENT]
