"""Nothing is cut off, and one bad value stays its own row's problem."""

import json

from pyspark.sql import functions as F

from concord.functions.values import container_count
from concord.operators import analytics as A
from concord.operators import boards as S
from concord.operators import cases as Q
from concord.operators import classify as K
from concord.operators import extract as E
from concord.operators import knowledge as B
from concord.operators import learning as L
from concord.plans.checks import check_cases
from concord.streaming import activity
from tests.test_checks import BL, BODY, SI


def test_learned_prefixes_of_any_length(spark):
    cases = spark.createDataFrame([("a", "ABCDEFGHIJKLM123"), ("b", "ABCDEFG999"), ("c", None), ("d", "Q")], "case_id string, bl_no string")
    kb = spark.createDataFrame([(1, "carrier_prefix", "ABCDEFGHIJKLM", "Thirteen", None, True), (2, "carrier_prefix", "ABCDEFG", "Seven", None, True)], "id int, kind string, key string, value string, weight double, active boolean")
    got = {r["case_id"]: r["carrier"] for r in E.detect_carrier(cases, ["bl_no"], [], kb).collect()}
    assert got == {"a": "Thirteen", "b": "Seven", "c": None, "d": None}
    none = {r["carrier"] for r in E.detect_carrier(cases, ["bl_no"], [], kb.where("id > 9")).collect()}
    assert none == {None}


def test_every_chosen_tag_counts(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    tags = [f"t{i}" for i in range(9)]
    labels = spark.createDataFrame([(c, t) for c in "ab" for t in tags if (c, t) != ("b", "t8")], "case_id string, name string")
    assert [r["case_id"] for r in Q.with_all_tags(cases, labels, tags).collect()] == ["a"]


def test_pages_have_the_size_asked_for_and_go_on_after_a_case(spark):
    cases = spark.range(700).select(F.format_string("c%03d", "id").alias("case_id"), (F.lit(1_700_000_000) + F.floor(F.col("id") / 7)).cast("timestamp").alias("received_at"))
    first = Q.page(cases, 1, 500).collect()
    assert len(first) == 500
    after = Q.page(cases, size=500, after=(first[-1]["received_at"], first[-1]["case_id"])).collect()
    assert [r["case_id"] for r in after] == [r["case_id"] for r in Q.page(cases, 2, 500).collect()] and len(after) == 200


def test_worst_value_outside_the_report(spark):
    rows = [(f"c{i}", "BL_COMPARISON", "MISMATCH" if k < 5 else "OK", True) for i in range(12) for k in range(50)] + [("small", "BL_COMPARISON", "MISMATCH", True)] * 3
    cases = spark.createDataFrame(rows, "carrier string, category string, status string, compared boolean")
    assert "small" not in {r["name"] for r in A.hotspots(cases, "carrier").collect()}
    assert A.worst_hotspot(cases, "carrier").collect()[0]["name"] == "small"


def test_evidence_is_whole(spark):
    from concord import specs

    text = "please check the draft bl and compare it with the si, " * 40
    df = spark.createDataFrame([("c", text, text, "x@best-deals.biz")], "case_id string, message string, subject string, sender string")
    got = K.classification_evidence(df, [("draft bl", "GENERAL", 4.0)]).collect()[0]["evidence"]
    assert any("[sender]" in e for e in got) and any("[hint]" in e for e in got) and specs.SPAM_DOMAIN_WEIGHT == 1.5
    assert K.low_confidence_queue(spark.createDataFrame([(0.1,), (0.99,)], "category_confidence double")).count() == 1


def test_title_far_down_the_body(spark):
    body = "line of nothing\n" * 1000 + "PACKING LIST\n"
    docs = spark.createDataFrame([("d", "x.txt", body)], "doc_id string, name string, text string")
    assert E.detect_doc_type(docs).collect()[0]["subtype"] == "PACKING_LIST"
    rows = E.docs_to_rows(docs)
    assert E.detect_doc_type(docs.select("doc_id", "name", F.lit(True).alias("readable")), rows).collect()[0]["subtype"] == "PACKING_LIST"
    again = E.number_rows(rows.drop("text_no")).where("text_no is not null").agg(F.max("text_no")).first()[0]
    assert again == 1000


def test_digits_of_other_scripts_do_not_end_the_job(spark):
    df = spark.createDataFrame([("（３）",), ("３ x 40HC",), ("99999999999 x 40HC",), ("TBA",)], "v string")
    assert [r["n"] for r in df.select(container_count(F.col("v"))["count"].alias("n")).collect()][1] == 3


def test_carrier_port_and_failures_of_the_whole_check(spark):
    mail = [
        ("invoice", "docs@example.com", "Invoice", "Dear team,\n\nPlease explain the invoice 5300001234: is the THC included or billed separately?"),
        ("blank", "docs@example.com", "x", BODY),
        ("broken", "docs@example.com", "x", None),
    ]
    draft = BL.replace("B/L No.: MEDU1234567", "Booking No.: MEDU1234567")
    docs = [
        ("invoice", "invoice/0", 0, "e_BL.txt", draft),
        ("blank", "blank/0", 0, "e_SI.txt", SI.replace("POD: JEBEL ALI, UAE (AEJEA)", "POD: TBA").replace("3 x 40'HC", "（３）")),
        ("blank", "blank/1", 1, "e_BL.txt", BL),
    ]
    got = check_cases(
        spark.createDataFrame(mail, "case_id string, sender string, subject string, body string"),
        spark.createDataFrame(docs, "case_id string, doc_id string, attachment_no int, name string, text string"),
        knowledge=B.seed_knowledge(spark),
    ).cases
    rows = {r["case_id"]: r for r in got.collect()}
    assert rows["invoice"]["category"] == "INVOICE_QUERY" and rows["invoice"]["carrier"] is None and rows["invoice"]["pod"] is None
    assert rows["blank"]["pod"] is None and rows["blank"]["status"] == "NEEDS_REVIEW"
    assert rows["broken"]["status"] == "FAILED" and rows["broken"]["error"].startswith("[prepare]") and rows["broken"]["needs_human"]
    assert rows["blank"]["error"] is None


def test_an_approved_hint_keeps_its_weight(spark):
    s = spark.createDataFrame([(1, "classifier_hint", "refund", "GENERAL", "pending"), (2, "reply_rule", "OK", "line", "pending")], "suggestion_id long, kind string, key string, value string, status string")
    d = spark.createDataFrame([(1, True, "u", 1), (2, True, "u", 1)], "suggestion_id long, approve boolean, user string, at long")
    _, kb, _ = L.apply_decisions(s, d, B.seed_knowledge(spark))
    assert {r["kind"]: r["weight"] for r in kb.where("source = 'learned'").collect()} == {"classifier_hint": 4.0, "reply_rule": None}


def test_small_board_operators(spark, tmp_path):
    up = spark.createDataFrame([("a", True), ("b", False)], "case_id string, is_new boolean")
    assert [tuple(r) for r in S.pending_cases(up).collect()] == [("a", "PENDING")]
    assert Q.sent_count(up).collect()[0]["n"] == 2
    board = spark.createDataFrame([("b", "BL_COMPARISON", "MISMATCH", None, ["shipper"]), ("a", "GENERAL", "OK", None, [])], "case_id string, category string, status string, review_reason string, defect_fields array<string>")
    S.write_submission(board, str(tmp_path / "s"))
    lines = [json.loads(x) for f in sorted((tmp_path / "s").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert [x["case_id"] for x in lines] == ["a", "b"] and lines[1]["has_defect"]
    assert callable(activity.live_counts)
