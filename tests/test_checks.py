"""The whole check on small hand-written messages."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from concord import specs
from concord.functions.text import clean_body, sentences
from concord.operators import learning as L
from concord.plans.checks import check_cases

SI = "SHIPPING INSTRUCTION\n====================\n\nShipper/Exporter: ACME PAPER SDN BHD\n  12 JALAN SATU\nConsignee (Non-Negotiable): GLOBEX TRADING LLC\n  PO BOX 1; DUBAI, UAE\nNotify: GLOBEX TRADING LLC\nPort of Loading (POL): PORT KLANG (WESTPORT), MALAYSIA (MYPKG)\nPOD: JEBEL ALI, UAE (AEJEA)\nNo. of Containers: 3 x 40'HC\nGross Wt (kgs): 61,250 KG\nVessel: TEST VESSEL V.001\n"
BL = "BILL OF LADING (DRAFT)\n======================\n\nSHIPPER: ACME PAPER SDN. BHD.\n  12 JALAN SATU\nTo the Order of: GLOBEX TRADING L.L.C.\nNotify Party/Intermediate Consignee: GLOBEX TRADING LLC\nLoad Port: Port Kelang, Malaysia\nDischarge Port: JEBEL ALI, UNITED ARAB EMIRATES\nContainer Count: THREE (3)\nGross Weight毛重(KGS): 61250\nB/L No.: MEDU1234567\n"
BODY = "Hi Team,\n\nAttached are the SI and draft BL. Please check the details and confirm.\n\nBest Regards,\nA"
CASES = [
    ("match", BODY, {"e_SI.txt": SI, "e_BL.txt": BL}, "OK", None, []),
    ("count", BODY, {"e_SI.txt": SI, "e_BL.txt": BL.replace("THREE (3)", "4 x 40'HC")}, "MISMATCH", None, ["container_count"]),
    ("wrong", BODY, {"e_SI.txt": SI, "e_BL.txt": "PACKING LIST\nConsignee: GLOBEX\nCarton No.  Gross Wt"}, "NEEDS_REVIEW", "wrong_doc_type", []),
    ("lone", BODY, {"e_SI.txt": SI}, "NEEDS_REVIEW", "missing_attachment", []),
    ("none", "Dear Team,\n\nPlease compare the SI and draft BL for X and confirm.", {}, "NEEDS_REVIEW", "missing_attachment", []),
    ("empty", BODY, {"e_SI.txt": SI, "e_BL.txt": ""}, "NEEDS_REVIEW", "unreadable", []),
    ("blank", BODY, {"e_SI.txt": SI.replace("GLOBEX TRADING LLC\n  PO", "\n  PO").replace("Notify: GLOBEX TRADING LLC", "Notify: TBA"), "e_BL.txt": BL}, "NEEDS_REVIEW", "missing_value", []),
    ("waits", "Dear Hari,\n\nPlease assist to send the draft BL for ABC123 for checking asap.\n\nThank you.", {}, "OK", None, []),
]


@pytest.fixture(scope="module")
def checked(spark):
    mail = spark.createDataFrame([(c, "docs@example.com", "RE_ something unrelated", body) for c, body, *_ in CASES], "case_id string, sender string, subject string, body string")
    rows = [(c, f"{c}/{i}", i, f"a/{name}", text) for c, _, files, *_ in CASES for i, (name, text) in enumerate(files.items())]
    docs = spark.createDataFrame(rows, "case_id string, doc_id string, attachment_no int, name string, text string")
    return check_cases(mail, docs)


def test_verdicts(checked):
    got = {r["case_id"]: (r["status"], r["review_reason"], r["defect_fields"]) for r in checked.cases.collect()}
    assert got == {c: (status, reason, defects) for c, _, _, status, reason, defects in CASES}


def test_carrier_and_reference(checked):
    row = checked.cases.where("case_id = 'match'").collect()[0]
    assert (row["carrier"], row["bl_no"], row["pod"]) == ("MSC", "MEDU1234567", "Jebel Ali")


def test_body_parts(spark):
    body = ("WARNING: This email originated outside of our organisation. Exercise caution with links or attachments.\n\nHi Lee,\n\nPlease check the draft BL.\n\n"
            "Best Regards,\nSam\nShipping\n\n______________________________\nFrom: X <x@y.com>\nSent: Monday\nSubject: RE: invoice 123\n\nold text about invoice")
    r = clean_body(spark.createDataFrame([(body,)], "body string")).collect()[0]
    assert r["message"] == "Please check the draft BL." and "invoice" in r["quoted"] and "Sam" in r["signature"] and r["banner"]


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([("We found it. Please quote BL no. MEDU123 in your reply. Kindly send",)], "t string")
    assert df.select(sentences(F.col("t")).alias("s")).collect()[0]["s"] == ["We found it.", "Please quote BL no. MEDU123 in your reply.", "Kindly send"]


def plain_sentences(text):
    """The same rule, one piece after the other."""
    out = []
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text or ""):
        for piece in filter(None, (p.strip() for p in re.split(r"(?<=[.!?])\s+", line))):
            if out and re.search(specs.ABBREVIATION, out[-1], re.I) and out[-1] in line:
                out[-1] += " " + piece
            else:
                out.append(piece)
    return out


def test_sentences_against_a_plain_loop(spark):
    rng = random.Random(4)
    bits = ["We ask no.", "BL no. 12", "Mr. Lee!", "ref. no. co.", "Ltd.", "end.", "why?", "\n", "  ", "\r\n", "a", "e.g. this", "ref.  two"]
    texts = [None, "", " \n ", "no.", "no. no.\nno. x"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", sentences(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_sentences(t) for i, t in enumerate(texts)}


def test_sentences_of_a_long_text(spark):
    text = " ".join(f"See no. {i} of the list. Then go on." for i in range(8000))
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t")).alias("s")).first()["s"]
    assert got == plain_sentences(text) and len(got) == 16000
    assert time.time() - began < 20


def test_added_reply_lines_become_templates(spark):
    row = ("c1", "draft", "MISMATCH", "Please amend.", "Please quote BL no. MEDU123 in your reply. Please amend.", "MEDU123", None, None, None)
    df = spark.createDataFrame([row], "case_id string, kind string, status string, ai_value string, final_value string, bl_no string, oc_no string, booking string, invoice string")
    got = L.mine_reply_lines(df).collect()
    assert [(r["key"], r["value"], r["evidence_count"]) for r in got] == [("MISMATCH", "Please quote BL no. {bl_no} in your reply.", 1)]


def test_review_details(checked):
    detail = {r["case_id"]: r["review_detail"] for r in checked.cases.collect()}
    assert detail["match"] is None and detail["count"] is None
    assert detail["waits"] == "a draft is asked for, so there is nothing to compare yet"
    assert detail["lone"] == "the draft BL was not attached"
    assert detail["blank"] == "notify_party: SI leaves it open (“TBA”)"


def test_every_check_has_all_fields(checked):
    rows = checked.field_results.collect()
    fields = {}
    for r in rows:
        fields.setdefault(r["case_id"], {})[r["field"]] = r
    assert set(fields) == {c for c, *_ in CASES} and all(len(f) == 7 for f in fields.values())
    lone = fields["lone"]["shipper"]
    assert (lone["result"], lone["left_value"], lone["right_value"], lone["confidence"]) == ("not_compared", "ACME PAPER SDN BHD", None, 0.0)
    assert {f: fields["waits"][f]["finding"] for f in ("shipper", "gross_weight_kg")} == dict.fromkeys(("shipper", "gross_weight_kg"), "not compared for want of SI and BL")
    assert fields["count"]["container_count"]["finding"] == "3 containers against 4"
    assert fields["match"]["gross_weight_kg"]["finding"] == "the weights agree"


def test_doubts_and_thresholds_are_told(spark):
    from concord.operators.reconcile import apply_thresholds, roll_up

    rows = [("a", "container_count", "match", 0.8, None, False, "the counts agree, the sizes do not"), ("a", "shipper", "unsure", 0.5, None, False, "so so"), ("b", "shipper", "match", 0.99, None, False, "the names agree")]
    results = spark.createDataFrame(rows, "case_id string, field string, result string, confidence double, missing_reason string, from_scan boolean, finding string")
    weak = apply_thresholds(results, {"container_count": 0.9})
    cases = spark.createDataFrame([("a", 0.9, False), ("b", 0.9, False)], "case_id string, category_confidence double, awaiting_draft boolean")
    got = {r["case_id"]: (r["status"], r["review_detail"]) for r in roll_up(cases, weak).collect()}
    told = "not certain: shipper: so so; container_count: the counts agree, the sizes do not; sure to 80 %, where 90 % are asked for"
    assert got == {"a": ("NEEDS_REVIEW", told), "b": ("OK", None)}
