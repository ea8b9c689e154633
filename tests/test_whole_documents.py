"""Documents read whole give the rows that the long way gives, without sending a row anywhere."""

import pytest
from pyspark.sql import functions as F

from concord.operators import extract as E
from concord.operators.knowledge import KNOWLEDGE_SCHEMA
from tests.test_checks import BL, SI

TEXTS = {
    "si": SI, "bl": BL, "none": None, "empty": " \n\t\n", "crlf": SI.replace("\n", "\r\n"),
    "late": "Notify:\nACME LTD\nConsignee:\n\nBUYER ONE\nShipper:\n  S ONE\n\n  S TWO\nPOD:\nPort of Loading: BUSAN\n",
    "many": "Shipper: A | B\n" + "".join(f"  LINE {i}\n" for i in range(11)) + "  Consignee: indented\nTotal Gross Weight: 5 KG\nGross Weight: 7 KG\nSHIPPER: SECOND\n",
    "glued": "NOTIFY PARTY X CO LTD\nTO THE ORDER OF (A) Y\nNo. of Containers (40) 3\nGROSS WEIGHT\n  900\nNet Weight: 3\nContainer No.: 4\n",
    "odd": "Konşimento: x\n毛重 KG: 12\nCNEE; a:b\n\x0b\u00a0Shipper：\u00a0WIDE\u00a0\nmy own name: LEARNED\nToTalGrossWt: 9\nPortOfLoadingXX: P\n" + "y" * 80 + ": z\n:\n",
    "long": "filler\n" * 1020 + "Shipper:\n  FAR\n  ROAD\n" + "filler\n\n" * 1500 + "POD: END\n",
}
CANDIDATE = ["doc_id", "field", "raw", "full", "label", "row_index", "label_row", "confidence", "method", "blank", "loc", "start", "stop"]


def _docs(spark, twice=()):
    rows = [*TEXTS.items(), *((d, TEXTS[d]) for d in twice)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def _knowledge(spark, n=0):
    rows = [(1, "label_alias", "my own name", "shipper", None, True)] + [(2 + i, "label_alias", f"name {i}", "consignee", None, True) for i in range(n)]
    return spark.createDataFrame(rows, KNOWLEDGE_SCHEMA)


def _sorted(df, *columns):
    return sorted(map(str, df.select(*columns or df.columns).collect()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("names", [0, 7, E.FEW_ALIASES])
def test_whole_documents_give_the_same_values(spark, names):
    docs, kb = _docs(spark), _knowledge(spark, names)
    rows, whole = E.docs_to_rows(docs), E.docs_to_rows(docs, whole=True)
    long = E.collect_continuations(E.split_rows(rows, kb))
    got = E.collect_continuations(E.split_rows(whole, kb))
    assert _sorted(got, *CANDIDATE) == _sorted(long, *CANDIDATE) and long.count() > 30
    values = E.extract_fields(whole, None, kb)
    assert _sorted(values) == _sorted(E.extract_fields(rows, None, kb))
    assert {r["doc_id"]: r["raw"] for r in values.where("field = 'shipper'").collect()}["odd"] == "LEARNED"  # the wide row before it is indented


def test_context_and_scans_of_whole_documents(spark):
    docs, kb = _docs(spark), _knowledge(spark)
    rows, whole = E.docs_to_rows(docs), E.docs_to_rows(docs, whole=True)
    want = E.value_context(E.extract_fields(rows, None, kb), rows)
    got = E.value_context(E.extract_fields(whole, None, kb, around=(2, 3)), whole)
    assert _sorted(got, *want.columns) == _sorted(want) and want.where("hit").count() > 20
    scans = docs.select("doc_id", F.when(F.col("doc_id").isin("si", "late"), F.lit("ocr")).otherwise(F.lit("text")).alias("method"), F.lit(0.7).alias("ocr_confidence"))
    capped = E.extract_fields(whole, scans, kb)
    assert _sorted(capped) == _sorted(E.extract_fields(rows, scans, kb)) and capped.where("method = 'ocr'").count() > 8


def test_documents_that_share_an_id_are_read_as_before(spark):
    docs, kb = _docs(spark, twice=("si", "late", "many", "empty")), _knowledge(spark)
    rows, whole = E.docs_to_rows(docs), E.docs_to_rows(docs, whole=True)
    columns = ["doc_id", "field", "raw", "blank", "confidence", "row_index"]
    values = E.extract_fields(whole, None, kb, around=(2, 3))
    assert _sorted(values, *columns) == _sorted(E.extract_fields(rows, None, kb), *columns)
    want = E.value_context(E.extract_fields(rows, None, kb), rows)
    assert _sorted(E.value_context(values, whole), *want.columns) == _sorted(want)


def test_nothing_is_shuffled_or_sorted_between_text_and_values(spark):
    docs = _docs(spark)
    whole = E.docs_to_rows(docs, whole=True)
    values = E.extract_fields(whole, None, _knowledge(spark), around=(2, 3))
    for df in (values, E.value_context(values, whole), E.collect_continuations(E.split_rows(whole))):
        assert not any(step in _plan(df) for step in ("Window", "Aggregate", "Join", "Sort ")), _plan(df)


def test_more_learned_names_than_a_plan_holds_are_joined(spark):
    docs, kb = _docs(spark), _knowledge(spark, E.FEW_ALIASES + 1)
    whole = E.docs_to_rows(docs, whole=True)
    assert _sorted(E.extract_fields(whole, None, kb)) == _sorted(E.extract_fields(E.docs_to_rows(docs), None, kb))
    want = E.value_context(E.extract_fields(E.docs_to_rows(docs), None, kb), E.docs_to_rows(docs))
    assert _sorted(E.value_context(E.extract_fields(whole, None, kb, around=(2, 3)), whole), *want.columns) == _sorted(want)
