"""Work that must not be done more often than the rows ask for, read off the plans, beside the results of the same steps."""

import datetime

from pyspark.sql import functions as F

from concord.functions.values import normalise_label
from concord.operators import extract as E
from concord.plans.catalog import QUERIES

DOCS = [
    ("a", "x_SI.txt", "\n  SHIPPING INSTRUCTION   \r\n\tShipper: A\x0b\n\n  12 ROAD \nlast"),
    ("b", "x_BL.txt", "COVER\nPACKING LIſT     BILL OF LADING\n"),
    ("c", "x.txt", "nothing\nhere\n" + "y" * 91 + "\nof   a bill of lading\n"),
    ("d", "x.txt", " \n\t"),
    ("e", "x.txt", None),
]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, name string, text string")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_numbered_once(spark):
    rows = E.docs_to_rows(_docs(spark))
    assert "size(" not in _plan(rows)  # no filter that numbers every text a second time
    got = {(r.doc_id, r.row_index): (r.text_no, r.text, r.indent) for r in rows.collect()}
    assert [got["a", i] for i in range(6)] == [
        (None, "", False), (0, "  SHIPPING INSTRUCTION", True), (1, "\tShipper: A", True), (None, "", False), (2, "  12 ROAD", True), (3, "last", False)]
    assert {d for d, _ in got} == {"a", "b", "c"}


def test_a_title_is_cut_once_for_all_patterns(spark):
    df = E.detect_doc_type(_docs(spark))
    assert _plan(df).count("(.*?)(\\s{3,}|$)") == 1
    got = {r.doc_id: (r.type, r.subtype, r.type_confidence) for r in df.collect()}
    assert got == {"a": ("SI", None, 0.97), "b": ("OTHER", "PACKING_LIST", 0.97), "c": ("BL", None, 0.75), "d": (None, None, None), "e": (None, None, None)}


def test_label_norms(spark):
    df = spark.createDataFrame([("Ａ毛重 Gross　WK. (KＧ)",), (None,), ("..",)], "l string")
    assert [r[0] for r in df.select(normalise_label(F.col("l"))).collect()] == ["gross wk k", None, ""]


def test_roles_are_computed_once_for_all_reasons(spark, tmp_path):
    day = datetime.date(1996, 1, 2)
    tables = {
        "orders": ([(1, 1, "O", 5.0, day, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        "lineitem": ([(15, 1, 2.0, day)], "l_orderkey long, l_suppkey long, l_quantity double, l_shipdate date"),
        "customer": ([(1, "Customer#1", 1, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(1, "Supplier#1", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "events": ([(1, 1)], "event_id long, user_id long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("completeness", "uncompared_fields"):
        assert "certificate" not in _plan(QUERIES[name](spark, str(tmp_path))), name  # no title pattern after the table of roles
