"""The standard forms, written with fewer patterns, against the patterns as they read."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from concord import specs
from concord.functions import regex
from concord.functions import values as N
from concord.operators import hints as H

NAMES = ["JOINT STOCK COMPANY X", "F Z COMPANY", "F Z C", "A SENDIRIAN  BERHAD", "P.V.T. LIMITED AND SONS & CO", "G.M.B.H.", "L L COMPANY", "to order", "TO THE ORDER OF: M/S A PRIVATE LIMITED",
         "M/S. BRAND", "  ", "", "-&-", "PUBLIC LIMITED COMPANY", "FZ CORPORATION", "LLCO L L C", "MESSRS: INCORPORATED", "Ünal ÇO & ß", None]


def _party(name: str) -> str:
    s = re.sub(specs.ORDER_PREFIX, "", name).replace(".", "")
    for pattern, form in specs.LEGAL_REWRITES:
        s = re.sub(pattern, form, s)
    return re.sub("[^A-Z0-9&]+", " ", s.replace("&", " & ")).strip(" ")


def test_party_norm_is_every_rewrite_in_order(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "raw string").select("raw", N.party_norm(F.col("raw"), F.col("raw")).alias("got")).collect()
    assert [r.got for r in rows] == [None if n is None else _party(n) for n in NAMES]


def test_port_parts_of_odd_texts(spark):
    texts = ["PORT OF SEAPORT", "A, B, USA (US LAX)", "(", "A (B\nC) D, ,", "", ",", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.port_parts(F.col("t"), F.col("t")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [
        ("PORT OF SEAPORT", "PORT OF SEAPORT", "", None), ("A B USA", "A", "US", "USLAX"), ("", "", "", None), ("A D", "A D", "", None), ("", "", "", None), ("", "", "", None), (None, None, None, None)]


def test_parts_of_a_form_are_cut_once(spark):
    """Written out, a port was cut by some thirty patterns, and negated classes took most of the time of all forms."""
    port = N.port_parts(F.col("t"), F.col("t"))._jc.toString()
    assert port.count("regexp_replace") <= 3
    assert "[^A-Z0-9" not in port + N.party_norm(F.col("t"), F.col("t"))._jc.toString() + N.normalise_label(F.col("t"))._jc.toString()


def test_cues_as_sql_match_the_column(spark):
    texts = ["Please verify your account", "carrier's draft against the instruction", "50 % off", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", regex.folded(F.col("t")))
    for cues in specs.CUES.values():
        for pattern, _ in cues:
            both = df.select(regex.guarded("low", F.col("t"), pattern, regex.NOCASE_LINES).alias("a"), F.expr(regex.guarded_sql("low", "t", pattern, regex.NOCASE_LINES)).alias("b")).collect()
            assert all(r.a == r.b for r in both)


def test_guarded_extract_is_the_plain_match(spark):
    texts = ["Please verify your account", "Check the draft B/L against the SI. CONGRATULATIONS!!!", "50 % off invoice", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", regex.folded(F.col("t")))
    cues = [pattern for cues in specs.CUES.values() for pattern, _ in cues]
    got = df.select(F.array(*[regex.guarded_extract("low", F.col("t"), p, regex.NOCASE_LINES) for p in cues]).alias("a"), F.array(*[regex.extract(F.col("t"), p, 0, regex.NOCASE_LINES) for p in cues]).alias("b"))
    assert all(r.a == r.b for r in got.collect())


def test_message_keys_hold_every_word_and_group(spark):
    keys = spark.createDataFrame([("-- abcd ab, Abcd!", "c")], "t string, case_id string").select(H.message_keys(F.col("t"), F.col("case_id")).alias("k")).first().k
    assert [k for k in keys if not k.startswith("any:")] == ["w:abcd", "g:abc", "g:bcd"]
