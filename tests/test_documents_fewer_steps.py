"""Steps over whole documents written with fewer tests a character, against the patterns as they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions.regex import LINES, sub
from concord.operators import extract as E

ENDS = ["", " ", "\n", " \n", "\t\r\n", "\x0b", "\x1c", " ", " \n", "\u0085", "‍", "\x00", "�"]
CORES = ["", "a", "é", "TBA", "n/a", "___", "??", "- -", "x x", "xxx", "to be advised", "A\x01\x02", "a \n b", "SDN & X LTD", "ABC"]


def _texts(spark):
    return spark.createDataFrame([(a + c + b,) for a in ENDS for c in CORES for b in ENDS] + [(None,)], "t string")


def test_state_and_trimmed_lines_are_as_the_patterns_read(spark):
    t = F.col("t")
    signs = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]"
    odd = F.length(t) - F.length(F.regexp_replace(t, signs, "")) > 0.10 * F.length(t)
    same = [(t.isNull() | ~t.rlike(r"(?U)\S") | odd).eqNullSafe(E.read_state(t).isNotNull()), sub(t, r"[^\S\n]+$", "", LINES).eqNullSafe(E._right_trimmed(t))]
    assert tuple(_texts(spark).select(*[F.count_if(~x).alias(f"d{i}") for i, x in enumerate(same)]).first()) == (0, 0)


def test_ascii_texts_take_classes_of_single_characters(spark):
    t = F.col("t")
    assert "octet_length" in E._right_trimmed(t)._jc.toString()
    assert "contains(t, '�')" in E.read_state(t)._jc.toString()
