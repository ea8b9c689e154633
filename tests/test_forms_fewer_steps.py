"""Standard forms and the pairing written with fewer steps, against the steps as they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import specs
from concord.functions import values as N
from concord.functions.regex import NOCASE, matches, sub
from concord.operators import reconcile as R

ENDS = ["", " ", "\n", " \n", "\t\r\n", "\x0b", "\x1c", " ", " \n", "\u0085", "‍", "\x00", "�"]
CORES = ["", "a", "é", "TBA", "n/a", "___", "??", "- -", "x x", "xxx", "to be advised", "A\x01\x02", "a \n b", "SDN & X LTD", "ABC"]


def _texts(spark):
    return spark.createDataFrame([(a + c + b,) for a in ENDS for c in CORES for b in ENDS] + [(None,)], "t string")


def test_blank_and_core_are_as_the_steps_read(spark):
    t = F.col("t")
    drop = F.array(*[F.lit(x) for x in [*specs.LEGAL_TOKENS, "&"]])
    core = F.array_join(F.filter(F.split(t, " "), lambda x: ~F.array_contains(drop, x)), " ")
    same = [(t.isNull() | matches(sub(t, r"^\s+|\s+$", ""), specs.BLANK_VALUE, NOCASE)).eqNullSafe(N.is_blank(t)), core.eqNullSafe(N.party_core(t))]
    assert tuple(_texts(spark).select(*[F.count_if(~x).alias(f"d{i}") for i, x in enumerate(same)]).first()) == (0, 0)


def test_forms_run_no_step_they_can_do_without(spark):
    t = F.col("t")
    assert "regexp_replace" not in N.is_blank(t)._jc.toString()
    assert "array_contains" not in N.party_core(t)._jc.toString()


def test_pairing_moves_only_the_parts_the_rules_read(spark):
    values = spark.createDataFrame(
        [("c", s, "port_of_loading", "PORT KLANG, MALAYSIA (MYPKG)", "POL", 0.9, False, "rule") for s in ("SI", "BL")],
        "case_id string, side string, field string, raw string, label string, confidence double, blank boolean, method string")
    paired = R.pair_fields(spark.createDataFrame([("c",)], "case_id string"), R.standard_forms(values))
    row = paired.where("field = 'port_of_loading'").first()
    assert row.l.norm.parts.asDict() == {"country": "MALAYSIA", "locode": "MYPKG"}
    assert row.l.norm.port == row.r.norm.port == "PORT KLANG"
