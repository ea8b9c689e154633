"""Labels and owners.

Rules and routes are written by people in an admin form; `match_rules` compiles the rule list into literal
expressions on the case row, so tagging a case needs no join and no shuffle whatever the number of cases.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import specs
from concord.functions.regex import NOCASE, look_up, matches
from concord.functions.text import sender_domain

LABELLED_CATEGORIES = ["BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY"]
SOURCE_PRIORITY = {"manual": 0, "auto": 1, "rule": 2}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Rule:
    rule_id: int
    label: str
    conditions: tuple[Condition, ...]
    enabled: bool = True


def auto_labels(cases: DataFrame) -> DataFrame:
    """G1: (case_id, name, grp): carrier, customer and port labels."""
    pairs = F.array(
        F.struct(F.col("carrier").alias("name"), F.lit("carrier").alias("grp")),
        F.struct(F.col("customer").alias("name"), F.lit("customer").alias("grp")),
        F.struct(F.concat(F.lit("POD "), F.col("pod")).alias("name"), F.lit("pod").alias("grp")),
    )
    rows = cases.where(F.col("category").isin(LABELLED_CATEGORIES)).select("case_id", F.inline(pairs))
    return rows.where(F.col("name").isNotNull() & ~F.col("name").isin("", "POD "))


def case_facts() -> dict[str, Column]:
    """The facts a rule may test."""
    facts = {n: F.col(n) for n in ("carrier", "customer", "pod", "category", "status", "sender", "subject", "body", "review_reason")}
    facts["sender_domain"] = sender_domain(F.col("sender"))
    facts["defect_field"] = F.array_join("defect_fields", " ")
    return {n: F.coalesce(c, F.lit("")) for n, c in facts.items()}


def _holds(cond: Condition, facts: dict[str, Column]) -> Column:
    fact = facts.get(cond.field, F.lit(""))
    have, want = F.lower(fact), F.lit(cond.value.lower())
    tests = {
        "contains": lambda: F.contains(have, want),
        "is": lambda: have == want,
        "is_not": lambda: have != want,
        "starts_with": lambda: F.startswith(have, want),
        "ends_with": lambda: F.endswith(have, want),
        "regex": lambda: matches(fact, cond.value, NOCASE),
    }
    return tests[cond.op]() if cond.op in tests else F.lit(False)


def match_rules(cases: DataFrame, rules: list[Rule]) -> DataFrame:
    """(case_id, rule_id, name) of every enabled rule whose conditions all hold; a rule without conditions never does."""
    facts = case_facts()
    hits = [
        F.when(
            reduce(lambda a, b: a & b, [_holds(c, facts) for c in rule.conditions]),
            F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.label).alias("name")),
        )
        for rule in rules
        if rule.enabled and rule.conditions
    ]
    if not hits:
        return cases.select("case_id", F.lit(0).alias("rule_id"), F.lit("").alias("name")).where(F.lit(False))
    return cases.select("case_id", F.inline(F.array_compact(F.array(*hits))))


def merge_labels(auto: DataFrame, ruled: DataFrame, manual: DataFrame) -> DataFrame:
    """One row per case and label; a label set by hand outranks the recomputed ones."""
    rows = (
        auto.select("case_id", "name", F.lit("auto").alias("source"))
        .unionByName(ruled.select("case_id", "name", F.lit("rule").alias("source")))
        .unionByName(manual.select("case_id", "name", F.lit("manual").alias("source")))
    )
    return rows.groupBy("case_id", "name").agg(F.min_by("source", look_up(SOURCE_PRIORITY, F.col("source"))).alias("source"))


def assign_owner(cases: DataFrame, labels: DataFrame, routes: DataFrame, users: DataFrame) -> DataFrame:
    """The owner by the best route: priority, then id; an inactive owner is replaced by the backup, even an inactive one;
    a route that yields nobody falls through. Locked cases keep their owner; spam has none.

    `routes`: route_id, name (label), user_id, backup_user_id, priority. The people are resolved on the routes first,
    so the case side only meets the finished route table.
    """
    people = users.select(F.col("user_id").alias("_uid"), F.col("active").alias("_active"))
    main = routes.join(people, F.col("user_id") == F.col("_uid"), "left").withColumn("_main", F.when(F.col("_active"), F.col("user_id"))).drop("_uid", "_active")
    backup = main.join(people.select("_uid"), F.col("backup_user_id") == F.col("_uid"), "left")
    chosen = backup.select("name", "route_id", "priority", F.coalesce("_main", "_uid").alias("owner")).where(F.col("owner").isNotNull())
    best = chosen.groupBy("name").agg(F.min_by(F.struct((-F.col("priority")).alias("p"), "route_id", "owner"), F.struct(-F.col("priority"), F.col("route_id"))).alias("r"))
    routed = labels.select("case_id", "name").join(best, "name").groupBy("case_id").agg(F.min("r").alias("r")).select("case_id", F.col("r.owner").alias("_owner"))
    df = cases.join(routed, "case_id", "left")
    locked = F.coalesce("assignee_locked", F.lit(False)) if "assignee_locked" in cases.columns else F.lit(False)
    owner = F.when(locked, F.col("assignee_id")).when(F.col("category").eqNullSafe(F.lit("SPAM")), F.lit(None)).otherwise(F.col("_owner"))
    return df.withColumn("assignee_id", owner.cast("int")).drop("_owner")


def retag_all(cases: DataFrame, rules: list[Rule], manual: DataFrame, routes: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every label and owner anew: (cases with owner, labels)."""
    labels = merge_labels(auto_labels(cases), match_rules(cases, rules), manual)
    return assign_owner(cases, labels, routes, users), labels


def default_rules() -> list[Rule]:
    """The two rules a new installation starts with."""
    return [
        Rule(1, "Needs amendment", (Condition("status", "is", "MISMATCH"),)),
        Rule(2, "External sender", (Condition("sender_domain", "regex", r"^(?!.*april).*$"), Condition("category", "is_not", "SPAM"))),
    ]
