"""Case metrics.

Every metric is a conditional aggregate with map-side combine; the scalar ones come out of one pass (`headline`).
Needs the case columns of the board plus `compared` (some field was compared).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import specs
from concord.functions.regex import look_up


def _check() -> Column:
    return F.col("category").eqNullSafe(F.lit(specs.CHECK))


def _compared() -> Column:
    return _check() & F.col("compared")


def _open_review() -> Column:
    return F.col("needs_human") & ~F.col("resolved")


def _share(part: Column, whole: Column, digits: int = 3) -> Column:
    """Rounded share, 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def scope(cases: DataFrame, *, date_from: str | None = None, date_to: str | None = None, carrier: str | None = None, customer: str | None = None,
          label: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """A1: the cases a report covers. The upper bound includes the midnight after the last day."""
    df = cases
    if date_from:
        df = df.where(F.col("received_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        df = df.where(F.col("received_at") <= F.lit(date_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    if carrier:
        df = df.where(F.coalesce("carrier", F.lit("")) == carrier)
    if customer:
        df = df.where(F.coalesce("customer", F.lit("")) == customer)
    if label:
        df = df.join(labels.where(F.col("name") == label).select("case_id"), "case_id", "left_semi")
    return df


def category_counts(cases: DataFrame) -> DataFrame:
    """A2."""
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def status_counts(cases: DataFrame) -> DataFrame:
    """A2: among checks."""
    return cases.where(_check()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def defect_field_counts(cases: DataFrame) -> DataFrame:
    """A3: how often each field is wrong, over compared cases, most frequent first."""
    rows = cases.where(_compared()).select(F.explode("defect_fields").alias("field"))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "field")


def review_reason_counts(cases: DataFrame) -> DataFrame:
    """A4: checks of `has_fields` cases waiting for a person, by reason."""
    open_ = _check() & (F.col("status") == "NEEDS_REVIEW") & F.col("review_reason").isNotNull()
    if "has_fields" in cases.columns:
        open_ = open_ & F.col("has_fields")
    return cases.where(open_).groupBy("review_reason").agg(F.count(F.lit(1)).alias("n"))


def hotspot_table(cases: DataFrame, dim: str) -> DataFrame:
    bad = F.count_if(F.col("status") == "MISMATCH")
    named = F.coalesce(F.nullif(F.col(dim), F.lit("")), F.lit("Unknown")).alias("name")
    return cases.where(_compared()).groupBy(named).agg(F.count(F.lit(1)).alias("checked"), bad.alias("mismatch")).withColumn("rate", F.round(F.col("mismatch") / F.col("checked"), 3))


def hotspots(cases: DataFrame, dim: str, n: int = 12) -> DataFrame:
    """A5: the dimension values with most mismatches (a top-n report; ties by name)."""
    return hotspot_table(cases, dim).orderBy(F.col("mismatch").desc(), F.col("rate").desc(), "name").limit(n)


def workload(cases: DataFrame, users: DataFrame) -> DataFrame:
    """Assigned and open cases per person; aggregated before the names are joined."""
    per = cases.where(F.col("assignee_id").isNotNull()).groupBy("assignee_id").agg(F.count(F.lit(1)).alias("assigned"), F.count_if(_open_review()).alias("open_review"))
    named = per.join(users.select(F.col("user_id").alias("assignee_id"), F.col("name")), "assignee_id", "left").withColumn("name", F.coalesce("name", F.lit("?")))
    return named.groupBy("name").agg(F.sum("assigned").alias("assigned"), F.sum("open_review").alias("open_review")).orderBy(F.col("assigned").desc(), "name")


def time_to_resolve(cases: DataFrame) -> DataFrame:
    """Resolved cases, and the mean minutes where the answer came after the check."""
    settled = F.col("resolved") & F.col("resolved_at").isNotNull() & F.col("processed_at").isNotNull()
    micros = F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("processed_at").cast("timestamp"))
    # whole microseconds are summed, so the mean does not depend on the order of the parts
    total = F.sum(F.when(settled & (micros >= 0), micros).cast("decimal(38,0)"))
    return cases.agg(F.count_if(settled).alias("resolved"), F.round(F.try_divide(total.cast("double"), F.count_if(settled & (micros >= 0))) / 60e6, 1).alias("avg_minutes"))


def _in_scope(rows: DataFrame, cases: DataFrame) -> DataFrame:
    return rows.join(cases.select("case_id"), "case_id", "left_semi")


def corrections_by(corrections: DataFrame, cases: DataFrame, by: str = "kind") -> DataFrame:
    """Corrections of the covered cases by kind or by day."""
    key = F.col("kind") if by == "kind" else F.date_format("at", "yyyy-MM-dd").alias("day")
    return _in_scope(corrections, cases).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def correction_rate(corrections: DataFrame, cases: DataFrame) -> DataFrame:
    """Corrected cases (of any category) over checks."""
    touched = _in_scope(corrections, cases).agg(F.count(F.lit(1)).alias("corrections"), F.count_distinct("case_id").alias("cases_corrected"))
    checks = cases.agg(F.count_if(_check()).alias("_checks")).scalar()
    return touched.withColumn("rate", _share(F.col("cases_corrected"), checks))


def timeline(cases: DataFrame) -> DataFrame:
    """Checks per day and status, keyed by the full date."""
    names = ["OK", "MISMATCH", "NEEDS_REVIEW", "FAILED", "PENDING"]
    day = F.date_format("received_at", "yyyy-MM-dd").alias("day")
    return cases.where(_check()).groupBy(day).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in names])


def headline(cases: DataFrame) -> DataFrame:
    """Every scalar metric in one pass."""
    check, compared, status = _check(), _compared(), F.col("status")
    auto = check & ~F.col("needs_human")
    base = cases.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(check).alias("checks"),
        F.count_if(compared).alias("compared"),
        F.count_if(auto).alias("auto_count"),
        F.count_if(check & (status == "MISMATCH")).alias("mistake"),
        F.count_if(compared & (status == "OK")).alias("clean"),
        F.count_if(check & (status == "NEEDS_REVIEW")).alias("person"),
        F.count_if(check & (status == "FAILED")).alias("failed"),
        F.count_if(check & (status == "OK") & ~F.col("compared")).alias("nothing_yet"),
        F.count_if(_open_review()).alias("open_review"),
        F.count_if(compared & (F.col("confidence") > 0) & (F.col("confidence") < 0.8)).alias("low_confidence"),
    )
    auto_share = F.try_divide(F.col("auto_count"), F.col("checks"))
    return base.select(
        "*",
        _share(F.col("auto_count"), F.col("checks")).alias("auto_rate"),
        F.coalesce(F.round(1 - auto_share, 3), F.lit(0.0)).alias("review_rate"),
        _share(F.col("mistake"), F.col("compared")).alias("mismatch_rate"),
    )


def rates(cases: DataFrame) -> DataFrame:
    """A10."""
    return headline(cases).select("auto_rate", "review_rate", "mismatch_rate")


def outcome(cases: DataFrame) -> DataFrame:
    """A11."""
    return headline(cases).select("clean", "mistake", "person", "failed", "nothing_yet")


def overrule_metrics(corrections: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases people overruled, their share of the checks, and edited replies."""
    rows = _in_scope(corrections, cases)
    ruled = F.col("kind").isin(specs.OVERRULE_KINDS)
    counts = rows.agg(F.count_distinct(F.when(ruled, F.col("case_id"))).alias("overruled_cases"), F.count_if(F.col("kind") == "draft").alias("replies_edited"))
    whole = cases.agg(F.struct(F.count_if(_check()).alias("checks"), F.count_if(F.col("status") == "FAILED").alias("failed")).alias("s")).scalar()
    df = counts.withColumn("_s", whole)
    return df.select("overruled_cases", _share(F.col("overruled_cases"), F.col("_s.checks")).alias("overruled_rate"), "replies_edited", F.col("_s.failed").alias("failed"))


def overrules_by_kind(corrections: DataFrame, cases: DataFrame) -> DataFrame:
    """(kind, n, cases) of what people overruled; kinds nobody overruled are listed with zero."""
    kinds = F.explode(F.array(*[F.lit(k) for k in specs.OVERRULE_KINDS])).alias("kind")
    found = _in_scope(corrections, cases).where(F.col("kind").isin(specs.OVERRULE_KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))
    listed = corrections.sparkSession.range(1).select(kinds)
    return listed.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cases", F.lit(0)).alias("cases"))


def overruled_fields(corrections: DataFrame, cases: DataFrame, n: int = 7) -> DataFrame:
    """The fields people corrected most (a top-n report)."""
    rows = _in_scope(corrections, cases).where(F.col("kind").isin(specs.OVERRULE_KINDS) & F.col("field").isNotNull())
    label = F.coalesce(look_up(specs.FIELD_TITLES, F.col("field")), F.col("field")).alias("label")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(n)


def queue_and_quality(cases: DataFrame, sent: DataFrame) -> DataFrame:
    """The open queue, weak comparisons, and covered cases that got a reply."""
    replied = _in_scope(sent.select("case_id"), cases).agg(F.count_distinct("case_id").alias("n")).scalar()
    return headline(cases).select("open_review", "low_confidence").withColumn("replies_sent", replied)


def assisted_counts(cases: DataFrame, values: DataFrame) -> DataFrame:
    """Cases whose category, or any of whose values, came from the assistant; cases with a preview."""
    read = _in_scope(values.where(F.col("method") == "llm"), cases).agg(F.count_distinct("case_id").alias("n")).scalar()
    return cases.agg(F.count_if(F.col("decided_by") == "llm").alias("sorted_by_assistant"), F.count_if(F.col("preview").isNotNull()).alias("previews")).withColumn("read_by_assistant", read)


def cost_by_task(usage: DataFrame) -> DataFrame:
    """Calls and spend per task, dearest first."""
    return usage.groupBy("task").agg(F.sum("calls").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")).orderBy(F.col("cost_usd").desc(), "task")


def cost_rollup(usage: DataFrame, cases: DataFrame) -> DataFrame:
    """Spend in total, per message, per check and per thousand messages."""
    whole = cases.agg(F.struct(F.count(F.lit(1)).alias("messages"), F.count_if(_check()).alias("checks")).alias("s")).scalar()
    df = usage.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_spent")).withColumn("_s", whole)
    return df.select(
        "calls",
        F.round("_spent", 4).alias("spent_usd"),
        _share(F.col("_spent"), F.col("_s.messages"), 6).alias("per_message_usd"),
        _share(F.col("_spent"), F.col("_s.checks"), 6).alias("per_check_usd"),
        F.coalesce(F.round(F.try_divide(F.col("_spent"), F.col("_s.messages")) * 1000, 2), F.lit(0.0)).alias("per_1000_messages_usd"),
    )


def worst_hotspot(cases: DataFrame, dim: str, min_support: int = 3) -> DataFrame:
    """Of all values with enough checks and a mismatch, the one with the highest rate."""
    listed = hotspot_table(cases, dim).where((F.col("checked") >= min_support) & (F.col("mismatch") > 0))
    return listed.orderBy(F.col("rate").desc(), F.col("mismatch").desc(), "name").limit(1)


def advice_flags(cases: DataFrame, corrections: DataFrame) -> DataFrame:
    """The four suggestions of the report as booleans, by fixed limits."""
    main = headline(cases)
    unreadable = review_reason_counts(cases).where(F.col("review_reason") == "unreadable").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    rate = correction_rate(corrections, cases).select("rate").scalar()
    hottest = hotspot_table(cases, "carrier").where((F.col("checked") >= 3) & (F.col("mismatch") > 0)).agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("r")).scalar()
    df = main.withColumn("_u", unreadable).withColumn("_c", rate).withColumn("_h", hottest)
    return df.select(
        (F.col("_u") >= 3).alias("ask_for_text_files"),
        ((F.col("_c") == 0) & (F.col("low_confidence") == 0) & (F.col("review_rate") < 0.15)).alias("thresholds_look_safe"),
        (F.col("_c") > 0.1).alias("review_learned_aliases"),
        (F.col("_h") > 0.35).alias("second_look_at_hotspot"),
    )


def suggestion_status_counts(suggestions: DataFrame) -> DataFrame:
    """A17."""
    return suggestions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def hours_saved(cases: DataFrame, minutes_per_check: float = 10.0) -> DataFrame:
    """A17."""
    return headline(cases).select("auto_count", F.round(F.col("auto_count") * minutes_per_check / 60, 1).alias("hours_saved"))


def metrics_cube(cases: DataFrame) -> DataFrame:
    """Check counts by carrier, customer and status with all subtotals from one scan."""
    base = cases.where(_check()).select(F.coalesce("carrier", F.lit("Unknown")).alias("carrier"), F.coalesce("customer", F.lit("Unknown")).alias("customer"), "status", _compared().alias("c"))
    # counted per finest group first: the cube then expands a few groups instead of every case
    fine = base.groupBy("carrier", "customer", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("c"))
    return fine.cube("carrier", "customer", "status").agg(F.grouping_id().alias("level"), F.sum("n").alias("checks"), F.sum("c").alias("compared"))
