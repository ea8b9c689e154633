"""Record reconciliation: two sources, seven fields, one verdict per case.

`field_values` is long: case_id, side (SI or BL), field, raw, label, confidence, blank, method. Everything here
is keyed by the case; `pair_fields` shuffles the values once by case_id and every later aggregate on
(case_id, field) or case_id reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import specs
from concord.functions.lookup import look_up_in
from concord.functions.regex import first_of, look_up
from concord.functions.similarity import Similarity
from concord.functions.values import ascii_upper, container_count, is_order_only, party_core, party_norm, port_candidates, port_key, port_parts, weight_kg
from concord.operators.knowledge import active_aliases


def field_grid(cases: DataFrame) -> DataFrame:
    """Every case with every field: (case_id, field)."""
    return cases.select("case_id", F.explode(F.array(*[F.lit(f) for f in specs.FIELDS])).alias("field"))


def standard_forms(field_values: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """Add the comparable form of every value as `norm`: struct(party, core, order_only, port, parts, count, weight).

    Runs on the single values, before any shuffle. Learned aliases need three lookups: the party name or the full
    port text, the city, and the city with "PORT " in front.
    """
    # one fold serves all kinds of values, as a column of its own; the field is tested on the input, not around the
    # result: inside a CASE branch Spark does not share subexpressions
    df = field_values.withColumn("_up", ascii_upper(F.when(~_is("gross_weight_kg"), F.col("raw"))))
    df = df.select(
        "*",
        F.when(_is(*specs.PARTY_FIELDS), F.col("_up")).alias("_party_text"),
        F.when(_is(*specs.PORT_FIELDS), F.col("_up")).alias("_port_text"),
        F.when(_is("container_count"), F.col("_up")).alias("_count_text"),
        F.when(_is("gross_weight_kg"), F.col("raw")).alias("_weight_text"),
    )
    df = df.select(
        *field_values.columns,
        party_norm(F.col("_party_text"), F.col("_party_text")).alias("_party"),
        is_order_only(F.col("_party_text"), F.col("_party_text")).alias("_order_only"),
        port_parts(F.col("_port_text"), F.col("_port_text")).alias("_parts"),
        container_count(F.col("_count_text"), F.col("_count_text")).alias("_count"),
        weight_kg(F.col("_weight_text"), F.col("label")).alias("_weight"),
    )
    learned, party = None, F.col("_party")
    if knowledge is not None:
        tagged = active_aliases(knowledge, "party_alias").withColumn("key", F.concat(F.lit("party:"), "key")).unionByName(
            active_aliases(knowledge, "port_alias").withColumn("key", F.concat(F.lit("port:"), "key"))
        )
        ports = [F.concat(F.lit("port:"), name) for name in port_candidates(F.col("_parts"))]
        keys = [F.coalesce(F.concat(F.lit("party:"), "_party"), ports[0]), ports[1], ports[2]]
        for i, key in enumerate(keys):
            df = look_up_in(df, key, tagged, "key", "value", f"_alias{i}", "case_id")
        learned = [F.col(f"_alias{i}") for i in range(3)]
        party = F.when(party.isNotNull(), F.coalesce("_alias0", "_party"))
    df = df.withColumn("_party", party)
    norm = F.struct(
        F.col("_party").alias("party"),
        party_core(F.col("_party")).alias("core"),
        F.col("_order_only").alias("order_only"),
        port_key(F.col("_parts"), learned).alias("port"),
        F.col("_parts").alias("parts"),
        F.col("_count").alias("count"),
        F.col("_weight").alias("weight"),
    )
    return df.withColumn("norm", norm).drop("_party", "_order_only", "_parts", "_count", "_weight", "_alias0", "_alias1", "_alias2")


VALUE = ["raw", "confidence", "blank", "method", "norm"]


def pair_fields(compared: DataFrame, standard: DataFrame) -> DataFrame:
    """Both sides of every field of every compared case, absent sides as nulls.

    A union and one aggregate do the full outer alignment: the values and the case x field grid meet in a single
    shuffle by case, and a case has at most 21 such rows. Of a port's parts only what the rules read is moved.
    """
    narrow = standard.withColumn("norm", F.col("norm").dropFields("parts.full", "parts.city"))
    values = narrow.select("case_id", "field", "side", F.struct(*VALUE).alias("value"), F.lit(False).alias("in_grid"))
    kind = values.schema["value"].dataType
    grid = field_grid(compared).select("case_id", "field", F.lit(None).cast("string").alias("side"), F.lit(None).cast(kind).alias("value"), F.lit(True).alias("in_grid"))
    return (
        values.unionByName(grid)
        .repartition("case_id")
        .groupBy("case_id", "field")
        .agg(
            F.first(F.when(F.col("side") == "SI", F.col("value")), ignorenulls=True).alias("l"),
            F.first(F.when(F.col("side") == "BL", F.col("value")), ignorenulls=True).alias("r"),
            F.max("in_grid").alias("in_grid"),
        )
        .where("in_grid")
        .drop("in_grid")
    )


def _is(*fields: str) -> Column:
    return F.col("field").isin(*fields)


def _outcome(result: str, confidence: float, finding: str | Column) -> Column:
    text = F.lit(finding) if isinstance(finding, str) else finding
    return F.struct(F.lit(result).alias("result"), F.lit(confidence).alias("confidence"), text.alias("finding"))


def _between(*parts: str | Column) -> Column:
    """One sentence of literals and values; an absent value reads as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _unread(what: str, l: Column) -> Column:
    return _between(f"no {what} can be read on the ", F.when(l.isNull(), F.lit("SI")).otherwise(F.lit("BL")))


def _party_rule(match_ratio: float, unsure_ratio: float) -> Column:
    """R2, tested in this order."""
    l, r = F.col("l.norm.party"), F.col("r.norm.party")
    same_core = (F.col("l.norm.core") != "") & (F.col("l.norm.core") == F.col("r.norm.core"))
    typo, close = Similarity.at_least(match_ratio), Similarity.at_least(unsure_ratio)
    return first_of(
        [
            (l == r, _outcome("match", 0.99, "the names agree")),
            (F.col("l.norm.order_only") | F.col("r.norm.order_only"), _outcome("unsure", 0.5, "an order clause stands where a name is needed")),
            (same_core, _outcome("unsure", 0.55, "the names agree but for the legal form")),
            ((F.abs(F.length(l) - F.length(r)) <= 2) & typo, _outcome("match", 0.75, "the names differ by a slip of the pen")),
            (close, _outcome("unsure", 0.5, _between("the names resemble each other: ", l, " and ", r))),
        ],
        _outcome("mismatch", 0.97, _between("two companies: ", l, " and ", r)),
    )


def _port_rule() -> Column:
    """The name decides, country and code are evidence."""
    l, r, lp, rp = F.col("l.norm.port"), F.col("r.norm.port"), F.col("l.norm.parts"), F.col("r.norm.parts")
    both_countries = (lp["country"] != "") & (rp["country"] != "")
    other_country = both_countries & (lp["country"] != rp["country"])
    other_code = lp["locode"].isNotNull() & rp["locode"].isNotNull() & (lp["locode"] != rp["locode"])
    close = Similarity.at_least(specs.PORT_UNSURE_RATIO)
    same_code = F.when(lp["locode"] == rp["locode"], F.concat(F.lit("; both carry the code "), lp["locode"]))
    return first_of(
        [
            ((l == r) & other_country, _outcome("unsure", 0.5, _between("one town in two countries: ", lp["country"], " and ", rp["country"]))),
            ((l == r) & other_code, _outcome("unsure", 0.55, _between("one town with two codes: ", lp["locode"], " and ", rp["locode"]))),
            (l == r, _outcome("match", 0.99, "the towns agree")),
            (~other_country & close, _outcome("unsure", 0.5, _between("the towns are spelled nearly alike: ", l, " and ", r))),
        ],
        _outcome("mismatch", 0.97, _between("two towns: ", l, " and ", r, same_code)),
    )


def _count_rule() -> Column:
    """R4."""
    l, r = F.col("l.norm.count"), F.col("r.norm.count")

    def sizes(c: Column) -> Column:
        return F.array_sort(F.transform(c["sizes"], lambda s: F.left(s, F.lit(2))))

    resized = (F.size(l["sizes"]) > 0) & (F.size(r["sizes"]) > 0) & (sizes(l) != sizes(r))
    return first_of(
        [
            (l["count"].isNull() | r["count"].isNull(), _outcome("unsure", 0.4, _unread("count", l["count"]))),
            (l["count"] != r["count"], _outcome("mismatch", 0.98, _between(l["count"], " containers against ", r["count"]))),
            (resized, _outcome("match", 0.8, "the counts agree, the sizes do not")),
        ],
        _outcome("match", 0.99, "the counts agree"),
    )


def _weight_rule(tolerance_kg: float, tolerance_pct: float) -> Column:
    """The larger of an absolute tolerance and a share of the left value."""
    l, r = F.col("l.norm.weight"), F.col("r.norm.weight")
    return first_of(
        [
            (l.isNull() | r.isNull(), _outcome("unsure", 0.4, _unread("weight", l))),
            (l == r, _outcome("match", 0.99, "the weights agree")),
            (F.abs(l - r) <= F.greatest(F.lit(tolerance_kg), tolerance_pct / 100 * l), _outcome("match", 0.99, "the weights agree within the tolerance")),
        ],
        _outcome("mismatch", 0.98, _between(_weight_text(l), " kg against ", _weight_text(r), " kg")),
    )


def _weight_text(weight: Column) -> Column:
    return F.when(weight == F.floor(weight), weight.cast("bigint").cast("string")).otherwise(weight.cast("string"))


def _norm_text(s: str) -> Column:
    return F.coalesce(f"{s}.norm.party", f"{s}.norm.port", F.col(f"{s}.norm.count.count").cast("string"), _weight_text(F.col(f"{s}.norm.weight")))


def reconcile(
    compared: DataFrame,
    field_values: DataFrame,
    knowledge: DataFrame | None = None,
    *,
    tolerance_kg: float = specs.WEIGHT_TOLERANCE_KG,
    tolerance_pct: float = specs.WEIGHT_TOLERANCE_PCT,
    match_ratio: float = specs.PARTY_MATCH_RATIO,
    unsure_ratio: float = specs.PARTY_UNSURE_RATIO,
) -> DataFrame:
    """One row per compared case and field with result, confidence, normal forms, the missing side and what was
    found, in a sentence."""
    df = pair_fields(compared, standard_forms(field_values, knowledge))
    names = [F.coalesce(f"{s}.norm.party", f"{s}.norm.port") for s in ("l", "r")]
    df = Similarity(*names, match_ratio, unsure_ratio, specs.PORT_UNSURE_RATIO).add(df)
    l_missing = F.col("l").isNull() | F.coalesce(F.col("l.blank"), F.lit(False))
    r_missing = F.col("r").isNull() | F.coalesce(F.col("r.blank"), F.lit(False))
    side = first_of([(l_missing & r_missing, F.lit("both")), (l_missing, F.lit("SI")), (r_missing, F.lit("BL"))])

    def why(s: str, name: str) -> Column:
        return first_of(
            [
                (F.col(s).isNull(), F.lit(f"{name} has no such line")),
                (F.col(f"{s}.blank"), F.concat(F.lit(f"{name} leaves it open (“"), F.coalesce(F.col(f"{s}.raw"), F.lit("")), F.lit("”)"))),
            ]
        )

    rule = first_of(
        [
            (_is(*specs.PARTY_FIELDS), _party_rule(match_ratio, unsure_ratio)),
            (_is(*specs.PORT_FIELDS), _port_rule()),
            (_is("container_count"), _count_rule()),
        ],
        _weight_rule(tolerance_kg, tolerance_pct),
    )
    df = df.withColumn("missing_side", side).withColumn("rule", F.when(F.col("missing_side").isNull(), rule))
    capped = F.round(F.least(F.col("rule.confidence"), F.col("l.confidence"), F.col("r.confidence")), 3)
    found = F.col("missing_side").isNull()
    return df.select(
        "case_id",
        "field",
        F.coalesce(F.col("rule.result"), F.lit("missing")).alias("result"),
        F.when(found, capped).otherwise(F.lit(0.9)).alias("confidence"),
        F.col("l.raw").alias("left_value"),
        F.col("r.raw").alias("right_value"),
        F.when(found, _norm_text("l")).alias("left_norm"),
        F.when(found, _norm_text("r")).alias("right_norm"),
        "missing_side",
        F.when(~found, F.concat_ws("; ", why("l", "SI"), why("r", "BL"))).alias("missing_reason"),
        F.when(found, F.col("rule.finding")).otherwise(F.concat_ws("; ", why("l", "SI"), why("r", "BL"))).alias("finding"),
        (F.coalesce(F.col("l.method") == "ocr", F.lit(False)) | F.coalesce(F.col("r.method") == "ocr", F.lit(False))).alias("from_scan"),
    )


def not_compared(pairs: DataFrame, field_values: DataFrame) -> DataFrame:
    """A row per field of every check that lacks one of its two documents, in the columns of `reconcile`.

    `pairs` holds case_id, si_doc, bl_doc (null where there is none). What the document at hand says stands beside, so
    a person sees it; only the values of these checks are moved.
    """
    lone = pairs.where(F.col("si_doc").isNull() | F.col("bl_doc").isNull())
    absent = F.concat_ws(" and ", F.when(F.col("si_doc").isNull(), F.lit("SI")), F.when(F.col("bl_doc").isNull(), F.lit("BL")))
    grid = lone.select("case_id", F.explode(F.array(*[F.lit(f) for f in specs.FIELDS])).alias("field"), F.concat(F.lit("not compared for want of "), absent).alias("finding"))
    own = field_values.join(lone.select("case_id"), "case_id", "left_semi")
    raw = own.groupBy("case_id", "field").agg(*[F.max(F.when(F.col("side") == s, F.col("raw"))).alias(n) for s, n in (("SI", "left_value"), ("BL", "right_value"))])
    none = F.lit(None).cast("string")
    return grid.join(raw, ["case_id", "field"], "left").select(
        "case_id", "field", F.lit("not_compared").alias("result"), F.lit(0.0).alias("confidence"), "left_value", "right_value",
        none.alias("left_norm"), none.alias("right_norm"), none.alias("missing_side"), none.alias("missing_reason"), "finding", F.lit(False).alias("from_scan"),
    )


def apply_thresholds(results: DataFrame, limits: dict[str, float] | DataFrame | None = None, default: float = specs.FIELD_REVIEW_BELOW) -> DataFrame:
    """A match or mismatch below its field's threshold becomes unsure; the earlier result is kept beside it.

    `limits` is a small settings dict or a table (field, review_below).
    """
    if isinstance(limits, DataFrame):
        df = results.join(limits.select("field", F.col("review_below").alias("_limit")), "field", "left")
    else:
        df = results.withColumn("_limit", look_up(limits, F.col("field")) if limits else F.lit(None).cast("double"))
    limit = F.coalesce("_limit", F.lit(default))
    weak = F.col("result").isin("match", "mismatch") & (F.col("confidence") < limit)
    df = df.withColumn("_weak", weak)
    if "finding" in df.columns:  # why the result does not stand
        short = _between("; sure to ", F.round(F.col("confidence") * 100).cast("int"), " %, where ", F.round(limit * 100).cast("int"), " % are asked for")
        df = df.withColumn("finding", F.when(F.col("_weak"), F.concat("finding", short)).otherwise(F.col("finding")))
    return df.withColumn("result_before", F.when(F.col("_weak"), F.col("result"))).withColumn(
        "result", F.when(F.col("_weak"), F.lit("unsure")).otherwise(F.col("result"))
    ).drop("_limit", "_weak")


def _rank(value: Column, names: list[str]) -> Column:
    return look_up({n: i for i, n in enumerate(names)}, value)


def roll_up(cases: DataFrame, results: DataFrame, reasons: DataFrame | None = None, *, classify_below: float = specs.CLASSIFY_REVIEW_BELOW) -> DataFrame:
    """One verdict per check.

    `cases` holds case_id, category_confidence and awaiting_draft; `results` comes from `apply_thresholds`,
    `reasons` from the completeness checks (case_id, reason, detail). All three meet in one aggregate by case;
    the collected lists hold at most seven fields and a handful of reasons per case. `review_detail` says what a person
    has to look at: the reasons, else the fields that are not certain; or that a check waits for its draft.
    """
    facts = results.select(
        "case_id",
        "field",
        "result",
        "confidence",
        F.lit(None).cast("double").alias("category_confidence"),
        F.lit(None).cast("boolean").alias("awaiting_draft"),
        F.when(F.col("result") == "missing", F.lit("missing_value")).alias("reason"),
        F.when(F.col("result") == "missing", F.concat(F.col("field"), F.lit(": "), F.col("missing_reason"))).alias("detail"),
        "from_scan",
        F.when(F.col("result") == "unsure", F.concat_ws(": ", "field", "finding") if "finding" in results.columns else F.col("field")).alias("doubt"),
    )
    blank = {"field": "string", "result": "string", "confidence": "double", "reason": "string", "detail": "string", "from_scan": "boolean", "doubt": "string"}
    heads = cases.select("case_id", "category_confidence", F.coalesce("awaiting_draft", F.lit(False)).alias("awaiting_draft"),
                         *[F.lit(None).cast(t).alias(n) for n, t in blank.items()])
    facts = facts.unionByName(heads)
    if reasons is not None:
        extra = reasons.select("case_id", "reason", "detail", F.lit(None).cast("double").alias("category_confidence"), F.lit(None).cast("boolean").alias("awaiting_draft"),
                                          *[F.lit(None).cast(t).alias(n) for n, t in blank.items() if n not in ("reason", "detail")])
        facts = facts.unionByName(extra)
    priority = _rank(F.col("reason"), specs.REASON_PRIORITY)
    order = F.struct(_rank(F.col("field"), specs.FIELDS).alias("o"), F.col("field").alias("v"))
    grouped = facts.groupBy("case_id").agg(
        F.max("category_confidence").alias("category_confidence"),
        F.max("awaiting_draft").alias("awaiting_draft"),
        F.min_by("reason", priority).alias("top_reason"),
        F.array_sort(F.collect_set(F.when(F.col("detail").isNotNull(), F.struct(priority.alias("p"), _rank(F.col("field"), specs.FIELDS).alias("o"), F.col("detail").alias("v"))))).alias("details"),
        F.array_sort(F.collect_list(F.when(F.col("result") == "mismatch", order))).alias("mismatches"),
        F.array_sort(F.collect_list(F.when(F.col("doubt").isNotNull(), F.struct(_rank(F.col("field"), specs.FIELDS).alias("o"), F.col("doubt").alias("v"))))).alias("doubts"),
        F.coalesce(F.bool_or(F.col("result") == "unsure"), F.lit(False)).alias("any_unsure"),
        F.coalesce(F.bool_or((F.col("result") == "unsure") & F.col("from_scan")), F.lit(False)).alias("unsure_scan"),
        F.min(F.when(F.col("result").isin("match", "mismatch"), F.col("confidence"))).alias("weakest"),
    ).where(F.col("awaiting_draft").isNotNull())
    waiting, has_reason = F.col("awaiting_draft"), F.col("top_reason").isNotNull()
    names = F.transform("mismatches", lambda m: m["v"])
    none = F.array().cast("array<string>")
    status = first_of(
        [(waiting, F.lit("OK")), (has_reason | F.col("any_unsure"), F.lit("NEEDS_REVIEW")), (F.size("mismatches") > 0, F.lit("MISMATCH"))], F.lit("OK")
    )
    df = grouped.withColumn("status", status)
    review = F.col("status") == "NEEDS_REVIEW"
    return df.select(
        "case_id",
        "status",
        F.when(review, F.coalesce("top_reason", F.when(F.col("unsure_scan"), F.lit("unreadable")).otherwise(F.lit("missing_value")))).alias("review_reason"),
        first_of(
            [
                (waiting, F.lit("a draft is asked for, so there is nothing to compare yet")),
                (review & has_reason, F.array_join(F.transform("details", lambda d: d["v"]), "; ")),
                (review, F.concat(F.lit("not certain: "), F.array_join(F.transform("doubts", lambda d: d["v"]), "; "))),
            ]
        ).alias("review_detail"),
        F.when(F.col("status") == "MISMATCH", names).otherwise(none).alias("defect_fields"),
        F.when(review, names).otherwise(none).alias("proposed_defects"),
        case_confidence(F.col("category_confidence"), F.when(~waiting, F.col("weakest"))).alias("confidence"),
        (review | (~waiting & (F.col("category_confidence") < classify_below))).alias("needs_human"),
        "category_confidence",
    )


def case_confidence(category: Column, weakest_field: Column) -> Column:
    """The weakest link of a case."""
    return F.when(weakest_field.isNull(), category).otherwise(F.round(F.least(category, weakest_field), 3))


def apply_verdicts(cases: DataFrame, overrides: DataFrame) -> DataFrame:
    """reviewers' decisions over computed ones.

    `overrides`: case_id, verdict_status, verdict_defects, verdict_reason, confirmed_status, confirmed_reason,
    review_requested_by, was_resolved; one row per case.
    """
    decided = F.col("verdict_status").isNotNull() & (F.col("status") != "FAILED")
    df = cases.join(overrides, "case_id", "left").withColumn("_decided", decided).withColumn("_judged", F.col("verdict_status").isNotNull())
    df = df.withColumn("ai_status", F.when(F.col("_decided"), F.col("status"))).withColumn("ai_defects", F.when(F.col("_decided"), F.col("defect_fields")))
    for name, verdict in (("status", "verdict_status"), ("defect_fields", "verdict_defects"), ("review_reason", "verdict_reason")):
        df = df.withColumn(name, F.when(F.col("_decided"), F.col(verdict)).otherwise(F.col(name)))
    agreed = (
        ~F.col("_judged")
        & ~F.col("status").isin("FAILED", "PENDING")
        & F.col("confirmed_status").eqNullSafe(F.col("status"))
        & F.col("confirmed_reason").eqNullSafe(F.col("review_reason"))
    )
    asked = F.col("review_requested_by").isNotNull()
    df = df.withColumn("_agreed", agreed)
    human = first_of(
        [(F.col("_agreed") | F.col("_decided"), F.lit(False)), (asked & ~F.col("_judged"), F.lit(True))], F.col("needs_human")
    )
    df = df.withColumn("needs_human", human)
    resolved = F.col("_judged") | F.col("_agreed") | (F.coalesce("was_resolved", F.lit(False)) & ~F.col("needs_human"))
    second_look = asked & ~F.col("_judged") & ~F.col("_agreed") & F.col("status").isin("OK", "MISMATCH")
    if "review_detail" in df.columns:
        note = F.concat(F.col("review_requested_by"), F.lit(" asked for another look"))
        df = df.withColumn("review_detail", F.when(second_look, note).otherwise(F.col("review_detail")))
    return df.withColumn("resolved", resolved).drop("_decided", "_judged", "_agreed", *[c for c in overrides.columns if c != "case_id"])


def derive_verdict(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """A case's verdict from per-field human decisions merged over the computed results.

    Only cases with a decision get a verdict. Both tables are small per case, so one aggregate by case does it.
    """
    both = results.select("case_id", "field", "result", F.lit(None).cast("string").alias("decided")).unionByName(
        decisions.select("case_id", "field", F.lit(None).cast("string").alias("result"), F.col("result").alias("decided"))
    )
    merged = both.groupBy("case_id", "field").agg(F.coalesce(F.max("decided"), F.max("result")).alias("final"), F.max("decided").isNotNull().alias("touched"))
    order = F.struct(_rank(F.col("field"), specs.FIELDS).alias("o"), F.col("field").alias("v"))
    return (
        merged.groupBy("case_id")
        .agg(F.bool_or("touched").alias("touched"), F.array_sort(F.collect_list(F.when(F.col("final") == "mismatch", order))).alias("m"))
        .where("touched")
        .select(
            "case_id",
            F.when(F.size("m") > 0, F.lit("MISMATCH")).otherwise(F.lit("OK")).alias("verdict_status"),
            F.transform("m", lambda x: x["v"]).alias("verdict_defects"),
        )
    )


def close_non_checks(cases: DataFrame, classify_below: float = specs.CLASSIFY_REVIEW_BELOW) -> DataFrame:
    """Messages that ask for no check are done once classified."""
    weak = F.col("category_confidence") < classify_below
    return cases.where(F.col("category").isNotNull() & (F.col("category") != specs.CHECK)).select(
        "case_id",
        "category",
        F.lit("OK").alias("status"),
        F.col("category_confidence").alias("confidence"),
        weak.alias("needs_human"),
        F.when(weak, F.lit("kind of message is not certain")).alias("review_detail"),
    )


def isolate_errors(df: DataFrame, required: dict[str, Column]) -> DataFrame:
    """Rows whose required parse failed become FAILED with the step named; the others keep their status.

    `required` maps a step name to a try_* expression paired with its input: the step failed where the input was
    there and the result is null. Give each as `F.struct(input, result)`.
    """
    failed = [F.when(pair.getField("input").isNotNull() & pair.getField("result").isNull(), F.lit(step)) for step, pair in required.items()]
    step = F.coalesce(*failed)
    return df.withColumn("_step", step).withColumn("status", F.when(F.col("_step").isNotNull(), F.lit("FAILED")).otherwise(F.col("status"))).withColumn(
        "error", F.when(F.col("_step").isNotNull(), F.concat(F.lit("["), F.col("_step"), F.lit("] value could not be read")))
    ).drop("_step")
