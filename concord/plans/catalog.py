"""The registered queries: one per operator, over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import specs
from concord.functions import text as T
from concord.functions import values as N
from concord.functions.similarity import Similarity, indel_ratio
from concord.operators import analytics as A
from concord.operators import boards as S
from concord.operators import cases as Q
from concord.operators import classify as K
from concord.operators import evaluate as V
from concord.operators import extract as E
from concord.operators import hints as H
from concord.operators import knowledge as B
from concord.operators import learning as L
from concord.operators import pairing as P
from concord.operators import reconcile as R
from concord.operators import tagging as G
from concord.plans import bindings as b
from concord.plans import checks
from concord.session import as_table, new_run_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(col: str) -> "F.Column":
    return F.array_join(col, ",").alias(col)


# ---------------------------------------------------------------- shared inputs


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    return b.shipments(spark, sf).select("case_id", F.lit(0.9).alias("category_confidence"), F.lit(False).alias("awaiting_draft"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return R.apply_thresholds(R.reconcile(_checks(spark, sf), b.field_values(spark, sf), B.seed_knowledge(spark)))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return b.documents(spark, sf).drop("variant")


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    return P.assign_roles(checks.prepare_documents(_docs(spark, sf)).drop("text"))


def _mail(spark: SparkSession, sf: str) -> DataFrame:
    return b.messages(spark, sf).select("case_id", "sender", "subject", "body")


def _users(spark: SparkSession) -> DataFrame:
    return B.inline_table(spark, b.TEAM, "user_id int, name string, active boolean")


def _routes(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, carrier, u + 1, k + 1, 1 if carrier == "PIL" else 0) for i, (carrier, (u, k)) in enumerate(specs.DEFAULT_ROUTES.items())]
    return B.inline_table(spark, rows, "route_id int, name string, user_id int, backup_user_id int, priority int")


def _labels(board: DataFrame) -> DataFrame:
    manual = board.where("starred").select("case_id", F.lit("Watch").alias("name")).unionByName(board.where("is_read").select("case_id", F.col("carrier").alias("name")).where("name IS NOT NULL"))
    return G.merge_labels(G.auto_labels(board), G.match_rules(board, G.default_rules()), manual)


def _events(spark: SparkSession, sf: str, ctes: str, name: str) -> DataFrame:
    return b.bind(spark, sf, ctes, f"SELECT * FROM {name}")


def _truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    board = b.case_board(spark, sf)
    truth = board.select("case_id", F.coalesce("category", F.lit("GENERAL")).alias("category"), "status", "review_reason", "defect_fields")
    weak = (F.col("status") == "MISMATCH") & F.col("is_read")
    defects = F.when(weak, F.array(F.lit("container_count"))).otherwise(F.col("defect_fields"))
    pred = board.where(~F.col("archived")).select(
        "case_id", F.when(F.col("starred"), F.lit("SPAM")).otherwise(F.coalesce("category", F.lit("GENERAL"))).alias("category"),
        F.when(weak & F.col("starred"), F.lit("OK")).otherwise(F.col("status")).alias("status"), "review_reason", defects.alias("defect_fields"))
    return truth, pred


# ---------------------------------------------------------------- reconciliation


@query
def case_verdicts(spark, sf):
    """Flagship: standardise, reconcile, threshold and roll up every shipment's two documents."""
    v = R.roll_up(_checks(spark, sf), _results(spark, sf))
    return v.select("case_id", "status", "review_reason", _joined("defect_fields"), _joined("proposed_defects"), "confidence", "needs_human")


@query
def field_reconciliation(spark, sf):
    return _results(spark, sf).select("case_id", "field", "result", "confidence", "left_norm", "right_norm", "missing_side")


@query
def verdict_details(spark, sf):
    """What a person is told about every case under review."""
    v = R.roll_up(_checks(spark, sf), _results(spark, sf))
    return v.where(F.col("status") == "NEEDS_REVIEW").select("case_id", "review_reason", "review_detail")


@query
def field_findings(spark, sf):
    """What each rule found on every field of every shipment."""
    return _results(spark, sf).select("case_id", "field", "result", "finding")


@query
def uncompared_fields(spark, sf):
    """The fields of shipments without both documents, with what the one at hand says."""
    roles = as_table(_roles(spark, sf), new_run_dir(spark), "roles")  # read by three branches
    pairs = P.pair_documents(T.clean_body(_mail(spark, sf)).select("case_id", "message"), roles)
    sides = roles.where(F.col("readable") & F.col("role").isNotNull()).select("case_id", F.col("role").alias("side"))
    values = b.field_values(spark, sf).join(sides, ["case_id", "side"], "left_semi")
    return R.not_compared(pairs, values).select("case_id", "field", "result", "left_value", "right_value", "finding")


@query
def verdict_counts(spark, sf):
    return R.roll_up(_checks(spark, sf), _results(spark, sf)).groupBy("status", "review_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def thresholds_by_field(spark, sf):
    """R7 with a per-field limit."""
    r = R.apply_thresholds(R.reconcile(_checks(spark, sf), b.field_values(spark, sf)), {"container_count": 0.9})
    return r.groupBy("field", "result", "result_before").agg(F.count(F.lit(1)).alias("n"))


@query
def reviewed_verdicts(spark, sf):
    """R10 over the case board: verdicts, confirmations and review requests by reviewers."""
    board = b.case_board(spark, sf).drop("resolved")
    ov = board.select(
        "case_id",
        F.when(F.col("is_read"), F.lit("MISMATCH")).alias("verdict_status"), F.when(F.col("is_read"), F.array(F.lit("shipper"))).alias("verdict_defects"),
        F.lit(None).cast("string").alias("verdict_reason"),
        F.when(F.col("archived"), F.lit("NEEDS_REVIEW")).when(F.col("starred"), F.lit("OK")).alias("confirmed_status"),
        F.when(F.col("archived"), F.lit("missing_value")).alias("confirmed_reason"),
        F.when(F.col("confidence") < 0.8, F.lit("Maya")).alias("review_requested_by"), F.col("starred").alias("was_resolved"))
    out = R.apply_verdicts(board, ov)
    return out.select("case_id", "status", _joined("defect_fields"), "review_reason", "ai_status", "needs_human", "resolved")


@query
def derived_verdicts(spark, sf):
    """Per-field decisions of reviewers merged over computed results."""
    res = _results(spark, sf)
    c = b.corrections(spark, sf).where((F.col("kind") == "field_result") & F.col("field").isNotNull())
    dec = c.groupBy("case_id", "field").agg(F.max_by("final_value", "id").alias("result"))
    return R.derive_verdict(res, dec).select("case_id", "verdict_status", _joined("verdict_defects"))


@query
def closed_non_checks(spark, sf):
    board = b.case_board(spark, sf).withColumn("category_confidence", F.when(F.col("starred"), F.lit(0.5)).otherwise(F.lit(0.9)))
    return R.close_non_checks(board)


@query
def isolated_errors(spark, sf):
    """R13 on event properties: the parse that fails marks its own row."""
    ev = b.load(spark, sf, "events")["events"].withColumn("status", F.lit("OK"))
    number = F.get_json_object("props", "$.k").try_cast("tinyint")
    big = F.when(F.col("value") > 100, F.lit("x")).otherwise(F.lit("1"))
    df = R.isolate_errors(ev, {"read": F.struct(F.col("props").alias("input"), number.alias("result")), "parse": F.struct(big.alias("input"), big.try_cast("int").alias("result"))})
    return df.groupBy("event_type", "status", "error").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- standard forms


def _variants(spark: SparkSession, sf: str, fields: list[str], canonical) -> DataFrame:
    fv = R.standard_forms(b.field_values(spark, sf).where(F.col("field").isin(fields)))
    per = fv.groupBy(canonical.alias("canonical"), "raw").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("canonical").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"))


@query
def standard_parties(spark, sf):
    return _variants(spark, sf, specs.PARTY_FIELDS, F.col("norm.party"))


@query
def standard_ports(spark, sf):
    return _variants(spark, sf, specs.PORT_FIELDS, F.col("norm.port"))


@query
def standard_counts(spark, sf):
    return _variants(spark, sf, ["container_count"], F.col("norm.count.count"))


@query
def standard_weights(spark, sf):
    return _variants(spark, sf, ["gross_weight_kg"], F.col("norm.weight"))


@query
def folded_text(spark, sf):
    """N9 over whole documents."""
    docs = b.load(spark, sf, "documents")["documents"]
    return docs.select("doc_id", F.length(N.ascii_upper(F.col("text"))).cast("bigint").alias("n_chars"), F.md5(N.ascii_upper(F.col("text"))).alias("digest"))


@query
def similar_customers(spark, sf):
    """Exact indel similarity of the draft's consignee to the instruction's."""
    f = b.forms(spark, sf).select("case_id", N.party_norm(F.col("si_consignee")).alias("l"), N.party_norm(F.col("bl_consignee")).alias("r"))
    tests = Similarity(F.col("l"), F.col("r"), 0.94, 0.85)
    return tests.add(f).select(
        "case_id", F.round(indel_ratio(F.col("l"), F.col("r")), 6).alias("ratio"), tests.at_least(0.94).alias("same"), tests.at_least(0.85).alias("close")
    )


# ---------------------------------------------------------------- text


@query
def message_parts(spark, sf):
    """The cut parts; the oracle knows them from before they were put together."""
    return T.clean_body(_mail(spark, sf)).select("case_id", "message", "signature", "quoted", "banner")


@query
def message_traffic(spark, sf):
    """T0 (T2-T5): messages per customer and reference kind."""
    return T.customer_traffic(T.enrich_messages(_mail(spark, sf)))


@query
def message_facts(spark, sf):
    """T2-T5, T7 per message."""
    e = T.enrich_messages(_mail(spark, sf))
    return e.select("case_id", "snippet", "oc_no", "bl_no", "invoice", "customer", "hello")


@query
def file_roles(spark, sf):
    return _docs(spark, sf).select("doc_id", T.filename_role(F.col("name")).alias("role"))


@query
def document_sentences(spark, sf):
    """T8 over whole documents."""
    docs = b.load(spark, sf, "documents")["documents"]
    return docs.select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query
def value_differences(spark, sf):
    """T9 for every order; one without lines has no documents, so its parts are null."""
    f = b.forms(spark, sf)
    return f.select("case_id", T.diff_values(F.col("si_shipper"), F.col("bl_shipper")).alias("d")).select("case_id", "d.*")


@query
def readable_subjects(spark, sf):
    c = b.case_board(spark, sf)
    return c.select("case_id", T.readable_subject(F.col("category"), F.col("carrier"), F.col("customer"), F.col("pod"), F.col("sender"), F.when(F.col("compared"), F.lit(2)).otherwise(F.lit(0))).alias("line"))


@query
def document_types(spark, sf):
    d = checks.prepare_documents(_docs(spark, sf))
    return d.select("doc_id", "readable", "type", "subtype", "type_confidence")


# ---------------------------------------------------------------- classification


@query
def cue_scores(spark, sf):
    """K1: score per message and category."""
    k = K.score_cues(T.clean_body(_mail(spark, sf)))
    return k.select("case_id", F.explode_outer("cue_scores").alias("category", "score"))


@query
def classified_messages(spark, sf):
    """K1-K4 with attached documents."""
    kinds = checks.prepare_documents(_docs(spark, sf)).select("case_id", "type")
    return K.classify(T.clean_body(_mail(spark, sf)), kinds).select("case_id", "category", "category_confidence")


@query
def signal_scores(spark, sf):
    kinds = checks.prepare_documents(_docs(spark, sf)).select("case_id", "type")
    return K.score_signals(_mail(spark, sf), kinds).select("case_id", F.explode_outer("signal_scores").alias("category", "score"))


HINTS = [(r"query\s+on\s+invoice", "INVOICE_QUERY", 4.0), ("automated", "NOTICE", 2.0), ("shipment 5RMY-000", "GENERAL", 0.5)]


@query
def hint_scores(spark, sf):
    return K.score_hints(T.clean_body(_mail(spark, sf)), HINTS).select("case_id", F.explode_outer("hint_scores").alias("category", "score"))


def _classified_with(spark: SparkSession, sf: str, hints: DataFrame) -> DataFrame:
    kinds = checks.prepare_documents(_docs(spark, sf)).select("case_id", "type")
    return K.classify(T.clean_body(_mail(spark, sf)), kinds, hints).select("case_id", "category", "category_confidence")


@query
def hinted_messages(spark, sf):
    """K3 as a table: one hint for each urgent order, found by its reference, beside a few without a required literal."""
    urgent = b.messages(spark, sf).where("k % 3 = 0")
    own = urgent.select(F.col("k").alias("hint_id"), F.concat(F.lit(r"\s+"), F.lower("bl_no"), F.lit(r"\s+and\s+confirm")).alias("pattern"), F.lit("URGENT").alias("category"), F.lit(9.0).alias("weight"))
    few = [(-3, "gift|prize", "SPAM", 1.5), (-2, r"docs?\b", "GENERAL", 0.25), (-1, "automat", "NOTICE", 6.5)]
    return _classified_with(spark, sf, own.unionByName(B.inline_table(spark, few, "hint_id long, pattern string, category string, weight double")))


@query
def learned_hints(spark, sf):
    """Categories people corrected are mined, approved where two or more cases say so, and change the next classification."""
    mined = L.mine_hints(b.corrections(spark, sf)).groupBy("kind", "key", "value").agg(F.sum("evidence_count").alias("n"))
    suggestions = mined.select(F.crc32(F.concat_ws("|", "key", "value")).alias("suggestion_id"), "kind", "key", "value", F.lit("pending").alias("status"), "n")
    decisions = suggestions.select("suggestion_id", (F.col("n") >= 2).alias("approve"), F.lit("reviewer").alias("user"), F.lit("2024-02-01").cast("timestamp").alias("at"))
    _, knowledge, _ = L.apply_decisions(suggestions.drop("n"), decisions, B.seed_knowledge(spark))
    return _classified_with(spark, sf, H.active_hints(knowledge))


@query
def cue_evidence(spark, sf):
    e = K.classification_evidence(T.clean_body(_mail(spark, sf)))
    return e.select("case_id", F.array_join("evidence", "\n").alias("evidence"))


@query
def category_overrides(spark, sf):
    """K6: reviewers' categories over the computed ones, and who still needs a look."""
    c = b.case_board(spark, sf).select("case_id", "category", F.when(F.col("starred"), F.lit(0.5)).otherwise(F.lit(0.9)).alias("category_confidence"), F.lit("rule").alias("decided_by"))
    ov = b.corrections(spark, sf).where(F.col("kind") == "category").groupBy("case_id").agg(F.max_by("final_value", "id").alias("category"))
    out = K.apply_category_override(c, ov)
    return out.select("case_id", "category", "category_confidence", "decided_by", (F.col("category_confidence") < specs.CLASSIFY_REVIEW_BELOW).alias("needs_look"))


# ---------------------------------------------------------------- extraction


@query
def document_rows(spark, sf):
    """S3 over whole documents: numbered, trimmed lines."""
    docs = b.load(spark, sf, "documents")["documents"].select("doc_id", "text")
    rows = E.docs_to_rows(docs)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count("text_no").alias("filled"), F.sum(F.length("text")).alias("chars"), F.count_if("indent").alias("indented"))


@query
def extracted_fields(spark, sf):
    """E1-E4 on rendered documents, each value with its line and characters; the oracle knows the values from before they were rendered."""
    v = E.extract_fields(E.docs_to_rows(_docs(spark, sf), whole=True), None, B.seed_knowledge(spark))
    return v.select("doc_id", "field", "raw", "blank", F.round("confidence", 3).alias("confidence"), F.col("loc.kind").alias("place"), F.col("loc.line").alias("line"), "start", "stop")


@query
def matched_labels(spark, sf):
    """How every label of the rendered documents is understood."""
    s = E.split_rows(E.docs_to_rows(_docs(spark, sf)), B.seed_knowledge(spark)).where(F.col("field").isNotNull())
    return s.groupBy("field_label", "field", "confidence", "method").agg(F.count(F.lit(1)).alias("n"))


@query
def value_lines(spark, sf):
    """Labels with the number of lines that belong to them."""
    c = E.collect_continuations(E.split_rows(E.docs_to_rows(_docs(spark, sf), whole=True)))
    lines = F.size(F.split("full", "\n")).cast("bigint")
    return c.groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(lines).alias("lines"), F.sum(F.col("row_index") - F.col("label_row")).alias("moved"))


@query
def scan_confidence(spark, sf):
    """E5 with the documents of starred messages as scans."""
    m = b.messages(spark, sf).select("case_id", "starred")
    docs = b.documents(spark, sf).select("doc_id", "case_id").join(m, "case_id")
    docs = docs.select("doc_id", F.when(F.col("starred"), F.lit("ocr")).otherwise(F.lit("text")).alias("method"), F.when(F.col("starred"), F.lit(0.8)).alias("ocr_confidence"))
    v = b.field_values(spark, sf).withColumn("doc_id", F.concat("case_id", F.lit("/"), "side"))
    return E.cap_ocr_confidence(v, docs).groupBy("method", F.round("confidence", 3).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query
def value_context(spark, sf):
    """The rows around every extracted value of both documents."""
    rows = E.docs_to_rows(_docs(spark, sf), whole=True)
    return E.value_context(E.extract_fields(rows, None, B.seed_knowledge(spark), around=(2, 3)), rows).select("doc_id", "field", "row_index", "text", "hit")


@query
def draft_references(spark, sf):
    """E7."""
    return E.find_reference(E.docs_to_rows(_docs(spark, sf)), specs.DOC_BL_NO)


@query
def carriers(spark, sf):
    """By reference prefix (fixed and learned), else by name."""
    f = b.forms(spark, sf).select("case_id", "bl_no", F.when(F.col("segment") == "building", F.lit("vessel operated by Maersk line")).otherwise(F.lit("one or pil")).alias("note"),
                                  F.when(F.col("variant") == 3, F.lit(None)).otherwise(F.col("bl_no")).alias("ref"))
    return E.detect_carrier(f, ["ref"], ["note"], B.seed_knowledge(spark)).select("case_id", "carrier")


@query
def value_overrides(spark, sf):
    """E9."""
    c = b.corrections(spark, sf).where(F.col("kind") == "field_value").groupBy("case_id", "field").agg(F.max_by("final_value", "id").alias("value"))
    ov = c.withColumn("side", F.lit("BL"))
    out = E.apply_value_overrides(b.field_values(spark, sf).select("case_id", "side", "field", "raw", "confidence", "method", "blank"), ov)
    return out.select("case_id", "side", "field", "raw", "confidence", "method", "blank")


@query
def grounded_values(spark, sf):
    """The middle half of every document as its own proposal, next to the whole benchmark item of the same number."""
    t = b.load(spark, sf, "documents", "benchmark")
    size = F.length("text")
    middle = F.substring("text", F.floor(size / 4).cast("int") + 1, F.ceil(size / 2).cast("int"))
    own = t["documents"].select("doc_id", F.lit("shipper").alias("field"), F.lower(middle).alias("value"))
    other = t["benchmark"].select(F.col("item_id").alias("doc_id"), F.lit("consignee").alias("field"), F.col("text").alias("value"))
    return E.verify_grounded(own.unionByName(other), t["documents"]).select("doc_id", "field", "grounded", "confidence")


@query
def missing_fields(spark, sf):
    """E11."""
    v = b.field_values(spark, sf).select(F.concat("case_id", F.lit("/"), "side").alias("doc_id"), "field")
    return E.missing_fields(v.select("doc_id").distinct(), v)


# ---------------------------------------------------------------- pairing


@query
def document_roles(spark, sf):
    return _roles(spark, sf).select("doc_id", "role")


@query
def inferred_pairs(spark, sf):
    """P2 with the drafts' titles and names taken away."""
    roles = _roles(spark, sf)
    bare = F.endswith("doc_id", F.lit("/BL"))
    hidden = roles.withColumn("type", F.when(bare, F.lit("UNKNOWN")).otherwise(F.col("type"))).withColumn("role", F.when(~bare, F.col("role")))
    counts = b.field_values(spark, sf).where(~F.col("blank")).groupBy(F.concat("case_id", F.lit("/"), "side").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_fields"))
    return P.infer_pair(hidden, counts).select("doc_id", "role", "paired")


@query
def missing_documents(spark, sf):
    return P.missing_documents(_roles(spark, sf))


@query
def completeness(spark, sf):
    """P4. The roles are read by four branches, so they are a table of the run instead of four runs over every text."""
    m = T.clean_body(_mail(spark, sf)).select("case_id", "message")
    return P.completeness_reasons(m, as_table(_roles(spark, sf), new_run_dir(spark), "roles"))


@query
def checked_cases(spark, sf):
    """Everything from raw messages and documents to the decided case."""
    c = checks.check_cases(_mail(spark, sf), _docs(spark, sf), knowledge=B.seed_knowledge(spark)).cases
    return c.select("case_id", "category", "status", "review_reason", _joined("defect_fields"))


# ---------------------------------------------------------------- knowledge


@query
def resolved_aliases(spark, sf):
    """B1: suppliers' names through party aliases that reviewers' corrections propose."""
    aliases = L.alias_evidence(b.corrections(spark, sf)).where(F.col("kind") == "party_alias").groupBy("kind", "key").agg(F.max("value").alias("value"))
    kb = aliases.select(F.lit(1).cast("long").alias("id"), "kind", "key", "value", F.lit(None).cast("double").alias("weight"), F.lit(True).alias("active"))
    f = b.forms(spark, sf).select("case_id", N.party_norm(F.col("bl_consignee")).alias("name"))
    return B.resolve_alias(f, "name", kb, "party_alias", "case_id", "canonical").select("case_id", "name", "canonical")


@query
def knowledge_digest(spark, sf):
    h = _events(spark, sf, b.HISTORY, "history")
    kb = h.select(F.col("id"), F.col("action").alias("kind"), F.col("item_id").cast("string").alias("key"), "value", F.lit(True).alias("active"))
    return B.knowledge_version(kb)


@query
def knowledge_as_of(spark, sf):
    h = _events(spark, sf, b.HISTORY, "history")
    return B.knowledge_as_of(h, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("item_id", "value")


@query
def reply_lines(spark, sf):
    """Active reply lines for one status."""
    h = _events(spark, sf, b.HISTORY, "history")
    kb = h.select("id", F.lit("reply_rule").alias("kind"), F.when(F.col("action") == "add", F.lit("ok")).when(F.col("action") == "edit", F.lit("All")).otherwise(F.lit("MISMATCH")).alias("key"), "value", (F.col("id") % 3 != 0).alias("active"))
    return B.reply_rules_for(kb, "OK").select("rule_id", "line")


@query
def latest_examples(spark, sf):
    h = _events(spark, sf, b.HISTORY, "history")
    kb = h.select("id", F.lit("example").alias("kind"), F.col("action").alias("key"), "value", F.lit(True).alias("active"))
    return B.latest_examples(kb, 5).select("id", "value")


# ---------------------------------------------------------------- tagging


@query
def auto_labels(spark, sf):
    return G.auto_labels(b.case_board(spark, sf))


@query
def matched_rules(spark, sf):
    rules = G.default_rules() + [
        G.Rule(3, "Maersk docs", (G.Condition("carrier", "contains", "MAER"), G.Condition("sender", "starts_with", "docs@"))),
        G.Rule(4, "Urgent", (G.Condition("subject", "regex", r"^re:\s+shipment"), G.Condition("defect_field", "contains", "container"))),
        G.Rule(5, "Never", ()), G.Rule(6, "Bad op", (G.Condition("carrier", "like", "x"),)), G.Rule(7, "Off", (G.Condition("status", "is", "OK"),), False),
        G.Rule(8, "Ends", (G.Condition("sender_domain", "ends_with", ".COM"), G.Condition("review_reason", "is", "missing_attachment"))),
    ]
    return G.match_rules(b.case_board(spark, sf), rules)


@query
def case_labels(spark, sf):
    """G3."""
    return _labels(b.case_board(spark, sf))


@query
def case_owners(spark, sf):
    """Owners after a full recompute."""
    board = b.case_board(spark, sf).withColumn("assignee_locked", F.col("archived"))
    return G.assign_owner(board, _labels(board), _routes(spark), _users(spark)).select("case_id", "assignee_id")


@query
def retag_report(spark, sf):
    board = b.case_board(spark, sf)
    owned, _ = G.retag_all(board, G.default_rules(), board.where("starred").select("case_id", F.lit("Watch").alias("name")), _routes(spark), _users(spark))
    return owned.groupBy("assignee_id").agg(F.count(F.lit(1)).alias("cases"))


# ---------------------------------------------------------------- case board


@query
def folder_review(spark, sf):
    return Q.folder(b.case_board(spark, sf), "review").select("case_id", "status")


@query
def inbox_tabs(spark, sf):
    board = b.case_board(spark, sf)
    return Q.inbox_tab(board, "spam").select("case_id", F.lit("spam").alias("tab")).unionByName(Q.inbox_tab(board, "review").select("case_id", F.lit("review").alias("tab")))


@query
def case_search(spark, sf):
    board = b.case_board(spark, sf)
    return Q.search(board, sender="HARI", status="review", carrier="ms", words="shipment 5rmy", assignee="tan", users=_users(spark)).select("case_id", "sender")


@query
def labelled_search(spark, sf):
    board = b.case_board(spark, sf)
    return Q.search(board, label="pod port", category="bl", unread=True, field="shipper", labels=_labels(board)).select("case_id")


@query
def cases_with_all_tags(spark, sf):
    board = b.case_board(spark, sf)
    return Q.with_all_tags(board, _labels(board), ["Needs amendment", "Watch", "MSC"]).select("case_id")


@query
def case_page(spark, sf):
    return Q.page(Q.folder(b.case_board(spark, sf), "inbox"), 3, 50).select("case_id", "received_at")


@query
def page_total(spark, sf):
    return Q.page_total(Q.folder(b.case_board(spark, sf), "inbox"))


@query
def labels_per_case(spark, sf):
    board = b.case_board(spark, sf)
    return Q.labels_of(board, _labels(board)).select("case_id", _joined("labels"))


@query
def folder_counts(spark, sf):
    return Q.folder_counts(b.case_board(spark, sf), 2)


@query
def label_usage(spark, sf):
    board = b.case_board(spark, sf)
    dim = G.auto_labels(board).select("name").unionByName(board.select(F.explode(F.array(F.lit("Never used"), F.lit("External sender"), F.lit("Needs amendment"), F.lit("Watch"))).alias("name"))).distinct()
    return Q.label_usage(dim, _labels(board))


@query
def latest_activity(spark, sf):
    return Q.latest_per_case(_events(spark, sf, b.ACTIVITY, "activity"), 30).select("case_id", "id", "action", "rank")


@query
def last_changes(spark, sf):
    return Q.latest(_events(spark, sf, b.ACTIVITY, "activity"), 60).select("id", "action")


@query
def attention_rows(spark, sf):
    return Q.attention_rows(_results(spark, sf)).select("case_id", "field", "result", "attention")


@query
def situations(spark, sf):
    return Q.situation(_facts_of_cases(spark, sf).withColumn("replied", F.col("is_read"))).select("case_id", "situation", "tone", "step", "done")


def _facts_of_cases(spark: SparkSession, sf: str) -> DataFrame:
    return b.case_board(spark, sf).withColumns({
        "decided_by_person": F.col("is_read") & F.col("starred"), "was_compared": F.col("compared"),
        "n_missing": F.when(F.col("variant").isin(13, 14), F.lit(1)).otherwise(F.lit(0)), "n_unsure": F.when(F.col("variant").isin(10, 12, 17), F.lit(1)).otherwise(F.lit(0)),
        "broken_file": F.col("variant") == 12, "scanned_file": F.col("variant").isin(10, 12, 17)})


def _replies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(sent replies, activity) out of the corrections: drafts count as sent, the other kinds as what a person did."""
    log = b.corrections(spark, sf)
    action = F.when(F.col("kind") == "verdict", F.lit("verdict changed")).when(F.col("kind") == "field_value", F.lit("value corrected")).when(F.col("kind") == "category", F.lit("category changed")).otherwise(F.lit("note added"))
    return log.where("kind = 'draft'").select("case_id", F.col("at").alias("sent_at")), log.where("kind <> 'draft'").select("case_id", action.alias("action"), "at")


@query
def reply_states(spark, sf):
    """Q10: whether the last reply still answers the case."""
    return Q.reply_state(*_replies(spark, sf)).select("case_id", "last_sent", "last_change", "replied", "outdated")


@query
def answered_situations(spark, sf):
    """Q10 with `replied` computed from the replies and the later changes."""
    facts = Q.with_replies(_facts_of_cases(spark, sf), *_replies(spark, sf))
    return Q.situation(facts).select("case_id", "replied", "situation", "tone", "step", "done")


@query
def filter_options(spark, sf):
    board = b.case_board(spark, sf)
    return Q.filter_options(board, G.auto_labels(board))


@query
def draft_replies(spark, sf):
    """T11 for every check of the board."""
    board = b.case_board(spark, sf)
    cases = board.withColumns({"bl_no": F.when(F.col("variant") % 2 == 0, F.concat(F.lit("REF"), F.col("case_id"))), "oc_no": F.lit(None).cast("string"), "invoice": F.lit(None).cast("string")})
    results = b.forms(spark, sf).select("case_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"si_{c}").alias("left_value"), F.col(f"bl_{c}").alias("right_value")) for f, c in b.FIELD_COLUMNS])).alias("r")).select("case_id", "r.*")
    results = results.join(board.select("case_id", "compared", "variant"), "case_id")
    results = results.withColumn("result", F.when(~F.col("compared"), F.lit("not_compared")).when((F.col("field") == "consignee") & F.col("variant").isin(13, 14), F.lit("missing")).otherwise(F.lit("match")))
    rules = B.inline_table(spark, [(1, "MISMATCH", "Please quote BL no. {bl_no} in your reply."), (2, "ALL", "Office hours apply."), (3, "OK", "Invoice {invoice} refers.")], "rule_id int, status string, line string")
    return Q.draft_reply(cases, results, None, rules).select("case_id", "subject", "body")


# ---------------------------------------------------------------- snapshots


@query
def message_timeline(spark, sf):
    return S.make_timeline(b.shipments(spark, sf).select("case_id")).select("case_id", "received_at")


@query
def upserted_messages(spark, sf):
    m = b.messages(spark, sf)
    old = m.where(~F.col("archived")).select("case_id", "sender", "subject", F.col("is_read"), F.col("received_at"))
    new = m.where(F.col("is_read") | F.col("archived")).select("case_id", F.lit("new@x.y").alias("sender"), F.concat(F.lit("Fwd: "), "subject").alias("subject"))
    return S.upsert_messages(old, new).select("case_id", "sender", "subject", "is_new", "received_at")


@query
def current_cases(spark, sf):
    return S.latest_case(_events(spark, sf, b.VERSIONS, "versions")).select("case_id", "run_id", "status")


@query
def submission(spark, sf):
    s = S.to_submission(b.case_board(spark, sf))
    return s.select("case_id", "category", "status", "review_reason", "has_defect", _joined("defect_fields"))


@query
def run_summary(spark, sf):
    return S.run_summary(_events(spark, sf, b.VERSIONS, "versions"))


@query
def run_breakdown(spark, sf):
    return S.run_breakdown(_events(spark, sf, b.VERSIONS, "versions"))


@query
def failed_messages(spark, sf):
    """The messages of a retry run."""
    board = b.case_board(spark, sf)
    return S.select_for_run(board.select("case_id", "sender"), failed_of=board.select("case_id", "status"))


# ---------------------------------------------------------------- analytics


@query
def report_scope(spark, sf):
    board = b.case_board(spark, sf)
    return A.scope(board, date_from="1996-01-01", date_to="1998-12-31", carrier="MSC", label="Watch", labels=_labels(board)).select("case_id", "received_at")


@query
def category_counts(spark, sf):
    return A.category_counts(b.case_board(spark, sf))


@query
def status_counts(spark, sf):
    return A.status_counts(b.case_board(spark, sf))


@query
def defect_field_counts(spark, sf):
    return A.defect_field_counts(b.case_board(spark, sf))


@query
def review_reason_counts(spark, sf):
    return A.review_reason_counts(b.case_board(spark, sf))


@query
def carrier_hotspots(spark, sf):
    return A.hotspots(b.case_board(spark, sf), "carrier")


@query
def customer_hotspots(spark, sf):
    return A.hotspots(b.case_board(spark, sf), "customer")


@query
def workload(spark, sf):
    return A.workload(b.case_board(spark, sf), _users(spark))


@query
def time_to_resolve(spark, sf):
    board = b.case_board(spark, sf)
    act = b.load(spark, sf, "lineitem")["lineitem"].groupBy(F.concat(F.lit("case_"), F.col("l_orderkey").cast("string")).alias("case_id")).agg(F.min("l_shipdate").alias("resolved_at"))
    df = board.join(act, "case_id", "left").withColumn("processed_at", F.col("received_at"))
    return A.time_to_resolve(df)


@query
def corrections_by_kind(spark, sf):
    return A.corrections_by(b.corrections(spark, sf), b.case_board(spark, sf))


@query
def corrections_by_day(spark, sf):
    return A.corrections_by(b.corrections(spark, sf), b.case_board(spark, sf), "day")


@query
def correction_rate(spark, sf):
    return A.correction_rate(b.corrections(spark, sf), b.case_board(spark, sf))


@query
def check_timeline(spark, sf):
    return A.timeline(b.case_board(spark, sf))


@query
def report_headline(spark, sf):
    """A10, A11, A13 in one pass."""
    return A.headline(b.case_board(spark, sf))


@query
def report_rates(spark, sf):
    return A.rates(b.case_board(spark, sf))


@query
def report_outcome(spark, sf):
    return A.outcome(b.case_board(spark, sf))


@query
def overrules(spark, sf):
    return A.overrule_metrics(b.corrections(spark, sf), b.case_board(spark, sf))


@query
def overrules_by_kind(spark, sf):
    """Overrules by what was overruled."""
    return A.overrules_by_kind(b.corrections(spark, sf), b.case_board(spark, sf))


@query
def overruled_fields(spark, sf):
    return A.overruled_fields(b.corrections(spark, sf), b.case_board(spark, sf))


@query
def queue_and_quality(spark, sf):
    return A.queue_and_quality(b.case_board(spark, sf), _events(spark, sf, b.ACTIVITY, "activity"))


@query
def assisted_counts(spark, sf):
    board = b.case_board(spark, sf).withColumn("decided_by", F.when(F.col("starred"), F.lit("llm")).otherwise(F.lit("rule"))).withColumn("preview", F.when(F.col("is_read"), F.lit("p")))
    v = b.field_values(spark, sf).withColumn("method", F.when(F.col("blank"), F.lit("llm")).otherwise(F.lit("rule")))
    return A.assisted_counts(board, v)


@query
def cost_by_task(spark, sf):
    return A.cost_by_task(_events(spark, sf, b.USAGE, "usage_log"))


@query
def cost_rollup(spark, sf):
    return A.cost_rollup(_events(spark, sf, b.USAGE, "usage_log"), b.case_board(spark, sf))


@query
def worst_carrier(spark, sf):
    return A.worst_hotspot(b.case_board(spark, sf), "carrier")


@query
def report_advice(spark, sf):
    return A.advice_flags(b.case_board(spark, sf), b.corrections(spark, sf))


@query
def suggestion_states(spark, sf):
    return A.suggestion_status_counts(_suggestions(spark, sf))


@query
def hours_saved(spark, sf):
    return A.hours_saved(b.case_board(spark, sf))


@query
def metrics_cube(spark, sf):
    return A.metrics_cube(b.case_board(spark, sf))


# ---------------------------------------------------------------- learning


@query
def mined_aliases(spark, sf):
    return L.mine_aliases(b.corrections(spark, sf))


@query
def mined_hints(spark, sf):
    return L.mine_hints(b.corrections(spark, sf))


@query
def mined_reply_lines(spark, sf):
    return L.mine_reply_lines(b.corrections(spark, sf))


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    h = _events(spark, sf, b.HISTORY, "history")
    return h.select(F.col("id").alias("suggestion_id"), F.lit("party_alias").alias("kind"), F.col("item_id").cast("string").alias("key"), "value",
                    F.when(F.col("action") == "add", F.lit("pending")).when(F.col("action") == "edit", F.lit("approved")).otherwise(F.lit("rejected")).alias("status"))


@query
def new_suggestions(spark, sf):
    """L4: proposals not yet known or pending."""
    mined = L.mine(b.corrections(spark, sf))
    kb = mined.where(F.col("evidence_count") > 3).select(F.lit(1).cast("long").alias("id"), "kind", F.upper("key").alias("key"), "value", F.lit(True).alias("active"))
    return L.new_suggestions(mined, kb)


@query
def unconsumed_corrections(spark, sf):
    return L.correction_kinds(L.unconsumed(b.corrections(spark, sf)))


@query
def decided_suggestions(spark, sf):
    """Suggestions after people decided: the grown knowledge table."""
    sg = _suggestions(spark, sf)
    ev = b.load(spark, sf, "events")["events"]
    dec = ev.select(F.col("event_id").alias("suggestion_id"), (F.col("value") < 50).alias("approve"), F.col("user_id").cast("string").alias("user"), F.col("ts").alias("at"))
    _, kb, _ = L.apply_decisions(sg, dec, B.seed_knowledge(spark))
    return kb.select("id", "kind", "key", "value", "source")


# ---------------------------------------------------------------- evaluation


@query
def holdout_split(spark, sf):
    return V.split_holdout(b.shipments(spark, sf).select("case_id"))


@query
def category_confusion(spark, sf):
    return V.confusion(*_truth(spark, sf), "category")


@query
def status_confusion(spark, sf):
    return V.confusion(*_truth(spark, sf), "status")


@query
def defect_confusion(spark, sf):
    return V.multilabel_confusion(*_truth(spark, sf))


@query
def split_scores(spark, sf):
    return V.scores(*_truth(spark, sf), "category")


@query
def class_scores(spark, sf):
    p = V.prf(V.confusion(*_truth(spark, sf), "category"))
    return p.select("class", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round("f1", 6).alias("f1"))


@query
def wrong_cases(spark, sf):
    return V.wrong_cases(*_truth(spark, sf)).select("case_id", "split")


@query
def activity_windows(spark, sf):
    """W3 batch twin: activity per 10-minute window and kind."""
    from concord.streaming.activity import window_counts

    return window_counts(_events(spark, sf, b.ACTIVITY, "activity"))


@query
def activity_sessions(spark, sf):
    """W3 batch twin: sessions of each kind of activity, closed by ten quiet minutes."""
    from concord.streaming.activity import session_counts

    return session_counts(_events(spark, sf, b.ACTIVITY, "activity"), "action", "10 minutes")
