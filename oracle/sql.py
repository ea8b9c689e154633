"""SQL twins of the registered queries, for an independent engine.

The rendered inputs come from the same binding text; everything computed from them is written here a second time:
truth that is known before a document or message is put together, or plain SQL over the rendered board.
"""

from __future__ import annotations

import re

from concord import specs
from concord.plans import bindings as b

O: dict[str, str] = {}


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


# ---------------------------------------------------------------- standard forms in SQL


def party(c: str) -> str:
    s = f"replace(regexp_replace(upper({c}), '{specs.ORDER_PREFIX}', ''), '.', '')"
    for pattern, form in specs.LEGAL_REWRITES:
        s = f"regexp_replace({s}, '{pattern}', '{form}', 'g')"
    return f"trim(regexp_replace(replace({s}, '&', ' & '), '[^A-Z0-9&]+', ' ', 'g'))"


_LEGAL = "|".join(specs.LEGAL_TOKENS + ["&"])


def core(c: str) -> str:
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda t: NOT regexp_full_match(t, '{_LEGAL}')), ' ')"


def bare_port(c: str) -> str:
    return f"regexp_replace(upper({c}), '\\([^)]*\\)', ' ', 'g')"


def town(c: str) -> str:
    return f"trim(regexp_replace(trim(split_part({bare_port(c)}, ',', 1)), '^PORT OF ', ''))"


def country(c: str) -> str:
    x = f"CASE WHEN contains({bare_port(c)}, ',') THEN trim(split_part({bare_port(c)}, ',', 2)) ELSE '' END"
    return f"CASE {x} WHEN 'USA' THEN 'US' WHEN 'UAE' THEN 'AE' WHEN 'UK' THEN 'GB' ELSE {x} END"


def code(c: str) -> str:
    return f"nullif(regexp_extract({c}, '\\(([A-Z]{{5}})\\)', 1), '')"


def kilos(c: str) -> str:
    digits = f"CAST(replace(regexp_extract({c}, '[0-9][0-9.,]*', 0), ',', '') AS DOUBLE)"
    return f"CASE WHEN NOT regexp_matches({c}, '[0-9]') THEN NULL ELSE {digits} * CASE WHEN contains({c}, 'MT') THEN 1000 ELSE 1 END END"


def boxes(c: str) -> str:
    return f"CAST(regexp_extract({c}, '([0-9]+)', 1) AS INTEGER)"


# ---------------------------------------------------------------- reconciliation

_PARTY_IN, _PORT_IN = "('shipper','consignee','notify_party')", "('port_of_loading','port_of_discharge')"
# similarity classes of the rendered names are known from how they were rendered: one letter dropped (11), a word added (18),
# another company (9); ports with one letter added (17)
RECONCILED = f"""{b.FORMS},
sides AS (
  SELECT f.case_id, f.variant, g.field,
    CASE g.field WHEN 'shipper' THEN si_shipper WHEN 'consignee' THEN si_consignee WHEN 'notify_party' THEN si_notify WHEN 'port_of_loading' THEN si_pol
      WHEN 'port_of_discharge' THEN si_pod WHEN 'container_count' THEN si_count ELSE si_weight END AS l,
    CASE g.field WHEN 'shipper' THEN bl_shipper WHEN 'consignee' THEN bl_consignee WHEN 'notify_party' THEN bl_notify WHEN 'port_of_loading' THEN bl_pol
      WHEN 'port_of_discharge' THEN bl_pod WHEN 'container_count' THEN bl_count ELSE bl_weight END AS r
  FROM forms f CROSS JOIN (VALUES ('shipper'),('consignee'),('notify_party'),('port_of_loading'),('port_of_discharge'),('container_count'),('gross_weight_kg')) AS g(field)),
flagged AS (SELECT *, (l IS NULL OR l = 'TBA' OR contains(l, '___')) AS lm, (r IS NULL OR r = 'TBA' OR contains(r, '___')) AS rm FROM sides),
normed AS (
  SELECT *, CASE WHEN field IN {_PARTY_IN} THEN {party('l')} END AS lp, CASE WHEN field IN {_PARTY_IN} THEN {party('r')} END AS rp,
    CASE WHEN field IN {_PORT_IN} THEN {town('l')} END AS lt, CASE WHEN field IN {_PORT_IN} THEN {town('r')} END AS rt,
    CASE WHEN field IN {_PORT_IN} THEN {country('l')} END AS lc, CASE WHEN field IN {_PORT_IN} THEN {country('r')} END AS rc,
    CASE WHEN field IN {_PORT_IN} THEN {code('l')} END AS lk, CASE WHEN field IN {_PORT_IN} THEN {code('r')} END AS rk,
    CASE WHEN field = 'gross_weight_kg' THEN {kilos('l')} END AS lw, CASE WHEN field = 'gross_weight_kg' THEN {kilos('r')} END AS rw,
    CASE WHEN field = 'container_count' THEN {boxes('l')} END AS ln, CASE WHEN field = 'container_count' THEN {boxes('r')} END AS rn
  FROM flagged),
ruled AS (
  SELECT *,
    CASE WHEN lm OR rm THEN 'missing'
      WHEN field IN {_PARTY_IN} THEN CASE WHEN lp = rp THEN 'match' WHEN upper(l) = 'TO ORDER' OR upper(r) = 'TO ORDER' THEN 'unsure'
        WHEN {core('lp')} = {core('rp')} THEN 'unsure'
        WHEN abs(length(lp) - length(rp)) <= 2 AND levenshtein(lp, rp) = 1 THEN 'match' WHEN contains(rp, ' WEST ') THEN 'unsure' ELSE 'mismatch' END
      WHEN field IN {_PORT_IN} THEN CASE
        WHEN lt = rt THEN CASE WHEN lc <> '' AND rc <> '' AND lc <> rc THEN 'unsure' WHEN lk <> rk THEN 'unsure' ELSE 'match' END
        WHEN rt = concat(lt, 'S') AND 2.0 * length(lt) / (2 * length(lt) + 1) >= 0.9 AND NOT (lc <> '' AND rc <> '' AND lc <> rc) THEN 'unsure' ELSE 'mismatch' END
      WHEN field = 'container_count' THEN CASE WHEN ln <> rn THEN 'mismatch' ELSE 'match' END
      ELSE CASE WHEN abs(lw - rw) <= 1.0 THEN 'match' ELSE 'mismatch' END END AS result,
    CASE WHEN lm OR rm THEN 0.9
      WHEN field IN {_PARTY_IN} THEN CASE WHEN lp = rp THEN 0.98 WHEN upper(l) = 'TO ORDER' OR upper(r) = 'TO ORDER' THEN 0.5
        WHEN {core('lp')} = {core('rp')} THEN 0.55
        WHEN abs(length(lp) - length(rp)) <= 2 AND levenshtein(lp, rp) = 1 THEN 0.75 WHEN contains(rp, ' WEST ') THEN 0.5 ELSE 0.97 END
      WHEN field IN {_PORT_IN} THEN CASE
        WHEN lt = rt THEN CASE WHEN lc <> '' AND rc <> '' AND lc <> rc THEN 0.5 WHEN lk <> rk THEN 0.55 ELSE 0.98 END
        WHEN rt = concat(lt, 'S') AND 2.0 * length(lt) / (2 * length(lt) + 1) >= 0.9 AND NOT (lc <> '' AND rc <> '' AND lc <> rc) THEN 0.5 ELSE 0.97 END
      WHEN field = 'container_count' THEN CASE WHEN ln <> rn THEN 0.98 WHEN variant = 19 THEN 0.8 ELSE 0.98 END
      ELSE 0.98 END AS confidence
  FROM normed)
"""
_ORD = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(specs.FIELDS)) + " END"
VERDICTS = f"""{RECONCILED},
verdicts AS (
  SELECT case_id, bool_or(result = 'missing') AS miss, bool_or(result = 'unsure') AS uns,
    coalesce(string_agg(field, ',' ORDER BY {_ORD}) FILTER (WHERE result = 'mismatch'), '') AS bad,
    min(confidence) FILTER (WHERE result IN ('match', 'mismatch')) AS weakest
  FROM ruled GROUP BY case_id)
"""
O["field_reconciliation"] = _with(RECONCILED, """SELECT case_id, field, result, CAST(confidence AS DOUBLE) AS confidence,
  CASE WHEN lm OR rm THEN NULL ELSE coalesce(lp, lt, CAST(ln AS VARCHAR), CASE WHEN lw = floor(lw) THEN CAST(CAST(lw AS BIGINT) AS VARCHAR) ELSE CAST(lw AS VARCHAR) END) END AS left_norm,
  CASE WHEN lm OR rm THEN NULL ELSE coalesce(rp, rt, CAST(rn AS VARCHAR), CASE WHEN rw = floor(rw) THEN CAST(CAST(rw AS BIGINT) AS VARCHAR) ELSE CAST(rw AS VARCHAR) END) END AS right_norm,
  CASE WHEN lm AND rm THEN 'both' WHEN lm THEN 'SI' WHEN rm THEN 'BL' END AS missing_side FROM ruled""")
_STATUS = "CASE WHEN miss OR uns THEN 'NEEDS_REVIEW' WHEN bad <> '' THEN 'MISMATCH' ELSE 'OK' END"
O["case_verdicts"] = _with(VERDICTS, f"""SELECT case_id, {_STATUS} AS status, CASE WHEN miss OR uns THEN 'missing_value' END AS review_reason,
  CASE WHEN miss OR uns THEN '' ELSE bad END AS defect_fields, CASE WHEN miss OR uns THEN bad ELSE '' END AS proposed_defects,
  CAST(least(0.9, coalesce(weakest, 0.9)) AS DOUBLE) AS confidence, (miss OR uns) AS needs_human FROM verdicts""")
_KG = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_OPEN = "CASE WHEN {0} IS NULL THEN '{1} has no such line' WHEN {0} = 'TBA' OR contains({0}, '___') THEN concat('{1} leaves it open (“', {0}, '”)') END"
FOUND = f"""{RECONCILED},
found AS (
  SELECT case_id, field, result, CASE
    WHEN lm OR rm THEN concat_ws('; ', {_OPEN.format('l', 'SI')}, {_OPEN.format('r', 'BL')})
    WHEN field IN {_PARTY_IN} THEN CASE WHEN lp = rp THEN 'the names agree'
      WHEN upper(l) = 'TO ORDER' OR upper(r) = 'TO ORDER' THEN 'an order clause stands where a name is needed'
      WHEN {core('lp')} = {core('rp')} THEN 'the names agree but for the legal form' WHEN result = 'match' THEN 'the names differ by a slip of the pen'
      WHEN result = 'unsure' THEN concat('the names resemble each other: ', lp, ' and ', rp) ELSE concat('two companies: ', lp, ' and ', rp) END
    WHEN field IN {_PORT_IN} THEN CASE WHEN lt = rt AND result = 'match' THEN 'the towns agree'
      WHEN lt = rt AND lc <> '' AND rc <> '' AND lc <> rc THEN concat('one town in two countries: ', lc, ' and ', rc)
      WHEN lt = rt THEN concat('one town with two codes: ', lk, ' and ', rk)
      WHEN result = 'unsure' THEN concat('the towns are spelled nearly alike: ', lt, ' and ', rt)
      ELSE concat('two towns: ', lt, ' and ', rt, CASE WHEN lk = rk THEN concat('; both carry the code ', lk) ELSE '' END) END
    WHEN field = 'container_count' THEN CASE WHEN ln <> rn THEN concat(ln, ' containers against ', rn)
      WHEN variant = 19 THEN 'the counts agree, the sizes do not' ELSE 'the counts agree' END
    WHEN lw = rw THEN 'the weights agree' WHEN result = 'match' THEN 'the weights agree within the tolerance'
    ELSE concat({_KG.format('lw')}, ' kg against ', {_KG.format('rw')}, ' kg') END AS finding
  FROM ruled)
"""
O["field_findings"] = _with(FOUND, "SELECT case_id, field, result, finding FROM found")
O["verdict_details"] = _with(FOUND, f"""SELECT case_id, 'missing_value' AS review_reason,
  coalesce(string_agg(concat(field, ': ', finding), '; ' ORDER BY {_ORD}) FILTER (WHERE result = 'missing'),
    concat('not certain: ', string_agg(concat(field, ': ', finding), '; ' ORDER BY {_ORD}) FILTER (WHERE result = 'unsure'))) AS review_detail
  FROM found GROUP BY case_id HAVING bool_or(result IN ('missing', 'unsure'))""")
O["uncompared_fields"] = _with(RECONCILED, """SELECT case_id, field, 'not_compared' AS result, CASE WHEN has_lines THEN l END AS left_value, CAST(NULL AS VARCHAR) AS right_value,
  concat('not compared for want of ', CASE WHEN has_lines THEN 'BL' ELSE 'SI and BL' END) AS finding
  FROM sides JOIN (SELECT case_id, has_lines FROM forms) USING (case_id) WHERE NOT has_lines OR variant IN (15, 16)""")
O["verdict_counts"] = _with(VERDICTS, f"SELECT {_STATUS} AS status, CASE WHEN miss OR uns THEN 'missing_value' END AS review_reason, count(*) AS n FROM verdicts GROUP BY 1, 2")
O["thresholds_by_field"] = _with(RECONCILED, """SELECT field, CASE WHEN field = 'container_count' AND result IN ('match','mismatch') AND confidence < 0.9 THEN 'unsure' ELSE result END AS result,
  CASE WHEN field = 'container_count' AND result IN ('match','mismatch') AND confidence < 0.9 THEN result END AS result_before, count(*) AS n FROM ruled GROUP BY 1, 2, 3""")
O["attention_rows"] = _with(RECONCILED, "SELECT case_id, field, result, CASE result WHEN 'mismatch' THEN 0 WHEN 'unsure' THEN 1 ELSE 2 END AS attention FROM ruled WHERE result <> 'match'")
O["derived_verdicts"] = f"""WITH {RECONCILED}, {b.CORRECTIONS[len(b.FORMS):].lstrip(', ').lstrip()},
  dec AS (SELECT case_id, field, arg_max(final_value, id) AS d FROM corrections WHERE kind = 'field_result' AND field IS NOT NULL GROUP BY 1, 2),
  merged AS (SELECT r.case_id, r.field, coalesce(d.d, r.result) AS final, d.d IS NOT NULL AS touched FROM ruled r LEFT JOIN dec d ON d.case_id = r.case_id AND d.field = r.field)
  SELECT case_id, CASE WHEN bool_or(final = 'mismatch') THEN 'MISMATCH' ELSE 'OK' END AS verdict_status,
    coalesce(string_agg(field, ',' ORDER BY {_ORD}) FILTER (WHERE final = 'mismatch'), '') AS verdict_defects FROM merged GROUP BY case_id HAVING bool_or(touched)"""
O["reviewed_verdicts"] = _with(b.CASES, """, ov AS (
  SELECT *, is_read AS judged, (is_read AND status <> 'FAILED') AS decided,
    CASE WHEN archived THEN 'NEEDS_REVIEW' WHEN starred THEN 'OK' END AS cs, CASE WHEN archived THEN 'missing_value' END AS cr FROM board),
  st AS (SELECT *, CASE WHEN decided THEN 'MISMATCH' ELSE status END AS s2, CASE WHEN decided THEN 'shipper' ELSE defect_text END AS d2, CASE WHEN decided THEN NULL ELSE review_reason END AS r2 FROM ov),
  ag AS (SELECT *, (NOT judged AND s2 NOT IN ('FAILED','PENDING') AND cs IS NOT DISTINCT FROM s2 AND cr IS NOT DISTINCT FROM r2) AS agreed FROM st),
  hu AS (SELECT *, CASE WHEN agreed OR decided THEN false WHEN confidence < 0.8 AND NOT judged THEN true ELSE needs_human END AS h2 FROM ag)
  SELECT case_id, s2 AS status, d2 AS defect_fields, r2 AS review_reason, CASE WHEN decided THEN status END AS ai_status, h2 AS needs_human, (judged OR agreed OR (starred AND NOT h2)) AS resolved FROM hu""")
O["closed_non_checks"] = _with(b.CASES, """SELECT case_id, category, 'OK' AS status, CASE WHEN starred THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, starred AS needs_human,
  CASE WHEN starred THEN 'kind of message is not certain' END AS review_detail FROM board WHERE category IS NOT NULL AND category <> 'BL_COMPARISON'""")
O["isolated_errors"] = """WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS TINYINT) IS NULL AS bad1, value > 100 AS bad2 FROM events)
  SELECT event_type, CASE WHEN bad1 OR bad2 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN bad1 THEN '[read] value could not be read' WHEN bad2 THEN '[parse] value could not be read' END AS error, count(*) AS n FROM e GROUP BY 1, 2, 3"""


def _variants(fields: str, canonical: str) -> str:
    return _with(b.FIELD_TABLE, f""", v AS (SELECT raw, {canonical} AS canonical FROM field_table WHERE field IN {fields}), per AS (SELECT canonical, raw, count(*) AS n FROM v GROUP BY 1, 2)
  SELECT canonical, count(*) AS variants, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY 1""")


O["standard_parties"] = _variants(_PARTY_IN, party("raw"))
O["standard_ports"] = _variants(_PORT_IN, town("raw"))
O["standard_counts"] = _variants("('container_count')", boxes("raw"))
O["standard_weights"] = _variants("('gross_weight_kg')", f"CASE WHEN contains(raw, '___') THEN NULL ELSE {kilos('raw')} END")
# the documents' accents are Latin letters with one base letter each, so the twin uses the engine's own accent stripper
O["folded_text"] = "SELECT doc_id, CAST(length(upper(strip_accents(replace(text, 'ß', 'SS')))) AS BIGINT) AS n_chars, md5(upper(strip_accents(replace(text, 'ß', 'SS')))) AS digest FROM documents"

# LCS of l and r by the textbook table, one row a letter of l: a cell is the largest of those up to it that the row above allows
_LCS_ROWS = """list_transform(string_split(l, ''), lambda x: list_transform(string_split(r, ''), lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))"""
_LCS_CELL = "greatest(above[k], CASE WHEN hits[k] = 1 THEN 1 + CASE WHEN k > 1 THEN above[k - 1] ELSE 0 END ELSE 0 END)"
_LCS = f"""list_max(list_reduce({_LCS_ROWS}, lambda above, hits: list_transform(range(1, len(hits) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: {_LCS_CELL}))),
  list_transform(string_split(r, ''), lambda y: 0)))"""
O["similar_customers"] = _with(b.FORMS, f""", p AS (SELECT case_id, {party('si_consignee')} AS l, {party('bl_consignee')} AS r FROM forms),
  q AS (SELECT case_id, CASE WHEN l = r THEN 1.0 WHEN l = '' OR r = '' THEN 0.0 ELSE 2.0 * {_LCS} / (length(l) + length(r)) END::DOUBLE AS x FROM p)
  SELECT case_id, round(x, 6) AS ratio, x >= 0.94 - 1e-9 AS same, x >= 0.85 - 1e-9 AS close FROM q""")


# ---------------------------------------------------------------- text

O["message_parts"] = _with(b.MESSAGES, "SELECT case_id, said AS message, trim(sign_off) AS signature, thread AS quoted, banner_text AS banner FROM messages")
_REFS = """CASE WHEN kind = 'order' THEN concat('5RCY-', lpad(CAST(k % 100000 AS VARCHAR), 5, '0')) ELSE NULL END"""
_FACTS = f""", facts AS (SELECT case_id, kind, said, concat('5RMY-', lpad(CAST(k % 100000 AS VARCHAR), 5, '0')) AS oc_no,
    CASE WHEN kind IN ('check', 'draft', 'claim') THEN bl_no END AS bl_no, CASE WHEN kind = 'invoice' THEN lpad(CAST(k AS VARCHAR), 10, '5') END AS invoice,
    split_part(split_part(sender, '@', 2), '.', 1) AS dom, split_part(sender, '@', 1) AS local FROM messages),
  named AS (SELECT *, array_to_string(list_transform(string_split(replace(dom, '-', ' '), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS customer FROM facts)"""
O["message_facts"] = _with(b.MESSAGES, _FACTS + """ SELECT case_id, left(regexp_replace(said, '\\s+', ' ', 'g'), 140) AS snippet, oc_no, bl_no, invoice, customer,
  CASE WHEN local = 'hari_m' THEN 'Hari' WHEN local = 'promo' THEN 'Promo' ELSE 'Team' END AS hello FROM named""")
O["message_traffic"] = _with(b.MESSAGES, _FACTS + """ SELECT customer, count(*) AS messages, count(oc_no) AS with_order_no, count(bl_no) AS with_bl_no, count(invoice) AS with_invoice,
  CAST(sum(length(said)) AS BIGINT) AS message_chars FROM named GROUP BY 1""")
O["file_roles"] = _with(b.DOCUMENTS, "SELECT doc_id, right(doc_id, 2) AS role FROM docs")
O["value_differences"] = _with(b.FORMS, """, p AS (SELECT case_id, si_shipper AS a, bl_shipper AS c FROM forms),
  s AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(a), length(c)) + 1), lambda i: left(a, i) = left(c, i))), 0) AS st FROM p),
  e AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(a), length(c)) - st + 1), lambda i: right(a, i) = right(c, i))), 0) AS en FROM s)
  SELECT case_id, left(a, st) AS same_start, substr(a, st + 1, length(a) - en - st) AS left_part, substr(c, st + 1, length(c) - en - st) AS right_part, right(a, en) AS same_end FROM e""")
_NICE = "array_to_string(list_transform(string_split(lower(pod), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')"
O["readable_subjects"] = _with(b.CASES, f""", x AS (SELECT *, coalesce(customer, sender) AS who, concat(' · going to ', {_NICE}) AS dest, CASE WHEN carrier IS NULL THEN 'the draft' ELSE concat('the ', carrier, ' draft') END AS line FROM board)
  SELECT case_id, CASE WHEN category = 'BL_COMPARISON' AND NOT compared THEN concat(who, ' is asking for ', line, dest) WHEN category = 'BL_COMPARISON' THEN concat('Check ', line, ' for ', who, dest)
  WHEN category = 'SI_REQUEST' THEN concat('New shipping instructions from ', who, dest) WHEN category = 'INVOICE_QUERY' THEN concat('Invoice question from ', who)
  WHEN category = 'GENERAL' THEN concat('General mail from ', who) WHEN category = 'SPAM' THEN concat('Junk from ', sender) END AS line FROM x""")
O["document_types"] = _with(b.DOCUMENTS, """SELECT doc_id, true AS readable, CASE WHEN right(doc_id, 2) = 'SI' THEN 'SI' WHEN variant = 16 THEN 'OTHER' ELSE 'BL' END AS type,
  CASE WHEN right(doc_id, 2) = 'BL' AND variant = 16 THEN 'PACKING_LIST' END AS subtype, CAST(0.97 AS DOUBLE) AS type_confidence FROM docs""")
O["document_roles"] = _with(b.DOCUMENTS, "SELECT doc_id, CASE WHEN right(doc_id, 2) = 'SI' THEN 'SI' WHEN variant = 16 THEN NULL ELSE 'BL' END AS role FROM docs")
O["missing_documents"] = _with(b.FORMS, "SELECT case_id, 'BL' AS role FROM forms WHERE has_lines AND variant = 15")
O["completeness"] = _with(b.MESSAGES, """SELECT case_id, 'wrong_doc_type' AS reason, concat(case_id, '_BL.txt is a Packing List and neither of the two documents to compare') AS detail FROM messages WHERE has_lines AND variant = 16
  UNION ALL SELECT case_id, 'missing_attachment', 'the draft BL was not attached' FROM messages WHERE has_lines AND variant = 15
  UNION ALL SELECT case_id, 'missing_attachment', 'files are mentioned in the message, but it came without any' FROM messages WHERE NOT has_lines AND kind = 'claim'""")
O["inferred_pairs"] = _with(b.DOCUMENTS, "SELECT doc_id, CASE WHEN right(doc_id, 2) = 'SI' THEN 'SI' ELSE 'BL' END AS role, right(doc_id, 2) = 'BL' AS paired FROM docs")
# a piece joins the one before if that ends in an abbreviation and its sentence so far stands in the piece's line
_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
_SHORT = specs.ABBREVIATION.replace("\\b", r"(?:^|[^\p{L}\p{M}\p{N}_])", 1)  # word ends beyond ASCII
O["document_sentences"] = rf"""WITH RECURSIVE lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents)),
  cut AS (SELECT doc_id, ln, line, unnest(c) AS raw, generate_subscripts(c, 1) AS pn FROM (SELECT *, string_split(regexp_replace(line, '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS c FROM lines)),
  p AS (SELECT doc_id, line, piece, row_number() OVER (PARTITION BY doc_id ORDER BY ln, pn) AS i
    FROM (SELECT *, regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS piece FROM cut) WHERE piece <> ''),
  q AS (SELECT *, coalesce(regexp_matches(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), '(?i){_SHORT}'), false) AS after_short FROM p),
  s AS (SELECT doc_id, i, piece AS sofar, 0 AS joined FROM q WHERE NOT after_short
    UNION ALL
    SELECT q.doc_id, q.i, CASE WHEN contains(q.line, s.sofar) THEN concat(s.sofar, ' ', q.piece) ELSE q.piece END, CASE WHEN contains(q.line, s.sofar) THEN 1 ELSE 0 END
    FROM s JOIN q ON q.doc_id = s.doc_id AND q.i = s.i + 1 AND q.after_short)
  SELECT d.doc_id, coalesce(n, 0) AS sentences FROM documents d LEFT JOIN (SELECT doc_id, count(*) - sum(joined) AS n FROM s GROUP BY doc_id) USING (doc_id)"""
O["draft_references"] = _with(b.DOCUMENTS, ", r AS (SELECT d.doc_id, f.bl_no FROM docs d JOIN forms f ON f.case_id = d.case_id WHERE right(d.doc_id, 2) = 'BL') SELECT doc_id, bl_no AS reference FROM r")
O["document_rows"] = """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE regexp_matches(text, '\\S')),
  t AS (SELECT doc_id, line, regexp_replace(line, '\\s+$', '') AS s FROM l)
  SELECT doc_id, count(*) AS rows, count(*) FILTER (WHERE s <> '') AS filled, CAST(sum(length(s)) AS BIGINT) AS chars, count(*) FILTER (WHERE regexp_matches(line, '^(\\s{2,}|\\t)\\S')) AS indented FROM t GROUP BY 1"""
# the rendered lines of the two documents: (side, field, line from 1, what stands before the value on it)
_LINES = [
    ("SI", "shipper", 4, "Shipper/Exporter: "), ("SI", "consignee", 7, "Consignee (Non-Negotiable): "), ("SI", "notify_party", 10, ""), ("SI", "port_of_loading", 11, "Port of Loading (POL): "),
    ("SI", "port_of_discharge", 12, "POD: "), ("SI", "container_count", 13, "No. of Containers: "), ("SI", "gross_weight_kg", 15, "Gross Wt (kgs): "),
    ("BL", "shipper", 4, "SHIPPER: "), ("BL", "consignee", 6, "To the Order of: "), ("BL", "notify_party", 9, "Notify Party/Intermediate Consignee: "), ("BL", "port_of_loading", 10, "Load Port: "),
    ("BL", "port_of_discharge", 11, "Discharge Port: "), ("BL", "container_count", 12, "Container Count: "), ("BL", "gross_weight_kg", 14, "Gross Weight (KG): "),
]
_PLACES = "places AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', {n}, '{before}')" for s, f, n, before in _LINES) + ") AS v(side, field, line, label_text))"
O["extracted_fields"] = _with(b.FIELD_TABLE, f""", {_PLACES}, d AS (SELECT f.case_id, f.side, f.field, f.raw, s.variant FROM field_table f JOIN forms s ON s.case_id = f.case_id WHERE s.has_lines AND NOT (f.side = 'BL' AND s.variant = 15))
  SELECT concat(case_id, '/', d.side) AS doc_id, d.field, raw, (raw = 'TBA' OR contains(raw, '___')) AS blank, CAST(CASE WHEN raw = 'TBA' OR contains(raw, '___') THEN 0.9 ELSE 0.98 END AS DOUBLE) AS confidence,
    'line' AS place, p.line, length(label_text) AS start, length(label_text) + length(raw) AS stop
  FROM d JOIN places p ON p.side = d.side AND p.field = d.field""")
O["value_context"] = _with(b.DOCUMENTS, f""", {_PLACES}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS row_index FROM docs)
  SELECT l.doc_id, p.field, l.row_index, l.text, l.row_index = p.line - 1 AS hit
  FROM l JOIN places p ON right(l.doc_id, 2) = p.side AND l.row_index BETWEEN p.line - 3 AND p.line + 2 WHERE trim(l.text) <> ''""")
O["missing_fields"] = _with(b.FORMS, """, m AS (SELECT case_id, unnest(['SI', 'BL']) AS side FROM forms WHERE NOT has_lines)
  SELECT concat(case_id, '/', side) AS doc_id, unnest(['shipper', 'port_of_loading']) AS field FROM m""")
O["scan_confidence"] = _with(b.MESSAGES, """, d AS (SELECT s.side, m.starred, m.has_lines AND NOT (s.side = 'BL' AND m.variant = 15) AS there, unnest(CASE WHEN m.has_lines THEN range(7) ELSE range(5) END) AS i
    FROM messages m CROSS JOIN (VALUES ('SI'), ('BL')) AS s(side))
  SELECT CASE WHEN starred AND there THEN 'ocr' ELSE 'rule' END AS method, CASE WHEN starred AND there THEN 0.784 ELSE 0.98 END::DOUBLE AS confidence, count(*) AS n FROM d GROUP BY 1, 2""")
O["carriers"] = _with(b.FORMS, """SELECT case_id, CASE WHEN variant = 3 THEN CASE WHEN segment = 'building' THEN 'Maersk' END
  ELSE CASE prefix WHEN 'MEDU' THEN 'MSC' WHEN 'OOLU' THEN 'OOCL' WHEN 'MAEU' THEN 'Maersk' WHEN 'SINF' THEN 'ONE' WHEN 'EGLV' THEN 'Evergreen' WHEN 'SIN2' THEN 'PIL' ELSE 'CMA CGM' END END AS carrier FROM forms""")
O["grounded_values"] = """WITH p AS (SELECT doc_id, 'shipper' AS field, lower(substr(text, CAST(floor(length(text) / 4) AS BIGINT) + 1, CAST(ceil(length(text) / 2) AS BIGINT))) AS value FROM documents
  UNION ALL SELECT item_id, 'consignee', text FROM benchmark)
  SELECT p.doc_id, p.field, contains(lower(d.text), lower(trim(p.value, E' \t\n\r'))) AS grounded, CASE WHEN contains(lower(d.text), lower(trim(p.value, E' \t\n\r'))) THEN 0.8 ELSE 0.4 END::DOUBLE AS confidence
  FROM p JOIN documents d ON d.doc_id = p.doc_id WHERE trim(p.value, E' \t\n\r') <> ''"""
O["value_overrides"] = _with(b.CORRECTIONS + ", " + b.FIELD_TABLE[len(b.FORMS):].lstrip(", ").lstrip(), """, ov AS (SELECT case_id, 'BL' AS side, field, arg_max(final_value, id) AS v FROM corrections WHERE kind = 'field_value' GROUP BY case_id, field)
  SELECT coalesce(t.case_id, o.case_id) AS case_id, coalesce(t.side, o.side) AS side, coalesce(t.field, o.field) AS field, coalesce(o.v, t.raw) AS raw, CASE WHEN o.v IS NOT NULL THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence,
  CASE WHEN o.v IS NOT NULL THEN 'human' ELSE 'rule' END AS method, CASE WHEN o.v IS NOT NULL THEN false ELSE (t.raw = 'TBA' OR contains(t.raw, '___')) END AS blank
  FROM field_table t FULL JOIN ov o ON o.case_id = t.case_id AND o.side = t.side AND o.field = t.field""")
O["checked_cases"] = _with(f"{b.MESSAGES}, {VERDICTS[len(b.FORMS):].lstrip(', ').lstrip()}", f""", kinds AS (SELECT m.*, CASE kind WHEN 'order' THEN 'SI_REQUEST' WHEN 'invoice' THEN 'INVOICE_QUERY' WHEN 'notice' THEN 'GENERAL' WHEN 'spam' THEN 'SPAM' ELSE 'BL_COMPARISON' END AS category FROM messages m)
  SELECT k.case_id, category,
  CASE WHEN category <> 'BL_COMPARISON' THEN 'OK' WHEN NOT has_lines THEN CASE WHEN kind = 'claim' THEN 'NEEDS_REVIEW' ELSE 'OK' END WHEN variant IN (15, 16) THEN 'NEEDS_REVIEW' ELSE {_STATUS} END AS status,
  CASE WHEN category <> 'BL_COMPARISON' THEN NULL WHEN NOT has_lines THEN CASE WHEN kind = 'claim' THEN 'missing_attachment' END WHEN variant = 15 THEN 'missing_attachment' WHEN variant = 16 THEN 'wrong_doc_type' WHEN miss OR uns THEN 'missing_value' END AS review_reason,
  CASE WHEN category <> 'BL_COMPARISON' OR NOT has_lines OR variant IN (15, 16) OR miss OR uns THEN '' ELSE bad END AS defect_fields
  FROM kinds k JOIN verdicts v ON v.case_id = k.case_id""")

# ---------------------------------------------------------------- classification


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# patterns as literals, so that each is compiled once; look-aheads are left off (no rendered text triggers one)
_CUE_SUMS = {
    cat: " + ".join(f"CASE WHEN regexp_matches(t, {_quoted('(?im)' + re.sub(r'[(][?]!.*$', '', p))}) THEN {w} ELSE 0 END" for p, w in cues)
    for cat, cues in specs.CUES.items()
}
_SCORED = f""", zones AS (SELECT case_id, said AS t, 1.0 AS zw FROM messages UNION ALL SELECT case_id, subject, 0.3 FROM messages UNION ALL SELECT case_id, thread, 0.1 FROM messages WHERE thread <> ''),
  texts AS (SELECT t, zw, list(case_id) AS ids FROM zones GROUP BY 1, 2),
  hits AS ({" UNION ALL ".join(f"SELECT ids, '{cat}' AS category, zw * ({total}) AS s FROM texts" for cat, total in _CUE_SUMS.items())}),
  scored AS (SELECT case_id, category, CAST(round(sum(s), 6) AS DOUBLE) AS score FROM (SELECT unnest(ids) AS case_id, category, s FROM hits) AS u GROUP BY 1, 2)"""
O["cue_scores"] = _with(b.MESSAGES, _SCORED + " SELECT * FROM scored")
_SIGNALS = """, sig AS (SELECT case_id, CASE WHEN kind = 'spam' THEN 1.5 ELSE 0.0 END AS spam, has_lines AND variant NOT IN (15, 16) AS bl, has_lines AS si FROM messages),
  signals AS (SELECT case_id, 'SPAM' AS category, spam AS score FROM sig UNION ALL SELECT case_id, 'BL_COMPARISON', CASE WHEN bl THEN 2.5 WHEN si THEN 0.8 ELSE 0.0 END FROM sig
    UNION ALL SELECT case_id, 'SI_REQUEST', CASE WHEN si AND NOT bl THEN 0.8 ELSE 0.0 END FROM sig)"""
O["signal_scores"] = _with(b.MESSAGES, _SIGNALS + " SELECT case_id, category, CAST(score AS DOUBLE) AS score FROM signals")
_CAT_ORDER = "CASE category WHEN 'BL_COMPARISON' THEN 0 WHEN 'SI_REQUEST' THEN 1 WHEN 'INVOICE_QUERY' THEN 2 WHEN 'GENERAL' THEN 3 WHEN 'SPAM' THEN 4 ELSE 5 END"


def _picked(more: str) -> str:
    """The best category of all scores; `more` adds rows (case_id, category, score) of hints."""
    return f""", every AS (SELECT case_id, category, round(sum(score), 6) AS score FROM (SELECT * FROM scored UNION ALL SELECT * FROM signals{more}) AS u GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, {_CAT_ORDER}) AS rn, sum(score) OVER (PARTITION BY case_id) AS total FROM every),
  tops AS (SELECT case_id, max(category) FILTER (WHERE rn = 1) AS category, max(score) FILTER (WHERE rn = 1) AS s1, max(score) FILTER (WHERE rn = 2) AS s2, max(total) AS total FROM ranked GROUP BY 1)
  SELECT case_id, CASE WHEN total <= 0 THEN 'GENERAL' ELSE category END AS category, CAST(CASE WHEN total <= 0 THEN 0.35 ELSE
    round(greatest(0.05, least(0.99, (0.5 * s1 / total + 0.5 * (s1 - s2) / s1) * (0.6 + 0.4 * least(1.0, s1 / 3.0)))), 3) END AS DOUBLE) AS category_confidence FROM tops"""


O["classified_messages"] = _with(b.MESSAGES, _SCORED + _SIGNALS + _picked(""))
_TEXT = "lower(concat(said, chr(10), subject))"
O["hinted_messages"] = _with(b.MESSAGES, _SCORED + _SIGNALS + f""", hinted AS (SELECT case_id, unnest(['URGENT', 'SPAM', 'GENERAL', 'NOTICE']) AS category, unnest([
    CASE WHEN k % 3 = 0 AND regexp_matches({_TEXT}, concat('\\s+', lower(bl_no), '\\s+and\\s+confirm')) THEN 9.0 ELSE 0.0 END, CASE WHEN regexp_matches({_TEXT}, 'gift|prize') THEN 1.5 ELSE 0.0 END,
    CASE WHEN regexp_matches({_TEXT}, 'docs?\\b') THEN 0.25 ELSE 0.0 END, CASE WHEN contains({_TEXT}, 'automat') THEN 6.5 ELSE 0.0 END]) AS score FROM messages)""" + _picked(" UNION ALL SELECT * FROM hinted"))
O["learned_hints"] = _with(b.CORRECTIONS, _SCORED + _SIGNALS + """, proposed AS (SELECT array_to_string(regexp_extract_all(message, '[A-Za-z]{3,}')[1:5], '\\s+') AS key FROM corrections WHERE kind = 'category'),
  approved AS (SELECT key FROM proposed WHERE key <> '' GROUP BY key HAVING count(*) >= 2),
  hinted AS (SELECT m.case_id, 'GENERAL' AS category, 4.0 AS score FROM messages m JOIN approved a ON regexp_matches(concat(m.said, chr(10), m.subject), concat('(?i)', a.key)))""" + _picked(" UNION ALL SELECT * FROM hinted"))
O["hint_scores"] = _with(b.MESSAGES, """ SELECT case_id, unnest(['INVOICE_QUERY', 'NOTICE', 'GENERAL']) AS category, CAST(unnest([CASE WHEN kind = 'invoice' THEN 4.0 ELSE 0.0 END, CASE WHEN kind = 'notice' THEN 2.0 ELSE 0.0 END,
  CASE WHEN contains(lower(subject), 'shipment 5rmy-000') THEN 0.5 ELSE 0.0 END]) AS DOUBLE) AS score FROM messages""")
O["category_overrides"] = _with(b.CORRECTIONS + ", " + b.CASES[len(b.MESSAGES):].lstrip(", ").lstrip(), """, ov AS (SELECT DISTINCT case_id FROM corrections WHERE kind = 'category')
  SELECT d.case_id, CASE WHEN o.case_id IS NOT NULL THEN 'GENERAL' ELSE d.category END AS category, CASE WHEN o.case_id IS NOT NULL THEN 1.0 WHEN d.starred THEN 0.5 ELSE 0.9 END::DOUBLE AS category_confidence,
  CASE WHEN o.case_id IS NOT NULL THEN 'human' ELSE 'rule' END AS decided_by, (d.starred AND o.case_id IS NULL) AS needs_look FROM board d LEFT JOIN ov o ON o.case_id = d.case_id""")

# ---------------------------------------------------------------- knowledge

O["knowledge_as_of"] = f"""WITH {b.HISTORY}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY "at" DESC, id DESC) AS rn FROM history WHERE "at" <= TIMESTAMP '2024-01-15 12:00:00')
  SELECT item_id, value FROM l WHERE rn = 1 AND action <> 'remove'"""
O["reply_lines"] = f"WITH {b.HISTORY} SELECT id AS rule_id, value AS line FROM history WHERE action IN ('add', 'edit') AND id % 3 <> 0"
O["latest_examples"] = f"WITH {b.HISTORY} SELECT id, value FROM history ORDER BY id DESC LIMIT 5"

# ---------------------------------------------------------------- tagging

_AUTO = """, auto AS (SELECT case_id, unnest([carrier, customer, concat('POD ', pod)]) AS name, unnest(['carrier', 'customer', 'pod']) AS grp FROM board WHERE category IN ('BL_COMPARISON', 'SI_REQUEST', 'INVOICE_QUERY')),
  autol AS (SELECT * FROM auto WHERE name IS NOT NULL),
  ruled_l AS (SELECT case_id, 1 AS rule_id, 'Needs amendment' AS name FROM board WHERE status = 'MISMATCH' UNION ALL
    SELECT case_id, 2, 'External sender' FROM board WHERE NOT contains(sender, 'april') AND coalesce(category, '') <> 'SPAM')"""
_LABELS = _AUTO + """, manual AS (SELECT case_id, 'Watch' AS name FROM board WHERE starred UNION ALL SELECT case_id, carrier FROM board WHERE is_read AND carrier IS NOT NULL),
  every_label AS (SELECT case_id, name, 1 AS p FROM autol UNION ALL SELECT case_id, name, 2 FROM ruled_l UNION ALL SELECT case_id, name, 0 FROM manual),
  labelled AS (SELECT case_id, name, min(p) AS p FROM every_label GROUP BY 1, 2)"""
O["auto_labels"] = _with(b.CASES, _AUTO + " SELECT case_id, name, grp FROM autol")
O["matched_rules"] = _with(b.CASES, _AUTO + """ SELECT case_id, rule_id, name FROM ruled_l UNION ALL SELECT case_id, 3, 'Maersk docs' FROM board WHERE carrier = 'Maersk' AND sender LIKE 'docs@%'
  UNION ALL SELECT case_id, 4, 'Urgent' FROM board WHERE subject LIKE 'RE: Shipment%' AND contains(defect_text, 'container')
  UNION ALL SELECT case_id, 8, 'Ends' FROM board WHERE sender LIKE '%.com' AND review_reason = 'missing_attachment'""")
O["case_labels"] = _with(b.CASES, _LABELS + " SELECT case_id, name, CASE p WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' ELSE 'rule' END AS source FROM labelled")
# the route table resolved by hand: owner 3 is inactive and falls back to the backup
_ROUTED = """, rt AS (SELECT * FROM (VALUES ('MSC', 2, 1, 0), ('OOCL', 2, 2, 0), ('Evergreen', 2, 3, 0), ('Yang Ming', 4, 4, 0), ('CMA CGM', 4, 5, 0), ('ONE', 4, 6, 0), ('Hapag-Lloyd', 2, 7, 0), ('Monter', 2, 8, 0), ('PIL', 4, 9, 1), ('Maersk', 4, 10, 0)) AS r(name, owner, rid, pr)),
  own AS (SELECT l.case_id, arg_min(r.owner, r.rid - 1000 * r.pr) AS owner FROM labelled l JOIN rt r ON r.name = l.name GROUP BY 1)"""
O["case_owners"] = _with(b.CASES, _LABELS + _ROUTED + """ SELECT d.case_id, CAST(CASE WHEN d.archived THEN d.assignee_id WHEN d.category = 'SPAM' THEN NULL ELSE o.owner END AS INTEGER) AS assignee_id FROM board d LEFT JOIN own o ON o.case_id = d.case_id""")
O["retag_report"] = _with(b.CASES, _LABELS.replace("UNION ALL SELECT case_id, carrier FROM board WHERE is_read AND carrier IS NOT NULL", "") + _ROUTED + """ SELECT CAST(CASE WHEN d.category = 'SPAM' THEN NULL ELSE o.owner END AS INTEGER) AS assignee_id, count(*) AS cases FROM board d LEFT JOIN own o ON o.case_id = d.case_id GROUP BY 1""")

# ---------------------------------------------------------------- case board

O["folder_review"] = _with(b.CASES, "SELECT case_id, status FROM board WHERE needs_human AND NOT resolved")
O["inbox_tabs"] = _with(b.CASES, "SELECT case_id, 'spam' AS tab FROM board WHERE NOT archived AND category = 'SPAM' UNION ALL SELECT case_id, 'review' FROM board WHERE NOT archived AND category = 'BL_COMPARISON' AND needs_human AND NOT resolved")
O["case_search"] = _with(b.CASES, "SELECT case_id, sender FROM board WHERE sender LIKE '%hari%' AND status = 'NEEDS_REVIEW' AND carrier = 'MSC' AND contains(lower(subject), 'shipment') AND contains(lower(subject), '5rmy') AND assignee_id = 1")
O["labelled_search"] = _with(b.CASES, "SELECT case_id FROM board WHERE pod LIKE 'PORT%' AND category = 'BL_COMPARISON' AND NOT is_read AND contains(defect_text, 'shipper')")
O["cases_with_all_tags"] = _with(b.CASES, _LABELS + " SELECT case_id FROM labelled WHERE name IN ('Needs amendment', 'Watch', 'MSC') GROUP BY case_id HAVING count(DISTINCT name) = 3")
O["case_page"] = _with(b.CASES, "SELECT case_id, received_at FROM board WHERE NOT archived AND (category <> 'SPAM' OR category IS NULL) ORDER BY received_at DESC, case_id DESC LIMIT 50 OFFSET 100")
O["page_total"] = _with(b.CASES, "SELECT count(*) AS total FROM board WHERE NOT archived AND (category <> 'SPAM' OR category IS NULL)")
O["labels_per_case"] = _with(b.CASES, _LABELS + ", l AS (SELECT case_id, string_agg(name, ',' ORDER BY name) AS labels FROM labelled GROUP BY 1) SELECT d.case_id, coalesce(l.labels, '') AS labels FROM board d LEFT JOIN l ON l.case_id = d.case_id")
_CHK = "category = 'BL_COMPARISON'"
_COUNTS = {
    ("folder", "inbox"): "NOT archived AND coalesce(category, '') <> 'SPAM'", ("folder", "assigned"): "assignee_id = 2 AND NOT archived", ("folder", "review"): "needs_human AND NOT resolved",
    ("folder", "mismatch"): "status = 'MISMATCH'", ("folder", "ok"): f"status = 'OK' AND {_CHK}", ("folder", "failed"): "status = 'FAILED'", ("folder", "all"): "true", ("folder", "spam"): "category = 'SPAM'",
    ("folder", "other"): "category IN ('SI_REQUEST','INVOICE_QUERY','GENERAL') AND NOT archived", ("folder", "bl"): _CHK, ("folder", "si"): "category = 'SI_REQUEST'", ("folder", "invoice"): "category = 'INVOICE_QUERY'",
    ("folder", "general"): "category = 'GENERAL'", ("folder", "starred"): "starred", ("unread", "inbox"): "NOT archived AND coalesce(category, '') <> 'SPAM' AND NOT is_read",
    ("unread", "assigned"): "assignee_id = 2 AND NOT archived AND NOT is_read", ("tab", "other"): "category IN ('SI_REQUEST','INVOICE_QUERY','GENERAL') AND NOT archived AND NOT is_read",
    ("tab", "spam"): "category = 'SPAM' AND NOT archived AND NOT is_read", ("tab", "cases"): f"{_CHK} AND NOT archived", ("tab", "review"): f"{_CHK} AND NOT archived AND needs_human AND NOT resolved",
    ("tab", "mismatch"): f"{_CHK} AND NOT archived AND status = 'MISMATCH'", ("tab", "ok"): f"{_CHK} AND NOT archived AND status = 'OK'",
}
O["folder_counts"] = _with(b.CASES, " UNION ALL ".join(f"SELECT '{k}' AS kind, '{n}' AS name, count(*) AS n FROM board WHERE {w}" for (k, n), w in _COUNTS.items()))
O["label_usage"] = _with(b.CASES, _LABELS + """, dim AS (SELECT DISTINCT name FROM autol UNION SELECT unnest(['Never used', 'External sender', 'Needs amendment', 'Watch']))
  SELECT d.name, count(l.case_id) AS n FROM dim d LEFT JOIN labelled l ON l.name = d.name GROUP BY 1""")
O["latest_activity"] = f"""WITH {b.ACTIVITY}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "at" DESC, id DESC) AS rank FROM activity) SELECT case_id, id, action, rank FROM r WHERE rank <= 30"""
O["last_changes"] = f"WITH {b.ACTIVITY} SELECT id, action FROM activity ORDER BY id DESC LIMIT 60"
O["filter_options"] = _with(b.CASES, _AUTO + """ SELECT DISTINCT 'carrier' AS kind, carrier AS value FROM board WHERE carrier IS NOT NULL UNION ALL SELECT DISTINCT 'customer', customer FROM board WHERE customer IS NOT NULL
  UNION ALL SELECT DISTINCT 'label', name FROM autol
  UNION ALL SELECT 'date_min', strftime(min(received_at), '%Y-%m-%d') FROM board UNION ALL SELECT 'date_max', strftime(max(received_at), '%Y-%m-%d') FROM board""")

_WAITING = "(needs_human AND NOT resolved)"
_KIND = f"""CASE WHEN status = 'FAILED' THEN 'failed' WHEN status = 'PENDING' OR category IS NULL THEN 'nocheck' WHEN category <> 'BL_COMPARISON' AND {_WAITING} THEN 'kind_unsure'
  WHEN category = 'SPAM' THEN 'junk' WHEN category <> 'BL_COMPARISON' THEN 'nocheck' WHEN status = 'MISMATCH' THEN 'mismatch' WHEN status = 'OK' THEN CASE WHEN compared THEN 'match' ELSE 'waiting_for_draft' END
  WHEN is_read AND starred THEN 'undecided' WHEN review_reason = 'missing_attachment' THEN 'missing_doc'
  WHEN review_reason = 'unreadable' THEN CASE WHEN variant = 12 OR variant NOT IN (10, 12, 17) THEN 'cant_open' ELSE 'scan' END WHEN review_reason = 'wrong_doc_type' THEN 'wrong_doc'
  WHEN variant IN (10, 12, 17) THEN 'unsure' WHEN variant IN (13, 14) THEN 'blank' ELSE 'not_sure_enough' END"""


def _situation(board: str, replied: str, more: str = "") -> str:
    return f""", s AS (SELECT *, {_KIND} AS situation, status = 'FAILED' OR (category = 'BL_COMPARISON' AND status <> 'PENDING') AS closes FROM {board}),
  t AS (SELECT *, CASE situation WHEN 'failed' THEN 'failed' WHEN 'nocheck' THEN 'neutral' WHEN 'junk' THEN 'neutral' WHEN 'mismatch' THEN 'mismatch' WHEN 'match' THEN 'ok' WHEN 'waiting_for_draft' THEN 'ok' ELSE 'review' END AS tone,
    CASE situation WHEN 'failed' THEN 'retry' WHEN 'nocheck' THEN 'none' WHEN 'junk' THEN 'none' WHEN 'kind_unsure' THEN 'confirm' WHEN 'undecided' THEN 'none' WHEN 'unsure' THEN 'decide' ELSE 'send' END AS first_step,
    coalesce(closes AND {replied} AND NOT {_WAITING}, false) AS done FROM s)
  SELECT case_id, {more}situation, tone, done, CASE WHEN closes AND {_WAITING} AND (status IN ('OK', 'MISMATCH') OR ({replied} AND first_step = 'send')) THEN 'confirm' WHEN done AND first_step = 'send' THEN 'none' ELSE first_step END AS step FROM t"""


O["situations"] = _with(b.CASES, _situation("board", "is_read"))
_STATES = """, states AS (SELECT case_id, max("at") FILTER (WHERE kind = 'draft') AS last_sent, max("at") FILTER (WHERE kind IN ('verdict', 'field_value', 'category')) AS last_change FROM corrections
    GROUP BY case_id HAVING last_sent IS NOT NULL OR last_change IS NOT NULL),
  replies AS (SELECT *, last_sent IS NOT NULL AND coalesce(last_change <= last_sent, true) AS replied, last_sent IS NOT NULL AND coalesce(last_change > last_sent, false) AS outdated FROM states)"""
O["reply_states"] = _with(b.CORRECTIONS, _STATES + " SELECT case_id, last_sent, last_change, replied, outdated FROM replies")
O["answered_situations"] = _with(b.CORRECTIONS + ", " + b.CASES[len(b.MESSAGES):].lstrip(", ").lstrip(), _STATES + ", told AS (SELECT d.*, coalesce(r.replied, false) AS replied FROM board d LEFT JOIN replies r ON r.case_id = d.case_id)"
                                + _situation("told", "replied", "replied, "))
O["knowledge_digest"] = f"""WITH {b.HISTORY}, i AS (SELECT md5(concat_ws(chr(31), action, CAST(item_id AS VARCHAR), value)) AS h FROM history),
  n AS (SELECT count(*) AS items, sum(CAST('0x' || h[1:8] AS UBIGINT)) AS a, sum(CAST('0x' || h[9:16] AS UBIGINT)) AS b FROM i)
  SELECT items, left(sha1(concat_ws(':', items, a, b)), 10) AS version FROM n"""

_T = {k: v.replace("'", "''") for k, v in specs.REPLY_TEXTS.items()}
_ASK = {k: [x.replace("'", "''") for x in v.split("{what}")] for k, v in specs.REASON_ASK.items()}
_WHAT = {"missing_attachment": "'the shipping instruction and the bill of lading draft'", "unreadable": "'what came with the message'", "wrong_doc_type": "'No bill of lading draft is among the files'",
         "missing_value": "CASE WHEN compared AND variant IN (13, 14) THEN 'Consignee' ELSE 'one or more of the key fields' END"}
_BLOCKS = ", ".join(
    f"CASE WHEN list_contains(string_split(defect_text, ','), '{f}') THEN concat('  - {specs.FIELD_TITLES[f]}', chr(10), '      as instructed: ', coalesce(nullif(si_{c}, ''), '-'), chr(10), '      as drafted:    ', coalesce(nullif(bl_{c}, ''), '-')) END"
    for f, c in sorted(b.FIELD_COLUMNS, key=lambda p: specs.FIELDS.index(p[0]))
)
O["draft_replies"] = _with(b.CASES, f""", x AS (SELECT m.*, f.*EXCLUDE (case_id, variant, has_lines), CASE WHEN m.variant % 2 = 0 THEN concat(' (REF', m.case_id, ')') ELSE '' END AS ref, coalesce(m.review_reason, 'unreadable') AS why
    FROM board m JOIN (SELECT case_id, variant, has_lines, {', '.join(f'si_{c}, bl_{c}' for _, c in b.FIELD_COLUMNS)} FROM forms) f ON f.case_id = m.case_id
    WHERE m.category = 'BL_COMPARISON' AND m.status NOT IN ('PENDING', 'FAILED')),
  y AS (SELECT *, array_to_string([{_BLOCKS}], chr(10)) AS blocks FROM x),
  z AS (SELECT *, CASE WHEN status = 'OK' AND NOT compared THEN concat('{_T["waiting_head"]}', ref, '{_T["waiting_tail"]}') WHEN status = 'OK' THEN concat('{_T["checked"]}', ref, '{_T["ok_tail"]}')
    WHEN status = 'MISMATCH' THEN concat('{_T["checked"]}', ref, '{_T["mismatch_middle"]}', CASE WHEN blocks = '' THEN '{_T["nothing_marked"]}' ELSE blocks END, '{_T["mismatch_tail"]}')
    ELSE concat('{_T["review"]}', ref, '.', chr(10), chr(10), CASE why {' '.join(f"WHEN '{k}' THEN concat('{a}', {_WHAT[k]}, '{z}')" for k, (a, z) in _ASK.items())} END) END AS middle,
    concat(CASE WHEN status = 'MISMATCH' AND ref <> '' THEN concat('Please quote BL no. REF', case_id, ' in your reply.', chr(10)) ELSE '' END, 'Office hours apply.') AS extra FROM y)
  SELECT case_id, CASE WHEN starts_with(lower(subject), 're:') THEN subject ELSE concat('RE: ', subject) END AS subject,
    concat('Dear ', CASE WHEN sender LIKE 'hari_m@%' THEN 'Hari' ELSE 'Team' END, ',', chr(10), chr(10), middle, chr(10), chr(10), extra, '{_T["closing"]}{specs.REPLY_SIGNER}') AS body FROM z""")

# ---------------------------------------------------------------- snapshots

O["message_timeline"] = _with(b.SHIPMENT, """, n AS (SELECT case_id, k, (SELECT count(*) FROM shipment) - k AS back FROM shipment)
  SELECT case_id, TIMESTAMP '2026-09-18 17:30:00' - to_days(CAST(back // 45 AS INTEGER)) - to_minutes((back % 45) * 11 + (k * 7) % 9) AS received_at FROM n""")
O["upserted_messages"] = _with(b.MESSAGES, """SELECT case_id, CASE WHEN is_read OR archived THEN 'new@x.y' ELSE sender END AS sender, CASE WHEN is_read OR archived THEN concat('Fwd: ', subject) ELSE subject END AS subject,
  archived AS is_new, CASE WHEN NOT archived THEN received_at END AS received_at FROM messages""")
O["current_cases"] = _with(b.CASES, "SELECT case_id, CASE WHEN archived THEN 1 ELSE 2 END::BIGINT AS run_id, CASE WHEN archived THEN 'PENDING' ELSE status END AS status FROM board")
O["submission"] = _with(b.CASES, """SELECT case_id, coalesce(category, 'GENERAL') AS category, CASE WHEN category = 'BL_COMPARISON' THEN CASE WHEN status IN ('FAILED', 'PENDING') THEN 'NEEDS_REVIEW' ELSE status END ELSE 'OK' END AS status,
  CASE WHEN category = 'BL_COMPARISON' AND status IN ('FAILED', 'PENDING', 'NEEDS_REVIEW') THEN coalesce(review_reason, 'unreadable') END AS review_reason,
  coalesce(category = 'BL_COMPARISON' AND status = 'MISMATCH', false) AS has_defect, CASE WHEN category = 'BL_COMPARISON' AND status = 'MISMATCH' THEN defect_text ELSE '' END AS defect_fields FROM board""")
O["run_summary"] = _with(b.VERSIONS, "SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status <> 'PENDING') AS done, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM versions GROUP BY 1")
O["run_breakdown"] = _with(b.VERSIONS, "SELECT run_id, 'category' AS kind, coalesce(category, 'none') AS name, count(*) AS n FROM versions GROUP BY 1, 3 UNION ALL SELECT run_id, 'status', status, count(*) FROM versions GROUP BY 1, 3")
O["failed_messages"] = _with(b.CASES, "SELECT case_id, sender FROM board WHERE status = 'FAILED'")

# ---------------------------------------------------------------- analytics

O["report_scope"] = _with(b.CASES, "SELECT case_id, received_at FROM board WHERE received_at >= TIMESTAMP '1996-01-01' AND received_at <= TIMESTAMP '1999-01-01' AND carrier = 'MSC' AND starred")
O["category_counts"] = _with(b.CASES, "SELECT category, count(*) AS n FROM board GROUP BY 1")
O["status_counts"] = _with(b.CASES, f"SELECT status, count(*) AS n FROM board WHERE {_CHK} GROUP BY 1")
O["defect_field_counts"] = _with(b.CASES, "SELECT unnest(string_split(defect_text, ',')) AS field, count(*) AS n FROM board WHERE compared AND defect_text <> '' GROUP BY 1")
O["review_reason_counts"] = _with(b.CASES, f"SELECT review_reason, count(*) AS n FROM board WHERE {_CHK} AND status = 'NEEDS_REVIEW' GROUP BY 1")


def _hot(dim: str) -> str:
    return f"""SELECT coalesce({dim}, 'Unknown') AS name, count(*) AS checked, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch,
  round(count(*) FILTER (WHERE status = 'MISMATCH') / count(*), 3)::DOUBLE AS rate FROM board WHERE compared GROUP BY 1 ORDER BY mismatch DESC, rate DESC, name LIMIT 12"""


O["carrier_hotspots"] = _with(b.CASES, _hot("carrier"))
O["customer_hotspots"] = _with(b.CASES, _hot("customer"))
O["worst_carrier"] = _with(b.CASES, f", h AS ({_hot('carrier').removesuffix(' LIMIT 12')}) SELECT * FROM h WHERE checked >= 3 AND mismatch > 0 ORDER BY rate DESC, mismatch DESC, name LIMIT 1")
_TEAM = ", ".join(f"({i}, '{n}')" for i, n, _ in b.TEAM)
O["workload"] = _with(b.CASES, f"SELECT u.name, count(*) AS assigned, count(*) FILTER (WHERE needs_human AND NOT resolved) AS open_review FROM board d JOIN (VALUES {_TEAM}) AS u(uid, name) ON u.uid = d.assignee_id GROUP BY 1")
O["time_to_resolve"] = _with(b.CASES, """, t AS (SELECT d.resolved, d.received_at AS p, l.r FROM board d LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS r FROM lineitem GROUP BY 1) l ON l.l_orderkey = d.k)
  SELECT count(*) FILTER (WHERE resolved AND r IS NOT NULL) AS resolved, round(avg(epoch(r - p)) FILTER (WHERE resolved AND r >= p) / 60, 1)::DOUBLE AS avg_minutes FROM t""")
_CORR_BOARD = b.CORRECTIONS + ", " + b.CASES[len(b.MESSAGES):].lstrip(", ").lstrip()
O["corrections_by_kind"] = _with(b.CORRECTIONS, "SELECT kind, count(*) AS n FROM corrections GROUP BY 1")
O["corrections_by_day"] = _with(b.CORRECTIONS, """SELECT strftime("at", '%Y-%m-%d') AS day, count(*) AS n FROM corrections GROUP BY 1""")
O["correction_rate"] = _with(_CORR_BOARD, f"SELECT count(*) AS corrections, count(DISTINCT case_id) AS cases_corrected, round(count(DISTINCT case_id) / (SELECT count(*) FROM board WHERE {_CHK}), 3)::DOUBLE AS rate FROM corrections")
O["check_timeline"] = _with(b.CASES, "SELECT strftime(received_at, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("OK", "MISMATCH", "NEEDS_REVIEW", "FAILED", "PENDING")) + f" FROM board WHERE {_CHK} GROUP BY 1")
_HEAD = f""", h AS (SELECT count(*) AS messages, count(*) FILTER (WHERE {_CHK}) AS checks, count(*) FILTER (WHERE compared) AS compared, count(*) FILTER (WHERE {_CHK} AND NOT needs_human) AS auto_count,
  count(*) FILTER (WHERE {_CHK} AND status = 'MISMATCH') AS mistake, count(*) FILTER (WHERE compared AND status = 'OK') AS clean, count(*) FILTER (WHERE {_CHK} AND status = 'NEEDS_REVIEW') AS person,
  count(*) FILTER (WHERE {_CHK} AND status = 'FAILED') AS failed, count(*) FILTER (WHERE {_CHK} AND status = 'OK' AND NOT compared) AS nothing_yet, count(*) FILTER (WHERE needs_human AND NOT resolved) AS open_review,
  count(*) FILTER (WHERE compared AND confidence < 0.8) AS low_confidence FROM board),
  hh AS (SELECT *, round(auto_count / checks, 3)::DOUBLE AS auto_rate, round(1 - auto_count / checks, 3)::DOUBLE AS review_rate, round(mistake / compared, 3)::DOUBLE AS mismatch_rate FROM h)"""
O["report_headline"] = _with(b.CASES, _HEAD + " SELECT * FROM hh")
O["report_rates"] = _with(b.CASES, _HEAD + " SELECT auto_rate, review_rate, mismatch_rate FROM hh")
O["report_outcome"] = _with(b.CASES, _HEAD + " SELECT clean, mistake, person, failed, nothing_yet FROM hh")
O["hours_saved"] = _with(b.CASES, _HEAD + " SELECT auto_count, round(auto_count * 10 / 60, 1)::DOUBLE AS hours_saved FROM hh")
O["queue_and_quality"] = _with(b.CASES, _HEAD + f" SELECT open_review, low_confidence, (SELECT count(DISTINCT user_id) FROM events) AS replies_sent FROM hh")
_RULED = "kind IN ('verdict', 'field_result', 'field_value', 'category')"
O["overrules"] = _with(_CORR_BOARD, f"""SELECT count(DISTINCT case_id) FILTER (WHERE {_RULED}) AS overruled_cases, round(count(DISTINCT case_id) FILTER (WHERE {_RULED}) / (SELECT count(*) FROM board WHERE {_CHK}), 3)::DOUBLE AS overruled_rate,
  count(*) FILTER (WHERE kind = 'draft') AS replies_edited, (SELECT count(*) FROM board WHERE status = 'FAILED') AS failed FROM corrections""")
O["overrules_by_kind"] = _with(_CORR_BOARD, f"""SELECT k.kind, count(c.id) AS n, count(DISTINCT c.case_id) AS cases FROM (SELECT unnest({list(specs.OVERRULE_KINDS)}) AS kind) k LEFT JOIN corrections c ON c.kind = k.kind GROUP BY 1""")
_TITLES = "CASE field " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in specs.FIELD_TITLES.items()) + " END"
O["overruled_fields"] = _with(b.CORRECTIONS, f"SELECT {_TITLES} AS label, count(*) AS n FROM corrections WHERE {_RULED} AND field IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 7")
O["assisted_counts"] = _with(b.MESSAGES, "SELECT count(*) FILTER (WHERE starred) AS sorted_by_assistant, count(*) FILTER (WHERE is_read) AS previews, count(*) FILTER (WHERE variant IN (13, 14)) AS read_by_assistant FROM messages")
O["cost_by_task"] = f"WITH {b.USAGE} SELECT task, CAST(sum(calls) AS BIGINT) AS calls, round(sum(cost_usd), 4)::DOUBLE AS cost_usd FROM usage_log GROUP BY 1"
O["cost_rollup"] = _with(b.USAGE + ", " + b.CASES, f""", s AS (SELECT CAST(sum(calls) AS BIGINT) AS calls, sum(cost_usd) AS c, (SELECT count(*) FROM board) AS m, (SELECT count(*) FROM board WHERE {_CHK}) AS k FROM usage_log)
  SELECT calls, round(c, 4)::DOUBLE AS spent_usd, round(c / m, 6)::DOUBLE AS per_message_usd, round(c / k, 6)::DOUBLE AS per_check_usd, round(c / m * 1000, 2)::DOUBLE AS per_1000_messages_usd FROM s""")
O["report_advice"] = _with(_CORR_BOARD, _HEAD + f""", hot AS ({_hot('carrier').removesuffix(' LIMIT 12')}) SELECT (SELECT count(*) FROM board WHERE {_CHK} AND status = 'NEEDS_REVIEW' AND review_reason = 'unreadable') >= 3 AS ask_for_text_files,
  ((SELECT count(*) FROM corrections) = 0 AND low_confidence = 0 AND review_rate < 0.15) AS thresholds_look_safe,
  (SELECT round(count(DISTINCT case_id) / (SELECT checks FROM hh), 3) FROM corrections) > 0.1 AS review_learned_aliases, (SELECT max(rate) FROM hot WHERE checked >= 3 AND mismatch > 0) > 0.35 AS second_look_at_hotspot FROM hh""")
O["suggestion_states"] = f"WITH {b.HISTORY} SELECT CASE action WHEN 'add' THEN 'pending' WHEN 'edit' THEN 'approved' ELSE 'rejected' END AS status, count(*) AS n FROM history GROUP BY 1"
O["metrics_cube"] = _with(b.CASES, f""", x AS (SELECT coalesce(carrier, 'Unknown') AS carrier, coalesce(customer, 'Unknown') AS customer, status, compared FROM board WHERE {_CHK})
  SELECT carrier, customer, status, CAST(grouping(carrier, customer, status) AS BIGINT) AS level, count(*) AS checks, count(*) FILTER (WHERE compared) AS compared FROM x GROUP BY CUBE (carrier, customer, status)""")

# ---------------------------------------------------------------- learning

_ALIAS = f""", a AS (SELECT CASE WHEN field = 'port_of_discharge' THEN 'port_alias' ELSE 'party_alias' END AS kind, CASE WHEN field = 'port_of_discharge' THEN {town('right_value')} ELSE {party('right_value')} END AS key,
  CASE WHEN field = 'port_of_discharge' THEN {town('left_value')} ELSE {party('left_value')} END AS value, case_id FROM corrections
  WHERE kind = 'field_result' AND final_value = 'match' AND ai_value IN ('mismatch', 'unsure') AND field <> 'container_count' AND left_value IS NOT NULL AND right_value IS NOT NULL),
  aliases AS (SELECT kind, key, value, count(*) AS evidence_count, count(DISTINCT case_id) AS cases FROM a WHERE key <> value GROUP BY 1, 2, 3)"""
_HINTS = """, hh AS (SELECT array_to_string(regexp_extract_all(message, '[A-Za-z]{3,}')[1:5], '\\s+') AS key, split_part(sender, '@', 2) AS domain, case_id FROM corrections WHERE kind = 'category'),
  hints AS (SELECT 'classifier_hint' AS kind, key, 'GENERAL' AS value, domain, count(*) AS evidence_count, count(DISTINCT case_id) AS cases FROM hh GROUP BY key, domain)"""
_REPLIES = """, replies AS (SELECT 'reply_rule' AS kind, status AS key, 'Please quote BL no. {bl_no} in your reply.' AS value, count(*) AS evidence_count, count(DISTINCT case_id) AS cases FROM corrections WHERE kind = 'draft' GROUP BY status)"""
O["mined_aliases"] = _with(b.CORRECTIONS, _ALIAS + " SELECT * FROM aliases")
O["mined_hints"] = _with(b.CORRECTIONS, _HINTS + " SELECT * FROM hints")
O["mined_reply_lines"] = _with(b.CORRECTIONS, _REPLIES + " SELECT * FROM replies")
O["new_suggestions"] = _with(b.CORRECTIONS, _ALIAS + _HINTS + _REPLIES + """, mined AS (SELECT * FROM aliases UNION ALL SELECT kind, key, value, evidence_count, cases FROM hints UNION ALL SELECT * FROM replies)
  SELECT * FROM mined m WHERE NOT EXISTS (SELECT 1 FROM mined x WHERE x.evidence_count > 3 AND x.kind = m.kind AND lower(x.key) = lower(m.key) AND lower(x.value) = lower(m.value))""")
O["unconsumed_corrections"] = _with(b.CORRECTIONS, "SELECT kind, count(*) AS n FROM corrections WHERE NOT consumed GROUP BY 1")
O["resolved_aliases"] = _with(b.CORRECTIONS, _ALIAS + f""", kb AS (SELECT key, max(value) AS value FROM aliases WHERE kind = 'party_alias' GROUP BY 1), f AS (SELECT case_id, {party('bl_consignee')} AS name FROM forms)
  SELECT f.case_id, f.name, coalesce(kb.value, f.name) AS canonical FROM f LEFT JOIN kb ON kb.key = f.name""")
_SEEDS = " UNION ALL ".join(f"SELECT {i + 1} AS id, '{k}' AS kind, '{a}' AS key, '{v}' AS value, 'seed' AS source" for i, (k, a, v) in enumerate(specs.SEED_KNOWLEDGE))
O["decided_suggestions"] = f"{_SEEDS} UNION ALL SELECT event_id + {len(specs.SEED_KNOWLEDGE)}, 'party_alias', CAST(user_id AS VARCHAR), concat('v', CAST(event_id AS VARCHAR)), 'learned' FROM events WHERE event_type = 'signup' AND value < 50"

# ---------------------------------------------------------------- evaluation, streaming twin

_HEX = "list_sum(list_transform(string_split(md5(concat('split-v1:', case_id)), ''), lambda c: instr('0123456789abcdef', c) - 1))"
_SPLIT = f"CASE WHEN {_HEX} % 5 = 0 THEN 'TEST' ELSE 'TUNE' END"
O["holdout_split"] = _with(b.SHIPMENT, f"SELECT case_id, {_SPLIT} AS split FROM shipment")
_EVAL = """, ev AS (SELECT case_id, coalesce(category, 'GENERAL') AS tc, status AS ts, defect_text AS td, archived, CASE WHEN archived THEN 'GENERAL' WHEN starred THEN 'SPAM' ELSE coalesce(category, 'GENERAL') END AS pc,
  CASE WHEN archived THEN 'OK' WHEN status = 'MISMATCH' AND is_read AND starred THEN 'OK' ELSE status END AS ps, review_reason AS tr, CASE WHEN archived THEN NULL ELSE review_reason END AS pr,
  CASE WHEN archived THEN '' WHEN status = 'MISMATCH' AND is_read THEN 'container_count' ELSE defect_text END AS pd FROM board)"""


def _confusion(t: str, p: str) -> str:
    return f"""SELECT class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
  SELECT {t} AS class, CASE WHEN {t} = {p} THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN {t} = {p} THEN 0 ELSE 1 END AS fn FROM ev UNION ALL SELECT {p}, 0, CASE WHEN {t} = {p} THEN 0 ELSE 1 END, 0 FROM ev) AS u GROUP BY class"""


O["category_confusion"] = _with(b.CASES, _EVAL + _confusion("tc", "pc"))
O["status_confusion"] = _with(b.CASES, _EVAL + _confusion("ts", "ps"))
_PRF = f", c AS ({_confusion('tc', 'pc')}), p AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)"
O["class_scores"] = _with(b.CASES, _EVAL + _PRF + " SELECT class, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)::DOUBLE AS f1 FROM p")
O["split_scores"] = _with(b.CASES, _EVAL + f""", e2 AS (SELECT tc, pc, unnest(['ALL', {_SPLIT}]) AS split FROM ev),
  s AS (SELECT split, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT split, tc AS class, CASE WHEN tc = pc THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN tc = pc THEN 0 ELSE 1 END AS fn FROM e2
    UNION ALL SELECT split, pc, 0, CASE WHEN tc = pc THEN 0 ELSE 1 END, 0 FROM e2) AS u GROUP BY 1, 2),
  q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s)
  SELECT split, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6)::DOUBLE AS macro_f1, round(sum(tp) / sum(tp + fn), 6)::DOUBLE AS accuracy, CAST(sum(tp + fn) AS BIGINT) AS n FROM q GROUP BY 1""")
O["defect_confusion"] = _with(b.CASES, _EVAL + f""", g AS (SELECT unnest({specs.FIELDS!r}) AS class, td, pd FROM ev) SELECT class, count(*) FILTER (WHERE contains(td, class) AND contains(pd, class)) AS tp,
  count(*) FILTER (WHERE NOT contains(td, class) AND contains(pd, class)) AS fp, count(*) FILTER (WHERE contains(td, class) AND NOT contains(pd, class)) AS fn FROM g GROUP BY 1 HAVING bool_or(contains(td, class) OR contains(pd, class))""")
O["wrong_cases"] = _with(b.CASES, _EVAL + f" SELECT case_id, {_SPLIT} AS split FROM ev WHERE tc <> pc OR ts <> ps OR tr IS DISTINCT FROM pr OR td <> pd")
O["activity_windows"] = f"""WITH {b.ACTIVITY} SELECT time_bucket(INTERVAL 10 MINUTE, "at") AS window_start, action, count(*) AS n FROM activity GROUP BY 1, 2"""

O["activity_sessions"] = f"""WITH {b.ACTIVITY}, g AS (SELECT action, "at", CASE WHEN "at" < lag("at") OVER (PARTITION BY action ORDER BY "at") + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM activity),
  s AS (SELECT action, "at", sum(fresh) OVER (PARTITION BY action ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT action, min("at") AS session_start, count(*) AS n FROM s GROUP BY action, k"""

ORACLES = O
