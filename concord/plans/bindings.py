"""Domain tables rendered from the driver's star schema.

The test tables hold no shipping documents, so messages, documents and cases are rendered from `orders`,
`lineitem`, `customer`, `supplier`, `nation` and `events` in portable SQL that two engines read the same way.
Every order gives one shipment; nothing is filtered or sampled. `variant` says how the second document of a
shipment deviates from the first and is the truth table of the evaluation queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.values import is_blank

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations"]

# ports of the nations, by nation number (name, country, code)
PORTS = [
    ("SINGAPORE", "SINGAPORE", "SGSIN"), ("PORT KLANG", "MALAYSIA", "MYPKG"), ("NHAVA SHEVA", "INDIA", "INNSA"), ("BUSAN", "SOUTH KOREA", "KRPUS"),
    ("HO CHI MINH", "VIETNAM", "VNSGN"), ("JEBEL ALI", "UAE", "AEJEA"), ("ROTTERDAM", "NETHERLANDS", "NLRTM"), ("HAMBURG", "GERMANY", "DEHAM"),
    ("FREMANTLE", "AUSTRALIA", "AUFRE"), ("MOMBASA", "KENYA", "KEMBA"), ("CALLAO", "PERU", "PECLL"), ("SANTOS", "BRAZIL", "BRSSZ"),
    ("YANGON", "MYANMAR", "MMRGN"), ("COLOMBO", "SRI LANKA", "LKCMB"), ("KARACHI", "PAKISTAN", "PKKHI"), ("JAKARTA", "INDONESIA", "IDJKT"),
    ("MANILA", "PHILIPPINES", "PHMNL"), ("LAEM CHABANG", "THAILAND", "THLCH"), ("SHANGHAI", "CHINA", "CNSHA"), ("YOKOHAMA", "JAPAN", "JPYOK"),
    ("LONG BEACH", "USA", "USLGB"), ("FELIXSTOWE", "UK", "GBFXT"), ("PIRAEUS", "GREECE", "GRPIR"), ("DURBAN", "SOUTH AFRICA", "ZADUR"),
    ("MERSIN", "TURKEY", "TRMER"),
]
_PORT_ROWS = ", ".join(f"({i}, '{n}', '{c}', '{l}')" for i, (n, c, l) in enumerate(PORTS))

# how the draft deviates, by variant
#  0-5 formatting only    6 count+1    7 weight+500    8 other discharge port, old code    9 other shipper
# 10 legal form dropped  11 typo in the consignee  12 bare TO ORDER  13 blank consignee  14 blank weight
# 15 draft missing       16 packing list instead   17 spelling of the port  18 longer notify name  19 size differs
SHIPMENT = f"""
ports AS (SELECT * FROM (VALUES {_PORT_ROWS}) AS p(nk, port, country, code)),
lines AS (SELECT l_orderkey AS k, CAST(count(*) AS INT) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, min(l_suppkey) AS sk
          FROM lineitem GROUP BY l_orderkey),
shipment AS (
  SELECT o.o_orderkey AS k, concat('case_', CAST(o.o_orderkey AS VARCHAR(20))) AS case_id, CAST(o.o_orderkey % 20 AS INT) AS variant,
         o.o_orderdate AS received_at, o.o_orderstatus AS ostatus, o.o_orderpriority AS opriority, o.o_totalprice AS price,
         coalesce(l.n, 0) AS n, coalesce(l.q, 0) AS q, CAST(l.n IS NOT NULL AS BOOLEAN) AS has_lines,
         CASE WHEN s.s_name IS NOT NULL THEN concat('SUPPLIER ', substr(s.s_name, 10)) END AS shipper_core,
         CASE CAST(s.s_suppkey % 5 AS INT) WHEN 0 THEN 'SDN BHD' WHEN 1 THEN 'PTE LTD' WHEN 2 THEN 'GMBH' WHEN 3 THEN 'CO LTD' ELSE 'LLC' END AS shipper_form,
         concat('BUYER ', substr(c.c_name, 10)) AS buyer_core,
         CASE CAST(c.c_custkey % 4 AS INT) WHEN 0 THEN 'LTD' WHEN 1 THEN 'LLC' WHEN 2 THEN 'SDN BHD' ELSE 'GMBH' END AS buyer_form,
         lower(c.c_mktsegment) AS segment, c.c_custkey AS custkey, coalesce(s.s_suppkey, 0) AS suppkey,
         pl.port AS pol, pl.country AS pol_country, pl.code AS pol_code, pd.port AS pod, pd.country AS pod_country, pd.code AS pod_code,
         CASE CAST(o.o_orderkey % 7 AS INT) WHEN 0 THEN 'MEDU' WHEN 1 THEN 'OOLU' WHEN 2 THEN 'MAEU' WHEN 3 THEN 'SINF' WHEN 4 THEN 'EGLV' WHEN 5 THEN 'SIN2' ELSE 'SIJ0' END AS prefix
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN ports pd ON pd.nk = c.c_nationkey
  LEFT JOIN lines l ON l.k = o.o_orderkey
  LEFT JOIN supplier s ON s.s_suppkey = l.sk
  LEFT JOIN ports pl ON pl.nk = s.s_nationkey)
"""

# the seven values of both documents, one row per shipment; a shipment without lines has no shipper, port of loading, goods
FORMS = f"""{SHIPMENT},
weights AS (
  SELECT *, q * 1000 AS kg,
         CASE WHEN q * 1000 >= 1000000 THEN concat(CAST(CAST(floor(q / 1000) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(q % 1000 AS VARCHAR(20)), 3, '0'), ',000')
              ELSE concat(CAST(q AS VARCHAR(20)), ',000') END AS kg_text,
         CASE WHEN q * 1000 >= 1000000 THEN concat(CAST(CAST(floor(q / 1000) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(q % 1000 AS VARCHAR(20)), 3, '0'), ',500')
              ELSE concat(CAST(q AS VARCHAR(20)), ',500') END AS kg_text_500
  FROM shipment),
forms AS (
  SELECT w.*,
    CASE WHEN has_lines THEN concat(shipper_core, ' ', shipper_form) END AS si_shipper,
    concat(buyer_core, ' ', buyer_form) AS si_consignee,
    concat(buyer_core, ' ', buyer_form) AS si_notify,
    CASE WHEN has_lines THEN concat(pol, ', ', pol_country, ' (', pol_code, ')') END AS si_pol,
    concat(pod, ', ', pod_country, ' (', pod_code, ')') AS si_pod,
    concat(CAST(n AS VARCHAR(20)), ' x 40', chr(39), 'HC') AS si_count,
    concat(kg_text, ' KG') AS si_weight,
    CASE WHEN NOT has_lines THEN NULL WHEN variant = 9 THEN concat('MERIDIAN EXPORTS ', shipper_form)
         WHEN variant = 10 THEN shipper_core
         WHEN variant = 1 THEN concat(shipper_core, ' ', CASE shipper_form WHEN 'SDN BHD' THEN 'SENDIRIAN BERHAD' WHEN 'PTE LTD' THEN 'PRIVATE LIMITED'
              WHEN 'CO LTD' THEN 'COMPANY, LIMITED' WHEN 'GMBH' THEN 'G.M.B.H.' ELSE 'L.L.C.' END)
         ELSE concat(shipper_core, ' ', shipper_form) END AS bl_shipper,
    CASE WHEN variant = 2 THEN concat('TO THE ORDER OF ', buyer_core, ' ', buyer_form)
         WHEN variant = 11 THEN concat('BUYR ', substr(buyer_core, 7), ' ', buyer_form)
         WHEN variant = 12 THEN 'TO ORDER'
         WHEN variant = 13 THEN 'TBA'
         WHEN variant = 3 THEN lower(concat(buyer_core, ' ', buyer_form))
         ELSE concat(buyer_core, ' ', buyer_form) END AS bl_consignee,
    CASE WHEN variant = 18 THEN concat(buyer_core, ' WEST ', buyer_form)
         ELSE concat(buyer_core, ' ', buyer_form) END AS bl_notify,
    CASE WHEN NOT has_lines THEN NULL WHEN variant = 4 THEN pol ELSE concat(pol, ', ', pol_country, ' (', pol_code, ')') END AS bl_pol,
    CASE WHEN variant = 8 THEN concat('PORT SUDAN, SUDAN (', pod_code, ')')
         WHEN variant = 17 THEN concat(pod, 'S, ', pod_country)
         WHEN variant = 5 THEN concat('Port of ', pod, ', ', pod_country)
         ELSE concat(pod, ', ', pod_country, ' (', pod_code, ')') END AS bl_pod,
    CASE WHEN variant = 6 THEN concat(CAST(n + 1 AS VARCHAR(20)), ' x 40', chr(39), 'HC')
         WHEN variant = 19 THEN concat(CAST(n AS VARCHAR(20)), ' x 20', chr(39), 'GP')
         WHEN variant = 2 THEN concat('SAY (', CAST(n AS VARCHAR(20)), ') CONTAINERS')
         ELSE concat(CAST(n AS VARCHAR(20)), ' x 40', chr(39), 'HC') END AS bl_count,
    CASE WHEN variant = 7 THEN concat(kg_text_500, ' KG')
         WHEN variant = 14 THEN '______ KG'
         WHEN variant = 4 THEN concat(CAST(q AS VARCHAR(20)), ' MT')
         WHEN variant = 5 THEN concat(kg_text, '.4')
         ELSE concat(kg_text, ' KGS') END AS bl_weight,
    concat(prefix, lpad(CAST(k AS VARCHAR(20)), 9, '0')) AS bl_no
  FROM weights w)
"""

# long form, one row per document field, straight from the forms (no text extraction)
FIELD_COLUMNS = [("shipper", "shipper"), ("consignee", "consignee"), ("notify_party", "notify"), ("port_of_loading", "pol"),
                 ("port_of_discharge", "pod"), ("container_count", "count"), ("gross_weight_kg", "weight")]
_LONG = " UNION ALL ".join(
    f"SELECT case_id, '{side.upper()}' AS side, '{field}' AS field, {side}_{col} AS raw, "
    f"'{'Gross Weight (KG)' if col == 'weight' else field}' AS label, CAST(0.98 AS DOUBLE) AS confidence FROM forms"
    for side in ("si", "bl")
    for field, col in FIELD_COLUMNS
)
FIELD_TABLE = f"{FORMS}, field_table AS (SELECT * FROM ({_LONG}) AS u WHERE raw IS NOT NULL)"

# the two documents as text; variant 15 and shipments without lines have no draft, 16 has a packing list
_SI_TEXT = """concat('SHIPPING INSTRUCTION\n====================\n\nShipper/Exporter: ', si_shipper, '\n  12 HARBOUR ROAD; UNIT 4\n  INDUSTRIAL ESTATE',
  '\nConsignee (Non-Negotiable): ', si_consignee, '\n  PO BOX ', CAST(custkey AS VARCHAR(20)), '\nNotify:\n', si_notify,
  '\nPort of Loading (POL): ', si_pol, '\nPOD: ', si_pod, '\nNo. of Containers: ', si_count, '\nNet Weight (kgs): 1\nGross Wt (kgs): ', si_weight,
  '\nVessel: TEST VESSEL V.001\n')"""
_BL_TEXT = """concat(CASE WHEN variant = 16 THEN 'PACKING LIST' WHEN variant % 2 = 0 THEN 'BILL OF LADING (DRAFT)' ELSE 'SEA WAYBILL' END,
  '\n======================\n\nSHIPPER: ', bl_shipper, '\n  12 HARBOUR ROAD; UNIT 4\nTo the Order of: ', bl_consignee, '\n  PO BOX ', CAST(custkey AS VARCHAR(20)),
  '\n\nNotify Party/Intermediate Consignee: ', bl_notify, '\nLoad Port: ', bl_pol, '\nDischarge Port: ', bl_pod, '\nContainer Count: ', bl_count,
  '\nSeal No.: 4711\nGross Weight (KG): ', bl_weight, '\nB/L No.: ', bl_no, '\n')"""
DOCUMENTS = f"""{FORMS},
docs AS (
  SELECT case_id, concat(case_id, '/SI') AS doc_id, CAST(0 AS INT) AS attachment_no, concat('attachments/', case_id, '_SI.txt') AS name,
         {_SI_TEXT} AS text, variant FROM forms WHERE has_lines
  UNION ALL
  SELECT case_id, concat(case_id, '/BL') AS doc_id, CAST(1 AS INT) AS attachment_no, concat('attachments/', case_id, '_BL.txt') AS name,
         {_BL_TEXT} AS text, variant FROM forms WHERE has_lines AND variant <> 15)
"""

# messages: the kind follows the order's priority and status; the parts are kept beside the body as truth
MESSAGES = f"""{FORMS},
parts AS (
  SELECT f.*,
    CASE WHEN has_lines AND opriority <> '5-LOW' THEN 'check'
         WHEN NOT has_lines AND opriority <> '5-LOW' THEN 'claim'
         WHEN ostatus = 'F' THEN 'invoice' WHEN ostatus = 'P' AND segment = 'machinery' THEN 'spam' WHEN ostatus = 'P' THEN 'notice'
         WHEN segment = 'building' THEN 'draft' ELSE 'order' END AS kind,
    CASE WHEN segment = 'furniture' THEN 'WARNING: This email originated outside of our organisation. Exercise caution with links.' ELSE '' END AS banner_text,
    CASE WHEN variant % 3 = 0 THEN 'Hi Team,' WHEN variant % 3 = 1 THEN 'Dear Sir' ELSE '' END AS greeting,
    CASE WHEN variant % 4 = 3 THEN '' WHEN variant % 4 = 2 THEN '-- \nDesk ' ELSE 'Best Regards,\nSam' END AS sign_off,
    CASE WHEN variant % 5 = 4 THEN '_____\nFrom: X\n\nold text about invoice' WHEN variant % 5 = 3 THEN 'On Monday, the agent wrote:\n> send the draft' ELSE '' END AS thread
  FROM forms f),
worded AS (
  SELECT p.*,
    CASE kind WHEN 'check' THEN concat('Attached are the SI and draft BL. Please check the details for B/L No: ', bl_no, ' and confirm.')
              WHEN 'claim' THEN concat('Please compare the SI and draft BL for ', bl_no, ' and confirm.')
              WHEN 'draft' THEN concat('Please assist to send the draft BL for ', bl_no, ' for checking asap.')
              WHEN 'order' THEN concat('Please find Shipping instruction for 5RCY-', lpad(CAST(k % 100000 AS VARCHAR(20)), 5, '0'), '.\n\nPOL: ', coalesce(pol, 'TBA'), '\nPOD: ', pod, '\n\nDocuments Required:\n3 originals')
              WHEN 'invoice' THEN concat('Query on invoice ', lpad(CAST(k AS VARCHAR(20)), 10, '5'), ': is the THC included or billed separately?')
              WHEN 'notice' THEN 'This is an automated notification. The billing process has completed successfully. No action required.'
              ELSE 'CONGRATULATIONS!!! You have won a gift card. Click here to claim: http://bit.ly/claim-prize-now' END AS said,
    concat(CASE WHEN kind = 'spam' THEN 'promo@best-deals.biz' WHEN variant % 2 = 0 THEN concat('hari_m@', segment, '-lines.com') ELSE concat('docs@', segment, '.com') END) AS sender,
    concat(CASE WHEN variant % 2 = 0 THEN 'RE: ' ELSE '' END, 'Shipment 5RMY-', lpad(CAST(k % 100000 AS VARCHAR(20)), 5, '0')) AS subject
  FROM parts p),
messages AS (
  SELECT case_id, sender, subject, kind, variant, has_lines, received_at, said, banner_text, sign_off, thread,
    concat(CASE WHEN banner_text = '' THEN '' ELSE concat(banner_text, '\n\n') END,
           CASE WHEN greeting = '' THEN '' ELSE concat(greeting, '\n\n') END, said,
           CASE WHEN sign_off = '' THEN '' ELSE concat('\n\n', sign_off) END,
           CASE WHEN thread = '' THEN '' ELSE concat('\n\n', thread) END) AS body,
    ostatus = 'F' AS is_read, price > 450000 AS starred, price < 20000 AS archived, bl_no, k
  FROM worded)
"""

# a finished case board, without running any check: statuses and flags follow order attributes
CASES = f"""{MESSAGES},
board AS (
  SELECT m.k, m.case_id, m.sender, m.subject, m.body, m.received_at, m.is_read, m.starred, m.archived, m.variant,
    CASE m.kind WHEN 'check' THEN 'BL_COMPARISON' WHEN 'claim' THEN 'BL_COMPARISON' WHEN 'draft' THEN 'BL_COMPARISON' WHEN 'order' THEN 'SI_REQUEST'
                WHEN 'invoice' THEN 'INVOICE_QUERY' WHEN 'notice' THEN CASE WHEN m.variant = 6 THEN NULL ELSE 'GENERAL' END ELSE 'SPAM' END AS category,
    CASE WHEN m.kind IN ('check') AND m.variant IN (6, 7, 8, 9) THEN 'MISMATCH'
         WHEN m.kind IN ('check') AND m.variant IN (10, 12, 13, 14, 15, 16, 17, 18) THEN 'NEEDS_REVIEW'
         WHEN m.kind = 'claim' THEN 'NEEDS_REVIEW'
         WHEN m.kind = 'notice' AND m.variant = 6 THEN 'PENDING'
         WHEN m.kind = 'check' AND m.variant = 19 AND m.starred THEN 'FAILED' ELSE 'OK' END AS status,
    CASE WHEN m.kind = 'claim' OR (m.kind = 'check' AND m.variant = 15) THEN 'missing_attachment'
         WHEN m.kind = 'check' AND m.variant = 16 THEN 'wrong_doc_type'
         WHEN m.kind = 'check' AND m.variant IN (10, 12, 13, 14, 17, 18) THEN CASE WHEN m.starred THEN 'unreadable' ELSE 'missing_value' END END AS review_reason,
    CASE WHEN m.kind <> 'check' THEN '' WHEN m.variant = 6 THEN 'container_count' WHEN m.variant = 7 THEN 'gross_weight_kg'
         WHEN m.variant = 8 THEN 'port_of_discharge' WHEN m.variant = 9 THEN 'shipper,gross_weight_kg' ELSE '' END AS defect_text,
    (m.kind = 'check' AND m.variant NOT IN (15, 16)) AS compared,
    CASE WHEN m.kind = 'check' AND m.variant IN (6, 7) THEN 0.75 ELSE 0.9 END AS confidence,
    (m.kind = 'claim' OR (m.kind = 'check' AND m.variant IN (10, 12, 13, 14, 15, 16, 17, 18))) AS needs_human,
    (m.is_read AND (m.kind = 'claim' OR (m.kind = 'check' AND m.variant IN (10, 12, 13)))) AS resolved,
    CASE substr(m.bl_no, 1, 4) WHEN 'MEDU' THEN 'MSC' WHEN 'OOLU' THEN 'OOCL' WHEN 'MAEU' THEN 'Maersk' WHEN 'SINF' THEN 'ONE' WHEN 'EGLV' THEN 'Evergreen' WHEN 'SIN2' THEN 'PIL' END AS carrier,
    CASE WHEN m.kind <> 'spam' THEN concat('Customer ', CAST(s.custkey % 40 AS VARCHAR(20))) END AS customer, s.pod AS pod,
    CAST(CASE WHEN m.kind = 'spam' OR m.variant = 3 THEN NULL ELSE s.suppkey % 5 + 1 END AS INT) AS assignee_id
  FROM messages m JOIN shipment s ON s.k = m.k)
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The driver's parquet tables by name."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in (names or TABLES)}


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """The orders over all cores. Everything rendered from them is long text and costly expressions over few bytes: a
    scan cuts its tasks by bytes, so a small file would leave all of that to one task. Dealt while rows are still narrow."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if name != "orders" or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(2 * cores, "o_orderkey")


def bind(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """Run a rendering query over the driver's tables."""
    for name in ("orders", "lineitem", "customer", "supplier", "events"):
        _spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name).createOrReplaceTempView(name)
    return spark.sql(f"WITH {ctes} {select}" if ctes else select)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, SHIPMENT, "SELECT * FROM shipment")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, FORMS, "SELECT * FROM forms")


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `field_table`, unpivoted from one pass over the forms."""
    cells = [
        F.struct(F.lit(side.upper()).alias("side"), F.lit(field).alias("field"), F.col(f"{side}_{col}").alias("raw"),
                 F.lit("Gross Weight (KG)" if col == "weight" else field).alias("label"))
        for side in ("si", "bl")
        for field, col in FIELD_COLUMNS
    ]
    long = forms(spark, sf_dir).select("case_id", F.explode(F.array(*cells)).alias("c")).select("case_id", "c.*").where("raw IS NOT NULL")
    return long.withColumns({"confidence": F.lit(0.98), "blank": is_blank(F.col("raw")), "method": F.lit("rule")})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `docs`, both documents from one pass over the forms."""

    def doc(side: str, no: int, text: str) -> Column:
        return F.struct(
            F.concat("case_id", F.lit(f"/{side}")).alias("doc_id"),
            F.lit(no).alias("attachment_no"),
            F.concat(F.lit("attachments/"), F.col("case_id"), F.lit(f"_{side}.txt")).alias("name"),
            F.expr(text).alias("text"),
        )

    pair = F.array(F.when(F.col("has_lines"), doc("SI", 0, _SI_TEXT)), F.when(F.col("has_lines") & (F.col("variant") != 15), doc("BL", 1, _BL_TEXT)))
    return forms(spark, sf_dir).select("case_id", "variant", F.explode(F.array_compact(pair)).alias("d")).select("case_id", "variant", "d.*")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, MESSAGES, "SELECT * FROM messages")


def case_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished case board with its defect list as an array."""
    board = bind(spark, sf_dir, CASES, "SELECT * FROM board")
    defects = F.when(F.col("defect_text") == "", F.array().cast("array<string>")).otherwise(F.split("defect_text", ","))
    return board.withColumn("defect_fields", defects)


# ---- tables rendered from `events`: corrections, activity, usage, knowledge history
CORRECTIONS = f"""{MESSAGES},
corrections AS (
  SELECT e.event_id AS id, m.case_id,
    CASE e.event_type WHEN 'click' THEN 'field_result' WHEN 'view' THEN 'category' WHEN 'error' THEN 'draft' WHEN 'signup' THEN 'field_value' ELSE 'verdict' END AS kind,
    CASE WHEN e.event_type IN ('click', 'signup') THEN CASE CAST(e.user_id % 5 AS INT) WHEN 0 THEN 'shipper' WHEN 1 THEN 'consignee' WHEN 2 THEN 'notify_party' WHEN 3 THEN 'port_of_discharge' ELSE 'container_count' END END AS field,
    CASE e.event_type WHEN 'click' THEN CASE WHEN e.value < 10 THEN 'match' WHEN e.value < 50 THEN 'mismatch' ELSE 'unsure' END
         WHEN 'error' THEN 'We found discrepancies. Please amend. All other fields match.' ELSE 'old' END AS ai_value,
    CASE e.event_type WHEN 'click' THEN CASE WHEN e.value > 300 THEN 'mismatch' ELSE 'match' END WHEN 'view' THEN 'GENERAL'
         WHEN 'error' THEN concat('We found discrepancies. Please quote BL no. ', m.bl_no, ' in your reply. Please amend. Dear all, thanks.') ELSE 'new' END AS final_value,
    CASE WHEN e.value < 100 THEN 'MISMATCH' ELSE 'OK' END AS status, m.sender, m.said AS message, m.bl_no,
    CASE CAST(e.user_id % 5 AS INT) WHEN 0 THEN f.si_shipper WHEN 1 THEN f.si_consignee WHEN 2 THEN f.si_notify WHEN 3 THEN f.si_pod ELSE f.si_count END AS left_value,
    CASE CAST(e.user_id % 5 AS INT) WHEN 0 THEN f.bl_shipper WHEN 1 THEN f.bl_consignee WHEN 2 THEN f.bl_notify WHEN 3 THEN f.bl_pod ELSE f.bl_count END AS right_value,
    CAST(e.user_id AS VARCHAR(20)) AS who, e.ts AS at, e.value > 200 AS consumed
  FROM events e
  JOIN messages m ON m.k = e.user_id * 100 + e.event_id % 100
  JOIN forms f ON f.k = m.k)
"""
ACTIVITY = """activity AS (SELECT event_id AS id, concat('case_', CAST(user_id AS VARCHAR(20))) AS case_id, event_type AS action, ts AS at FROM events)"""
USAGE = """usage_log AS (SELECT event_type AS task, CAST(1 AS BIGINT) AS calls, value / 1000 AS cost_usd, ts AS at FROM events)"""
HISTORY = """history AS (SELECT user_id AS item_id, event_id AS id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'edit' END AS action,
  concat('v', CAST(event_id AS VARCHAR(20))) AS value, ts AS at FROM events)"""
# several runs over every order: the later run of a case is the current one
VERSIONS = f"""{CASES},
versions AS (
  SELECT case_id, CAST(1 AS BIGINT) AS run_id, received_at AS processed_at, category, 'PENDING' AS status, review_reason FROM board
  UNION ALL
  SELECT case_id, CAST(2 AS BIGINT) AS run_id, received_at AS processed_at, category, status, review_reason FROM board WHERE NOT archived)
"""
TEAM = [(1, "Maya Tan", True), (2, "Arif Rahman", True), (3, "Dewi Lestari", False), (4, "Jun Wei Lim", True), (5, "Guest Viewer", False)]


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind(spark, sf_dir, CORRECTIONS, "SELECT * FROM corrections")
    return rows.withColumns({n: F.lit(None).cast("string") for n in ("oc_no", "booking", "invoice")})
