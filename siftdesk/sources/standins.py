"""The domain tables, put together from the generic test tables.

The SQL is portable: the same text builds the views in Spark and in the
oracle, so a comparison covers the operators and not the input. Ids stay
bigint; the operators do not depend on the key's type.
"""

from pyspark.sql import DataFrame, SparkSession

TICKETS = """
SELECT o_orderkey AS id,
  concat('Order ', o_orderkey, ' ', o_orderpriority) AS title,
  concat('Customer ', o_custkey, ' reports a problem with order ', o_orderkey) AS description,
  CASE o_orderkey % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'triaged' WHEN 2 THEN 'in_progress'
    WHEN 3 THEN 'waiting_on_customer' WHEN 4 THEN 'resolved' ELSE 'closed' END AS status,
  CASE o_custkey % 6 WHEN 3 THEN 'api' WHEN 4 THEN 'monitoring' WHEN 5 THEN 'email'
    ELSE 'web_form' END AS source,
  CASE WHEN o_custkey % 10 = 0 THEN NULL
    ELSE concat('customer', o_custkey, '@company.com') END AS submitter_email,
  CASE o_custkey % 4 WHEN 1 THEN 'agent_alice' WHEN 2 THEN 'agent_bob'
    WHEN 3 THEN 'agent_carlos' END AS assigned_to,
  o_orderdate AS created_at,
  CASE WHEN o_custkey % 5 = 0 THEN o_orderdate + INTERVAL '50' YEAR ELSE o_orderdate END AS updated_at
FROM {orders}
"""

# Some rows were last changed after all requests; their time must stay.
# Line items are summed up per order before the join, so the join is 1:1.
ENRICHMENTS = """
SELECT o_orderkey AS id, o_orderkey AS ticket_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
    WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CASE first_part % 5 WHEN 0 THEN 'bug_report' WHEN 1 THEN 'billing'
    WHEN 2 THEN 'account_access' WHEN 3 THEN 'feature_request' ELSE 'general' END AS category,
  concat('Summary of order ', o_orderkey) AS summary,
  concat('Reply to customer ', o_custkey) AS suggested_response,
  CAST(0.5 + top_discount * 5 AS DECIMAL(4,3)) AS confidence,
  'stand-in' AS model_used, 'v1.0' AS prompt_version,
  tokens_in, tokens_out,
  CAST(tokens_in * 0.000003 + tokens_out * 0.000015 AS DECIMAL(10,6)) AS estimated_cost,
  concat('raw ', o_orderkey) AS raw_response,
  o_orderdate AS created_at,
  CASE WHEN o_custkey % 5 = 0 THEN o_orderdate + INTERVAL '50' YEAR ELSE o_orderdate END AS updated_at
FROM {orders} JOIN (
  SELECT l_orderkey, min(l_partkey) AS first_part, max(l_discount) AS top_discount,
    CAST(500 + sum(l_quantity) AS INT) AS tokens_in,
    CAST(50 + max(l_quantity) * 3 AS INT) AS tokens_out
  FROM {lineitem} GROUP BY l_orderkey) x ON o_orderkey = l_orderkey
"""

_AGENT = "CASE user_id % 3 WHEN 0 THEN 'agent_alice' WHEN 1 THEN 'agent_bob' ELSE 'agent_carlos' END"
_SEVERITY = (
    "CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
)
_CATEGORY = (
    "CASE user_id % 5 WHEN 0 THEN 'bug_report' WHEN 1 THEN 'billing' "
    "WHEN 2 THEN 'account_access' WHEN 3 THEN 'feature_request' ELSE 'general' END"
)

ACTIONS = f"""
SELECT event_id AS id, CAST(floor(event_id / 3.0) AS BIGINT) AS ticket_id,
  {_AGENT} AS agent_id,
  CASE WHEN event_type IN ('error','click') THEN 'override' ELSE 'status_change' END AS action_type,
  CASE WHEN event_type IN ('error','click')
    THEN CASE event_id % 2 WHEN 0 THEN 'severity' ELSE 'category' END
    ELSE 'status' END AS override_field,
  CASE WHEN event_type IN ('error','click') THEN
      CASE WHEN event_id % 2 = 0 THEN {_SEVERITY} ELSE {_CATEGORY} END
    ELSE CASE user_id % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'resolved' ELSE 'closed' END
    END AS new_value,
  ts AS created_at
FROM {{events}}
"""

# Requests on every kind of target: known, unknown and not enriched tickets,
# wrong fields, wrong values and wrong agents among them.
OVERRIDE_REQUESTS = f"""
SELECT CASE WHEN user_id % 20 = 0 THEN event_id * 7
    ELSE CAST(floor(event_id / 4.0) AS BIGINT) END AS ticket_id,
  CASE event_id % 8 WHEN 0 THEN 'suggested_response' WHEN 7 THEN
      CASE WHEN event_type = 'view' THEN 'summary' ELSE 'category' END
    WHEN 1 THEN 'category' WHEN 2 THEN 'category' ELSE 'severity' END AS field,
  CASE event_id % 8 WHEN 0 THEN
      CASE WHEN event_type = 'view' THEN '' ELSE concat('Reply ', user_id) END
    WHEN 7 THEN {_CATEGORY} WHEN 1 THEN {_CATEGORY} WHEN 2 THEN {_CATEGORY}
    ELSE CASE WHEN user_id % 13 = 0 THEN 'HIGH' ELSE {_SEVERITY} END END AS new_value,
  CASE WHEN user_id % 17 = 0 THEN '' ELSE {_AGENT} END AS agent_id,
  ts AS requested_at, event_id AS seq
FROM {{events}}
"""

STATUS_REQUESTS = f"""
SELECT CASE WHEN user_id % 20 = 0 THEN event_id * 7
    ELSE CAST(floor(event_id / 4.0) AS BIGINT) END AS ticket_id,
  CASE event_id % 9 WHEN 0 THEN 'new' WHEN 1 THEN 'triaged' WHEN 2 THEN 'in_progress'
    WHEN 3 THEN 'waiting_on_customer' WHEN 4 THEN 'resolved' WHEN 5 THEN 'closed'
    WHEN 6 THEN 'in_progress' WHEN 7 THEN
      CASE WHEN event_type = 'view' THEN 'banana' ELSE 'in_progress' END END AS status,
  CASE user_id % 5 WHEN 0 THEN {_AGENT} WHEN 1 THEN '' END AS assigned_to,
  CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {_AGENT} END AS agent_id,
  ts AS requested_at, event_id AS seq
FROM {{events}}
"""

# Whole documents as submissions; a first line may exceed the title limit.
SUBMISSIONS = """
SELECT doc_id AS id,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN instr(text, chr(10)) > 0
    THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS description,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(source, ' with too long a name')
    ELSE source END AS source,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('user', doc_id, '@', repeat(lang, 130), '.com')
    ELSE concat('user', doc_id, '@company.com') END AS submitter_email,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM {documents}
"""

FORMS = """
SELECT doc_id AS id,
  CASE doc_id % 24 WHEN 0 THEN concat('  ', lang, ' ') WHEN 1 THEN '   ' WHEN 2 THEN NULL
    ELSE CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1)
      ELSE text END END AS title,
  CASE doc_id % 35 WHEN 0 THEN concat(chr(10), lang, chr(9)) WHEN 1 THEN chr(10)
    WHEN 2 THEN concat('Printer ', lang, ' jam')
    ELSE concat(chr(10), text, chr(9)) END AS description,
  CASE doc_id % 3 WHEN 0 THEN ' Ada' WHEN 1 THEN '' END AS first_name,
  CASE doc_id % 4 WHEN 0 THEN 'Byron ' WHEN 1 THEN '  ' WHEN 2 THEN 'King' END AS last_name,
  CASE WHEN doc_id % 5 < 3 THEN 'email' ELSE 'sms' END AS contact_method,
  CASE doc_id % 8 WHEN 0 THEN 'a@b' WHEN 1 THEN ' ' WHEN 2 THEN concat('x y@', lang, '.org')
    WHEN 3 THEN 'a@@b.c' ELSE concat('user', doc_id, '@', lang, '.example.org') END AS email,
  CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '555-1234' ELSE
    concat('(555) 010-', CAST(1000 + doc_id % 9000 AS VARCHAR(9))) END AS phone
FROM {documents}
"""

_QUOTED = (
    "concat(chr(34), replace(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))),"
    " chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')),"
    " chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')), chr(34))"
)
_LABELS = (
    "CASE n_chars % 4 WHEN 0 THEN 'critical' WHEN 1 THEN ' HIGH ' WHEN 2 THEN 'Medium' ELSE 'urgent' END"
)
_KINDS = (
    "CASE n_chars % 6 WHEN 0 THEN 'bug_report' WHEN 1 THEN 'Billing' WHEN 2 THEN 'account_access'"
    " WHEN 3 THEN 'feature_request' WHEN 4 THEN 'general' ELSE 'other' END"
)

# Replies that hold whole documents: plain, fenced, with keys missing or of
# the wrong type, with text after the object, and not JSON at all.
REPLIES = f"""
SELECT ticket_id, tokens_in, tokens_out,
  CASE form WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```')
    WHEN 2 THEN concat(' ```', body, '``` ') WHEN 3 THEN concat(chr(10), body, ' ')
    WHEN 4 THEN concat(body, ' and more') WHEN 5 THEN concat('```json ', body, '```')
    WHEN 6 THEN text ELSE body END AS raw_text
FROM (
  SELECT doc_id AS ticket_id, text, doc_id % 11 AS form,
    CAST(200 + n_chars AS INT) AS tokens_in, CAST(20 + n_chars % 300 AS INT) AS tokens_out,
    CASE doc_id % 11
      WHEN 7 THEN concat('{{{{"summary": ', CASE n_chars % 7 WHEN 0 THEN CAST(n_chars AS VARCHAR(20))
          WHEN 1 THEN concat(CAST(n_chars AS VARCHAR(20)), '.250') WHEN 2 THEN 'true' WHEN 3 THEN 'null'
          WHEN 4 THEN concat('-', CAST(1 + n_chars % 9 AS VARCHAR(20)), '.5e20') ELSE {_QUOTED} END, '}}}}')
      WHEN 8 THEN concat('{{{{"severity": null, "summary": ', {_QUOTED}, '}}}}')
      WHEN 9 THEN concat('{{{{"severity": "', {_LABELS}, '", "category": 5, "summary": ', {_QUOTED}, '}}}}')
      WHEN 10 THEN concat('{{{{"category": "', {_KINDS}, '", "confidence": "0.9", "suggested_response": ',
        {_QUOTED}, '}}}}')
      ELSE concat('{{{{"severity": "', {_LABELS}, '", "category": "', {_KINDS}, '", "confidence": ',
        CASE n_chars % 5 WHEN 0 THEN '7' WHEN 1 THEN '-1' WHEN 2 THEN 'true' WHEN 3 THEN 'null'
          ELSE concat('0.', CAST(10 + n_chars % 90 AS VARCHAR(9))) END,
        ', "suggested_response": "Thanks", "summary": ', {_QUOTED}, '}}}}') END AS body
  FROM {{documents}}) d
"""

# Expected labels of those documents that have quality marks.
EXPECTED = """
SELECT doc_id AS ticket_id,
  CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 1 THEN 'medium' ELSE 'low' END AS expected_severity,
  CASE WHEN quality = 1 THEN 'general' ELSE 'billing' END AS expected_category
FROM {labels}
"""

# Several enrichments per ticket, as if triggers had raced.
ENRICHMENT_COPIES = """
SELECT concat(l_partkey, '-', l_suppkey, '-', l_linenumber, '-', l_quantity) AS id,
  l_orderkey AS ticket_id, l_shipdate AS created_at
FROM {lineitem}
"""

VIEWS = {
    "tickets": TICKETS,
    "ai_enrichments": ENRICHMENTS,
    "agent_actions": ACTIONS,
    "override_requests": OVERRIDE_REQUESTS,
    "status_requests": STATUS_REQUESTS,
    "submissions": SUBMISSIONS,
    "forms": FORMS,
    "replies": REPLIES,
    "expected": EXPECTED,
    "enrichment_copies": ENRICHMENT_COPIES,
}

BASE_TABLES = ("orders", "lineitem", "events", "documents", "labels")


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the domain tables, as a frame over the base tables in ``sf_dir``."""
    used = [name for name in BASE_TABLES if "{" + name + "}" in VIEWS[view]]
    return standin_frame(view, **{name: base_table(spark, sf_dir, name) for name in used})


def standin_frame(view: str, **base: DataFrame) -> DataFrame:
    """The view over the given frames, which may be streams."""
    spark = next(iter(base.values())).sparkSession
    return spark.sql(VIEWS[view], **base)


def standin_sql(view: str) -> str:
    """The same view over base tables that are registered under their own names."""
    return VIEWS[view].format(**{name: name for name in BASE_TABLES})
