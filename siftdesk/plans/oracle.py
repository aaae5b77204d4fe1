"""The same questions in plain SQL, for a check against another engine."""

from siftdesk.constants import JS_SPACE, OVERRIDABLE_FIELDS, PY_SPACE, SEVERITIES, STATUSES
from siftdesk.plans.queries import AS_OF, CURSOR
from siftdesk.sources.standins import standin_sql

_STATEMENTS: dict[str, str] = {}


def statements() -> dict[str, str]:
    return dict(_STATEMENTS)


def _sql(name: str, views: str, body: str, **ctes: str) -> None:
    """Register ``body`` with the named stand-in views and further CTEs before it."""
    parts = [f"{view} AS ({standin_sql(view)})" for view in views.split()]
    parts += [f"{cte} AS ({text})" for cte, text in ctes.items()]
    prefix = f"WITH {', '.join(parts)}\n" if parts else ""
    _STATEMENTS[name] = prefix + body


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SEVERITY_SET = "('critical', 'high', 'medium', 'low')"
CATEGORY_SET = "('bug_report', 'billing', 'account_access', 'feature_request', 'general')"
FIELD_SET = "('severity', 'category', 'suggested_response')"

# Dashboards and reports


_BY_COUNT = "count(*) DESC, {column}"


def _ranked(domain) -> str:
    places = " ".join(f"WHEN '{value}' THEN {n}" for n, value in enumerate(domain))
    return f"CASE {{column}} {places} ELSE {len(domain)} END, {{column}}"


def _counted(view: str, column: str, order: str) -> str:
    order = order.format(column=column)
    return f"""SELECT {column} AS label, count(*) AS count,
    CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position FROM {view} GROUP BY {column}"""


_COUNTS = {
    "tickets_by_status": ("tickets", "status", _ranked(STATUSES)),
    "status_distribution": ("tickets", "status", _BY_COUNT),
    "enrichments_by_severity": ("ai_enrichments", "severity", _ranked(SEVERITIES)),
    "enrichments_by_category": ("ai_enrichments", "category", _BY_COUNT),
    "actions_by_type": ("agent_actions", "action_type", _BY_COUNT),
}
for _name, (_view, _column, _order) in _COUNTS.items():
    _sql(_name, _view, _counted(_view, _column, _order))
_sql(
    "stream_counts",
    "agent_actions",
    "SELECT action_type AS label, count(*) AS count FROM agent_actions GROUP BY action_type",
)

_sql(
    "overrides_by_field",
    "agent_actions",
    f"""SELECT override_field AS field, count(*) AS override_count FROM agent_actions
    WHERE action_type = 'override' AND override_field IN {FIELD_SET} GROUP BY override_field""",
)


def _summary_body(overridden: str, e: str = "ai_enrichments", a: str = "agent_actions") -> str:
    return f"""
SELECT
  (SELECT count(*) FROM tickets) AS total_tickets,
  (SELECT count(*) FROM tickets WHERE status NOT IN ('resolved', 'closed')) AS open_tickets,
  (SELECT count(*) FROM {e} WHERE severity IN ('critical', 'high')) AS critical_high_tickets,
  CAST(CASE WHEN (SELECT count(*) FROM {e}) = 0 THEN 0 ELSE round(
    ((SELECT count(*) FROM {e}) - (SELECT {overridden} FROM {a} WHERE action_type = 'override'))
      / CAST((SELECT count(*) FROM {e}) AS DOUBLE), 3) END AS DOUBLE) AS ai_accuracy_rate,
  (SELECT coalesce(round(CAST(CAST(sum(estimated_cost) * 1000000 AS HUGEINT) AS DOUBLE) / count(*))
    / 1000000, 0) FROM {e}) AS avg_enrichment_cost,
  (SELECT CAST(coalesce(sum(estimated_cost), 0) AS DOUBLE) FROM {e}) AS total_enrichment_cost,
  (SELECT count(*) FROM {e}) AS total_enriched
"""


_DASHBOARD = "tickets ai_enrichments agent_actions"
_sql("dashboard_summary_actions", _DASHBOARD, _summary_body("count(*)"))
_sql("dashboard_summary_tickets", _DASHBOARD, _summary_body("count(DISTINCT ticket_id)"))

# One row of three filtered counts, turned into rows; the field's name orders them.
_BREAKDOWN = f"""
WITH size AS (SELECT count(*) AS total_enriched FROM ai_enrichments),
wide AS (
  SELECT {", ".join(f"count(*) FILTER (override_field = '{f}') AS {f}" for f in OVERRIDABLE_FIELDS)}
  FROM agent_actions WHERE action_type = 'override'),
tall AS (UNPIVOT wide ON {", ".join(OVERRIDABLE_FIELDS)} INTO NAME field VALUE override_count)
SELECT field, override_count, total_enriched,
  CASE WHEN total_enriched > 0
    THEN round(CAST(total_enriched - override_count AS DOUBLE) / total_enriched, 3)
    ELSE 0.0::DOUBLE END AS accuracy_rate,
  CAST(rank() OVER (ORDER BY field) AS INT) AS position
FROM tall, size
"""
_sql("override_breakdown", "ai_enrichments agent_actions", "SELECT * FROM breakdown", breakdown=_BREAKDOWN)
_sql(
    "dashboard_charts",
    _DASHBOARD,
    " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, label, count, position FROM ({_counted(*_COUNTS[name])}) x"
        for chart, name in (
            ("by_severity", "enrichments_by_severity"),
            ("by_category", "enrichments_by_category"),
            ("by_status", "tickets_by_status"),
        )
    )
    + " UNION ALL SELECT 'override_breakdown', field, override_count, position FROM breakdown",
    breakdown=_BREAKDOWN,
)

_sql(
    "cost_summary",
    "ai_enrichments",
    """SELECT count(*) AS total, CAST(round(sum(estimated_cost), 4) AS DOUBLE) AS total_cost,
    round(CAST(sum(estimated_cost) AS DOUBLE) / count(*), 4) AS avg_cost FROM ai_enrichments""",
)

_sql(
    "dedupe_enrichments",
    "enrichment_copies",
    """SELECT id, ticket_id, created_at FROM (SELECT *, row_number() OVER
    (PARTITION BY ticket_id ORDER BY created_at, id) AS n FROM enrichment_copies) x WHERE n = 1""",
)

# Replies

_BODIES = f"""
SELECT *, trim(regexp_replace(regexp_replace(trim(raw_text, '{PY_SPACE}'),
  '^```[^\n]*\n|^```', ''), '```$', ''), '{PY_SPACE}') AS body FROM replies
"""
_OBJECTS = """
SELECT *, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'OBJECT' THEN body END END AS obj
FROM bodies
"""
_ERRORS = """
SELECT *, CASE WHEN obj IS NULL THEN 'not_an_object'
  WHEN coalesce(json_type(obj, '$.severity'), 'VARCHAR') <> 'VARCHAR' THEN 'severity_not_text'
  WHEN coalesce(json_type(obj, '$.category'), 'VARCHAR') <> 'VARCHAR' THEN 'category_not_text'
  END AS parse_error FROM objects
"""


def _label(key: str, domain: str, default: str) -> str:
    value = f"trim(lower(json_extract_string(obj, '$.{key}')), '{PY_SPACE}')"
    return f"CASE WHEN {value} IN {domain} THEN {value} ELSE '{default}' END"


_NUMBER = """greatest(0.0, least(1.0, CASE WHEN json_type(obj, '$.confidence')
  IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(obj, '$.confidence') AS DOUBLE)
  WHEN json_type(obj, '$.confidence') = 'BOOLEAN'
  THEN CASE json_extract_string(obj, '$.confidence') WHEN 'true' THEN 1.0 ELSE 0.0 END
  ELSE 0.5 END))"""
# The numbers that occur: integers, fractions of three places, and nnn.5e20.
_SUMMARY = """CASE json_type(obj, '$.summary') WHEN 'NULL' THEN 'None'
    WHEN 'BOOLEAN' THEN CASE json_extract_string(obj, '$.summary') WHEN 'true' THEN 'True' ELSE 'False' END
    WHEN 'DOUBLE' THEN CASE WHEN contains(body, '.5e20')
      THEN regexp_extract(body, '-[0-9]+\\.5') || 'e+20' ELSE regexp_extract(body, '[0-9]+\\.25') END
    ELSE coalesce(json_extract_string(obj, '$.summary'), 'No summary available') END"""
_PARSED = f"""
SELECT ticket_id,
  CASE WHEN parse_error IS NULL THEN {_label("severity", SEVERITY_SET, "medium")} END AS severity,
  CASE WHEN parse_error IS NULL THEN {_label("category", CATEGORY_SET, "general")} END AS category,
  CASE WHEN parse_error IS NULL THEN {_SUMMARY} END AS summary,
  CASE WHEN parse_error IS NULL THEN coalesce(json_extract_string(obj, '$.suggested_response'),
    'No response generated') END AS suggested_response,
  CASE WHEN parse_error IS NULL THEN CAST(round({_NUMBER}, 3) AS DOUBLE) END AS confidence,
  'stand-in' AS model_used, 'v1.0' AS prompt_version, tokens_in, tokens_out,
  CASE WHEN parse_error IS NULL THEN
    CAST(CAST((tokens_in * 3 + tokens_out * 15) / 1000000.0 AS DECIMAL(10,6)) AS DOUBLE) END AS estimated_cost,
  raw_text AS raw_response, parse_error
FROM errors
"""
_PARSING = {"bodies": _BODIES, "objects": _OBJECTS, "errors": _ERRORS, "parsed": _PARSED}

_sql("parse_responses", "replies", "SELECT * FROM parsed", **_PARSING)
_sql(
    "run_report",
    "replies",
    """
SELECT count(*) AS created, count(*) FILTER (parse_error IS NULL) AS enriched,
  count(*) FILTER (parse_error IS NOT NULL) AS failed,
  CAST(round(coalesce(sum(CAST(estimated_cost AS DECIMAL(10,6))), 0), 4) AS DOUBLE) AS total_cost,
  round(CAST(coalesce(sum(CAST(estimated_cost AS DECIMAL(10,6))), 0) AS DOUBLE)
    / greatest(count(*) FILTER (parse_error IS NULL), 1), 4) AS cost_per_ticket
FROM parsed
""",
    **_PARSING,
)

_EVALUATED = """
SELECT e.ticket_id, e.expected_severity, e.expected_category, p.severity, p.category,
  p.ticket_id IS NOT NULL AS predicted,
  coalesce(p.severity = e.expected_severity, FALSE) AS severity_match,
  coalesce(p.category = e.expected_category, FALSE) AS category_match
FROM expected e LEFT JOIN (SELECT * FROM parsed WHERE parse_error IS NULL) p ON e.ticket_id = p.ticket_id
"""
_sql("evaluate_labels", "replies expected", _EVALUATED, **_PARSING)
_sql(
    "match_rates",
    "replies expected",
    """SELECT count(*) AS evaluated, count(*) FILTER (predicted) AS predicted,
    avg(CASE WHEN severity_match THEN 1.0 ELSE 0.0 END) AS severity_rate,
    avg(CASE WHEN category_match THEN 1.0 ELSE 0.0 END) AS category_rate FROM evaluated""",
    **_PARSING,
    evaluated=_EVALUATED,
)
_sql(
    "response_cost",
    "ai_enrichments",
    """SELECT ticket_id, CAST(CAST((tokens_in * 3 + tokens_out * 15) / 1000000.0
    AS DECIMAL(10,6)) AS DOUBLE) AS cost FROM ai_enrichments""",
)
_sql(
    "apply_enrichments",
    "tickets replies",
    f"""SELECT t.id, CASE WHEN p.ticket_id IS NULL THEN t.status ELSE 'triaged' END AS status,
    CASE WHEN p.ticket_id IS NULL OR t.status = 'triaged' THEN t.updated_at
      ELSE greatest(t.updated_at, TIMESTAMP '{AS_OF}') END AS updated_at
    FROM tickets t LEFT JOIN (SELECT ticket_id FROM parsed WHERE parse_error IS NULL) p
    ON t.id = p.ticket_id""",
    **_PARSING,
)

# Lists and lookups

_BOTH = "tickets ai_enrichments"
_ITEMS = """
SELECT t.*, e.severity, e.category, CAST(e.confidence AS DOUBLE) AS confidence
FROM tickets t LEFT JOIN ai_enrichments e ON t.id = e.ticket_id
"""
_sql(
    "latest_five",
    _BOTH,
    """SELECT id, title, status, severity, category, confidence FROM items
    ORDER BY created_at DESC, id DESC LIMIT 5""",
    items=_ITEMS,
)


def _page(name: str, limit: int, order: str = "DESC", where: str = "TRUE") -> None:
    body = f"SELECT * FROM items WHERE {where} ORDER BY created_at {order}, id {order} LIMIT {limit}"
    _sql(name, _BOTH, body, items=_ITEMS)


def _after(sign: str) -> str:
    return f"(created_at, id) {sign} (SELECT (created_at, id) FROM tickets WHERE id = {CURSOR})"


_FILTERED = "status = 'in_progress' AND severity = 'high' AND assigned_to = 'agent_bob'"
_page("list_page_desc", 20)
_page("list_page_asc", 45, "ASC")
_page("list_page_filtered", 20, where=_FILTERED)
_page("list_page_after_cursor", 100, where=_after("<"))
_page("list_page_after_cursor_asc", 100, "ASC", f"category = 'billing' AND {_after('>')}")
_page("list_page_unknown_cursor", 20)

_sql(
    "list_page_record",
    _BOTH,
    """
SELECT coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) FILTER (n <= 10), '') AS tickets,
  CASE WHEN count(*) > 10 THEN CAST(max(id) FILTER (n = 10) AS VARCHAR) END AS next_cursor,
  count(*) > 10 AS has_more, (SELECT count(*) FROM matching) AS total
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM rest) x
""",
    items=_ITEMS,
    matching=f"SELECT * FROM items WHERE {_FILTERED}",
    rest=f"SELECT * FROM matching WHERE {_after('<')}",
)
_sql(
    "list_items",
    _BOTH,
    "SELECT * FROM items WHERE category = 'account_access' AND status = 'new'",
    items=_ITEMS,
)
_sql(
    "list_total",
    _BOTH,
    "SELECT count(*) AS total FROM items WHERE status = 'resolved' AND category = 'billing'",
    items=_ITEMS,
)
_sql(
    "page_ranges",
    "tickets",
    """
SELECT p AS page, (p - 1) * 45 + 1 AS range_start, least(p * 45, n) AS range_end, n AS total
FROM (SELECT count(*) AS n FROM tickets) c, unnest(generate_series(1, CAST(ceil(n / 45.0) AS BIGINT))) AS u(p)
""",
)

_sql(
    "stored_page",
    "tickets",
    """
SELECT id, status, created_at, r AS row
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r, count(*) OVER () AS n FROM tickets) x
WHERE (r - 1) // 45 = n * 3 // 4 // 45
""",
)
_sql(
    "stored_page_after",
    "tickets",
    f"""
SELECT id, status, created_at, CAST(row_number() OVER (ORDER BY created_at, id) AS INT) AS position FROM tickets
WHERE (created_at, id) > (SELECT (created_at, id) FROM tickets WHERE id = {CURSOR})
ORDER BY created_at, id LIMIT 60
""",
)
_sql(
    "ticket_pages",
    "tickets",
    """
SELECT id, r AS row, (r - 1) // 45 + 1 AS page, (r - 1) // 45 * 45 + 1 AS range_start,
  least((r - 1) // 45 * 45 + 45, n) AS range_end, n AS total
FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r, count(*) OVER () AS n FROM tickets) x
""",
)

_DETAIL = (
    "id severity category summary suggested_response confidence model_used prompt_version "
    "tokens_in tokens_out estimated_cost raw_response created_at"
).split()
_DETAIL_SQL = ", ".join(
    f"CAST(e.{c} AS DOUBLE) AS enrichment_{c}"
    if c in ("id", "confidence", "tokens_in", "tokens_out", "estimated_cost")
    else f"e.{c} AS enrichment_{c}"
    for c in _DETAIL
)
_sql(
    "ticket_detail",
    _BOTH,
    f"SELECT t.*, {_DETAIL_SQL} FROM tickets t LEFT JOIN ai_enrichments e ON t.id = e.ticket_id",
)
_sql(
    "get_ticket",
    "tickets",
    """SELECT w.id, t.title, t.status, t.id IS NOT NULL AS found
    FROM (SELECT DISTINCT event_id * 2 AS id FROM events) w LEFT JOIN tickets t ON w.id = t.id""",
)
_sql(
    "action_history",
    "agent_actions",
    """SELECT ticket_id, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC)
    AS position, id, action_type, new_value, created_at FROM agent_actions""",
)
_sql(
    "pending_enrichment",
    _BOTH,
    "SELECT * FROM tickets WHERE id NOT IN (SELECT ticket_id FROM ai_enrichments)",
)
_sql(
    "orphan_actions",
    "tickets agent_actions",
    """SELECT * FROM agent_actions a WHERE NOT EXISTS
    (SELECT 1 FROM tickets t WHERE t.id = a.ticket_id AND t.status <> 'closed')""",
)
_sql(
    "cascade_delete",
    _DASHBOARD,
    """
SELECT 'tickets' AS table_name, id FROM tickets WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'ai_enrichments', id FROM ai_enrichments WHERE ticket_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'agent_actions', id FROM agent_actions WHERE ticket_id NOT IN (SELECT id FROM gone)
""",
    gone="SELECT id FROM tickets WHERE status = 'closed'",
)
_sql(
    "display_columns",
    _BOTH,
    """
SELECT id,
  CASE status WHEN 'new' THEN 'New' WHEN 'triaged' THEN 'Triaged' WHEN 'in_progress' THEN 'In Progress'
    WHEN 'waiting_on_customer' THEN 'Waiting' WHEN 'resolved' THEN 'Resolved' WHEN 'closed' THEN 'Closed'
    ELSE status END AS status_label,
  CASE severity WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium'
    WHEN 'low' THEN 'Low' ELSE severity END AS severity_label,
  CASE category WHEN 'bug_report' THEN 'Bug Report' WHEN 'billing' THEN 'Billing'
    WHEN 'account_access' THEN 'Account Access' WHEN 'feature_request' THEN 'Feature Request'
    WHEN 'general' THEN 'General' ELSE category END AS category_label,
  CASE source WHEN 'web_form' THEN 'Form' ELSE source END AS source_label,
  CAST(percent AS DOUBLE) AS confidence_percent,
  CASE WHEN percent >= 80 THEN 'green' WHEN percent >= 50 THEN 'yellow' WHEN percent IS NOT NULL THEN 'red'
    END AS confidence_band,
  age AS age_seconds,
  CASE WHEN abs(age) < 60 THEN 'seconds' WHEN abs(age) < 3600 THEN 'minutes' WHEN abs(age) < 86400 THEN 'hours'
    WHEN abs(age) < 2592000 THEN 'days' WHEN abs(age) < 31536000 THEN 'months' ELSE 'years' END AS age_bucket
FROM aged
""",
    items=_ITEMS,
    aged=f"""SELECT *, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS percent,
    CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(created_at) AS BIGINT) AS age FROM items""",
)


def _json(**fields: str) -> str:
    """A JSON object of SQL values that are JSON texts already; null stays null."""
    pairs = " || ',' || ".join(f"'\"{name}\":' || coalesce({value}, 'null')" for name, value in fields.items())
    return f"'{{{{' || {pairs} || '}}}}'".replace("{{", "{").replace("}}", "}")


def _quoted(column: str) -> str:
    return f"('\"' || {column} || '\"')"


def _moment(column: str) -> str:
    return f"strftime({column}, '\"%Y-%m-%dT%H:%M:%S.%g\"')"


_JSON_ITEM = _json(
    id="CAST(id AS VARCHAR)",
    title=_quoted("title"),
    description=_quoted("description"),
    status=_quoted("status"),
    source=_quoted("source"),
    submitter_email=_quoted("submitter_email"),
    assigned_to=_quoted("assigned_to"),
    created_at=_moment("created_at"),
    updated_at=_moment("updated_at"),
    severity=_quoted("severity"),
    category=_quoted("category"),
    confidence="CAST(exact AS VARCHAR)",
)
_sql(
    "json_records",
    _BOTH,
    f"SELECT {_JSON_ITEM} AS record FROM exact_items",
    exact_items="""SELECT t.*, e.severity, e.category, e.confidence AS exact
    FROM tickets t LEFT JOIN ai_enrichments e ON t.id = e.ticket_id""",
)
_JSON_ENRICHMENT = _json(
    **{
        name: f"CAST(e.{name} AS VARCHAR)"
        if name in ("id", "confidence", "tokens_in", "tokens_out", "estimated_cost")
        else _moment("e.created_at")
        if name == "created_at"
        else _quoted(f"e.{name}")
        for name in _DETAIL
    }
)
_JSON_DETAIL = _json(
    id="CAST(t.id AS VARCHAR)",
    status=_quoted("t.status"),
    created_at=_moment("t.created_at"),
    enrichment=f"CASE WHEN e.id IS NOT NULL THEN {_JSON_ENRICHMENT} END",
)
_sql(
    "json_details",
    _BOTH,
    f"SELECT {_JSON_DETAIL} AS record FROM tickets t LEFT JOIN ai_enrichments e ON t.id = e.ticket_id",
)
_sql(
    "stored_actions",
    "agent_actions",
    """SELECT CAST(id AS VARCHAR) AS id, CAST(ticket_id AS VARCHAR) AS ticket_id, agent_id, action_type,
    override_field, CAST(NULL AS VARCHAR) AS old_value, new_value, created_at,
    CAST(NULL AS TIMESTAMP) AS updated_at
    FROM agent_actions WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
_sql(
    "stored_views",
    _BOTH,
    """SELECT t.status, e.severity, count(*) AS tickets, CAST(sum(e.tokens_in) AS BIGINT) AS tokens_in
    FROM tickets t JOIN ai_enrichments e ON t.id = e.ticket_id GROUP BY t.status, e.severity""",
)
_sql(
    "upgrade_enrichments",
    "ai_enrichments",
    """
SELECT id, severity, CAST(confidence AS DOUBLE) AS confidence, 'v1.0' AS prompt_version, 0 AS tokens_in,
  0 AS tokens_out, CAST(0 AS DOUBLE) AS estimated_cost, CAST(NULL AS VARCHAR) AS raw_response FROM ai_enrichments
UNION ALL SELECT id, severity, CAST(confidence AS DOUBLE), prompt_version, tokens_in, tokens_out,
  CAST(estimated_cost AS DOUBLE), raw_response FROM ai_enrichments
""",
)

# Intake


def _checked(source: str) -> str:
    return f"""
SELECT id, title, description, {source} AS source, submitter_email,
  concat_ws(',', CASE WHEN NOT coalesce(length(title) BETWEEN 1 AND 255, FALSE) THEN 'title_length' END,
    CASE WHEN NOT coalesce(length(description) >= 1, FALSE) THEN 'description_empty' END,
    CASE WHEN length({source}) > 20 THEN 'source_length' END,
    CASE WHEN length(submitter_email) > 255 THEN 'email_length' END) AS errors
FROM submissions
"""


_ACCEPTED = """
SELECT id, title, description, 'new' AS status, source, submitter_email,
  CAST(NULL AS VARCHAR) AS assigned_to FROM checked WHERE errors = ''
"""
_REJECTED = "SELECT * FROM checked WHERE errors <> ''"
_FORM, _EXTERNAL = _checked("'web_form'"), _checked("coalesce(source, 'api')")
_sql("intake_form_accepted", "submissions", _ACCEPTED, checked=_FORM)
_sql("intake_form_rejected", "submissions", _REJECTED, checked=_FORM)
_sql("intake_external_accepted", "submissions", _ACCEPTED, checked=_EXTERNAL)
_sql("intake_external_rejected", "submissions", _REJECTED, checked=_EXTERNAL)
_sql(
    "stream_intake",
    "submissions",
    """SELECT id, title, 'new' AS status, source, errors,
    CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS side FROM checked""",
    checked=_EXTERNAL,
)


def _js(column: str) -> str:
    return f"trim(coalesce({column}, ''), '{JS_SPACE}')"


def _units(value: str) -> str:
    """UTF-16 length: characters outside the basic plane count twice."""
    return f"(length({value}) + length(regexp_replace({value}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


_FORM_ERRORS = f"""
SELECT *,
  CASE WHEN {_units(_js("title"))} = 0 THEN 'title_required'
    WHEN {_units(_js("title"))} < 5 THEN 'title_short' END AS title_error,
  CASE WHEN {_units(_js("description"))} = 0 THEN 'description_required'
    WHEN {_units(_js("description"))} < 10 THEN 'description_short' END AS description_error,
  CASE WHEN contact_method = 'email' THEN
    CASE WHEN {_js("email")} = '' THEN 'email_required' WHEN NOT regexp_full_match(email,
      '[^{JS_SPACE}@]+@[^{JS_SPACE}@]+\\.[^{JS_SPACE}@]+') THEN 'email_invalid' END
    ELSE CASE WHEN {_js("phone")} = '' THEN 'phone_required'
      WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) < 10 THEN 'phone_invalid' END END AS contact_error
FROM forms
"""
_FORM_CONTACT = f"""
SELECT *, trim(concat_ws(' ', nullif({_js("first_name")}, ''), nullif({_js("last_name")}, ''))) AS full_name,
  CASE WHEN contact_method = 'email' THEN {_js("email")} ELSE concat('sms:', {_js("phone")}) END AS reach
FROM checked
"""
_CONTACT = "CASE WHEN full_name = '' THEN reach ELSE concat(full_name, ' <', reach, '>') END"
_FORM_CTES = {"checked": _FORM_ERRORS, "contacts": _FORM_CONTACT}
_sql(
    "form_rules",
    "forms",
    f"""SELECT id, concat_ws(',', title_error, description_error, contact_error) AS errors,
    coalesce({_units("description")} BETWEEN 1 AND 19, FALSE) AS short_description FROM checked""",
    **_FORM_CTES,
)
_sql("contact_string", "forms", f"SELECT id, {_CONTACT} AS contact FROM contacts", **_FORM_CTES)
_sql(
    "submit_forms",
    "forms",
    f"""SELECT id, {_js("title")} AS title, {_js("description")} AS description, {_CONTACT} AS submitter_email
    FROM contacts WHERE title_error IS NULL AND description_error IS NULL AND contact_error IS NULL""",
    **_FORM_CTES,
)

# Scoring: the rule scorer's replies follow from lengths alone.

_SCORED = """
SELECT *, CASE WHEN ok1 THEN 1 WHEN ok2 THEN 2 ELSE 3 END AS tries, ok1 OR ok2 OR ok3 AS fine
FROM (SELECT *, a % 7 <> 0 AND NOT unreadable AND a % 4 < 1 AS ok1,
    NOT raising AND NOT unreadable AND a % 4 < 2 AS ok2, NOT raising AND NOT unreadable AND a % 4 < 3 AS ok3
  FROM (SELECT id AS ticket_id, description, length(title) AS a, length(description) AS b,
      length(description) % 50 = 0 AS unreadable, length(description) % 11 = 0 AS raising
    FROM accepted) x) y
"""
_OUTCOME = """
SELECT ticket_id,
  CASE WHEN fine THEN CASE b % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium'
    ELSE 'low' END END AS severity,
  CASE WHEN fine THEN CASE a % 3 WHEN 0 THEN 'billing' WHEN 1 THEN 'general' ELSE 'bug_report' END END AS category,
  CASE WHEN fine THEN concat(a, ' and ', b, ' characters') END AS summary,
  CASE WHEN fine THEN description END AS suggested_response,
  CASE WHEN fine THEN (b % 100) / 100.0 END AS confidence,
  CAST(CASE WHEN fine OR NOT (raising OR unreadable) THEN a + b ELSE 0 END AS INT) AS tokens_in,
  CAST(CASE WHEN fine OR NOT (raising OR unreadable) THEN 10 * tries ELSE 0 END AS INT) AS tokens_out,
  CASE WHEN fine THEN CAST(CAST(((a + b) * 3 + 10 * tries * 15) / 1000000.0 AS DECIMAL(10,6)) AS DOUBLE) END
    AS estimated_cost,
  CAST(tries AS INT) AS attempts,
  CASE WHEN fine THEN NULL WHEN raising THEN 'ValueError: cannot read'
    WHEN unreadable THEN 'unreadable ticket' ELSE 'not_an_object' END AS last_error
FROM scored
"""
_SCORING = {"checked": _EXTERNAL, "accepted": _ACCEPTED, "scored": _SCORED, "outcome": _OUTCOME}
_sql(
    "scorer_input",
    "submissions",
    """SELECT id, concat('Ticket title: ', title, chr(10), chr(10), 'Ticket description: ', description) AS input
    FROM accepted""",
    checked=_EXTERNAL,
    accepted=_ACCEPTED,
)
_sql(
    "score_batches",
    "submissions",
    "SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM outcome",
    **_SCORING,
)
_sql(
    "stream_enrich",
    "submissions",
    """SELECT * EXCLUDE (attempts, last_error) REPLACE (CAST(confidence AS DOUBLE) AS confidence)
    FROM outcome WHERE last_error IS NULL""",
    **_SCORING,
)

_sql(
    "stream_enrich_by_state",
    "submissions",
    """SELECT * EXCLUDE (attempts, last_error) REPLACE (CAST(confidence AS DOUBLE) AS confidence)
    FROM outcome WHERE last_error IS NULL""",
    **_SCORING,
)

_sql(
    "stream_outcomes",
    "submissions",
    """SELECT 'enrichments' AS kind, ticket_id, severity AS value FROM outcome WHERE last_error IS NULL
    UNION ALL SELECT 'changes', ticket_id, 'triaged' FROM outcome WHERE last_error IS NULL
    UNION ALL SELECT 'failures', ticket_id, last_error FROM outcome WHERE last_error IS NOT NULL""",
    **_SCORING,
)

_sql(
    "stream_triaged",
    "submissions",
    """SELECT ticket_id AS id, CASE WHEN last_error IS NULL THEN 'triaged' ELSE 'new' END AS status
    FROM outcome""",
    **_SCORING,
)

# Changes

_OVERRIDE_VIEWS = "tickets ai_enrichments override_requests"
_GOOD_VALUE = f"""(field = 'severity' AND new_value IN {SEVERITY_SET}
  OR field = 'category' AND new_value IN {CATEGORY_SET} OR field = 'suggested_response')"""
_WELL_FORMED = "field IS NOT NULL AND length(new_value) >= 1 AND length(agent_id) BETWEEN 1 AND 100"
_OVERRIDES = {
    "present": "SELECT id FROM tickets WHERE id % 16 <> 3",
    "valid": f"""SELECT * FROM override_requests WHERE {_WELL_FORMED} AND {_GOOD_VALUE}
    AND ticket_id IN (SELECT id FROM present)""",
    "logged": """
SELECT v.*, coalesce(lag(v.new_value) OVER (PARTITION BY v.ticket_id, v.field ORDER BY requested_at, seq),
    CASE v.field WHEN 'severity' THEN e.severity WHEN 'category' THEN e.category
      ELSE e.suggested_response END) AS old_value,
  row_number() OVER (PARTITION BY v.ticket_id, v.field ORDER BY requested_at DESC, seq DESC) AS n
FROM valid v JOIN ai_enrichments e ON v.ticket_id = e.ticket_id
""",
    "latest": """
SELECT ticket_id, max(new_value) FILTER (field = 'severity' AND n = 1) AS severity,
  max(new_value) FILTER (field = 'category' AND n = 1) AS category,
  max(new_value) FILTER (field = 'suggested_response' AND n = 1) AS suggested_response,
  max(requested_at) FILTER (old_value <> new_value) AS moved_at
FROM logged GROUP BY ticket_id
""",
    "state": """
SELECT e.ticket_id, coalesce(l.severity, e.severity) AS severity, coalesce(l.category, e.category) AS category,
  coalesce(l.suggested_response, e.suggested_response) AS suggested_response,
  greatest(coalesce(l.moved_at, e.updated_at), e.updated_at) AS updated_at, e.estimated_cost
FROM ai_enrichments e LEFT JOIN latest l ON e.ticket_id = l.ticket_id
""",
    "log": """
SELECT ticket_id, agent_id, 'override' AS action_type, field AS override_field, old_value, new_value,
  requested_at AS created_at, requested_at AS updated_at FROM logged
""",
}
_sql("apply_overrides_state", _OVERRIDE_VIEWS, "SELECT * EXCLUDE (estimated_cost) FROM state", **_OVERRIDES)
_sql("apply_overrides_log", _OVERRIDE_VIEWS, "SELECT * FROM log", **_OVERRIDES)
_sql("stream_overrides_log", _OVERRIDE_VIEWS, "SELECT * FROM log", **_OVERRIDES)
_sql(
    "apply_overrides_rejects",
    _OVERRIDE_VIEWS,
    """
SELECT * EXCLUDE (known, enriched), CASE reason
  WHEN 'invalid_override_field' THEN 'severity,category,suggested_response'
  WHEN 'invalid_override_value' THEN CASE field WHEN 'severity' THEN 'critical,high,low,medium'
    ELSE 'account_access,billing,bug_report,feature_request,general' END END AS valid_values
FROM (SELECT *, CASE WHEN NOT (WELL) THEN 'invalid_request' WHEN known IS NULL THEN 'ticket_not_found'
    WHEN enriched IS NULL THEN 'no_enrichment' WHEN field NOT IN FIELDS THEN 'invalid_override_field'
    WHEN NOT VALUE THEN 'invalid_override_value' END AS reason
  FROM (SELECT r.*, t.id AS known, e.ticket_id AS enriched FROM override_requests r
    LEFT JOIN present t ON r.ticket_id = t.id LEFT JOIN ai_enrichments e ON r.ticket_id = e.ticket_id) x) y
WHERE reason IS NOT NULL
""".replace("WELL", _WELL_FORMED).replace("FIELDS", FIELD_SET).replace("VALUE", _GOOD_VALUE),
    present=_OVERRIDES["present"],
)
_sql("dashboard_after_overrides", _OVERRIDE_VIEWS, _summary_body("count(*)", "state", "log"), **_OVERRIDES)
_sql("dashboard_from_partials", _OVERRIDE_VIEWS, _summary_body("count(*)", "state", "log"), **_OVERRIDES)

_STATUS_VIEWS = "tickets status_requests"
_STATUS = {
    "valid": f"SELECT * FROM status_requests WHERE status IS NULL OR status IN {_in(STATUSES)}",
    "long": """
SELECT ticket_id, agent_id, requested_at, seq, 'status' AS field, status AS new_value
FROM valid WHERE status IS NOT NULL
UNION ALL SELECT ticket_id, agent_id, requested_at, seq, 'assigned_to', assigned_to
FROM valid WHERE assigned_to IS NOT NULL
""",
    "chained": """
SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.ticket_id, l.field ORDER BY requested_at, seq) = 1
    THEN CASE l.field WHEN 'status' THEN t.status ELSE t.assigned_to END
    ELSE lag(l.new_value) OVER (PARTITION BY l.ticket_id, l.field ORDER BY requested_at, seq) END AS old_value,
  row_number() OVER (PARTITION BY l.ticket_id, l.field ORDER BY requested_at DESC, seq DESC) AS n
FROM long l JOIN tickets t ON l.ticket_id = t.id
""",
    "latest": """
SELECT ticket_id, max(new_value) FILTER (field = 'status' AND n = 1) AS status,
  max(new_value) FILTER (field = 'assigned_to' AND n = 1) AS assigned_to,
  max(requested_at) FILTER (old_value IS DISTINCT FROM new_value) AS moved_at
FROM chained GROUP BY ticket_id
""",
}
_sql(
    "apply_status_state",
    _STATUS_VIEWS,
    """SELECT t.id, coalesce(l.status, t.status) AS status, coalesce(l.assigned_to, t.assigned_to) AS assigned_to,
    greatest(coalesce(l.moved_at, t.updated_at), t.updated_at) AS updated_at
    FROM tickets t LEFT JOIN latest l ON t.id = l.ticket_id""",
    **_STATUS,
)
for _name in ("status_from_partials", "stream_status_counts"):
    _sql(
        _name,
        _STATUS_VIEWS,
        """SELECT coalesce(l.status, t.status) AS label, count(*) AS count
        FROM tickets t LEFT JOIN latest l ON t.id = l.ticket_id GROUP BY 1""",
        **_STATUS,
    )
_sql(
    "apply_status_log",
    _STATUS_VIEWS,
    """SELECT ticket_id, coalesce(nullif(agent_id, ''), 'system') AS agent_id, 'status_change' AS action_type,
    'status' AS override_field, old_value, new_value, requested_at AS created_at, requested_at AS updated_at
    FROM chained WHERE field = 'status' AND old_value <> new_value""",
    **_STATUS,
)
_sql(
    "apply_status_rejects",
    _STATUS_VIEWS,
    f"""
SELECT *, CASE reason WHEN 'invalid_status' THEN '{",".join(STATUSES)}' END AS valid_values
FROM (SELECT r.*, CASE WHEN t.id IS NULL THEN 'ticket_not_found'
    WHEN r.status NOT IN {_in(STATUSES)} THEN 'invalid_status' END AS reason
  FROM status_requests r LEFT JOIN tickets t ON r.ticket_id = t.id) x
WHERE reason IS NOT NULL
""",
)
_sql(
    "current_state",
    "tickets agent_actions",
    """
SELECT t.id, coalesce(l.status, t.status) AS status,
  greatest(coalesce(l.moved_at, t.updated_at), t.updated_at) AS updated_at
FROM tickets t LEFT JOIN (SELECT ticket_id, max(new_value) FILTER (n = 1) AS status,
  max(created_at) FILTER (old_value <> new_value) AS moved_at FROM chained GROUP BY ticket_id) l
  ON t.id = l.ticket_id
""",
    chained="""
SELECT a.*, row_number() OVER (PARTITION BY a.ticket_id ORDER BY a.created_at DESC, a.id DESC) AS n,
  coalesce(lag(a.new_value) OVER (PARTITION BY a.ticket_id ORDER BY a.created_at, a.id), t.status) AS old_value
FROM agent_actions a JOIN tickets t ON a.ticket_id = t.id WHERE a.override_field = 'status'
""",
)
_sql(
    "updated_in_place",
    "tickets agent_actions",
    """
SELECT t.id, coalesce(l.status, t.status) AS status,
  greatest(coalesce(l.moved_at, t.updated_at), t.updated_at) AS updated_at
FROM tickets t LEFT JOIN (SELECT ticket_id, max(new_value) FILTER (n = 1) AS status,
  max(created_at) FILTER (old_value <> new_value) AS moved_at FROM chained GROUP BY ticket_id) l
  ON t.id = l.ticket_id
""",
    chained="""
SELECT a.*, row_number() OVER (PARTITION BY a.ticket_id ORDER BY a.created_at DESC, a.id DESC) AS n,
  coalesce(lag(a.new_value) OVER (PARTITION BY a.ticket_id ORDER BY a.created_at, a.id), t.status) AS old_value
FROM agent_actions a JOIN tickets t ON a.ticket_id = t.id WHERE a.override_field = 'status' AND a.ticket_id % 50 = 7
""",
)
_sql(
    "current_labels",
    "ai_enrichments agent_actions",
    """
SELECT e.ticket_id, coalesce(l.severity, e.severity) AS severity, coalesce(l.category, e.category) AS category,
  greatest(coalesce(l.moved_at, e.updated_at), e.updated_at) AS updated_at
FROM ai_enrichments e LEFT JOIN (
  SELECT ticket_id, max(new_value) FILTER (n = 1 AND override_field = 'severity') AS severity,
    max(new_value) FILTER (n = 1 AND override_field = 'category') AS category,
    max(created_at) FILTER (old_value <> new_value) AS moved_at
  FROM chained GROUP BY ticket_id) l ON e.ticket_id = l.ticket_id
""",
    chained="""
SELECT a.*, row_number() OVER (PARTITION BY a.ticket_id, a.override_field
    ORDER BY a.created_at DESC, a.id DESC) AS n,
  coalesce(lag(a.new_value) OVER (PARTITION BY a.ticket_id, a.override_field ORDER BY a.created_at, a.id),
    CASE a.override_field WHEN 'severity' THEN e.severity ELSE e.category END) AS old_value
FROM agent_actions a JOIN ai_enrichments e ON a.ticket_id = e.ticket_id
WHERE a.override_field IN ('severity', 'category')
""",
)
