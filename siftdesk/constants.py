"""Domains, ranks and limits of the support-desk data model."""

# The label domains, each in rank order.
STATUSES = ("new", "triaged", "in_progress", "waiting_on_customer", "resolved", "closed")
SEVERITIES = ("critical", "high", "medium", "low")
CATEGORIES = ("bug_report", "billing", "account_access", "feature_request", "general")
ACTION_TYPES = ("override", "status_change")
SOURCES = ("web_form", "api", "email", "monitoring")

# Groups of labels used by the dashboard figures.
FINISHED_STATUSES = ("resolved", "closed")
URGENT_SEVERITIES = ("critical", "high")
OVERRIDABLE_FIELDS = ("severity", "category", "suggested_response")

# What a reply falls back to when a key is absent or unknown.
DEFAULT_SEVERITY = "medium"
DEFAULT_CATEGORY = "general"
DEFAULT_SUMMARY = "No summary available"
DEFAULT_RESPONSE = "No response generated"
DEFAULT_CONFIDENCE = 0.5

# Defaults of stored columns.
DEFAULT_STATUS = "new"
ENRICHED_STATUS = "triaged"
FORM_SOURCE = "web_form"
EXTERNAL_SOURCE = "api"
SYSTEM_AGENT = "system"
DEFAULT_PROMPT_VERSION = "v1.0"

# Display labels.
STATUS_LABELS = {
    "new": "New",
    "triaged": "Triaged",
    "in_progress": "In Progress",
    "waiting_on_customer": "Waiting",
    "resolved": "Resolved",
    "closed": "Closed",
}
SEVERITY_LABELS = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}
CATEGORY_LABELS = {
    "bug_report": "Bug Report",
    "billing": "Billing",
    "account_access": "Account Access",
    "feature_request": "Feature Request",
    "general": "General",
}

# Length and page limits.
TITLE_MAX = 255
SOURCE_MAX = 20
EMAIL_MAX = 255
AGENT_MAX = 100
PAGE_DEFAULT = 20
PAGE_MAX = 100
MAX_ATTEMPTS = 3

# The characters that Python's str.strip and JavaScript's
# String.trim take for white space.
_SHARED_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PY_SPACE = _SHARED_SPACE + "\x1c\x1d\x1e\x1f\x85"
JS_SPACE = _SHARED_SPACE + "\ufeff"
