"""Spark schemas of the three tables and of the request frames."""

from pyspark.sql import types as T

_STR, _INT, _LONG, _NTZ = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()

CONFIDENCE = T.DecimalType(4, 3)
COST = T.DecimalType(10, 6)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


TICKETS = _schema(
    ("id", _STR, False),
    ("title", _STR, False),
    ("description", _STR, False),
    ("status", _STR, False),
    ("source", _STR, False),
    ("submitter_email", _STR, True),
    ("assigned_to", _STR, True),
    ("created_at", _NTZ, False),
    ("updated_at", _NTZ, False),
)

ENRICHMENTS = _schema(
    ("id", _STR, False),
    ("ticket_id", _STR, False),
    ("severity", _STR, False),
    ("category", _STR, False),
    ("summary", _STR, False),
    ("suggested_response", _STR, False),
    ("confidence", CONFIDENCE, False),
    ("model_used", _STR, False),
    ("prompt_version", _STR, False),
    ("tokens_in", _INT, False),
    ("tokens_out", _INT, False),
    ("estimated_cost", COST, False),
    ("raw_response", _STR, True),
    ("created_at", _NTZ, False),
    ("updated_at", _NTZ, False),
)

ACTIONS = _schema(
    ("id", _STR, False),
    ("ticket_id", _STR, False),
    ("agent_id", _STR, False),
    ("action_type", _STR, False),
    ("override_field", _STR, True),
    ("old_value", _STR, True),
    ("new_value", _STR, False),
    ("created_at", _NTZ, False),
    ("updated_at", _NTZ, False),
)

# What callers hand in. ``seq`` breaks ties between requests of one instant.
SUBMISSIONS = _schema(
    ("id", _STR, True),
    ("title", _STR, True),
    ("description", _STR, True),
    ("source", _STR, True),
    ("submitter_email", _STR, True),
    ("created_at", _NTZ, True),
)

OVERRIDE_REQUESTS = _schema(
    ("ticket_id", _STR, False),
    ("field", _STR, True),
    ("new_value", _STR, True),
    ("agent_id", _STR, True),
    ("requested_at", _NTZ, False),
    ("seq", _LONG, False),
)

STATUS_REQUESTS = _schema(
    ("ticket_id", _STR, False),
    ("status", _STR, True),
    ("assigned_to", _STR, True),
    ("agent_id", _STR, True),
    ("requested_at", _NTZ, False),
    ("seq", _LONG, False),
)

REPLIES = _schema(
    ("ticket_id", _STR, False),
    ("raw_text", _STR, True),
    ("tokens_in", _INT, True),
    ("tokens_out", _INT, True),
)

TICKET_COLUMNS = TICKETS.fieldNames()

# The enrichment record embedded in a ticket's detail view.
DETAIL_FIELDS = [name for name in ENRICHMENTS.fieldNames() if name not in ("ticket_id", "updated_at")]

# The columns the second schema version added, with the value old rows get.
ADDED_ENRICHMENT_COLUMNS = {
    "prompt_version": (_STR, "v1.0"),
    "tokens_in": (_INT, 0),
    "tokens_out": (_INT, 0),
    "estimated_cost": (COST, 0),
    "raw_response": (_STR, None),
}
