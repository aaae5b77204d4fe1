"""Overrides and status changes, applied in bulk with an audit trail.

Requests of one batch take effect in the order of (requested_at, seq); every
logged old value is what the request before it left behind.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftdesk.constants import ENRICHED_STATUS, OVERRIDABLE_FIELDS, STATUSES, SYSTEM_AGENT
from siftdesk.functions import rules, text
from siftdesk.operators.sequences import HOT_ROWS, HotKeys, find_hot, lookup, with_previous

ORDER = ["requested_at", "seq"]
STATUS_FIELDS = ("status", "assigned_to")

_LOG_COLUMNS = [
    "ticket_id",
    "agent_id",
    "action_type",
    "override_field",
    "old_value",
    "new_value",
    "created_at",
    "updated_at",
]


@dataclass(frozen=True)
class Applied:
    """Outcome of a batch: the table afterwards, the new audit rows and the refused requests."""

    table: DataFrame
    actions: DataFrame
    rejects: DataFrame


def _chained(changes: DataFrame, hot: HotKeys) -> DataFrame:
    """Changes (ticket_id, field, new_value, ...) with the value requested before each."""
    return with_previous(changes, ["ticket_id", "field"], ORDER, "new_value", hot)


def _of_field(field: str, value: Column) -> Column:
    return F.when(F.col("field") == field, value)


def _current_of(field: Column, fields: tuple[str, ...]) -> Column:
    """The table's value of the field a row names."""
    value = F.lit(None).cast("string")
    for name in fields:
        value = F.when(field == name, F.col(f"now_{name}")).otherwise(value)
    return value


def _now_values(table: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    return table.select(
        F.col(key).alias("ticket_id"), *[F.col(name).alias(f"now_{name}") for name in fields]
    )


def _folded(chained: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per ticket: per field the last and the first requested value,
    and when a request last differed from the one before it."""
    when_asked = F.struct(*ORDER)
    sums = [
        F.max(F.when(F.col("prev_value") != F.col("new_value"), F.col("requested_at"))).alias("_moved_at")
    ]
    for name in fields:
        mine = _of_field(name, when_asked)
        sums += [
            F.max_by("new_value", mine).alias(f"_last_{name}"),
            F.min_by("new_value", mine).alias(f"_first_{name}"),
            F.min(mine).alias(f"_start_{name}"),
        ]
    return chained.groupBy("ticket_id").agg(*sums)


def _with_changes(table: DataFrame, key: str, chained: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The table with the last requested values; ``updated_at`` moves only on a real change."""
    folded = _folded(chained, fields)
    joined = table.join(folded, table[key] == folded["ticket_id"], "left").drop(folded["ticket_id"])
    values = {name: F.coalesce(F.col(f"_last_{name}"), F.col(name)) for name in fields}
    if "updated_at" in table.columns:
        starts = [
            F.when(
                F.col(f"_first_{name}").isNotNull() & ~F.col(f"_first_{name}").eqNullSafe(F.col(name)),
                F.col(f"_start_{name}.requested_at"),
            )
            for name in fields
        ]
        # greatest() skips nulls; a row changed later than that keeps its time.
        values["updated_at"] = F.greatest(F.col("_moved_at"), *starts, F.col("updated_at"))
    return joined.select(*[values.get(name, F.col(name)).alias(name) for name in table.columns])


def current_state(
    table: DataFrame, changes: DataFrame, fields: tuple[str, ...], key: str = "id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Fold a change log (ticket_id, field, new_value, requested_at, seq) into the table."""
    hot = find_hot(changes, "ticket_id", hot_rows)
    return _with_changes(table, key, _chained(changes, hot), fields)


def _logged(chained: DataFrame, now: DataFrame, fields: tuple[str, ...], hot: HotKeys) -> DataFrame:
    """Changes of known tickets with their old value."""
    known = lookup(chained, now, hot, "inner")
    old = F.coalesce(F.col("prev_value"), _current_of(F.col("field"), fields))
    return known.withColumn("old_value", old)


def with_table_value(
    requests: DataFrame, table: DataFrame, key: str, fields: tuple[str, ...], hot: HotKeys
) -> DataFrame:
    """Requests of known tickets with ``now_value``, the table's value of their field."""
    known = lookup(requests, _now_values(table, key, fields), hot, "inner")
    valued = known.withColumn("now_value", _current_of(F.col("field"), fields))
    return valued.drop(*[f"now_{name}" for name in fields])


def audit_rows(logged: DataFrame, action_type: str, agent: Column) -> DataFrame:
    key = text.key_from(
        F.lit(action_type), F.col("ticket_id"), F.col("field"), F.col("requested_at"), F.col("seq")
    )
    return logged.select(
        key.alias("id"),
        "ticket_id",
        agent.alias("agent_id"),
        F.lit(action_type).alias("action_type"),
        F.col("field").alias("override_field"),
        "old_value",
        "new_value",
        F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"),
    )


def checked_overrides(
    tickets: DataFrame, enrichments: DataFrame, requests: DataFrame, hot: HotKeys
) -> DataFrame:
    """Override requests with the first ``reason`` to refuse them, null if there is none."""
    c = F.col
    known = tickets.select(c("id").alias("ticket_id"), F.lit(True).alias("_ticket")).join(
        enrichments.select("ticket_id", F.lit(True).alias("_enriched")), "ticket_id", "left"
    )
    checked = lookup(requests, known, hot)
    well_formed = (
        c("field").isNotNull()
        & rules.length_between(c("new_value"), 1)
        & rules.valid_agent(c("agent_id"))
    )
    reason = (
        F.when(~well_formed, "invalid_request")
        .when(c("_ticket").isNull(), "ticket_not_found")
        .when(c("_enriched").isNull(), "no_enrichment")
        .when(~rules.valid_override_field(c("field")), "invalid_override_field")
        .when(~rules.valid_override_value(c("field"), c("new_value")), "invalid_override_value")
    )
    return checked.select(*requests.columns, reason.alias("reason"))


def override_rejects(checked: DataFrame) -> DataFrame:
    """Refused override requests with the reason and the values allowed instead."""
    c = F.col
    allowed = F.when(
        c("reason") == "invalid_override_field", rules.text_list(OVERRIDABLE_FIELDS)
    ).when(c("reason") == "invalid_override_value", rules.allowed_override_values(c("field")))
    refused = checked.where(c("reason").isNotNull())
    return refused.select(*checked.columns, allowed.alias("valid_values"))


def apply_overrides(
    tickets: DataFrame,
    enrichments: DataFrame,
    requests: DataFrame,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> Applied:
    """Apply override requests (see ``schemas.OVERRIDE_REQUESTS``) to the enrichments.

    Every request is either applied or refused. One that sets the value already
    there is logged like any other. ``hot`` are the requests' hot tickets where
    the caller has counted them.
    """
    hot = hot or find_hot(requests, "ticket_id", hot_rows)
    checked = checked_overrides(tickets, enrichments, requests, hot)
    chained = _chained(checked.where(F.col("reason").isNull()).drop("reason"), hot)
    now = _now_values(enrichments, "ticket_id", OVERRIDABLE_FIELDS)
    logged = _logged(chained, now, OVERRIDABLE_FIELDS, hot)
    return Applied(
        _with_changes(enrichments, "ticket_id", chained, OVERRIDABLE_FIELDS),
        audit_rows(logged, "override", F.col("agent_id")),
        override_rejects(checked),
    )


def _valid_status_request() -> Column:
    return F.col("status").isNull() | rules.valid_status(F.col("status"))


def requested_values(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid status requests as one row per field that they set; ``keep`` are columns to go along."""
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("new_value")) for f in STATUS_FIELDS]
    )
    return (
        requests.where(_valid_status_request())
        .select("ticket_id", "agent_id", *ORDER, *keep, F.explode(per_field).alias("change"))
        .select("ticket_id", "agent_id", *ORDER, *keep, "change.field", "change.new_value")
        .where(F.col("new_value").isNotNull())
    )


def checked_statuses(tickets: DataFrame, requests: DataFrame, hot: HotKeys) -> DataFrame:
    """Status requests with the first ``reason`` to refuse them, null if there is none,
    and the ``now_`` values of their ticket's fields."""
    c = F.col
    known = _now_values(tickets, "id", STATUS_FIELDS).withColumn("_ticket", F.lit(True))
    reason = F.when(c("_ticket").isNull(), "ticket_not_found").when(
        ~_valid_status_request(), "invalid_status"
    )
    return lookup(requests, known, hot).withColumn("reason", reason).drop("_ticket")


def split_statuses(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked status requests as (rows per field that valid ones set, with ``now_value``;
    refused ones)."""
    now = tuple(f"now_{name}" for name in STATUS_FIELDS)
    values = requested_values(checked.where(F.col("reason").isNull()), keep=now)
    valued = values.withColumn("now_value", _current_of(F.col("field"), STATUS_FIELDS))
    return valued.drop(*now), checked.where(F.col("reason").isNotNull()).drop(*now)


def status_rejects(tickets: DataFrame, requests: DataFrame, hot: HotKeys) -> DataFrame:
    allowed = F.when(F.col("reason") == "invalid_status", rules.text_list(STATUSES))
    refused = checked_statuses(tickets, requests, hot).where(F.col("reason").isNotNull())
    return refused.select(*requests.columns, "reason", allowed.alias("valid_values"))


def apply_status_changes(
    tickets: DataFrame,
    requests: DataFrame,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> Applied:
    """Apply status and assignment requests (see ``schemas.STATUS_REQUESTS``) to the tickets.

    Any status may follow any other. Only a status that differs is logged; an
    assignment never is, and '' is a value to assign.
    """
    hot = hot or find_hot(requests, "ticket_id", hot_rows)
    changes = requested_values(requests)
    chained = _chained(changes, hot)
    logged = _logged(
        chained.where(F.col("field") == "status"), _now_values(tickets, "id", ("status",)), ("status",), hot
    ).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return Applied(
        _with_changes(tickets, "id", chained, STATUS_FIELDS),
        audit_rows(logged, "status_change", text.agent_or_system(F.col("agent_id"), SYSTEM_AGENT)),
        status_rejects(tickets, requests, hot),
    )


def apply_enrichments(
    tickets: DataFrame, new_enrichments: DataFrame, at: Column | None = None
) -> DataFrame:
    """Tickets after enrichment: triaged whatever they were before, with no audit row.

    ``at`` is when the change is dated, by default now.
    """
    at = F.localtimestamp() if at is None else at
    done = new_enrichments.select("ticket_id").distinct().withColumn("_done", F.lit(True))
    joined = tickets.join(done, tickets["id"] == done["ticket_id"], "left").drop("ticket_id")
    moved = F.col("_done") & (F.col("status") != ENRICHED_STATUS)
    values = {"status": F.when(F.col("_done"), F.lit(ENRICHED_STATUS)).otherwise(F.col("status"))}
    if "updated_at" in tickets.columns:
        later = F.greatest(at, F.col("updated_at"))
        values["updated_at"] = F.when(moved, later).otherwise(F.col("updated_at"))
    return joined.select(*[values.get(name, F.col(name)).alias(name) for name in tickets.columns])
