"""Overrides and status changes against a one-by-one simulation."""

import random

import pytest
from conftest import action, enrichment, minute, ticket

from siftdesk import schemas
from siftdesk.constants import CATEGORIES, SEVERITIES, STATUSES
from siftdesk.operators import changes, relations

OVERRIDABLE = {"severity": SEVERITIES, "category": CATEGORIES, "suggested_response": None}


def override(ticket_id, field="severity", new_value="high", agent_id="a", at=1, seq=0):
    return {
        "ticket_id": ticket_id,
        "field": field,
        "new_value": new_value,
        "agent_id": agent_id,
        "requested_at": minute(at),
        "seq": seq,
    }


def status(ticket_id, status=None, assigned_to=None, agent_id="a", at=1, seq=0):
    return {
        "ticket_id": ticket_id,
        "status": status,
        "assigned_to": assigned_to,
        "agent_id": agent_id,
        "requested_at": minute(at),
        "seq": seq,
    }


def one_by_one_overrides(ticket_ids, table, requests):
    """Every request on its own, in order: (state, log, reasons)."""
    state = {row["ticket_id"]: dict(row) for row in table}
    log, reasons = [], []
    for r in sorted(requests, key=lambda r: (r["requested_at"], r["seq"])):
        row = state.get(r["ticket_id"])
        if not r["field"] or not r["new_value"] or not 1 <= len(r["agent_id"] or "") <= 100:
            reasons.append((r["seq"], "invalid_request"))
        elif r["ticket_id"] not in ticket_ids:
            reasons.append((r["seq"], "ticket_not_found"))
        elif row is None:
            reasons.append((r["seq"], "no_enrichment"))
        elif r["field"] not in OVERRIDABLE:
            reasons.append((r["seq"], "invalid_override_field"))
        elif OVERRIDABLE[r["field"]] and r["new_value"] not in OVERRIDABLE[r["field"]]:
            reasons.append((r["seq"], "invalid_override_value"))
        else:
            old = row[r["field"]]
            row[r["field"]] = r["new_value"]
            if old != r["new_value"]:
                row["updated_at"] = r["requested_at"]
            log.append((r["ticket_id"], r["agent_id"], r["field"], old, r["new_value"], r["requested_at"]))
    kept = [(k, v["severity"], v["category"], v["suggested_response"], v["updated_at"]) for k, v in state.items()]
    return sorted(kept), sorted(log), sorted(reasons)


def applied_overrides(result):
    state = [
        (r.ticket_id, r.severity, r.category, r.suggested_response, r.updated_at)
        for r in result.table.collect()
    ]
    log = [
        (r.ticket_id, r.agent_id, r.override_field, r.old_value, r.new_value, r.created_at)
        for r in result.actions.collect()
    ]
    return sorted(state), sorted(log), sorted((r.seq, r.reason) for r in result.rejects.collect())


@pytest.fixture
def random_overrides():
    rng = random.Random(7)
    keys = ["hot"] * 5 + ["a", "b", "c", "plain", "none"]
    rows = []
    for seq in range(160):
        field = rng.choice(["severity"] * 4 + ["category", "suggested_response", "summary"])
        domain = OVERRIDABLE.get(field) or ("x", "y", "")
        value = rng.choice([*domain, "HIGH"] if field == "severity" else domain)
        rows.append(
            override(rng.choice(keys), field, value, rng.choice(["a", "b", ""] + ["c"] * 5), rng.randrange(20), seq)
        )
    return rows


@pytest.mark.parametrize("hot_rows", [10, 40, 1_000_000])
def test_overrides_match_simulation(frame, tickets, enrichments, random_overrides, hot_rows):
    rows = [ticket(k) for k in ("hot", "a", "b", "c", "plain")]
    table = [enrichment(k) for k in ("hot", "a", "b", "c")]
    result = changes.apply_overrides(
        tickets(*rows), enrichments(*table), frame(schemas.OVERRIDE_REQUESTS, random_overrides), hot_rows
    )
    expected = one_by_one_overrides({r["id"] for r in rows}, table, random_overrides)
    assert applied_overrides(result) == expected


def test_one_by_one_equals_batch(frame, tickets, enrichments):
    requests = [
        override("a", new_value="high", at=1, seq=1),
        override("a", new_value="high", at=2, seq=2),
        override("a", "category", "billing", at=2, seq=3),
        override("a", new_value="medium", at=2, seq=4),
    ]
    all_tickets = tickets(ticket("a"))
    batch = changes.apply_overrides(
        all_tickets, enrichments(enrichment("a")), frame(schemas.OVERRIDE_REQUESTS, requests)
    )
    table, log = enrichments(enrichment("a")), []
    for request in requests:
        step = changes.apply_overrides(all_tickets, table, frame(schemas.OVERRIDE_REQUESTS, [request]))
        log += step.actions.collect()
        table = step.table
    assert table.collect() == batch.table.collect()
    assert sorted(log) == sorted(batch.actions.collect())


def test_override_rejects(frame, tickets, enrichments):
    requests = [
        override("zz", seq=1),
        override("b", seq=2),
        override("a", "summary", "x", seq=3),
        override("a", new_value="HIGH", seq=4),
        override("a", agent_id="", seq=5),
        override("a", agent_id="x" * 101, seq=6),
        override("a", new_value="", seq=7),
        override("a", None, seq=8),
        override("a", "category", "nope", seq=9),
    ]
    result = changes.apply_overrides(
        tickets(ticket("a"), ticket("b")), enrichments(enrichment("a")), frame(schemas.OVERRIDE_REQUESTS, requests)
    )
    found = {r.seq: (r.reason, r.valid_values) for r in result.rejects.collect()}
    assert found[1] == ("ticket_not_found", None)
    assert found[2] == ("no_enrichment", None)
    assert found[3] == ("invalid_override_field", ["severity", "category", "suggested_response"])
    assert found[4] == ("invalid_override_value", ["critical", "high", "low", "medium"])
    assert [found[n][0] for n in (5, 6, 7, 8)] == ["invalid_request"] * 4
    assert found[9][1] == sorted(CATEGORIES)
    assert result.actions.count() == 0


def test_no_op_override_is_logged_but_does_not_touch_the_row(frame, tickets, enrichments):
    result = changes.apply_overrides(
        tickets(ticket("a")),
        enrichments(enrichment("a", severity="high")),
        frame(schemas.OVERRIDE_REQUESTS, [override("a", new_value="high", at=9)]),
    )
    (row,) = result.actions.collect()
    assert (row.old_value, row.new_value) == ("high", "high")
    assert result.table.first().updated_at == minute(0)


def one_by_one_status(table, requests):
    state = {row["id"]: dict(row) for row in table}
    log, reasons = [], []
    for r in sorted(requests, key=lambda r: (r["requested_at"], r["seq"])):
        row = state.get(r["ticket_id"])
        if row is None:
            reasons.append((r["seq"], "ticket_not_found"))
            continue
        if r["status"] is not None and r["status"] not in STATUSES:
            reasons.append((r["seq"], "invalid_status"))
            continue
        if r["status"] is not None and r["status"] != row["status"]:
            log.append((r["ticket_id"], r["agent_id"] or "system", row["status"], r["status"], r["requested_at"]))
            row["status"], row["updated_at"] = r["status"], r["requested_at"]
        if r["assigned_to"] is not None and r["assigned_to"] != row["assigned_to"]:
            row["assigned_to"], row["updated_at"] = r["assigned_to"], r["requested_at"]
    kept = [(k, v["status"], v["assigned_to"], v["updated_at"]) for k, v in state.items()]
    return sorted(kept, key=repr), sorted(log), sorted(reasons)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_status_changes_match_simulation(frame, tickets, hot_rows):
    rng = random.Random(11)
    requests = [
        status(
            rng.choice(["hot"] * 4 + ["a", "b", "gone"]),
            rng.choice([*STATUSES, "banana", None]),
            rng.choice([None, None, "", "x", "y"]),
            rng.choice(["a", "", None]),
            rng.randrange(25),
            seq,
        )
        for seq in range(150)
    ]
    table = [ticket("hot"), ticket("a", assigned_to="x"), ticket("b", "closed"), ticket("idle")]
    result = changes.apply_status_changes(tickets(*table), frame(schemas.STATUS_REQUESTS, requests), hot_rows)
    state = [(r.id, r.status, r.assigned_to, r.updated_at) for r in result.table.collect()]
    log = [(r.ticket_id, r.agent_id, r.old_value, r.new_value, r.created_at) for r in result.actions.collect()]
    found = sorted(state, key=repr), sorted(log), sorted((r.seq, r.reason) for r in result.rejects.collect())
    assert found == one_by_one_status(table, requests)
    assert {(r.action_type, r.override_field) for r in result.actions.collect()} == {("status_change", "status")}


def test_audit_keys_are_stable_and_distinct(frame, tickets, enrichments, random_overrides):
    def keys():
        result = changes.apply_overrides(
            tickets(*[ticket(k) for k in ("hot", "a")]),
            enrichments(enrichment("hot"), enrichment("a")),
            frame(schemas.OVERRIDE_REQUESTS, random_overrides),
        )
        return sorted(r.id for r in result.actions.collect())

    first = keys()
    assert len(set(first)) == len(first) and first == keys()


def test_enrichment_moves_any_status_to_triaged(tickets, enrichments):
    from pyspark.sql import functions as F

    table = tickets(ticket("a", "closed"), ticket("b", "new"), ticket("c", "triaged"))
    new = enrichments(enrichment("a"), enrichment("a"), enrichment("c"))
    done = changes.apply_enrichments(table, new, F.lit(minute(5)).cast("timestamp_ntz"))
    found = {r.id: (r.status, r.updated_at) for r in done.collect()}
    assert found == {"a": ("triaged", minute(5)), "b": ("new", minute(0)), "c": ("triaged", minute(0))}


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_history_positions(actions, hot_rows):
    rows = [action(f"{i:03}", "hot", created=i // 4) for i in range(60)]
    rows += [action("x1", "a", created=1), action("x2", "a", created=1), action("x0", "a", created=2)]
    found = relations.action_history(actions(*rows), hot_rows).collect()
    by_ticket = {}
    for row in sorted(found, key=lambda r: r.position):
        by_ticket.setdefault(row.ticket_id, []).append((row.position, row.id))
    assert by_ticket["hot"] == [(i + 1, f"{59 - i:03}") for i in range(60)]
    assert [key for _, key in by_ticket["a"]] == ["x0", "x2", "x1"]
    assert [r.id for r in relations.ticket_actions(actions(*rows), "a").collect()] == ["x0", "x2", "x1"]


def test_a_request_is_either_applied_or_refused(frame, tickets, enrichments):
    requests = frame(schemas.OVERRIDE_REQUESTS, [override("a", seq=1), override("gone", seq=2)])
    table = enrichments(enrichment("a"), enrichment("gone"))
    applied = changes.apply_overrides(tickets(ticket("a")), table, requests)
    assert {r.ticket_id: r.severity for r in applied.table.collect()} == {"a": "high", "gone": "low"}
    assert [r.ticket_id for r in applied.actions.collect()] == ["a"]
    assert [(r.ticket_id, r.reason) for r in applied.rejects.collect()] == [("gone", "ticket_not_found")]


def test_updated_at_never_goes_back(frame, tickets, enrichments):
    late = minute(100)
    requests = frame(schemas.OVERRIDE_REQUESTS, [override("a", at=1)])
    row = enrichment("a", updated_at=late)
    changed = changes.apply_overrides(tickets(ticket("a")), enrichments(row), requests).table.first()
    assert (changed.severity, changed.updated_at) == ("high", late)
    wanted = frame(schemas.STATUS_REQUESTS, [status("a", "closed", at=1)])
    moved = changes.apply_status_changes(tickets(ticket("a", updated_at=late)), wanted).table.first()
    assert (moved.status, moved.updated_at) == ("closed", late)
