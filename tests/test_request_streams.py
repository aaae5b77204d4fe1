"""Requests on a stream give what one batch of them gives, however they are cut."""

import pytest
from conftest import enrichment, minute, ticket

from siftdesk import schemas
from siftdesk.operators import changes
from siftdesk.streaming import jobs, requests


def override(key, field, value, at, agent="x"):
    return {"ticket_id": key, "field": field, "new_value": value, "agent_id": agent, "requested_at": minute(at), "seq": at}


def status(key, value, at, assigned=None, agent=None):
    return {"ticket_id": key, "status": value, "assigned_to": assigned, "agent_id": agent, "requested_at": minute(at), "seq": at}


OVERRIDES = [
    override("a", "severity", "high", 1),
    override("a", "severity", "high", 2),
    override("b", "category", "billing", 3),
    override("a", "severity", "urgent", 4),
    override("gone", "severity", "low", 5),
    override("a", "category", "billing", 6),
    override("a", "severity", "low", 7),
    override("a", "suggested_response", "text", 8, agent="é"),
    override("b", "other", "low", 9),
]
STATUSES = [
    status("a", "new", 1),
    status("a", "closed", 2, agent="x"),
    status("a", None, 3, assigned=""),
    status("b", "wrong", 4),
    status("a", "closed", 5, assigned="me"),
    status("a", "new", 6),
    status("gone", "new", 7),
]


def play(spark, frame, folder, schema, made, cuts, start):
    """The rows in micro-batches that end at ``cuts``, in two runs of the stream."""
    inbox = str(folder / "in")
    batches = [made[i:j] for i, j in zip([0, *cuts], [*cuts, len(made)])]
    for some in (batches[:1], batches[1:]):
        for rows in some:
            frame(schema, rows).coalesce(1).write.mode("append").parquet(inbox)
        stream = jobs.read_stream(spark, inbox, schema, "parquet", files_per_batch=1)
        query = start(stream, str(folder / "out"), str(folder / "state"))
        query.awaitTermination(180)
        assert query.exception() is None
    return str(folder / "out")


def rows(df, *names):
    df = df.select(*names) if names else df
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("cuts", [[4], [1, 2, 3, 6]])
def test_overrides(spark, tmp_path, frame, tickets, enrichments, cuts):
    table, labels = tickets(ticket("a"), ticket("b"), ticket("c")), enrichments(enrichment("a"), enrichment("b"))
    batch = changes.apply_overrides(table, labels, frame(schemas.OVERRIDE_REQUESTS, OVERRIDES))
    out = play(
        spark, frame, tmp_path, schemas.OVERRIDE_REQUESTS, OVERRIDES, cuts,
        lambda stream, to, state: requests.stream_overrides(table, labels, stream, to, state),
    )
    assert rows(requests.override_actions(spark, out)) == rows(batch.actions)
    names = [*schemas.OVERRIDE_REQUESTS.fieldNames(), "reason"]
    assert rows(requests.read_refused(spark, out), *names) == rows(batch.rejects, *names)
    log = requests.read_applied(spark, out)
    now = changes.current_state(labels, log, changes.OVERRIDABLE_FIELDS, key="ticket_id")
    assert rows(now) == rows(batch.table)


@pytest.mark.parametrize("cuts", [[3, 5]])
def test_status_changes(spark, tmp_path, frame, tickets, cuts):
    table = tickets(ticket("a"), ticket("b"))
    batch = changes.apply_status_changes(table, frame(schemas.STATUS_REQUESTS, STATUSES))
    out = play(
        spark, frame, tmp_path, schemas.STATUS_REQUESTS, STATUSES, cuts,
        lambda stream, to, state: requests.stream_status_changes(table, stream, to, state),
    )
    assert rows(requests.status_actions(spark, out)) == rows(batch.actions)
    names = [*schemas.STATUS_REQUESTS.fieldNames(), "reason"]
    assert rows(requests.read_refused(spark, out), *names) == rows(batch.rejects, *names)
    now = changes.current_state(table, requests.read_applied(spark, out), changes.STATUS_FIELDS)
    assert rows(now) == rows(batch.table)


def test_old_values_are_worked_out_without_python(spark, frame, enrichments):
    valid = frame(schemas.OVERRIDE_REQUESTS, OVERRIDES).selectExpr("*", "'low' AS now_value")
    held = spark.createDataFrame([("a", "severity", "medium")], "ticket_id string, field string, value string")
    chained = requests.with_old_values(valid, held)
    plan = chained._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    found = {r.seq: (r.old_value, r.latest) for r in chained.collect()}
    assert len(found) == len(OVERRIDES) and found[1] == ("medium", False) and found[2] == ("high", False)
    assert found[7] == ("urgent", True) and found[6] == ("low", True)


def test_values_outlast_merged_runs_and_repeated_batches(spark, tmp_path, frame, tickets, enrichments, monkeypatch):
    monkeypatch.setattr(requests.ledger, "RUNS", 2)
    table, labels = tickets(ticket("a"), ticket("b")), enrichments(enrichment("a"), enrichment("b"))
    out = str(tmp_path / "out")

    def split(asked, folder):
        checked = changes.checked_overrides(table, labels, asked, requests._NONE_HOT)
        valid = checked.where("reason is null").drop("reason")
        fields = changes.OVERRIDABLE_FIELDS
        return changes.with_table_value(valid, labels, "ticket_id", fields, requests._NONE_HOT), checked.where("reason is not null")

    made = [override("a", "severity", ["high", "critical"][n % 2], n) for n in range(1, 7)]
    made.append(override("b", "category", "billing", 7))
    for n, row in enumerate(made):
        for _ in range(2):
            requests.apply_batch(frame(schemas.OVERRIDE_REQUESTS, [row]), n, out=out, split=split)
    batch = changes.apply_overrides(table, labels, frame(schemas.OVERRIDE_REQUESTS, made))
    assert rows(requests.override_actions(spark, out)) == rows(batch.actions)
    assert not list((tmp_path / "out").glob("_batch-*"))


def test_a_batch_of_status_requests_joins_the_tickets_once(spark, tmp_path, frame, tickets, monkeypatch):
    made, joins = frame(schemas.STATUS_REQUESTS, STATUSES).coalesce(1), []
    made.write.parquet(str(tmp_path / "in"))
    lookup = changes.lookup
    monkeypatch.setattr(changes, "lookup", lambda *given: joins.append(1) or lookup(*given))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schemas.STATUS_REQUESTS, "parquet")
    out = str(tmp_path / "out")
    query = requests.stream_status_changes(tickets(ticket("a"), ticket("b")), stream, out, str(tmp_path / "state"))
    query.awaitTermination(180)
    assert query.exception() is None and len(joins) == 1
    refused = {(r.seq, r.reason) for r in requests.read_refused(spark, out).collect()}
    assert refused == {(4, "invalid_status"), (7, "ticket_not_found")}
