"""Streams end with what a batch run gives, and repeats add nothing."""

from decimal import Decimal

import pytest
from conftest import ticket

from siftdesk import schemas
from siftdesk.functions.replies import Prices
from siftdesk.operators.changes import current_state
from siftdesk.operators.intake import intake_external
from siftdesk.streaming import jobs

PRICES = Prices(Decimal(3), Decimal(15))


def scorer():
    import pandas as pd

    def score_batch(batch):
        replies = ["{}" if "ok" in t else "no" for t in batch["title"]]
        return pd.DataFrame({"ticket_id": batch["ticket_id"], "raw_text": replies, "tokens_in": 1, "tokens_out": 1})

    return score_batch


@pytest.fixture
def inbox(spark, tmp_path, frame):
    folder = tmp_path / "in"

    def put(schema, *rows):
        frame(schema, rows).write.mode("append").json(str(folder))
        return str(folder)

    return put


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_intake(spark, tmp_path, inbox, frame):
    first = {"id": "1", "title": "t", "description": "d"}
    bad = {"id": "2", "title": "", "description": "d"}
    more = {"id": "3", "title": "t", "description": "d", "source": "email"}
    folder = inbox(schemas.SUBMISSIONS, first, bad)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        rows = jobs.read_stream(spark, folder, schemas.SUBMISSIONS)
        run(jobs.stream_intake(rows, out, state))

    go()
    inbox(schemas.SUBMISSIONS, more)
    go()
    go()
    batch, _ = intake_external(frame(schemas.SUBMISSIONS, [first, bad, more]))
    found = jobs.read_intake(spark, out).select("id", "source", "status").collect()
    assert sorted(found) == sorted(batch.select("id", "source", "status").collect())
    assert [r.id for r in jobs.read_intake(spark, out, jobs.REJECT_SIDE).collect()] == ["2"]


def test_enrich_once(spark, tmp_path, inbox):
    folder = inbox(schemas.TICKETS, ticket("a", title="ok"), ticket("a", title="ok"), ticket("b", title="no"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        rows = jobs.read_stream(spark, folder, schemas.TICKETS)
        run(jobs.stream_enrich(rows, out, state, scorer(), PRICES, "m"))

    go()
    # A repeat, an old ticket that arrives late, and the failed one again.
    inbox(schemas.TICKETS, ticket("a", title="ok"), ticket("c", title="ok", created=-100_000), ticket("b", title="ok"))
    go()
    done = jobs.read_enriched(spark, out).collect()
    assert sorted(r.ticket_id for r in done) == ["a", "b", "c"]
    assert [r.ticket_id for r in jobs.read_enriched(spark, out, "failures").collect()] == ["b"]
    table = spark.read.schema(schemas.TICKETS).json(folder).dropDuplicates(["id"])
    log = jobs.status_changes(jobs.read_enriched(spark, out))
    state = current_state(table, log, ("status",)).collect()
    assert {r.id: r.status for r in state} == dict.fromkeys("abc", "triaged")


def test_batch_run_again_adds_nothing(spark, tmp_path, tickets):
    out = str(tmp_path / "out")
    batch = tickets(ticket("a", title="ok"), ticket("b", title="ok"))
    options = {"out": out, "scorer": scorer(), "prices": PRICES, "model": "m"}
    jobs.enrich_batch(batch, 0, **options)
    jobs.enrich_batch(batch, 0, **options)
    assert sorted(r.ticket_id for r in jobs.read_enriched(spark, out).collect()) == ["a", "b"]
    jobs.enrich_batch(batch, 1, **options)
    assert sorted(r.ticket_id for r in jobs.read_enriched(spark, out).collect()) == ["a", "b"]


def test_counts(spark, tmp_path, inbox):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in ([ticket("a"), ticket("b", "closed")], [ticket("c")]):
        folder = inbox(schemas.TICKETS, *rows)
        run(jobs.stream_counts(jobs.read_stream(spark, folder, schemas.TICKETS), "status", out, state))
    assert {r.label: r["count"] for r in jobs.read_counts(spark, out).collect()} == {"new": 2, "closed": 1}


def test_repeats_on_other_days_are_found_by_id_alone(spark, tmp_path, tickets):
    out = str(tmp_path / "out")
    options = {"out": out, "scorer": scorer(), "prices": PRICES, "model": "m"}
    jobs.enrich_batch(tickets(ticket("a", title="ok"), ticket("b", title="ok")), 0, **options)
    # Few days and many, and a batch that begins with what is known.
    later = [ticket("a", title="ok", created=1440 * n) for n in range(1, 30)]
    jobs.enrich_batch(tickets(*later, ticket("c", title="ok")), 1, **options)
    jobs.enrich_batch(tickets(ticket("a", title="ok", created=3000)), 2, **options)
    assert sorted(r.ticket_id for r in jobs.read_enriched(spark, out).collect()) == ["a", "b", "c"]


def test_a_batch_opens_its_buckets_only(spark, tmp_path, tickets):
    out = str(tmp_path / "out")
    options = {"out": out, "scorer": scorer(), "prices": PRICES, "model": "m"}
    jobs.enrich_batch(tickets(*[ticket(str(n), title="ok") for n in range(200)]), 0, **options)
    fresh = jobs._unseen(tickets(ticket("7"), ticket("new")), 1, f"{out}/ledger")
    files = fresh._jdf.queryExecution().optimizedPlan().collectLeaves().mkString()
    assert [r.id for r in fresh.collect()] == ["new"] and files
    opened = {f.split("bucket=")[1].split("/")[0] for f in fresh.inputFiles() if "bucket=" in f}
    assert 0 < len(opened) <= 2


def test_batches_leave_no_scratch(spark, tmp_path, tickets):
    from pathlib import Path

    from siftdesk.session import shared_dir

    options = {"out": str(tmp_path / "out"), "scorer": scorer(), "prices": PRICES, "model": "m"}
    jobs.enrich_batch(tickets(ticket("a", title="ok")), 77, **options)
    assert not list(Path(shared_dir(spark)).glob("enrich-77-*"))


def test_counts_take_turns_in_two_folders(spark, tmp_path, inbox):
    out, state = tmp_path / "out", str(tmp_path / "state")
    for n in range(5):
        folder = inbox(schemas.TICKETS, ticket(str(n)))
        rows = jobs.read_stream(spark, folder, schemas.TICKETS)
        run(jobs.stream_counts(rows, "status", str(out), state))
        assert [r["count"] for r in jobs.read_counts(spark, str(out)).collect()] == [n + 1]
    assert len(list((out / "counts").glob("slot=*"))) == 2
