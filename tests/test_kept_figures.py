"""Figures per day, stored pages and label counts on small tables."""

import shutil

import pytest
from conftest import action, enrichment, minute, ticket
from pyspark.sql import functions as F

from siftdesk import schemas
from siftdesk.constants import STATUSES
from siftdesk.operators import listing, metrics
from siftdesk.sources import pages, partials, tables
from siftdesk.streaming import jobs

DAY = 24 * 60
MOVES = "override_field string, old_value string, new_value string"


def counted(spark, root, **frames):
    for name, rows in frames.items():
        tables.replace_table(rows, f"{root}/{name}", by_day="created_at")
        partials.refresh(spark, name, f"{root}/{name}", f"{root}/figures")
    return f"{root}/figures"


def test_dashboard_after_an_append(spark, tmp_path, tickets, enrichments, actions):
    mine = [ticket(f"t{n}", STATUSES[n % 6], n * DAY // 4) for n in range(20)]
    told = [enrichment(f"t{n}", ("high", "low")[n % 2], created_at=minute(n * DAY // 4)) for n in range(15)]
    done = [action(f"a{n}", f"t{n}", ("override", "status_change")[n % 2], created=n * DAY) for n in range(5)]
    new = [ticket("n1", "closed", 3 * DAY + 5), ticket("n2", "new", 9 * DAY)]
    figures = counted(
        spark, tmp_path, tickets=tickets(*mine), ai_enrichments=enrichments(*told), agent_actions=actions(*done)
    )
    # Other days' folders are gone: an append may not read them.
    kept = tmp_path / "tickets"
    for folder in kept.glob("day=*"):
        if folder.name != "day=" + minute(3 * DAY).date().isoformat():
            shutil.rmtree(folder)
    days = partials.append_counted(tickets(*new), "tickets", str(kept), figures)
    assert days == [minute(3 * DAY).date(), minute(9 * DAY).date()]
    for _ in range(2):  # a batch of moves counts once
        log = spark.createDataFrame(
            [("severity", "low", "high"), ("status", "new", "closed"), ("status", "closed", "closed")], MOVES
        )
        partials.record_moves(log, figures, "first")
    mine[0]["status"], told[1]["severity"] = "closed", "high"
    want = metrics.dashboard_summary(tickets(*mine, *new), enrichments(*told), actions(*done))
    got = partials.dashboard_summary(spark, figures)
    assert got.columns == want.columns and got.collect() == want.collect()
    by_status = metrics.count_by(tickets(*mine, *new), "status").collect()
    assert sorted(partials.counts(spark, figures, "status").collect()) == sorted(by_status)


def test_dashboard_of_empty_tables(spark, tmp_path, tickets, enrichments, actions):
    figures = counted(spark, tmp_path, tickets=tickets(ticket("a", "new")))
    want = metrics.dashboard_summary(tickets(ticket("a", "new")), enrichments(), actions())
    assert partials.dashboard_summary(spark, figures).collect() == want.collect()


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_any_stored_page(spark, tmp_path, tickets, order):
    # Many tickets of one instant are told apart by id.
    table = tickets(*[ticket(f"t{n:03}", created=n // 40) for n in range(157)])
    path = str(tmp_path / "paged")
    pages.save_paged(table, path, 7)
    assert pages.total(spark, path) == 157
    ordered = [r.id for r in listing.order_tickets(table, order).collect()]
    for page in (1, 4, 15, 16, 17):
        got = pages.read_page(spark, path, schemas.TICKETS, page, 10, order).collect()
        assert [r.id for r in got] == ordered[(page - 1) * 10 : page * 10]
        assert [r.row for r in got] == list(range((page - 1) * 10 + 1, (page - 1) * 10 + 1 + len(got)))
    for at in (0, 79, 150, 156):
        n = int(ordered[at][1:])
        after = pages.read_after(spark, path, schemas.TICKETS, minute(n // 40), ordered[at], 25, order)
        assert [r.id for r in after.collect()] == ordered[at + 1 : at + 26]
    # Other ranges are not opened: their files are no Parquet any more.
    page = {r.id for r in pages.read_page(spark, path, schemas.TICKETS, 9, 10, order).collect()}
    held = spark.read.parquet(f"{path}/rows").where(F.col("id").isin(list(page))).select("range").distinct()
    ranges = {f"range={r[0]}" for r in held.collect()}
    assert 1 <= len(ranges) <= 2
    for file in (tmp_path / "paged/rows").glob("range=*/*.parquet"):
        if file.parent.name not in ranges:
            file.write_bytes(b"none")
    assert {r.id for r in pages.read_page(spark, path, schemas.TICKETS, 9, 10, order).collect()} == page


def test_no_stored_pages(spark, tmp_path, tickets):
    pages.save_paged(tickets(), str(tmp_path / "none"), 3)
    assert pages.total(spark, str(tmp_path / "none")) == 0
    assert pages.read_page(spark, str(tmp_path / "none"), schemas.TICKETS, 1, 10).count() == 0
    with pytest.raises(ValueError):
        pages.read_page(spark, str(tmp_path / "none"), schemas.TICKETS, 0, 10)


def test_counts_follow_moves(spark, tmp_path):
    def arrive(*labels):
        spark.createDataFrame([(x,) for x in labels], "label string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def move(*steps):
        kind = "old_value string, new_value string"
        spark.createDataFrame(list(steps), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/moves")

    def counts():
        ins = spark.readStream.schema("label string").parquet(f"{tmp_path}/in")
        moves = spark.readStream.schema("old_value string, new_value string").parquet(f"{tmp_path}/moves")
        jobs.stream_label_counts(ins, moves, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r.label: r["count"] for r in jobs.read_counts(spark, f"{tmp_path}/out").collect()}

    arrive("new", "new", "open")
    move(("new", "open"), ("open", "open"))
    assert counts() == {"new": 1, "open": 2}
    arrive("new")
    move(("new", "closed"), ("new", "closed"))
    assert counts() == {"open": 2, "closed": 2}
