"""Filters, pages and lookups."""

import pytest
from conftest import enrichment, ticket
from pyspark.sql import functions as F

from siftdesk.operators import listing, relations


@pytest.fixture(scope="module")
def data(spark):
    from siftdesk import schemas

    rows = [ticket(f"t{i:02}", ["new", "closed"][i % 2], i // 3, assigned_to=["x", None][i % 2]) for i in range(23)]
    extra = [enrichment(f"t{i:02}", ["low", "high"][i % 2], "billing") for i in range(0, 23) if i % 5]

    def make(schema, values):
        names = schema.fieldNames()
        return spark.createDataFrame([tuple(v[n] for n in names) for v in values], schema).cache()

    return make(schemas.TICKETS, rows), make(schemas.ENRICHMENTS, extra), rows, extra


def walk(tickets, enrichments, **kwargs):
    seen, after = [], None
    while True:
        page = listing.list_page(tickets, enrichments, after=after, **kwargs)
        ids = [row.id for row in page.items.collect()]
        seen += ids
        assert page.has_more == (page.next_cursor is not None)
        if not page.has_more:
            return seen, page.total
        assert page.next_cursor == ids[-1]
        after = page.next_cursor


@pytest.mark.parametrize("limit", [1, 5, 22, 23, 100])
def test_walk_returns_each_once(data, limit):
    tickets, enrichments, rows, _ = data
    if limit == 1:
        tickets = tickets.where(F.col("id") < "t04")
        rows = rows[:4]
    newest_first = [r["id"] for r in sorted(rows, key=lambda r: (r["created_at"], r["id"]), reverse=True)]
    down, total = walk(tickets, enrichments, limit=limit)
    assert down == newest_first and total == len(rows)
    up, _ = walk(tickets, enrichments, limit=limit, order="asc")
    assert up == newest_first[::-1]


def test_filters(data):
    tickets, enrichments, rows, extra = data
    high = {e["ticket_id"] for e in extra if e["severity"] == "high"}
    found, total = walk(tickets, enrichments, limit=3, severity="high", status="closed")
    assert set(found) == high & {r["id"] for r in rows if r["status"] == "closed"} and total == len(found)
    assert listing.list_page(tickets, enrichments, status="", severity=None, limit=1).total == 23
    empty = listing.list_page(tickets, enrichments, status="banana")
    assert (empty.items.count(), empty.has_more, empty.next_cursor, empty.total) == (0, False, None, 0)


def test_cursor(data):
    tickets, enrichments, _, _ = data
    first = listing.list_page(tickets, enrichments, limit=3)
    unknown = listing.list_page(tickets, enrichments, limit=3, after="nope")
    assert unknown.items.collect() == first.items.collect()
    # The cursor row is closed, so the filter itself would not return it.
    page = listing.list_page(tickets, enrichments, status="new", after="t21", limit=100)
    assert [r.id for r in page.items.collect()][:2] == ["t20", "t18"]
    assert page.total == 12
    last = listing.list_page(tickets, enrichments, after="t03", limit=3)
    assert (last.has_more, last.next_cursor) == (False, None)


def test_order_word_is_exact(data):
    tickets, enrichments, _, _ = data
    for word in ("ASC", "up", ""):
        assert listing.list_page(tickets, enrichments, order=word, limit=1).items.first().id == "t22"


@pytest.mark.parametrize("limit", [0, 101, -1])
def test_limit_bounds(data, limit):
    with pytest.raises(ValueError):
        listing.list_page(data[0], data[1], limit=limit)


def test_page_record(data):
    page = listing.list_page(data[0], data[1], limit=4, order="asc")
    (row,) = listing.page_envelope(page).collect()
    assert [t.id for t in row.tickets] == ["t00", "t01", "t02", "t03"]
    assert (row.next_cursor, row.has_more, row.total) == ("t03", True, 23)
    assert row.tickets[0].severity is None and row.tickets[1].severity == "high"


@pytest.mark.parametrize(
    "count, size, ranges", [(0, 45, []), (4, 2, [(1, 2), (3, 4)]), (5, 2, [(1, 2), (3, 4), (5, 5)])]
)
def test_page_ranges(spark, count, size, ranges):
    rows = listing.page_ranges(spark.range(count), size).orderBy("page").collect()
    assert [(r.range_start, r.range_end) for r in rows] == ranges
    assert [r.page for r in rows] == list(range(1, len(ranges) + 1))


def test_latest_and_detail(data):
    tickets, enrichments, _, _ = data
    assert [r.id for r in listing.latest(tickets, enrichments, 3).collect()] == ["t22", "t21", "t20"]
    detail = {r.id: r.enrichment for r in relations.ticket_detail(tickets, enrichments).collect()}
    assert detail["t05"] is None and detail["t06"].severity == "low"
    assert len(detail["t06"]) == 13


def test_lookups(spark, data):
    tickets, enrichments, _, _ = data
    assert relations.get_ticket(tickets, "t01").count() == 1
    assert relations.get_ticket(tickets, "nope").count() == 0
    wanted = spark.createDataFrame([("t01",), ("nope",), ("t01",)], "id string")
    found = {r.id: r.found for r in relations.lookup_tickets(tickets, wanted).collect()}
    assert found == {"t01": True, "nope": False}
    pending = relations.pending_enrichment(tickets, enrichments).collect()
    assert sorted(r.id for r in pending) == ["t00", "t05", "t10", "t15", "t20"]


def test_cascade(spark, data):
    tickets, enrichments, _, extra = data
    gone = tickets.where(F.col("id").isin("t00", "t01"))
    kept, kept_e, _ = relations.cascade_delete(gone, tickets, enrichments, enrichments)
    assert kept.count() == 21 and kept_e.count() == len(extra) - 1
    assert [r.ticket_id for r in relations.orphans(enrichments, kept).collect()] == ["t01"]
