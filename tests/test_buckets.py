"""Tables updated in place, and page numbers per row."""

import random
from pathlib import Path

import pytest
from conftest import minute, ticket

from siftdesk import schemas
from siftdesk.operators.changes import current_state
from siftdesk.operators.listing import numbered_pages
from siftdesk.sources import buckets

LOG = "ticket_id string, field string, new_value string, requested_at timestamp_ntz, seq long"


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def rows(df):
    return sorted(df.collect())


def test_only_changed_folders_are_rewritten(spark, tmp_path, tickets):
    path = str(tmp_path / "tickets")
    table = tickets(*[ticket(f"t{n}", created=n) for n in range(60)])
    buckets.save_in_buckets(table, path, buckets=16)
    whole = buckets.read_in_buckets(spark, path, schemas.TICKETS)
    assert rows(whole) == rows(table)
    before = files(path)
    log = spark.createDataFrame(
        [("t5", "status", "closed", minute(100), 1), ("t5", "status", "resolved", minute(100), 2),
         ("gone", "status", "closed", minute(100), 3), (None, "status", "closed", minute(1), 4)],
        LOG,
    )
    expected = rows(current_state(table, log, ("status",)))
    touched = buckets.update_in_buckets(spark, path, schemas.TICKETS, log, ("status",), buckets=16)
    assert 1 <= len(touched) <= 3
    assert rows(buckets.read_in_buckets(spark, path, schemas.TICKETS)) == expected
    kept = {p: t for p, t in before.items() if int(p.parent.name.split("=")[1]) not in touched}
    after = files(path)
    assert kept and kept.items() <= after.items()
    assert not (after.keys() - kept.keys()) & before.keys()
    # The same changes again leave the same rows.
    buckets.update_in_buckets(spark, path, schemas.TICKETS, log, ("status",), buckets=16)
    assert rows(buckets.read_in_buckets(spark, path, schemas.TICKETS)) == expected
    opened = buckets.read_in_buckets(spark, path, schemas.TICKETS, touched)
    read = {f.split("bucket=")[1].split("/")[0] for f in opened.inputFiles()} if touched else set()
    assert opened.count() < 60 and read


def test_no_changes_and_no_rows(spark, tmp_path, tickets):
    path = str(tmp_path / "tickets")
    buckets.save_in_buckets(tickets(ticket("a")), path, buckets=4)
    empty = spark.createDataFrame([], LOG)
    assert buckets.update_in_buckets(spark, path, schemas.TICKETS, empty, ("status",), buckets=4) == []
    assert buckets.read_in_buckets(spark, path, schemas.TICKETS).count() == 1


@pytest.mark.parametrize("order, slices", [("desc", 1), ("desc", 5), ("asc", 5)])
def test_pages_per_row(spark, order, slices):
    draw = random.Random(slices)
    made = [(minute(draw.randint(0, 9)), n) for n in range(103)]
    frame = spark.createDataFrame(made, "created_at timestamp_ntz, id long").repartition(4)
    got = {r.id: r for r in numbered_pages(frame, 10, order, slices).collect()}
    assert len(got) == 103
    for place, (_, key) in enumerate(sorted(made, reverse=order == "desc")):
        row = got[key]
        page = place // 10 + 1
        assert (row.row, row.page, row.total) == (place + 1, page, 103)
        assert (row.range_start, row.range_end) == (page * 10 - 9, min(page * 10, 103))


def test_pages_of_nothing(spark):
    frame = spark.createDataFrame([], "created_at timestamp_ntz, id long")
    assert numbered_pages(frame, 10).collect() == []
    with pytest.raises(ValueError):
        numbered_pages(frame, 0)
