"""The ledger of a stream, what its batches commit, and state instead of a ledger."""

import os
from decimal import Decimal
from pathlib import Path

from conftest import ticket
from pyspark.sql import types as T

from siftdesk import schemas
from siftdesk.functions.replies import Prices
from siftdesk.operators.enrichment import NO_ID, score
from siftdesk.streaming import jobs, ledger

PRICES = Prices(Decimal(3), Decimal(15))


def scorer():
    import pandas as pd

    def score_batch(batch):
        replies = ["{}" if "ok" in t else "no" for t in batch["title"]]
        return pd.DataFrame({"ticket_id": batch["ticket_id"], "raw_text": replies, "tokens_in": 1, "tokens_out": 1})

    return score_batch


def ids_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "ticket_id long")


def batch_of(spark, *ids):
    return spark.createDataFrame([(i, "t") for i in ids], "id long, title string")


def files_per_bucket(folder):
    counts = {}
    for path in Path(folder).rglob("*.parquet"):
        counts[path.parent.name] = counts.get(path.parent.name, 0) + 1
    return counts


def test_runs_are_merged_in_tiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "RUNS", 3)
    monkeypatch.setattr(ledger, "BUCKETS", 2)
    folder, per_batch = str(tmp_path / "ledger"), 4
    most, opened = 0, []
    for n in range(28):
        ledger.merge(spark, folder, T.LongType(), before=n)
        ledger.add(ids_of(spark, *range(per_batch * n, per_batch * (n + 1))), n, folder)
        most = max(most, *files_per_bucket(folder).values())
        standing = ledger.runs(spark, folder)
        opened.append(len(standing))
    # Two or three runs of the newest tier, two of each older one.
    assert most <= 3 + 2 + 2 + 1 and max(opened) <= 8
    assert [run for run in standing if run.tier == 3] == [ledger.Run(3, 0, 26)]
    batch = batch_of(spark, 0, 30, 107, 111, 500, None)
    with ledger.pushing(spark):
        fresh = ledger.unseen(batch, 28, folder)
        assert sorted(r.id for r in fresh.collect() if r.id is not None) == [500]
        assert "In(ticket_id" in fresh._jdf.queryExecution().executedPlan().toString()
    # A batch that is run again does not count what it listed itself.
    again = ledger.unseen(batch_of(spark, 106, 109), 27, folder)
    assert [r.id for r in again.collect()] == [109]
    # Ids beyond the literals are joined, with the same outcome.
    monkeypatch.setattr(ledger, "FEW_IDS", 2)
    assert sorted(r.id for r in ledger.unseen(batch, 28, folder).collect() if r.id is not None) == [500]


def test_a_merge_that_stopped_is_done_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "RUNS", 2)
    folder = str(tmp_path / "ledger")
    for n in range(2):
        ledger.add(ids_of(spark, n), n, folder)
    # A merged run whose job was never committed, and nothing removed.
    os.makedirs(f"{folder}/run-1-0-1/bucket=0")
    assert ledger.runs(spark, folder) == [ledger.Run(0, 0, 0), ledger.Run(0, 1, 1)]
    ledger.merge(spark, folder, T.LongType(), before=2)
    assert ledger.runs(spark, folder) == [ledger.Run(1, 0, 1)]
    assert sorted(os.listdir(folder)) == ["run-1-0-1"]
    assert ledger.unseen(batch_of(spark, 0, 1, 2), 2, folder).count() == 1


def test_files_are_sorted_by_id(spark, tmp_path):
    import pyarrow.parquet as pq

    folder = str(tmp_path / "ledger")
    ledger.add(ids_of(spark, *range(500)), 0, folder)
    file = next(Path(folder).rglob("*.parquet"))
    ids = pq.read_table(file).column("ticket_id").to_pylist()
    assert ids == sorted(ids)


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, tickets):
    out = str(tmp_path / "out")
    options = {"out": out, "scorer": scorer(), "prices": PRICES, "model": "m"}
    assert jobs.read_enriched(spark, out).collect() == []
    jobs.enrich_batch(tickets(ticket("a", title="ok"), ticket("b", title="no")), 0, **options)
    jobs.enrich_batch(tickets(ticket("c", title="ok")), 1, **options)
    # The second batch as if its job had stopped when all files but the mark were there.
    os.remove(f"{out}/batches/batch_id=1/_SUCCESS")

    def found(part):
        return [r.ticket_id for r in jobs.read_enriched(spark, out, part).collect()]

    assert (found("enrichments"), found("changes"), found("failures")) == (["a"], ["a"], ["b"])
    (moved,) = jobs.read_enriched(spark, out, "changes").collect()
    (made,) = jobs.read_enriched(spark, out).collect()
    assert (moved.field, moved.new_value, moved.requested_at) == ("status", "triaged", made.created_at)
    jobs.enrich_batch(tickets(ticket("c", title="ok")), 1, **options)
    assert sorted(found("enrichments")) == sorted(found("changes")) == ["a", "c"]


def test_repeats_by_state_across_restarts(spark, tmp_path, frame):
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    arrivals = [
        [ticket("a", title="ok"), ticket("a", title="ok"), ticket("b", title="ok")],
        [ticket("a", title="ok"), ticket("c", title="ok", created=-100_000), ticket("b", title="ok")],
    ]
    for rows in arrivals:
        frame(schemas.TICKETS, rows).write.mode("append").json(folder)
        stream = jobs.read_stream(spark, folder, schemas.TICKETS)
        query = jobs.stream_enrich(stream, out, state, scorer(), PRICES, "m", horizon="7 days")
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.ticket_id for r in jobs.read_enriched(spark, out).collect()) == ["a", "b", "c"]
    assert not os.path.exists(f"{out}/ledger")
    assert list(Path(state).rglob("*.zip"))  # the state store that Spark keeps on RocksDB


def test_large_ids_beside_a_null_one(spark):
    schema = "id long, title string, description string"
    rows = [(2**60 + 1, "ok", "d"), (None, "ok", "d"), (2**60 + 3, "no", "d"), (5, "ok", "d")]
    scored = score(spark.createDataFrame(rows, schema).coalesce(1), scorer(), PRICES, "m").collect()
    found = {r.ticket_id: (r.attempts, r.last_error) for r in scored}
    assert len(scored) == 4
    assert found == {
        2**60 + 1: (1, None), 2**60 + 3: (3, "not_an_object"), 5: (1, None), None: (0, NO_ID),
    }


def test_ids_are_not_worked_out_while_nothing_is_listed(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    ids = ids_of(spark, 1, 2).selectExpr("CAST(raise_error('read') AS BIGINT) AS ticket_id")
    assert ledger.listed(ids, 0, folder) is None
    ledger.add(ids_of(spark, 1, 2), 0, folder)
    # A batch that is run again finds its own run alone.
    assert ledger.listed(ids, 0, folder) is None
    assert ledger.listed(ids_of(spark, 2, 2, 3), 1, folder).count() == 1
