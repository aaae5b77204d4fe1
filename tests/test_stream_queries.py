"""The registered streams, whatever files their tables lie in."""

import datetime as dt

import pytest

from siftdesk.plans import queries
from siftdesk.session import setting

DOCUMENTS = [(n, f"title {n}\nbody {n}", "en", "web" if n % 2 else None, 15) for n in range(40)]
EVENTS = [(n, dt.datetime(2024, 1, 1, 0, n), n, ["error", "view"][n % 2]) for n in range(40)]


@pytest.fixture(params=["folder", "file"])
def table(request, spark, tmp_path):
    """Writes a table as a folder of several files or as one file."""

    def put(name, rows, schema):
        df, path = spark.createDataFrame(rows, schema), tmp_path / "tables" / f"{name}.parquet"
        if request.param == "folder":
            df.repartition(3).write.parquet(str(path))
        else:
            path.parent.mkdir(exist_ok=True)
            df.toPandas().to_parquet(path, coerce_timestamps="us")
        return str(path.parent)

    return put


def test_intake_reads_documents_of_any_layout(spark, table):
    tables = table("documents", DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
    rows = queries.stream_intake(spark, tables).collect()
    assert sorted(r.id for r in rows) == list(range(40))


def test_counts_read_events_of_any_layout(spark, table):
    tables = table("events", EVENTS, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    rows = queries.stream_counts(spark, tables).collect()
    assert {r.label: r["count"] for r in rows} == {"override": 20, "status_change": 20}


def test_long_texts_come_to_the_scorer_in_small_batches(spark, frame, monkeypatch):
    from conftest import ticket

    from siftdesk import schemas
    from siftdesk.operators import enrichment

    def scorer(batch):
        import json

        import pandas as pd

        raw = json.dumps({"summary": f"{len(batch)} rows"})
        return pd.DataFrame({"ticket_id": batch["ticket_id"], "raw_text": raw, "tokens_in": 1, "tokens_out": 1})

    monkeypatch.setattr(enrichment, "BATCH_BYTES", 100_000)
    given = frame(schemas.TICKETS, [ticket(str(n), description="x" * 10_000) for n in range(100)]).coalesce(1)
    scored = enrichment.score(given, scorer, queries.PRICES, "m").collect()
    assert len({r.ticket_id for r in scored}) == 100
    assert max(int(r.summary.split()[0]) for r in scored) <= 10


def test_the_inbox_of_the_enrichment_stream_is_written_by_all_tasks(spark, table, request, monkeypatch):
    if "folder" not in request.node.name:
        pytest.skip("one file is one task")
    tables = table("documents", DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    read = queries.jobs.read_stream

    def spy(spark, folder, *args, **more):
        seen.append(spark.read.parquet(folder).inputFiles())
        return read(spark, folder, *args, **more)

    monkeypatch.setattr(queries.jobs, "read_stream", spy)
    with setting(spark, "spark.sql.files.openCostInBytes", "128m"):
        queries.stream_enrich(spark, tables)
    assert len(seen[0]) >= 3
