"""Reading, writing, clearing and evolving the tables."""

import json

import pytest
from conftest import action, enrichment, ticket

from siftdesk import schemas, session
from siftdesk.sources import evolution, jdbc, tables


def test_round_trip_and_clear(spark, tmp_path, tickets, enrichments, actions):
    paths = {n: str(tmp_path / n) for n in ("tickets", "ai_enrichments", "agent_actions")}
    tables.append_rows(tickets(ticket("a")), paths["tickets"])
    tables.append_rows(tickets(ticket("b")), paths["tickets"])
    tables.append_rows(enrichments(enrichment("a")), paths["ai_enrichments"])
    tables.append_rows(actions(action("1", "a")), paths["agent_actions"])
    assert tables.read_tickets(spark, paths["tickets"]).count() == 2
    assert tables.read_enrichments(spark, paths["ai_enrichments"]).first().ticket_id == "a"
    assert tables.read_actions(spark, paths["agent_actions"]).first().new_value == "high"
    tables.clear_tables(spark, paths)
    assert tables.read_tickets(spark, paths["tickets"]).count() == 0
    assert spark.read.parquet(paths["agent_actions"]).count() == 0


def test_day_folders(spark, tmp_path, tickets):
    path = str(tmp_path / "t")
    tables.replace_table(tickets(ticket("a"), ticket("b", created=2000)), path, by_day="created_at")
    assert sorted(p.name for p in (tmp_path / "t").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]
    assert spark.read.parquet(path).where("day = date'2024-01-02'").first().id == "b"


def test_json(spark, tmp_path, tickets):
    df = tickets(ticket("a"))
    (row,) = tables.to_json_records(df).collect()
    assert json.loads(row.record)["assigned_to"] is None
    tables.write_json(df, str(tmp_path / "j"))
    assert tables.read_tickets(spark, str(tmp_path / "j"), "json").collect() == df.collect()


def test_evolution(enrichments):
    rows = enrichments(enrichment("a"))
    old = evolution.downgrade_enrichments(rows)
    assert set(rows.columns) - set(old.columns) == set(schemas.ADDED_ENRICHMENT_COLUMNS)
    up = evolution.upgrade_enrichments(old)
    row = up.first()
    assert (row.prompt_version, row.tokens_in, row.tokens_out) == ("v1.0", 0, 0)
    assert (row.estimated_cost, row.raw_response) == (0, None)
    assert {f.name: f.dataType for f in up.schema} == {f.name: f.dataType for f in rows.schema}
    assert evolution.union_versions(old, rows).count() == 2


def test_inline_values(spark):
    assert [r.field for r in tables.inline_values(spark, "field", ("b", "a")).collect()] == ["b", "a"]


def test_jdbc_needs_bounds(spark):
    with pytest.raises(TypeError):
        jdbc.read_jdbc(spark, "jdbc:postgresql://host/db", "tickets")
    with pytest.raises(TypeError):
        jdbc.read_jdbc(spark, "jdbc:postgresql://host/db", "tickets", split_on="id")


def test_appending_keeps_day_folders(spark, tmp_path, tickets):
    path = str(tmp_path / "t")
    tables.replace_table(tickets(ticket("a")), path, by_day="created_at")
    tables.append_rows(tickets(ticket("b", created=2000)), path)
    found = tables.read_tickets(spark, path)
    assert sorted(r.id for r in found.collect()) == ["a", "b"]
    assert found.columns == schemas.TICKETS.fieldNames()
    second = tables.read_tickets(spark, path, days=("2024-01-02", "2024-01-02"))
    assert [r.id for r in second.collect()] == ["b"]


def test_views_take_the_ad_hoc_queries(spark, tickets, enrichments, actions):
    tables.register_views(
        tickets(ticket("a"), ticket("b", created=1)), enrichments(enrichment("a")), actions(action("1", "a"))
    )
    newest = spark.sql(
        "SELECT t.id, e.severity FROM tickets t LEFT JOIN ai_enrichments e ON t.id = e.ticket_id "
        "ORDER BY t.created_at DESC LIMIT 5"
    )
    assert [tuple(r) for r in newest.collect()] == [("b", None), ("a", "low")]
    kinds = spark.sql("SELECT action_type, COUNT(*) AS count FROM agent_actions GROUP BY action_type")
    assert [tuple(r) for r in kinds.collect()] == [("override", 1)]


def test_shared_dir_follows_the_setting(monkeypatch, tmp_path):
    class Conf:
        def get(self, key, default=None):
            assert key == "spark.checkpoint.dir"
            return self.folder or default

    class Session:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://somewhere", "app-1"

        conf = Conf()

    Conf.folder = str(tmp_path)
    assert session.work_dir(Session, "x").startswith(str(tmp_path))
    Conf.folder = None
    with pytest.raises(RuntimeError):
        session.work_dir(Session, "x")
