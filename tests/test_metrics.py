"""Dashboard figures, reports and display columns."""

from decimal import Decimal

import pytest
from conftest import action, enrichment, minute, ticket
from pyspark.sql import functions as F

from siftdesk.functions import display
from siftdesk.operators import metrics


def test_empty_tables(tickets, enrichments, actions):
    row = metrics.dashboard_summary(tickets(), enrichments(), actions()).first()
    assert row.asDict() == {
        "total_tickets": 0,
        "open_tickets": 0,
        "critical_high_tickets": 0,
        "ai_accuracy_rate": 0.0,
        "avg_enrichment_cost": 0.0,
        "total_enrichment_cost": 0.0,
        "total_enriched": 0,
    }
    rows = metrics.override_breakdown(enrichments(), actions()).collect()
    assert [tuple(r) for r in rows] == [
        ("category", 0, 0, 0.0),
        ("severity", 0, 0, 0.0),
        ("suggested_response", 0, 0, 0.0),
    ]
    assert tuple(metrics.cost_summary(enrichments()).first()) == (0, None, None)


def test_summary(tickets, enrichments, actions):
    frames = (
        tickets(ticket("a"), ticket("b", "resolved"), ticket("c", "closed"), ticket("d", "triaged")),
        enrichments(
            enrichment("a", "critical"),
            enrichment("b", "high", estimated_cost=Decimal("0.000001")),
            enrichment("c", estimated_cost=Decimal("0.000002")),
        ),
        actions(action("1", "a"), action("2", "a"), action("3", "b", "status_change", "status")),
    )
    row = metrics.dashboard_summary(*frames).first()
    assert (row.total_tickets, row.open_tickets, row.critical_high_tickets) == (4, 2, 2)
    assert (row.total_enriched, row.ai_accuracy_rate) == (3, 0.333)
    assert (row.total_enrichment_cost, row.avg_enrichment_cost) == (0.000453, 0.000151)
    assert metrics.dashboard_summary(*frames, accuracy="tickets").first().ai_accuracy_rate == 0.667
    with pytest.raises(ValueError):
        metrics.dashboard_summary(*frames, accuracy="both")


def test_rate_can_be_negative_and_breaks_ties_like_a_float(tickets, enrichments, actions):
    rows = [action(str(i), "a") for i in range(3)]
    one = metrics.dashboard_summary(tickets(), enrichments(enrichment("a")), actions(*rows)).first()
    assert one.ai_accuracy_rate == -2.0
    many = enrichments(*[enrichment(str(i)) for i in range(16)])
    row = metrics.dashboard_summary(tickets(), many, actions(*[action(str(i), "a") for i in range(15)])).first()
    assert row.ai_accuracy_rate == round(1 / 16, 3) == 0.062
    # The breakdown is rounded as an exact decimal, ties away from zero.
    severity = metrics.override_breakdown(many, actions(*[action(str(i), "a") for i in range(15)]))
    assert severity.where("field = 'severity'").first().accuracy_rate == 0.063


def test_breakdown_ignores_other_fields(enrichments, actions):
    rows = [action("1", "a"), action("2", "a", field="summary"), action("3", "a", "status_change", "severity")]
    found = {r.field: r.override_count for r in metrics.override_breakdown(enrichments(), actions(*rows)).collect()}
    assert found == {"severity": 1, "category": 0, "suggested_response": 0}


def test_orders(tickets, enrichments):
    rows = [ticket("1", "closed"), ticket("2", "new"), ticket("3", "closed"), ticket("4", "triaged")]
    assert [r.label for r in metrics.tickets_by_status(tickets(*rows)).collect()] == ["new", "triaged", "closed"]
    by_count = metrics.order_by_count(metrics.count_by(tickets(*rows), "status")).collect()
    assert [(r.label, r["count"]) for r in by_count] == [("closed", 2), ("new", 1), ("triaged", 1)]
    odd = enrichments(enrichment("1", "weird"), enrichment("2", "low"), enrichment("3", "critical"))
    assert [r.label for r in metrics.enrichments_by_severity(odd).collect()] == ["critical", "low", "weird"]


def test_charts(tickets, enrichments, actions):
    charts = metrics.dashboard_charts(tickets(ticket("a")), enrichments(enrichment("a")), actions())
    assert set(charts) == {"by_severity", "by_category", "by_status", "override_breakdown"}
    assert charts["by_status"].first().label == "new"


def test_cost_summary_and_report(spark, enrichments):
    row = metrics.cost_summary(
        enrichments(
            enrichment("a", estimated_cost=Decimal("0.00015")), enrichment("b", estimated_cost=Decimal("0.00035"))
        )
    ).first()
    assert tuple(row) == (2, 0.0005, 0.0003)
    attempts = spark.createDataFrame(
        [(True, Decimal("0.5")), (False, Decimal("9")), (True, Decimal("0.25"))],
        "succeeded boolean, estimated_cost decimal(10,6)",
    )
    assert tuple(metrics.run_report(attempts).first()) == (3, 2, 1, 0.75, 0.375)
    assert tuple(metrics.run_report(attempts.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)


def test_evaluation(spark):
    predicted = spark.createDataFrame(
        [("1", "high", "billing"), ("2", "low", "general")], "ticket_id string, severity string, category string"
    )
    expected = spark.createDataFrame(
        [("1", "high", "general"), ("2", "low", "general"), ("3", "low", "general")],
        "ticket_id string, expected_severity string, expected_category string",
    )
    evaluated = metrics.evaluate(predicted, expected)
    assert {r.ticket_id: (r.predicted, r.severity_match) for r in evaluated.collect()}["3"] == (False, False)
    rates = metrics.match_rates(evaluated).first()
    assert tuple(rates)[:2] == (3, 2) and rates.severity_rate == pytest.approx(2 / 3)
    assert rates.category_rate == pytest.approx(1 / 3)


def test_dedupe(enrichments):
    rows = [
        enrichment("a", id="2", created_at=minute(1)),
        enrichment("a", id="1", created_at=minute(1)),
        enrichment("a", id="0", created_at=minute(2)),
        enrichment("b"),
    ]
    found = {r.ticket_id: r.id for r in metrics.dedupe_enrichments(enrichments(*rows)).collect()}
    assert found == {"a": "1", "b": "e-b"}


@pytest.mark.parametrize(
    "confidence, percent, band",
    [("0.800", 80, "green"), ("0.795", 80, "green"), ("0.145", 14, "red"), ("0.500", 50, "yellow"),
     ("0.494", 49, "red"), (None, None, None)],
)
def test_confidence_display(spark, confidence, percent, band):
    value = None if confidence is None else Decimal(confidence)
    df = spark.createDataFrame([(value,)], "c decimal(4,3)")
    row = df.select(display.confidence_percent(F.col("c")), display.confidence_band(F.col("c"))).first()
    assert tuple(row) == (percent, band)


def test_labels(spark):
    rows = [("waiting_on_customer", "high", "", "web_form"), ("odd", None, "odd", "api")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    c = F.col
    rows = df.select(
        display.status_label(c("a")), display.severity_label(c("b")), display.category_label(c("c")),
        display.source_label(c("d")),
    ).collect()
    assert [tuple(r) for r in rows] == [("Waiting", "High", None, "Form"), ("odd", None, "odd", "api")]


@pytest.mark.parametrize(
    "minutes, bucket",
    [(0, "seconds"), (59, "minutes"), (60, "hours"), (1440, "days"), (50000, "months"), (600000, "years")],
)
def test_age(spark, minutes, bucket):
    df = spark.createDataFrame([(minute(0), minute(minutes))], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(display.age_seconds(F.col("a"), F.col("b")), display.age_bucket(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (minutes * 60, bucket)
