import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftdesk import schemas
from siftdesk.session import get_session

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def minute(n: int) -> dt.datetime:
    return START + dt.timedelta(minutes=n)


def ticket(key, status="new", created=0, **more):
    row = {
        "id": key,
        "title": f"title {key}",
        "description": f"description {key}",
        "status": status,
        "source": "web_form",
        "submitter_email": None,
        "assigned_to": None,
        "created_at": minute(created),
        "updated_at": minute(created),
    }
    return {**row, **more}


def enrichment(key, severity="low", category="general", **more):
    from decimal import Decimal

    row = {
        "id": f"e-{key}",
        "ticket_id": key,
        "severity": severity,
        "category": category,
        "summary": "s",
        "suggested_response": "r",
        "confidence": Decimal("0.500"),
        "model_used": "m",
        "prompt_version": "v1.0",
        "tokens_in": 100,
        "tokens_out": 10,
        "estimated_cost": Decimal("0.000450"),
        "raw_response": None,
        "created_at": minute(0),
        "updated_at": minute(0),
    }
    return {**row, **more}


def action(key, ticket_id, kind="override", field="severity", created=0, **more):
    row = {
        "id": key,
        "ticket_id": ticket_id,
        "agent_id": "a",
        "action_type": kind,
        "override_field": field,
        "old_value": "low",
        "new_value": "high",
        "created_at": minute(created),
        "updated_at": minute(created),
    }
    return {**row, **more}


@pytest.fixture
def frame(spark):
    """Rows (dicts) as a frame of one of the schemas."""

    def make(schema, rows):
        names = schema.fieldNames()
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)

    return make


@pytest.fixture
def tickets(frame):
    return lambda *rows: frame(schemas.TICKETS, rows)


@pytest.fixture
def enrichments(frame):
    return lambda *rows: frame(schemas.ENRICHMENTS, rows)


@pytest.fixture
def actions(frame):
    return lambda *rows: frame(schemas.ACTIONS, rows)
