"""Submissions, the form's rules and the contact string."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftdesk import schemas
from siftdesk.operators import intake


def submission(**more):
    return {"id": "x", "title": "t", "description": "d", "created_at": dt.datetime(2024, 1, 1), **more}


@pytest.fixture
def checked(frame):
    def run(external, *rows):
        split = intake.intake_external if external else intake.intake_form
        accepted, rejected = split(frame(schemas.SUBMISSIONS, rows))
        return accepted.collect(), rejected.collect()

    return run


@pytest.mark.parametrize(
    "change, errors",
    [
        ({}, None),
        ({"title": "x" * 255}, None),
        ({"title": "é😀" * 127}, None),
        ({"title": " "}, None),
        ({"title": "x" * 256}, ["title_length"]),
        ({"title": ""}, ["title_length"]),
        ({"title": None}, ["title_length"]),
        ({"description": ""}, ["description_empty"]),
        ({"source": "s" * 21}, ["source_length"]),
        ({"source": "anything"}, None),
        ({"submitter_email": "not an address"}, None),
        ({"submitter_email": "e" * 256}, ["email_length"]),
        ({"title": "", "description": None}, ["title_length", "description_empty"]),
    ],
)
def test_external_rules(checked, change, errors):
    accepted, rejected = checked(True, submission(**change))
    if errors is None:
        assert len(accepted) == 1 and not rejected
    else:
        assert not accepted and rejected[0].errors == errors


def test_sources_and_defaults(checked):
    (form,), _ = checked(False, submission(source="email"))
    (given,), _ = checked(True, submission(source="monitoring"))
    (default,), _ = checked(True, submission())
    assert (form.source, given.source, default.source) == ("web_form", "monitoring", "api")
    assert (form.status, form.assigned_to, form.id) == ("new", None, "x")
    assert form.created_at == form.updated_at == dt.datetime(2024, 1, 1)


def test_generated_keys_and_times(checked):
    accepted, _ = checked(True, *[submission(id=None, created_at=None) for _ in range(3)])
    assert len({row.id for row in accepted}) == 3
    assert all(len(row.id) == 36 and row.created_at is not None for row in accepted)


FORM = "id string, title string, description string, first_name string, last_name string, " \
    "contact_method string, email string, phone string"


def form(**more):
    base = {
        "id": "1",
        "title": "Printer jam",
        "description": "The printer on floor two eats paper",
        "first_name": None,
        "last_name": None,
        "contact_method": "email",
        "email": "a@b.co",
        "phone": None,
    }
    return tuple({**base, **more}.values())


@pytest.mark.parametrize(
    "change, errors",
    [
        ({}, []),
        ({"title": None}, ["title_required"]),
        ({"title": "﻿  "}, ["title_required"]),
        ({"title": "  abcd  "}, ["title_short"]),
        ({"title": "a😀😀"}, []),
        ({"description": "\n"}, ["description_required"]),
        ({"description": "123456789 "}, ["description_short"]),
        ({"email": " "}, ["email_required"]),
        ({"email": "a@b"}, ["email_invalid"]),
        ({"email": "a b@c.de"}, ["email_invalid"]),
        ({"email": "a@b@c.de"}, ["email_invalid"]),
        ({"email": "a@b.co\n"}, ["email_invalid"]),
        ({"contact_method": "sms"}, ["phone_required"]),
        ({"contact_method": "sms", "phone": "555-0100"}, ["phone_invalid"]),
        ({"contact_method": "sms", "phone": "(555) 123-4567", "email": None}, []),
    ],
)
def test_form_rules(spark, change, errors):
    (row,) = intake.check_forms(spark.createDataFrame([form(**change)], FORM)).collect()
    assert row.errors == errors


@pytest.mark.parametrize(
    "text, short", [("", False), ("x" * 19, True), ("x" * 20, False), (" ", True), ("😀" * 10, False)]
)
def test_short_description(spark, text, short):
    (row,) = intake.check_forms(spark.createDataFrame([form(description=text)], FORM)).collect()
    assert row.short_description is short


@pytest.mark.parametrize(
    "change, contact",
    [
        ({}, "a@b.co"),
        ({"first_name": " Ada "}, "Ada <a@b.co>"),
        ({"first_name": "Ada", "last_name": "King"}, "Ada King <a@b.co>"),
        ({"first_name": " ", "last_name": ""}, "a@b.co"),
        ({"contact_method": "sms", "phone": " 5551234567 "}, "sms:5551234567"),
        ({"contact_method": "sms", "phone": "5551234567", "last_name": "K"}, "K <sms:5551234567>"),
    ],
)
def test_contact(spark, change, contact):
    (row,) = intake.submit_forms(spark.createDataFrame([form(**change)], FORM)).collect()
    assert row.submitter_email == contact


def test_submitted_forms_are_submissions(spark):
    forms = spark.createDataFrame([form(title="  Printer jam ")], FORM)
    accepted, rejected = intake.intake_form(intake.submit_forms(forms))
    (row,) = accepted.collect()
    assert row.title == "Printer jam" and row.source == "web_form"
    assert rejected.select(F.count("*")).first()[0] == 0
