"""Columns for showing a ticket list."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftdesk.constants import CATEGORY_LABELS, SEVERITY_LABELS, STATUS_LABELS


def _labelled(value: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def status_label(status: Column) -> Column:
    return _labelled(status, STATUS_LABELS)


def severity_label(severity: Column) -> Column:
    return _labelled(F.nullif(severity, F.lit("")), SEVERITY_LABELS)


def category_label(category: Column) -> Column:
    return _labelled(F.nullif(category, F.lit("")), CATEGORY_LABELS)


def source_label(source: Column) -> Column:
    return F.when(source == "web_form", F.lit("Form")).otherwise(source)


def confidence_percent(confidence: Column) -> Column:
    """Whole percent, rounded on the double as a browser does."""
    return F.floor(confidence.cast("double") * 100 + 0.5)


def confidence_band(confidence: Column) -> Column:
    percent = confidence_percent(confidence)
    return (
        F.when(percent.isNull(), F.lit(None).cast("string"))
        .when(percent >= 80, "green")
        .when(percent >= 50, "yellow")
        .otherwise("red")
    )


def age_seconds(created_at: Column, as_of: Column) -> Column:
    """Seconds from creation to ``as_of``; both on the session's clock."""
    return F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(created_at.cast("timestamp"))


def age_bucket(created_at: Column, as_of: Column) -> Column:
    """The largest unit that fits the age at least once."""
    age = F.abs(age_seconds(created_at, as_of))
    return (
        F.when(age < 60, "seconds")
        .when(age < 3600, "minutes")
        .when(age < 86400, "hours")
        .when(age < 30 * 86400, "days")
        .when(age < 365 * 86400, "months")
        .when(age.isNotNull(), "years")
    )


def display_columns(as_of: Column) -> dict[str, Column]:
    """The derived columns of a list row, by name."""
    c = F.col
    return {
        "status_label": status_label(c("status")),
        "severity_label": severity_label(c("severity")),
        "category_label": category_label(c("category")),
        "source_label": source_label(c("source")),
        "confidence_percent": confidence_percent(c("confidence")),
        "confidence_band": confidence_band(c("confidence")),
        "age_seconds": age_seconds(c("created_at"), as_of),
        "age_bucket": age_bucket(c("created_at"), as_of),
    }
