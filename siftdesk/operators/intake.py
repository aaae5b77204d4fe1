"""Submissions into tickets: checked, defaulted and keyed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftdesk.constants import DEFAULT_STATUS, EXTERNAL_SOURCE, FORM_SOURCE
from siftdesk.functions import rules, text


def _given(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def check_submissions(df: DataFrame, source: Column) -> DataFrame:
    """Submissions with the source they will get and their ``errors``."""
    df = df.withColumn("source", source)
    errors = rules.submission_errors(
        F.col("title"), F.col("description"), F.col("source"), _given(df, "submitter_email")
    )
    return df.withColumn("errors", errors)


def as_tickets(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Checked rows in the shape of the tickets table.

    Ids and times that are given are kept, so that a replay gives the same
    rows; the others are generated. ``keep`` names further columns to carry.
    """
    key = F.uuid()
    if "id" in df.columns:
        # Only text keys can be generated; others must be given.
        textual = isinstance(df.schema["id"].dataType, T.StringType)
        key = F.coalesce(F.col("id"), key) if textual else F.col("id")
    now = F.localtimestamp()
    created = F.coalesce(_given(df, "created_at", "timestamp_ntz").cast("timestamp_ntz"), now)
    return df.select(
        key.alias("id"),
        "title",
        "description",
        F.lit(DEFAULT_STATUS).alias("status"),
        "source",
        _given(df, "submitter_email").alias("submitter_email"),
        F.lit(None).cast("string").alias("assigned_to"),
        created.alias("created_at"),
        created.alias("updated_at"),
        *keep,
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tickets, rejected submissions with their errors)."""
    fine = F.size("errors") == 0
    return as_tickets(checked.where(fine)), checked.where(~fine)


def form_source(df: DataFrame) -> Column:
    return F.lit(FORM_SOURCE)


def external_source(df: DataFrame) -> Column:
    return F.coalesce(_given(df, "source"), F.lit(EXTERNAL_SOURCE))


def intake_form(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Form submissions: the source is always the form."""
    return split_checked(check_submissions(df, form_source(df)))


def intake_external(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions of other systems: their own source, or the default."""
    return split_checked(check_submissions(df, external_source(df)))


def check_forms(df: DataFrame) -> DataFrame:
    """The form's own rules, before anything is submitted."""
    c = F.col
    errors = rules.rule_set(
        rules.title_error(c("title")),
        rules.description_error(c("description")),
        rules.contact_error(c("contact_method"), c("email"), c("phone")),
    )
    return df.withColumns(
        {"errors": errors, "short_description": rules.short_description(c("description"))}
    )


def submit_forms(df: DataFrame) -> DataFrame:
    """Forms without errors as submissions: trimmed texts and one contact string."""
    c = F.col
    fine = check_forms(df).where(F.size("errors") == 0)
    contact = text.contact_string(
        c("first_name"), c("last_name"), c("contact_method"), c("email"), c("phone")
    )
    return fine.select(
        *(["id"] if "id" in df.columns else []),
        rules.js_trim(c("title")).alias("title"),
        rules.js_trim(c("description")).alias("description"),
        contact.alias("submitter_email"),
    )
