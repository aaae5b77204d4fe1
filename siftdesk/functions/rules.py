"""Field rules. Each rule yields its code where it is broken, else null.

A rule set is an ``array<string>`` of broken codes; an empty array accepts.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftdesk.constants import (
    AGENT_MAX,
    CATEGORIES,
    EMAIL_MAX,
    JS_SPACE,
    OVERRIDABLE_FIELDS,
    SEVERITIES,
    SOURCE_MAX,
    STATUSES,
    TITLE_MAX,
)

# An address as the submission form accepts it.
FORM_EMAIL = f"^[^{JS_SPACE}@]+@[^{JS_SPACE}@]+\\.[^{JS_SPACE}@]+\\z"


def broken(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def rule_set(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def length_between(value: Column, low: int, high: int | None = None) -> Column:
    """Non-null with a length (in code points) in the range."""
    size = F.char_length(value)
    fits = size >= low
    if high is not None:
        fits = fits & (size <= high)
    return F.coalesce(fits, F.lit(False))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units, the way a browser counts."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def js_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(JS_SPACE))


def submission_errors(title: Column, description: Column, source: Column, email: Column) -> Column:
    return rule_set(
        broken(~length_between(title, 1, TITLE_MAX), "title_length"),
        broken(~length_between(description, 1), "description_empty"),
        broken(F.char_length(source) > SOURCE_MAX, "source_length"),
        broken(F.char_length(email) > EMAIL_MAX, "email_length"),
    )


def title_error(title: Column) -> Column:
    size = utf16_length(js_trim(F.coalesce(title, F.lit(""))))
    return F.when(size == 0, "title_required").when(size < 5, "title_short")


def description_error(description: Column) -> Column:
    size = utf16_length(js_trim(F.coalesce(description, F.lit(""))))
    return F.when(size == 0, "description_required").when(size < 10, "description_short")


def email_error(email: Column) -> Column:
    email = F.coalesce(email, F.lit(""))
    return F.when(js_trim(email) == "", "email_required").when(
        ~email.rlike(FORM_EMAIL), "email_invalid"
    )


def phone_error(phone: Column) -> Column:
    phone = F.coalesce(phone, F.lit(""))
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(js_trim(phone) == "", "phone_required").when(
        F.char_length(digits) < 10, "phone_invalid"
    )


def contact_error(method: Column, email: Column, phone: Column) -> Column:
    """The error of whichever contact the form asked for; anything but 'email' is a phone."""
    return F.when(method.eqNullSafe("email"), email_error(email)).otherwise(phone_error(phone))


def short_description(description: Column) -> Column:
    """The form's warning: some text, but under 20 characters, untrimmed."""
    return F.coalesce(utf16_length(description).between(1, 19), F.lit(False))


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(*STATUSES), F.lit(False))


def valid_override_field(field: Column) -> Column:
    return F.coalesce(field.isin(*OVERRIDABLE_FIELDS), F.lit(False))


def valid_override_value(field: Column, value: Column) -> Column:
    """Case-exact membership in the field's domain; a response may be any text."""
    return (
        F.when(field == "severity", value.isin(*SEVERITIES))
        .when(field == "category", value.isin(*CATEGORIES))
        .otherwise(F.lit(True))
    )


def valid_agent(agent: Column) -> Column:
    return length_between(agent, 1, AGENT_MAX)


def text_list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def allowed_override_values(field: Column) -> Column:
    """What an 'invalid value' reject lists: the field's domain, sorted."""
    return F.when(field == "severity", F.sort_array(text_list(SEVERITIES))).when(
        field == "category", F.sort_array(text_list(CATEGORIES))
    )
