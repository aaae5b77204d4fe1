"""Texts put together from ticket and contact fields."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftdesk.functions.rules import js_trim


def scorer_input(title: Column, description: Column) -> Column:
    """The text a scorer reads for one ticket."""
    return F.concat(
        F.lit("Ticket title: "), title, F.lit("\n\nTicket description: "), description
    )


def contact_string(
    first_name: Column, last_name: Column, method: Column, email: Column, phone: Column
) -> Column:
    """``Name <contact>``, or the bare contact where no name is given."""
    first, last, mail, number = (
        js_trim(F.coalesce(c, F.lit(""))) for c in (first_name, last_name, email, phone)
    )
    name = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))
    contact = F.when(method.eqNullSafe("email"), mail).otherwise(F.concat(F.lit("sms:"), number))
    return F.when(name == "", contact).otherwise(F.concat(name, F.lit(" <"), contact, F.lit(">")))


def agent_or_system(agent: Column, system: str) -> Column:
    return F.coalesce(F.nullif(agent, F.lit("")), F.lit(system))


def key_from(*columns: Column) -> Column:
    """A UUID-shaped key that depends on the given values only."""
    digest = F.md5(F.to_json(F.struct(*columns)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
