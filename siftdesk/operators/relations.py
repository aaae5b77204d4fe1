"""Joins between tickets, enrichments and actions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftdesk.operators.sequences import HOT_ROWS, find_hot, with_position
from siftdesk.schemas import DETAIL_FIELDS, TICKET_COLUMNS


def with_enrichment(tickets: DataFrame, enrichments: DataFrame, columns: list[str]) -> DataFrame:
    """Every ticket, with the named enrichment columns or nulls."""
    right = enrichments.select("ticket_id", *columns)
    return tickets.join(right, tickets["id"] == right["ticket_id"], "left").drop("ticket_id")


def ticket_detail(tickets: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Tickets with their enrichment as one record, or null without one."""
    fields = [name for name in DETAIL_FIELDS if name in enrichments.columns]
    record = enrichments.select(
        F.col("ticket_id"), F.struct(*fields).alias("enrichment")
    )
    joined = tickets.select(*TICKET_COLUMNS).join(
        record, tickets["id"] == record["ticket_id"], "left"
    )
    return joined.drop("ticket_id")


def get_ticket(tickets: DataFrame, ticket_id) -> DataFrame:
    """The ticket of one key; no row if there is none."""
    return tickets.where(F.col("id") == F.lit(ticket_id))


def lookup_tickets(tickets: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted id (column ``id``), with ``found`` false where no ticket has it."""
    known = tickets.withColumn("_known", F.lit(True))
    joined = wanted.select("id").distinct().join(known, "id", "left")
    return joined.withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


def action_history(actions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Actions with their ``position`` in the ticket's history, newest first.

    The history stays in rows: a list per ticket would put all actions of a
    busy ticket into one value.
    """
    newest_first = [F.col("created_at").desc(), F.col("id").desc()]
    hot = find_hot(actions, "ticket_id", hot_rows)
    return with_position(actions, ["ticket_id"], newest_first, hot)


def ticket_actions(actions: DataFrame, ticket_id) -> DataFrame:
    """One ticket's actions, newest first."""
    mine = actions.where(F.col("ticket_id") == F.lit(ticket_id))
    return mine.orderBy(F.desc("created_at"), F.desc("id"))


def earliest_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key in the given order.

    Every task keeps only its first row per key before the shuffle, so a key
    with very many copies does not gather in one task.
    """
    window = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_copy", F.row_number().over(window))
    return ranked.where(F.col("_copy") == 1).drop("_copy")


def pending_enrichment(tickets: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Tickets that have no enrichment yet."""
    done = enrichments.select("ticket_id")
    return tickets.join(done, tickets["id"] == done["ticket_id"], "left_anti")


def orphans(children: DataFrame, tickets: DataFrame) -> DataFrame:
    """Rows whose ticket does not exist."""
    known = tickets.select("id")
    return children.join(known, children["ticket_id"] == known["id"], "left_anti")


def cascade_delete(
    deleted: DataFrame, tickets: DataFrame, enrichments: DataFrame, actions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the deleted tickets (column ``id``) and what hangs on them."""
    gone = deleted.select(F.col("id").alias("_gone"))

    def kept(df: DataFrame, key: str) -> DataFrame:
        return df.join(gone, df[key] == gone["_gone"], "left_anti")

    return kept(tickets, "id"), kept(enrichments, "ticket_id"), kept(actions, "ticket_id")
