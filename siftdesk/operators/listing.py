"""Filtered, sorted and paged ticket lists."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftdesk.constants import PAGE_DEFAULT, PAGE_MAX
from siftdesk.operators.relations import with_enrichment
from siftdesk.operators.sequences import with_global_position
from siftdesk.schemas import TICKET_COLUMNS

LIST_ENRICHMENT = ["severity", "category", "confidence"]


@dataclass(frozen=True)
class Page:
    """One page; ``items`` is a frame of at most ``limit`` rows in page order."""

    items: DataFrame
    next_cursor: object
    has_more: bool
    total: int
    ascending: bool = False


def check_limit(limit: int) -> int:
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_MAX}")
    return limit


def _equals(df: DataFrame, **filters: str | None) -> DataFrame:
    """Rows equal to every given filter; None and '' do not filter."""
    for column, value in filters.items():
        if value:
            df = df.where(F.col(column) == F.lit(value))
    return df


def filter_tickets(
    joined: DataFrame,
    status: str | None = None,
    severity: str | None = None,
    category: str | None = None,
    assigned_to: str | None = None,
) -> DataFrame:
    """Filter a frame that has ticket and enrichment columns side by side."""
    return _equals(
        joined, status=status, assigned_to=assigned_to, severity=severity, category=category
    )


def list_items(tickets: DataFrame, enrichments: DataFrame) -> DataFrame:
    """The list row: ticket columns and the enrichment's labels and confidence."""
    return with_enrichment(tickets, enrichments, LIST_ENRICHMENT).select(
        *TICKET_COLUMNS, *LIST_ENRICHMENT
    )


def is_ascending(order: str) -> bool:
    """Only the exact word 'asc' sorts ascending."""
    return order == "asc"


def order_tickets(df: DataFrame, order: str = "desc") -> DataFrame:
    direction = F.asc if is_ascending(order) else F.desc
    return df.orderBy(direction("created_at"), direction("id"))


def after_cursor(df: DataFrame, created_at: Column, ticket_id: Column, order: str = "desc") -> DataFrame:
    """Rows that come after the given key in the list's order."""
    at, key = F.col("created_at"), F.col("id")
    if is_ascending(order):
        return df.where((at > created_at) | ((at == created_at) & (key > ticket_id)))
    return df.where((at < created_at) | ((at == created_at) & (key < ticket_id)))


def matching_keys(
    tickets: DataFrame,
    enrichments: DataFrame,
    status: str | None = None,
    severity: str | None = None,
    category: str | None = None,
    assigned_to: str | None = None,
) -> DataFrame:
    """Sort keys of the tickets that pass the filters.

    Only keys travel: enrichments are read if they are filtered on, and then
    just their ticket ids take part in the join.
    """
    keys = _equals(tickets, status=status, assigned_to=assigned_to).select("created_at", "id")
    if not (severity or category):
        return keys
    wanted = _equals(enrichments, severity=severity, category=category).select("ticket_id")
    return keys.join(wanted, keys["id"] == wanted["ticket_id"], "left_semi")


def list_total(tickets: DataFrame, enrichments: DataFrame, **filters: str | None) -> DataFrame:
    """Number of tickets that pass the filters, in one row."""
    return matching_keys(tickets, enrichments, **filters).agg(F.count("*").alias("total"))


def _key_rows(df: DataFrame) -> list[tuple[str, object]]:
    """(created_at as text, id) of a frame that is at most one page long."""
    rows = df.select(F.col("created_at").cast("string"), "id").collect()
    return [(row[0], row[1]) for row in rows]


def list_page(
    tickets: DataFrame,
    enrichments: DataFrame,
    *,
    status: str | None = None,
    severity: str | None = None,
    category: str | None = None,
    assigned_to: str | None = None,
    order: str = "desc",
    after=None,
    limit: int = PAGE_DEFAULT,
) -> Page:
    """One page of the list, with the number of all matches.

    The keys of the page, at most ``limit + 1``, come to the driver; they give
    the next cursor, and as literals they reach the scans that fetch the
    page's wide rows. An unknown cursor is ignored, and a cursor row need not
    pass the filters.
    """
    check_limit(limit)
    keys = matching_keys(tickets, enrichments, status, severity, category, assigned_to)
    total = keys.count()
    kind = tickets.schema["created_at"].dataType
    if after is not None:
        for at, key in _key_rows(tickets.where(F.col("id") == F.lit(after)).limit(1)):
            keys = after_cursor(keys, F.lit(at).cast(kind), F.lit(key), order)
    head = _key_rows(order_tickets(keys, order).limit(limit + 1))
    shown, has_more = head[:limit], len(head) > limit
    ids = [key for _, key in shown]
    if shown:
        first, last = (shown[0][0], shown[-1][0]) if is_ascending(order) else (shown[-1][0], shown[0][0])
        in_span = F.col("created_at").between(F.lit(first).cast(kind), F.lit(last).cast(kind))
        mine = tickets.where(in_span & F.col("id").isin(ids))
        theirs = enrichments.where(F.col("ticket_id").isin(ids))
        items = order_tickets(list_items(mine, theirs), order)
    else:
        items = list_items(tickets.limit(0), enrichments.limit(0))
    return Page(items, ids[-1] if has_more else None, has_more, total, is_ascending(order))


def page_envelope(page: Page) -> DataFrame:
    """A page as one record: its items in order, the next cursor and the counts."""
    ranked = page.items.select(F.struct("created_at", "id", F.struct("*").alias("item")).alias("r"))
    # At most PAGE_MAX items, so the list stays small.
    listed = F.sort_array(F.collect_list("r"), asc=page.ascending)
    return ranked.agg(listed.alias("r")).select(
        F.col("r.item").alias("tickets"),
        F.lit(page.next_cursor).alias("next_cursor"),
        F.lit(page.has_more).alias("has_more"),
        F.lit(page.total).cast("long").alias("total"),
    )


def latest(tickets: DataFrame, enrichments: DataFrame, n: int = 5) -> DataFrame:
    """The newest tickets with their labels.

    The newest are picked before the join, so it has ``n`` rows on the left;
    the enrichments are narrowed down to them without a shuffle.
    """
    check_limit(n)
    newest = order_tickets(tickets.select("id", "title", "status", "created_at")).limit(n)
    ids = newest.select(F.col("id").alias("_id"))
    mine = enrichments.join(F.broadcast(ids), enrichments["ticket_id"] == ids["_id"], "left_semi")
    joined = with_enrichment(newest, F.broadcast(mine), LIST_ENRICHMENT)
    return order_tickets(joined).select("id", "title", "status", *LIST_ENRICHMENT)


def page_ranges(df: DataFrame, page_size: int) -> DataFrame:
    """One row per page: its number from 1 and the range of rows it shows."""
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    total = df.count()
    pages = df.sparkSession.range(-(-total // page_size))
    start = F.col("id") * page_size + 1
    end = F.least((F.col("id") + 1) * page_size, F.lit(total))
    return pages.select(
        (F.col("id") + 1).alias("page"),
        start.cast("long").alias("range_start"),
        end.cast("long").alias("range_end"),
        F.lit(total).cast("long").alias("total"),
    )


def numbered_pages(df: DataFrame, page_size: int, order: str = "desc", slices: int | None = None) -> DataFrame:
    """Every ticket with its row number, its page and the page's range of rows.

    ``df`` has created_at and id. Numbers come from ranges of the order and the
    rows before each range, so no task orders the whole list.
    """
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    total = df.count()
    keys = [F.col("created_at"), F.col("id")]
    keys = [key.asc() if is_ascending(order) else key.desc() for key in keys]
    placed = with_global_position(df, keys, slices)
    before = F.expr(f"(row - 1) div {page_size}")
    paged = placed.withColumnRenamed("position", "row").withColumns(
        {"page": before + 1, "range_start": before * page_size + 1}
    )
    return paged.withColumns(
        {
            "range_end": F.least(F.col("range_start") + page_size - 1, F.lit(total).cast("long")),
            "total": F.lit(total).cast("long"),
        }
    )
