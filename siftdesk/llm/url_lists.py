"""URL filters: a temporal join of captures with dated list entries.

An entry adds a pattern to a list or removes it, from a day on. A pattern is a
host, which stands for its subdomains too (a bare ``zip`` for a whole top-level
domain), or a host with the beginning of a
path in whole segments. Per list and pattern the entries become validity
intervals [from, to) that end where the next entry begins. A capture meets the
patterns that its URL falls under, and of each list's intervals the one that is
valid on the day of the capture: a later entry never touches an earlier capture.

Entries are reduced to one per list, pattern and day first, so the history of a
pattern is bounded by the calendar however often it is repeated; it becomes one
row, and the as-of look-up inside it needs no further join. The join by pattern
has one row per key on the list side, so adaptive execution can split a host
with a large share of all captures. Everything is built from DataFrame functions.

Defined results: hosts and patterns compare in lower case, paths as they are;
ports, user names, queries and fragments are left out; a trailing dot of a host
and empty segments are dropped. On one day a removal beats an addition. Entries
with a null in list, pattern or day, or with another action than add and remove,
are not used. A null or hostless URL, or a null time, has no active entry. Rows
that repeat are evaluated each for itself; empty tables on either side are fine.
Other columns of the captures are not read.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import pinned

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def url_host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_keys(url: Column, depth: int, least_labels: int = 1) -> Column:
    """The patterns a URL falls under: its host, the parent domains of
    ``least_labels`` labels or more, and the host with its first 1 to ``depth``
    path segments."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(count - least_labels + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, count), "."),
    )
    keys = domains
    if depth > 0:
        parts = segments(F.regexp_extract(url, _PATH, 1))
        size = F.least(F.size(parts), F.lit(depth))
        paths = F.when(
            size > 0,
            F.transform(
                F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
                lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
            ),
        ).otherwise(F.array().cast("array<string>"))
        keys = F.concat(domains, paths)
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def pattern_key(pattern: Column) -> Column:
    """A pattern in the form of ``url_keys``."""
    cut = F.split(pattern, "/", 2)
    host = F.rtrim(F.lower(F.get(cut, F.lit(0))), F.lit("."))
    parts = segments(F.coalesce(F.get(cut, F.lit(1)), F.lit("")))
    return F.when(F.size(parts) > 0, F.concat(host, F.lit("/"), F.array_join(parts, "/"))).otherwise(
        host
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, history): per pattern its intervals (list, since, until), days.

    ``entries`` has list, pattern, action ('add' or 'remove') and dated_on (a
    date). ``until`` is null for an interval that is still open.
    """
    days = (
        entries.select(
            "list",
            pattern_key(F.col("pattern")).alias("key"),
            "action",
            F.col("dated_on").cast("date").alias("day"),
        )
        .where(
            F.col("list").isNotNull()
            & F.col("key").isNotNull()
            & F.col("day").isNotNull()
            & F.col("action").isin("add", "remove")
        )
        .groupBy("key", "list", "day")
        .agg(F.max("action").alias("action"))  # 'remove' comes after 'add'
    )
    by_list = days.groupBy("key", "list").agg(
        F.array_sort(F.collect_list(F.struct("day", "action"))).alias("steps")
    )
    intervals = F.filter(
        F.transform(
            "steps",
            lambda step, i: F.struct(
                F.col("list").alias("list"),
                step["day"].alias("since"),
                F.get("steps", i + 1)["day"].alias("until"),
                (step["action"] == "add").alias("listed"),
            ),
        ),
        lambda x: x["listed"],
    )
    return (
        by_list.select("key", F.explode(intervals).alias("interval"))
        .groupBy("key")
        .agg(F.collect_list("interval").alias("history"))
    )


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_on, n_active, lists, blocked), a row per capture.

    ``captures`` has page_id, url and fetched_on (a date). ``n_active`` counts
    the entries active that day, ``lists`` names their lists.
    """
    history = pinned(validity_intervals(entries))
    listed = F.split("key", "/")
    labels = F.size(F.split(F.get(listed, F.lit(0)), r"\."))
    # Keys that no pattern can have are not made.
    deepest, shortest = history.agg(F.max(F.size(listed) - 1), F.min(labels)).first()
    # Written once, so that a task computed again finds the same row numbers.
    rows = pinned(
        captures.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            "url",
            F.col("fetched_on").cast("date").alias("fetched_on"),
        )
    )
    keyed = rows.select("*", F.explode_outer(url_keys(F.col("url"), deepest or 0, shortest or 1)).alias("own"))
    active = F.filter(
        "history",
        lambda x: (x["since"] <= F.col("fetched_on"))
        & (x["until"].isNull() | (F.col("fetched_on") < x["until"])),
    )
    joined = keyed.join(history, keyed["own"] == history["key"], "left").select(
        "row",
        "page_id",
        "url",
        "fetched_on",
        F.coalesce(F.transform(active, lambda x: x["list"]), F.array().cast("array<string>")).alias(
            "active"
        ),
    )
    per_row = joined.groupBy("row", "page_id", "url", "fetched_on").agg(
        F.sum(F.size("active")).alias("n_active"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("active")))).alias("lists"),
    )
    return per_row.select(
        "page_id",
        "url",
        "fetched_on",
        "n_active",
        F.array_join("lists", ",").alias("lists"),
        (F.col("n_active") > 0).alias("blocked"),
    )
