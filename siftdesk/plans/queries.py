"""The registered queries: every operator over the stand-in tables."""

import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftdesk import schemas
from siftdesk.functions import display, text
from siftdesk.functions.replies import Prices, token_cost
from siftdesk.operators import changes, enrichment, intake, listing, metrics, relations
from siftdesk.session import is_folder, pinned, work_dir
from siftdesk.sources import buckets, evolution, pages, partials, tables
from siftdesk.sources.standins import base_table, standin, standin_frame
from siftdesk.streaming import jobs, requests as request_streams

Query = Callable[[SparkSession, str], DataFrame]

PRICES = Prices(Decimal("3.00"), Decimal("15.00"))
MODEL = "stand-in"
AS_OF = "1999-01-01 12:34:56"

PAGE_FILTERS = {"status": "in_progress", "severity": "high", "assigned_to": "agent_bob"}
TOTAL_FILTERS = {"status": "resolved", "category": "billing"}
CURSOR = 700

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _tickets(spark, sf_dir):
    return standin(spark, sf_dir, "tickets")


def _enrichments(spark, sf_dir):
    return standin(spark, sf_dir, "ai_enrichments")


def _actions(spark, sf_dir):
    return standin(spark, sf_dir, "agent_actions")


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in columns})


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-separated text."""
    return df.withColumns({name: F.array_join(name, ",") for name in columns})


def _placed(ordered: DataFrame) -> DataFrame:
    """A short ordered result with the place of each row, so a check sees the order."""
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_at"))
    return numbered.withColumn("position", place).drop("_at")


# Dashboards and reports


@query
def tickets_by_status(spark, sf_dir):
    return _placed(metrics.tickets_by_status(_tickets(spark, sf_dir)))


@query
def status_distribution(spark, sf_dir):
    return _placed(metrics.order_by_count(metrics.count_by(_tickets(spark, sf_dir), "status")))


@query
def enrichments_by_severity(spark, sf_dir):
    return _placed(metrics.enrichments_by_severity(_enrichments(spark, sf_dir)))


@query
def enrichments_by_category(spark, sf_dir):
    return _placed(metrics.enrichments_by_category(_enrichments(spark, sf_dir)))


@query
def actions_by_type(spark, sf_dir):
    return _placed(metrics.actions_by_type(_actions(spark, sf_dir)))


@query
def dashboard_charts(spark, sf_dir):
    charts = metrics.dashboard_charts(
        _tickets(spark, sf_dir), _enrichments(spark, sf_dir), _actions(spark, sf_dir)
    )
    breakdown = charts.pop("override_breakdown").select(
        F.col("field").alias("label"), F.col("override_count").alias("count")
    )
    parts = [
        _placed(chart).select(F.lit(name).alias("chart"), "label", "count", "position")
        for name, chart in {**charts, "override_breakdown": breakdown}.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def overrides_by_field(spark, sf_dir):
    return metrics.overrides_by_field(_actions(spark, sf_dir))


def _summary(spark, sf_dir, accuracy):
    return metrics.dashboard_summary(
        _tickets(spark, sf_dir), _enrichments(spark, sf_dir), _actions(spark, sf_dir), accuracy
    )


@query
def dashboard_summary_actions(spark, sf_dir):
    return _summary(spark, sf_dir, "actions")


@query
def dashboard_summary_tickets(spark, sf_dir):
    return _summary(spark, sf_dir, "tickets")


@query
def override_breakdown(spark, sf_dir):
    return _placed(metrics.override_breakdown(_enrichments(spark, sf_dir), _actions(spark, sf_dir)))


@query
def cost_summary(spark, sf_dir):
    return metrics.cost_summary(_enrichments(spark, sf_dir))


@query
def run_report(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, fields=())
    return metrics.run_report(
        parsed.select(F.col("parse_error").isNull().alias("succeeded"), "estimated_cost")
    )


@query
def evaluate_labels(spark, sf_dir):
    expected = standin(spark, sf_dir, "expected")
    # Only replies to labelled tickets are parsed.
    labelled = standin(spark, sf_dir, "replies").join(expected, "ticket_id", "left_semi")
    parsed = enrichment.parse_responses(labelled, PRICES, MODEL, fields=("severity", "category"))
    return metrics.evaluate(enrichment.split_parsed(parsed)[0], expected)


@query
def match_rates(spark, sf_dir):
    return metrics.match_rates(evaluate_labels(spark, sf_dir))


@query
def dedupe_enrichments(spark, sf_dir):
    return metrics.dedupe_enrichments(standin(spark, sf_dir, "enrichment_copies"))


# Lists and lookups


@query
def latest_five(spark, sf_dir):
    found = listing.latest(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))
    return _doubles(found, "confidence")


def _page(spark, sf_dir, **kwargs):
    return listing.list_page(_tickets(spark, sf_dir), _enrichments(spark, sf_dir), **kwargs)


def _items(spark, sf_dir, **kwargs):
    return _doubles(_page(spark, sf_dir, **kwargs).items, "confidence")


@query
def list_page_desc(spark, sf_dir):
    return _items(spark, sf_dir)


@query
def list_page_asc(spark, sf_dir):
    return _items(spark, sf_dir, order="asc", limit=45)


@query
def list_page_filtered(spark, sf_dir):
    return _items(spark, sf_dir, **PAGE_FILTERS)


@query
def list_page_after_cursor(spark, sf_dir):
    return _items(spark, sf_dir, after=CURSOR, limit=100)


@query
def list_page_after_cursor_asc(spark, sf_dir):
    return _items(spark, sf_dir, after=CURSOR, order="asc", limit=100, category="billing")


@query
def list_page_unknown_cursor(spark, sf_dir):
    return _items(spark, sf_dir, after=-1)


@query
def list_page_record(spark, sf_dir):
    page = _page(spark, sf_dir, after=CURSOR, limit=10, **PAGE_FILTERS)
    record = listing.page_envelope(page)
    ids = F.transform("tickets", lambda t: t["id"].cast("string"))
    return record.withColumns(
        {"tickets": F.array_join(ids, ","), "next_cursor": F.col("next_cursor").cast("string")}
    )


@query
def list_items(spark, sf_dir):
    joined = listing.list_items(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))
    found = listing.filter_tickets(joined, category="account_access", status="new")
    return _doubles(listing.order_tickets(found), "confidence")


@query
def list_total(spark, sf_dir):
    return listing.list_total(
        _tickets(spark, sf_dir), _enrichments(spark, sf_dir), **TOTAL_FILTERS
    )


@query
def page_ranges(spark, sf_dir):
    return listing.page_ranges(_tickets(spark, sf_dir), 45)


def _paged(spark, sf_dir):
    path = work_dir(spark, "paged")
    keys = _tickets(spark, sf_dir).select("id", "status", "created_at")
    pages.save_paged(keys, path, 16)
    return path, keys.schema


@query
def stored_page(spark, sf_dir):
    """A page far down of tickets stored with fences."""
    path, schema = _paged(spark, sf_dir)
    page = pages.total(spark, path) * 3 // 4 // 45 + 1
    return pages.read_page(spark, path, schema, page, 45)


@query
def stored_page_after(spark, sf_dir):
    """The rows after a key of tickets stored with fences."""
    path, schema = _paged(spark, sf_dir)
    at = _tickets(spark, sf_dir).where(F.col("id") == CURSOR).select("created_at").first()[0]
    return _placed(pages.read_after(spark, path, schema, at, CURSOR, 60, "asc"))


@query
def ticket_pages(spark, sf_dir):
    keys = _tickets(spark, sf_dir).select("id", "created_at")
    return listing.numbered_pages(keys, 45).select("id", "row", "page", "range_start", "range_end", "total")


@query
def ticket_detail(spark, sf_dir):
    detail = relations.ticket_detail(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))
    record = detail.schema["enrichment"].dataType
    flat = [F.col(f"enrichment.{n}").alias(f"enrichment_{n}") for n in record.fieldNames()]
    flat_detail = detail.select(*[c for c in detail.columns if c != "enrichment"], *flat)
    numbers = ("id", "confidence", "tokens_in", "tokens_out", "estimated_cost")
    return _doubles(flat_detail, *[f"enrichment_{name}" for name in numbers])


@query
def get_ticket(spark, sf_dir):
    wanted = base_table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("id"))
    found = relations.lookup_tickets(_tickets(spark, sf_dir), wanted)
    return found.select("id", "title", "status", "found")


@query
def action_history(spark, sf_dir):
    history = relations.action_history(_actions(spark, sf_dir))
    return history.select("ticket_id", "position", "id", "action_type", "new_value", "created_at")


@query
def pending_enrichment(spark, sf_dir):
    return relations.pending_enrichment(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))


def _closed(spark, sf_dir):
    return _tickets(spark, sf_dir).where(F.col("status") == "closed")


@query
def orphan_actions(spark, sf_dir):
    open_tickets = _tickets(spark, sf_dir).where(F.col("status") != "closed")
    return relations.orphans(_actions(spark, sf_dir), open_tickets)


@query
def cascade_delete(spark, sf_dir):
    kept = relations.cascade_delete(
        _closed(spark, sf_dir), _tickets(spark, sf_dir), _enrichments(spark, sf_dir), _actions(spark, sf_dir)
    )
    names = ("tickets", "ai_enrichments", "agent_actions")
    parts = [df.select(F.lit(name).alias("table_name"), "id") for name, df in zip(names, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def display_columns(spark, sf_dir):
    items = listing.list_items(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    shown = items.withColumns(display.display_columns(as_of))
    shown = shown.select("id", *display.display_columns(as_of))
    return _doubles(shown, "confidence_percent")


@query
def json_records(spark, sf_dir):
    """List items as the records a client gets, times and confidence included."""
    items = listing.list_items(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))
    return tables.to_json_records(items)


@query
def json_details(spark, sf_dir):
    """Tickets with their enrichment as a record inside the record."""
    detail = relations.ticket_detail(_tickets(spark, sf_dir), _enrichments(spark, sf_dir))
    return tables.to_json_records(detail.select("id", "status", "created_at", "enrichment"))


def _typed(rows, schema):
    rows = rows.withColumns({n: F.lit(None) for n in schema.fieldNames() if n not in rows.columns})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _stored(spark, sf_dir, name, schema, by_day=None):
    """A stand-in written as a table, half of it appended later."""
    path = work_dir(spark, name)
    typed = _typed(standin(spark, sf_dir, name), schema)
    half = F.xxhash64("id") % 2 == 0
    tables.replace_table(typed.where(half), path, by_day=by_day)
    tables.append_rows(typed.where(~half), path)
    return path


@query
def stored_actions(spark, sf_dir):
    """Written in day folders, appended to, and read back for some of the days."""
    path = _stored(spark, sf_dir, "agent_actions", schemas.ACTIONS, by_day="created_at")
    return tables.read_actions(spark, path, days=("2024-01-05", "2024-01-20"))


@query
def stored_views(spark, sf_dir):
    """A statement over the written tables under their own names."""
    found = tables.read_tickets(spark, _stored(spark, sf_dir, "tickets", schemas.TICKETS))
    made = _stored(spark, sf_dir, "ai_enrichments", schemas.ENRICHMENTS)
    tables.register_views(found, tables.read_enrichments(spark, made), _actions(spark, sf_dir))
    return spark.sql(
        """SELECT t.status, e.severity, count(*) AS tickets, sum(e.tokens_in) AS tokens_in
        FROM tickets t JOIN ai_enrichments e ON t.id = e.ticket_id GROUP BY t.status, e.severity"""
    )


@query
def upgrade_enrichments(spark, sf_dir):
    rows = _enrichments(spark, sf_dir)
    both = evolution.union_versions(evolution.downgrade_enrichments(rows), rows)
    return _doubles(both, "estimated_cost", "confidence").select(
        "id", "severity", "confidence", *evolution.ADDED_ENRICHMENT_COLUMNS
    )


# Intake


@query
def intake_form_accepted(spark, sf_dir):
    accepted, _ = intake.intake_form(standin(spark, sf_dir, "submissions"))
    return accepted.drop("created_at", "updated_at")


@query
def intake_form_rejected(spark, sf_dir):
    _, rejected = intake.intake_form(standin(spark, sf_dir, "submissions"))
    return _listed(rejected.drop("created_at"), "errors")


@query
def intake_external_accepted(spark, sf_dir):
    accepted, _ = intake.intake_external(standin(spark, sf_dir, "submissions"))
    return accepted.drop("created_at", "updated_at")


@query
def intake_external_rejected(spark, sf_dir):
    _, rejected = intake.intake_external(standin(spark, sf_dir, "submissions"))
    return _listed(rejected.drop("created_at"), "errors")


@query
def form_rules(spark, sf_dir):
    checked = intake.check_forms(standin(spark, sf_dir, "forms"))
    return _listed(checked, "errors").select("id", "errors", "short_description")


@query
def contact_string(spark, sf_dir):
    c = F.col
    contact = text.contact_string(
        c("first_name"), c("last_name"), c("contact_method"), c("email"), c("phone")
    )
    return standin(spark, sf_dir, "forms").select("id", contact.alias("contact"))


@query
def submit_forms(spark, sf_dir):
    return intake.submit_forms(standin(spark, sf_dir, "forms"))


# Replies


def _parsed(spark, sf_dir, fields=enrichment.REPLY_FIELDS):
    return enrichment.parse_responses(standin(spark, sf_dir, "replies"), PRICES, MODEL, fields=fields)


@query
def parse_responses(spark, sf_dir):
    return _doubles(_parsed(spark, sf_dir), "confidence", "estimated_cost")


@query
def response_cost(spark, sf_dir):
    cost = token_cost(F.col("tokens_in"), F.col("tokens_out"), PRICES)
    return _enrichments(spark, sf_dir).select("ticket_id", cost.cast("double").alias("cost"))


@query
def scorer_input(spark, sf_dir):
    submitted = _submitted(spark, sf_dir)
    return submitted.select("id", text.scorer_input(F.col("title"), F.col("description")).alias("input"))


def length_scorer() -> enrichment.Scorer:
    """A scorer that reads nothing but lengths and behaves badly.

    Some calls fail, some only at first; tickets are left out of the first
    call, answered twice, or make a call of their own raise.
    """

    def reply(attempt: int, title: str, description: str) -> str:
        a, b = len(title), len(description)
        if attempt <= a % 4:
            return "try again"
        fields = {
            "severity": ["critical", "high", "medium", "low"][b % 4],
            "category": ["billing", "general", "bug_report"][a % 3],
            "summary": f"{a} and {b} characters",
            "suggested_response": description,
            "confidence": (b % 100) / 100,
        }
        return json.dumps(fields, ensure_ascii=False)

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        retry = batch["attempt"].iloc[0] > 1
        if retry and (batch["description"].str.len() % 11 == 0).any():
            raise ValueError("cannot read")
        if not retry:
            batch = batch[batch["title"].str.len() % 7 != 0]
        sizes = batch["description"].str.len()
        readable = sizes % 50 != 0
        given = zip(batch["attempt"], batch["title"], batch["description"])
        replies = pd.Series([reply(*row) for row in given], index=batch.index, dtype="object")
        made = pd.DataFrame(
            {
                "ticket_id": batch["ticket_id"],
                "raw_text": replies.where(readable, None),
                "tokens_in": (sizes + batch["title"].str.len()).where(readable, 0),
                "tokens_out": (10 * batch["attempt"]).where(readable, 0),
                "error": readable.map({True: None, False: "unreadable ticket"}),
            }
        )
        again = made[batch["title"].str.len() % 5 == 0].assign(raw_text="{}", tokens_in=0)
        return pd.concat([made, again])

    return score


def _submitted(spark, sf_dir):
    accepted, _ = intake.intake_external(standin(spark, sf_dir, "submissions"))
    return accepted


_SCORED = [
    "ticket_id",
    "severity",
    "category",
    "summary",
    "suggested_response",
    "confidence",
    "tokens_in",
    "tokens_out",
    "estimated_cost",
]


@query
def score_batches(spark, sf_dir):
    tasks = spark.sparkContext.defaultParallelism
    scored = enrichment.score(_submitted(spark, sf_dir), length_scorer(), PRICES, MODEL, tasks=tasks)
    return _doubles(scored, "confidence", "estimated_cost").select(*_SCORED, "attempts", "last_error")


# Changes


def _overrides(spark, sf_dir):
    # Some enrichments have lost their ticket; requests for those are refused.
    present = _tickets(spark, sf_dir).where(F.col("id") % 16 != 3)
    return changes.apply_overrides(
        present, _enrichments(spark, sf_dir), standin(spark, sf_dir, "override_requests")
    )


@query
def apply_overrides_state(spark, sf_dir):
    state = _overrides(spark, sf_dir).table
    return state.select("ticket_id", "severity", "category", "suggested_response", "updated_at")


@query
def apply_overrides_log(spark, sf_dir):
    return _overrides(spark, sf_dir).actions.drop("id")


@query
def apply_overrides_rejects(spark, sf_dir):
    return _listed(_overrides(spark, sf_dir).rejects, "valid_values")


@query
def dashboard_after_overrides(spark, sf_dir):
    """The summary reads what the overrides left behind."""
    applied = _overrides(spark, sf_dir)
    return metrics.dashboard_summary(_tickets(spark, sf_dir), applied.table, applied.actions)


def _counted(spark, sf_dir, **frames) -> str:
    """Tables in day folders and their figures; what came last is appended.

    The stand-in tickets lie six to a day; here thirty days hold all of them.
    """
    root = work_dir(spark, "counted")
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(pmod(unix_date(to_date(created_at)), 30))")
    for name, rows in frames.items():
        typed = _typed(rows, partials.MEASURES[name][0]).withColumn("created_at", day)
        late = F.col("created_at") >= F.lit("2024-01-20").cast("timestamp_ntz")
        tables.replace_table(typed.where(~late), f"{root}/{name}", by_day="created_at")
        partials.refresh(spark, name, f"{root}/{name}", f"{root}/figures")
        partials.append_counted(typed.where(late), name, f"{root}/{name}", f"{root}/figures")
    return f"{root}/figures"


@query
def dashboard_from_partials(spark, sf_dir):
    """The summary after overrides, folded from figures per day and moves."""
    applied = pinned(_overrides(spark, sf_dir).actions)
    figures = _counted(
        spark,
        sf_dir,
        tickets=_tickets(spark, sf_dir),
        ai_enrichments=_enrichments(spark, sf_dir),
        agent_actions=applied,
    )
    partials.record_moves(applied, figures, "first")
    return partials.dashboard_summary(spark, figures)


@query
def status_from_partials(spark, sf_dir):
    """Tickets by status after the status changes, from figures per day and moves."""
    figures = _counted(spark, sf_dir, tickets=_tickets(spark, sf_dir))
    partials.record_moves(_status_changes(spark, sf_dir).actions, figures, "first")
    return partials.counts(spark, figures, "status")


def _status_changes(spark, sf_dir):
    return changes.apply_status_changes(
        _tickets(spark, sf_dir), standin(spark, sf_dir, "status_requests")
    )


@query
def apply_status_state(spark, sf_dir):
    state = _status_changes(spark, sf_dir).table
    return state.select("id", "status", "assigned_to", "updated_at")


@query
def apply_status_log(spark, sf_dir):
    return _status_changes(spark, sf_dir).actions.drop("id")


@query
def apply_status_rejects(spark, sf_dir):
    return _listed(_status_changes(spark, sf_dir).rejects, "valid_values")


def _change_log(spark, sf_dir):
    return _actions(spark, sf_dir).select(
        "ticket_id",
        F.col("override_field").alias("field"),
        "new_value",
        F.col("created_at").alias("requested_at"),
        F.col("id").alias("seq"),
    )


@query
def current_labels(spark, sf_dir):
    log = _change_log(spark, sf_dir).where(F.col("field").isin("severity", "category"))
    fields = ("severity", "category")
    state = changes.current_state(_enrichments(spark, sf_dir), log, fields, key="ticket_id")
    return state.select("ticket_id", "severity", "category", "updated_at")


@query
def current_state(spark, sf_dir):
    log = _change_log(spark, sf_dir)
    moved = log.where(F.col("field") == "status")
    state = changes.current_state(_tickets(spark, sf_dir), moved, ("status",))
    return state.select("id", "status", "updated_at")


@query
def updated_in_place(spark, sf_dir):
    """Tickets in buckets after the status changes of some of the buckets."""
    path = f"{work_dir(spark, 'tickets')}/rows"
    tickets = _tickets(spark, sf_dir)
    buckets.save_in_buckets(tickets, path, buckets=100)
    log = _change_log(spark, sf_dir).where((F.col("field") == "status") & (F.col("ticket_id") % 50 == 7))
    buckets.update_in_buckets(spark, path, tickets.schema, log, ("status",), buckets=100)
    state = buckets.read_in_buckets(spark, path, tickets.schema)
    return state.select("id", "status", "updated_at")


@query
def apply_enrichments(spark, sf_dir):
    found, _ = enrichment.split_parsed(_parsed(spark, sf_dir, fields=()))
    at = F.lit(AS_OF).cast("timestamp_ntz")
    moved = changes.apply_enrichments(_tickets(spark, sf_dir), found, at)
    return moved.select("id", "status", "updated_at")


# Streams


def _table_stream(spark, sf_dir, name):
    """A base table as a stream, be it one file or a folder of them.

    A name filter holds for files alone, and a stream's path must be a folder.
    """
    schema, path = base_table(spark, sf_dir, name).schema, f"{sf_dir}/{name}.parquet"
    if is_folder(spark, path):
        return jobs.read_stream(spark, path, schema, "parquet")
    return jobs.read_stream(spark, sf_dir, schema, "parquet", f"{name}.parquet")


def _submission_stream(spark, sf_dir):
    return standin_frame("submissions", documents=_table_stream(spark, sf_dir, "documents"))


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


@query
def stream_intake(spark, sf_dir):
    out = work_dir(spark, "intake")
    _finish(jobs.stream_intake(_submission_stream(spark, sf_dir), f"{out}/rows", f"{out}/state"))
    return spark.read.parquet(f"{out}/rows").select(
        "id", "title", "status", "source", F.array_join("errors", ",").alias("errors"), "side"
    )


def _enriched_stream(spark, sf_dir, horizon=None) -> str:
    """Two runs of the enrichment stream: the second brings the tickets of the
    first again, a day later, and the others."""
    out = work_dir(spark, "enrich")
    arrived = _submitted(spark, sf_dir).select(*schemas.TICKETS.fieldNames())
    tasks = spark.sparkContext.defaultParallelism
    first = arrived.where(F.col("id") % 3 != 0)
    later = arrived.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    # Within one run, too, tickets arrive more than once.
    for rows in (first.unionByName(first.where(F.col("id") % 5 == 0)), later):
        # As many files as tasks wrote; the files of a run are one micro-batch.
        rows.write.mode("append").parquet(f"{out}/inbox")
        tickets = jobs.read_stream(
            spark, f"{out}/inbox", arrived.schema, "parquet", files_per_batch=1_000_000
        )
        _finish(
            jobs.stream_enrich(
                tickets,
                f"{out}/rows",
                f"{out}/state",
                length_scorer(),
                PRICES,
                MODEL,
                tasks=tasks,
                horizon=horizon,
            )
        )
    return f"{out}/rows"


@query
def stream_enrich(spark, sf_dir):
    done = jobs.read_enriched(spark, _enriched_stream(spark, sf_dir))
    return _doubles(done, "confidence", "estimated_cost").select(*_SCORED)


@query
def stream_enrich_by_state(spark, sf_dir):
    """The same stream with its repeats found by Spark's state, across the restart."""
    done = jobs.read_enriched(spark, _enriched_stream(spark, sf_dir, "3 days"))
    return _doubles(done, "confidence", "estimated_cost").select(*_SCORED)


@query
def stream_outcomes(spark, sf_dir):
    """All that the stream's batches have committed, of each kind, per ticket."""
    out = _enriched_stream(spark, sf_dir)
    told = {jobs.ENRICHED: "severity", jobs.MOVED: "new_value", jobs.FAILED: "last_error"}
    parts = [
        jobs.read_enriched(spark, out, part).select(F.lit(part).alias("kind"), "ticket_id", F.col(name).alias("value"))
        for part, name in told.items()
    ]
    # A ticket that fails is tried again when it comes again.
    return reduce(DataFrame.unionByName, parts).distinct()


@query
def stream_triaged(spark, sf_dir):
    """What the enrichments of a stream leave of their tickets' status."""
    log = jobs.read_enriched(spark, _enriched_stream(spark, sf_dir), jobs.MOVED)
    return changes.current_state(_submitted(spark, sf_dir), log, ("status",)).select("id", "status")


@query
def stream_counts(spark, sf_dir):
    out = work_dir(spark, "counts")
    actions = standin_frame("agent_actions", events=_table_stream(spark, sf_dir, "events"))
    _finish(jobs.stream_counts(actions, "action_type", f"{out}/rows", f"{out}/state"))
    return jobs.read_counts(spark, f"{out}/rows")


def _override_stream(spark, sf_dir) -> str:
    """Override requests in three micro-batches, cut by time."""
    out = work_dir(spark, "overrides")
    present = _tickets(spark, sf_dir).where(F.col("id") % 16 != 3)
    asked = standin(spark, sf_dir, "override_requests")
    for stream in _cut_by_time(spark, asked, f"{out}/inbox"):
        _finish(
            request_streams.stream_overrides(
                present, _enrichments(spark, sf_dir), stream, f"{out}/rows", f"{out}/state"
            )
        )
    return f"{out}/rows"


def _cut_by_time(spark, asked, inbox):
    """Requests as a stream of three runs, in order of time; each run's files are one micro-batch."""
    second = F.expr("unix_seconds(requested_at::timestamp)")
    span = asked.agg(F.percentile_approx(second, [0.3, 0.7])).first()[0]
    for low, high in zip([None, *span], [*span, None]):
        part = asked.where(F.lit(low is None) | (second >= F.lit(low)))
        part = part.where(F.lit(high is None) | (second < F.lit(high)))
        part.write.mode("append").parquet(inbox)
        yield jobs.read_stream(spark, inbox, asked.schema, "parquet", files_per_batch=1_000_000)


@query
def stream_overrides_log(spark, sf_dir):
    return request_streams.override_actions(spark, _override_stream(spark, sf_dir)).drop("id")


@query
def stream_status_counts(spark, sf_dir):
    """Tickets per status, kept by a stream while status changes move them."""
    out = work_dir(spark, "status-counts")
    rows, asked = f"{out}/rows", standin(spark, sf_dir, "status_requests")
    for stream in _cut_by_time(spark, asked, f"{out}/inbox"):
        _finish(request_streams.stream_status_changes(_tickets(spark, sf_dir), stream, rows, f"{out}/state"))
    labels = _tickets(spark, sf_dir).select(F.col("status").alias("label"))
    labels.write.parquet(f"{out}/arrivals")
    arrivals = jobs.read_stream(spark, f"{out}/arrivals", labels.schema, "parquet")
    moves = request_streams.stream_status_moves(spark, rows)
    _finish(jobs.stream_label_counts(arrivals, moves, f"{out}/counts", f"{out}/count-state"))
    return jobs.read_counts(spark, f"{out}/counts")
