"""Raw replies into enrichment rows, and the scorer that makes the replies."""

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftdesk.constants import DEFAULT_PROMPT_VERSION, MAX_ATTEMPTS
from siftdesk.functions import replies
from siftdesk.functions.replies import Prices
from siftdesk.functions.text import key_from, scorer_input
from siftdesk.schemas import ENRICHMENTS
from siftdesk.session import pinned, setting

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

NO_ID = "no_ticket_id"

#: A scorer's process gets so many bytes of rows at once, however long their texts;
#: the session's own setting goes before it.
BATCH_BYTES = 4 * 2**20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

REPLY_FIELDS = ("severity", "category", "summary", "suggested_response", "confidence")

ENRICHED_COLUMNS = [
    "ticket_id",
    "severity",
    "category",
    "summary",
    "suggested_response",
    "confidence",
    "model_used",
    "prompt_version",
    "tokens_in",
    "tokens_out",
    "estimated_cost",
    "raw_response",
]


def parse_responses(
    raw: DataFrame,
    prices: Prices,
    model: str,
    prompt_version: str = DEFAULT_PROMPT_VERSION,
    fields: tuple[str, ...] = REPLY_FIELDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Replies (``schemas.REPLIES``) as enrichment columns plus ``parse_error``.

    ``parse_error`` is null on a usable reply; on others the labels, texts,
    confidence and cost are null. With ``fields``, only those of the reply are
    worked out and returned; the labels still decide whether it is usable.
    Columns of ``raw`` in ``carry`` are passed on.
    """
    fields = tuple(name for name in REPLY_FIELDS if name in fields)
    needed = tuple(dict.fromkeys(("severity", "category", *fields)))
    read = raw.withColumn("_body", replies.unfenced(F.col("raw_text")))
    read = read.withColumn("_listed", replies.marked_list(F.col("_body")))
    # Exploding a list of one keeps the parsed text a column of its own:
    # otherwise a filter on the outcome would repeat the parsing per condition.
    parsed = replies.read_list(F.col("_listed"), needed)
    read = read.select("*", F.explode(F.array(parsed)).alias("_elements"))
    read = read.withColumn("_reply", replies.reply_record(F.col("_body"), F.col("_elements")))

    # What several results need is a column first: repeated in every
    # expression, the generated code outgrows what the JVM compiles.
    def field(name: str) -> Column:
        return F.col("_reply").getField(name)

    def kind(name: str) -> Column:
        return F.col(f"_{name}_kind")

    read = read.withColumns({f"_{name}_kind": replies.kind(field(name)) for name in needed})
    error = (
        F.when(F.col("_reply").isNull(), "not_an_object")
        .when(~replies.is_label(kind("severity")), "severity_not_text")
        .when(~replies.is_label(kind("category")), "category_not_text")
        .when(F.col("_cost").isNull(), "cost_out_of_range")
    )
    texts = [name for name in ("summary", "suggested_response") if name in fields]
    staged = {
        "_severity": replies.cleaned_label(field("severity")),
        "_category": replies.cleaned_label(field("category")),
        "_cost": replies.token_cost(F.col("tokens_in"), F.col("tokens_out"), prices),
    }
    if "confidence" in fields:
        staged["_number"] = replies.clamped_number(field("confidence"), kind("confidence"))
    if texts:
        staged["_tokens"] = replies.number_tokens(F.col("_body"), [kind(name) for name in texts])
    read = read.withColumns(staged).withColumn("parse_error", error)

    def text(name: str) -> Column:
        make = replies.summary if name == "summary" else replies.suggested_response
        return make(field(name), kind(name), F.col("_tokens").getField(name))

    values = {
        "severity": lambda: replies.severity(F.col("_severity")),
        "category": lambda: replies.category(F.col("_category")),
        "summary": lambda: text("summary"),
        "suggested_response": lambda: text("suggested_response"),
        "confidence": lambda: replies.confidence(F.col("_number")),
    }
    usable = F.col("parse_error").isNull()
    made = {name: F.when(usable, values[name]()) for name in fields}
    made["estimated_cost"] = F.when(usable, F.col("_cost"))
    read = read.withColumns(made).withColumns(
        {
            "model_used": F.lit(model),
            "prompt_version": F.lit(prompt_version),
            "raw_response": F.col("raw_text"),
        }
    )
    kept = [name for name in ENRICHED_COLUMNS if name not in REPLY_FIELDS or name in fields]
    return read.select(*kept, "parse_error", *carry)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enrichments, failed): a failed reply leaves no enrichment row."""
    usable = F.col("parse_error").isNull()
    return parsed.where(usable).drop("parse_error"), parsed.where(~usable)


def as_enrichments(parsed: DataFrame, at: Column | None = None) -> DataFrame:
    """Usable replies in the shape of the enrichments table.

    The key follows from the ticket, which has one enrichment; ``at`` is the
    time of creation, by default now.
    """
    at = F.localtimestamp() if at is None else at
    usable, _ = split_parsed(parsed)
    keyed = usable.withColumn("id", key_from(F.lit("enrichment"), F.col("ticket_id")))
    dated = keyed.withColumns({"created_at": at, "updated_at": at})
    return dated.select(*ENRICHMENTS.fieldNames())


def _batch_runner(scorer: Scorer) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The function that scores a task's batches.

    All it needs is nested in here, so it travels to the workers by value and
    they need not have this package.
    """

    columns = ["ticket_id", "raw_text", "tokens_in", "tokens_out", "error"]

    def send(batch: pd.DataFrame) -> dict:
        """One call: what came back per ticket, or the error for all of them."""
        try:
            replied = scorer(batch)
            if "error" not in replied:
                replied = replied.assign(error=None)
            # Of several replies to a ticket the first one counts.
            found: dict = {}
            for ticket, *outcome in replied[columns].itertuples(index=False, name=None):
                found.setdefault(ticket, outcome)
            unknown = found.keys() - set(batch["ticket_id"])
            if unknown:
                raise ValueError(f"the scorer made up ids: {sorted(map(str, unknown))[:3]}")
        except Exception as error:  # noqa: BLE001 - any failure of the scorer is a failed attempt
            failed = [None, 0, 0, f"{type(error).__name__}: {error}"]
            return dict.fromkeys(batch["ticket_id"], failed)
        return found

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            found: dict = {}
            # A retry goes ticket by ticket, so one that makes the scorer raise
            # takes no other with it.
            size = 1 if batch["attempt"].iloc[0] > 1 else len(batch)
            for i in range(0, len(batch), size):
                found |= send(batch.iloc[i : i + size])
            missing = [None, 0, 0, "no reply"]
            outcomes = [found.get(ticket, missing) for ticket in batch["ticket_id"]]
            replies = pd.DataFrame(outcomes, columns=columns[1:], dtype="object")
            given = batch.drop(columns=["input"]).reset_index(drop=True)
            yield pd.concat([given, replies], axis=1)

    return run


def _attempt(tickets: DataFrame, scorer: Scorer, attempt: int) -> DataFrame:
    key = tickets.schema["ticket_id"].dataType.simpleString()
    given = tickets.select(
        "ticket_id",
        "title",
        "description",
        scorer_input(F.col("title"), F.col("description")).alias("input"),
        F.lit(attempt).alias("attempt"),
    )
    return given.mapInPandas(
        _batch_runner(scorer),
        f"ticket_id {key}, title string, description string, attempt int, raw_text string, "
        "tokens_in int, tokens_out int, error string",
    )


def score(
    tickets: DataFrame,
    scorer: Scorer,
    prices: Prices,
    model: str,
    prompt_version: str = DEFAULT_PROMPT_VERSION,
    max_attempts: int = MAX_ATTEMPTS,
    tasks: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Score tickets, up to ``max_attempts`` times until the reply is usable.

    The scorer gets pandas batches (ticket_id, title, description, input,
    attempt) and returns (ticket_id, raw_text, tokens_in, tokens_out), and for
    calls that failed an ``error``. Every ticket gets exactly one outcome: rows
    the scorer leaves out have failed, of repeated rows the first counts, and if
    it raises or answers for a ticket it was not given, all rows of that call
    have failed. The first pass sends batches, later ones failed tickets one by
    one, so a ticket is sent ``attempts`` times and never more than the limit.

    A ticket without an id is refused: it has no attempts and the error
    ``no_ticket_id``.

    ``tasks`` spreads every pass over that many tasks. Every pass is written to
    the shared folder with the texts of its failed tickets, so no later step
    calls the scorer a second time and the source is read once. The result has
    the columns of ``parse_responses``, ``attempts`` and ``last_error``; a
    ticket that failed every time has its last reply. With ``folder`` the
    passes lie below that one.
    """
    given = tickets.select(F.col("id").alias("ticket_id"), "title", "description")
    # Beside a null, pandas would turn whole numbers into doubles.
    pending = given.where(F.col("ticket_id").isNotNull())
    usable, passes = F.col("parse_error").isNull(), []
    carry = ("attempts", "last_error", "title", "description")
    for attempt in range(1, max_attempts + 1):
        spread = pending if tasks is None else pending.repartition(tasks, "ticket_id")
        replied = _attempt(spread, scorer, attempt).withColumns(
            {"attempts": F.col("attempt"), "last_error": F.col("error")}
        )
        parsed = parse_responses(replied, prices, model, prompt_version, carry=carry)
        parsed = parsed.withColumns(
            {
                "last_error": F.coalesce("last_error", "parse_error"),
                "title": F.when(~usable, F.col("title")),
                "description": F.when(~usable, F.col("description")),
            }
        )
        spark = tickets.sparkSession
        with setting(spark, _BATCH_LIMIT, spark.conf.get(_BATCH_LIMIT, str(BATCH_BYTES))):
            parsed = pinned(parsed, folder)
        outcome = parsed.drop("title", "description")
        if attempt == max_attempts:
            passes.append(outcome)
            break
        passes.append(outcome.where(usable))
        pending = parsed.where(~usable).select("ticket_id", "title", "description")
        if pending.isEmpty():
            break
    refused = {
        "model_used": F.lit(model),
        "prompt_version": F.lit(prompt_version),
        "tokens_in": F.lit(0),
        "tokens_out": F.lit(0),
        "attempts": F.lit(0),
        "parse_error": F.lit(NO_ID),
        "last_error": F.lit(NO_ID),
    }
    nameless = given.where(F.col("ticket_id").isNull()).select(
        *[refused.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in passes[0].schema]
    )
    return reduce(DataFrame.unionByName, [*passes, nameless])
