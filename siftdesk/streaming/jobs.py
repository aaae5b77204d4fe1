"""Continuous intake, enrichment and counts as Structured Streaming jobs."""

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftdesk.constants import DEFAULT_PROMPT_VERSION, ENRICHED_STATUS, MAX_ATTEMPTS
from siftdesk.functions.replies import Prices
from siftdesk.operators.enrichment import ENRICHED_COLUMNS, Scorer, score
from siftdesk.operators.intake import as_tickets, check_submissions, external_source, form_source
from siftdesk.operators.relations import earliest_per
from siftdesk.functions.text import key_from
from siftdesk.schemas import ENRICHMENTS
from siftdesk.session import children, is_complete, pinned, remove, setting, work_dir
from siftdesk.streaming import ledger

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TICKET_SIDE = "accepted"
REJECT_SIDE = "rejected"


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "json",
    glob: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """New files of a folder as a stream of the given schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def state_store() -> tuple[str, str]:
    """The setting under which a query keeps its state on RocksDB, not in memory."""
    return _STATE_STORE, _ROCKS_DB


def checked_intake(submissions: DataFrame, external: bool) -> DataFrame:
    """Submissions as ticket rows with ``errors`` and ``side``; works on a stream."""
    source = external_source(submissions) if external else form_source(submissions)
    checked = check_submissions(submissions, source)
    tickets = as_tickets(checked, keep=("errors",))
    side = F.when(F.size("errors") == 0, TICKET_SIDE).otherwise(REJECT_SIDE)
    return tickets.withColumn("side", side)


def stream_intake(
    submissions: DataFrame, out: str, checkpoint: str, external: bool = True, every: str | None = None
) -> StreamingQuery:
    """Check submissions as they come; ``out`` gets one folder for each side.

    One pass writes both sides, and the file sink's own log keeps a restarted
    batch from being written twice. Without ``every`` the job takes what is
    there and ends.
    """
    checked = checked_intake(submissions, external)
    writer = checked.writeStream.format("parquet").partitionBy("side").option("path", out)
    return start(writer, checkpoint, every)


def read_intake(spark: SparkSession, out: str, side: str = TICKET_SIDE) -> DataFrame:
    return spark.read.parquet(out).where(F.col("side") == side).drop("side")


def _unseen(batch: DataFrame, batch_id: int, listed: str) -> DataFrame:
    """Tickets of the batch that no other batch has enriched, whatever their day."""
    return ledger.unseen(batch, batch_id, listed)


#: What a batch commits together, by kind: enrichments with the move of their
#: ticket's status, and the tickets whose scoring failed.
ENRICHED, MOVED, FAILED = "enrichments", "changes", "failures"

_MOVE_COLUMNS = ["ticket_id", "field", "new_value", "requested_at", "seq"]
_FAILED_COLUMNS = [*ENRICHED_COLUMNS, "parse_error", "attempts", "last_error"]


def _committed_rows(scored: DataFrame) -> DataFrame:
    """Outcomes as rows of one wide table with their ``kind``, from one pass."""
    usable = F.col("parse_error").isNull()
    kinds = F.when(usable, F.array(F.lit(ENRICHED), F.lit(MOVED))).otherwise(F.array(F.lit(FAILED)))
    rows = scored.withColumn("kind", F.explode(kinds))
    enriched, moved = F.col("kind") == ENRICHED, F.col("kind") == MOVED
    at = F.localtimestamp()
    made = {
        "id": F.when(enriched, key_from(F.lit("enrichment"), F.col("ticket_id"))),
        "created_at": F.when(enriched, at),
        "updated_at": F.when(enriched, at),
        "field": F.when(moved, "status"),
        "new_value": F.when(moved, ENRICHED_STATUS),
        "requested_at": F.when(moved, at),
        "seq": F.when(moved, F.lit(0).cast("long")),
    }
    for name in scored.columns:
        if name != "ticket_id":
            made[name] = F.when(~moved, F.col(name))
    return rows.withColumns(made)


def enrich_batch(
    batch: DataFrame,
    batch_id: int,
    *,
    out: str,
    scorer: Scorer,
    prices: Prices,
    model: str,
    prompt_version: str = DEFAULT_PROMPT_VERSION,
    max_attempts: int = MAX_ATTEMPTS,
    tasks: int | None = None,
    known: bool = True,
) -> None:
    """Enrich one micro-batch into a folder of its own.

    All that the batch changes is one partitioned write, which readers see when
    its job is committed. A batch that is run again replaces its folder and does
    not count what the ledger has of it, so no ticket is enriched twice and none
    is lost. Intermediate frames are removed when the batch is done. Without
    ``known`` there is no ledger: the stream has no repeats.
    """
    spark = batch.sparkSession
    scratch = work_dir(spark, f"enrich-{batch_id}")
    listed, key = f"{out}/ledger", batch.schema["id"].dataType
    try:
        # Read by more than one job: the source and its state are not run again for each.
        fresh = pinned(earliest_per(batch, "id", ["created_at", "title", "description"]), scratch)
        with ledger.pushing(spark):
            if known:
                ledger.merge(spark, listed, key, batch_id)
                fresh = _unseen(fresh, batch_id, listed)
            scored = score(fresh, scorer, prices, model, prompt_version, max_attempts, tasks, scratch)
        # One job, one commit: an enrichment is there with its ticket's move or not at all.
        rows = _committed_rows(scored).write.mode("overwrite").partitionBy("kind")
        rows.option("partitionOverwriteMode", "static").parquet(f"{out}/batches/batch_id={batch_id}")
        if known:
            # Written last: the ledger names only what is there.
            ledger.add(scored.where("parse_error is null"), batch_id, listed)
    finally:
        remove(spark, scratch)


def without_repeats(tickets: DataFrame, horizon: str) -> DataFrame:
    """Tickets whose id has not arrived for ``horizon``, by Spark's own keyed state.

    Time is that of arrival, so no ticket is late, whatever its own dates say.
    The state holds the ids of the horizon and lets go of older ones.
    """
    dated = tickets.withColumn("_arrived_at", F.current_timestamp())
    timed = dated.withWatermark("_arrived_at", horizon)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_arrived_at")


def stream_enrich(
    tickets: DataFrame,
    out: str,
    checkpoint: str,
    scorer: Scorer,
    prices: Prices,
    model: str,
    prompt_version: str = DEFAULT_PROMPT_VERSION,
    max_attempts: int = MAX_ATTEMPTS,
    tasks: int | None = None,
    every: str | None = None,
    horizon: str | None = None,
) -> StreamingQuery:
    """Enrich each arriving ticket once.

    Repeated triggers are found in the batch and in the ledger of enriched
    tickets, by id alone and without end; a ticket that failed may come again.
    With ``horizon``, such as '7 days', there is no ledger: Spark's state store
    keeps the ids that arrived in that time, failed ones too.
    """
    run = partial(
        enrich_batch,
        out=out,
        scorer=scorer,
        prices=prices,
        model=model,
        prompt_version=prompt_version,
        max_attempts=max_attempts,
        tasks=tasks,
        known=horizon is None,
    )
    rows = tickets if horizon is None else without_repeats(tickets, horizon)
    writer = rows.writeStream.foreachBatch(lambda df, n: run(df, n))
    with setting(tickets.sparkSession, *state_store()):
        return start(writer, checkpoint, every)


def read_enriched(spark: SparkSession, out: str, part: str = ENRICHED) -> DataFrame:
    """``enrichments``, ``changes`` or ``failures`` of all committed batches."""
    batches = [f"{out}/batches/{name}" for name in children(spark, f"{out}/batches")]
    batches = [path for path in batches if is_complete(spark, path)]
    names = {ENRICHED: ENRICHMENTS.fieldNames(), MOVED: _MOVE_COLUMNS, FAILED: _FAILED_COLUMNS}[part]
    if not batches:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    whole = spark.read.option("basePath", f"{out}/batches").parquet(*batches)
    return whole.where(F.col("kind") == part).select(*names)


def status_changes(enrichments: DataFrame) -> DataFrame:
    """What the enrichments did to their tickets, as a log for ``current_state``."""
    return enrichments.select(
        "ticket_id",
        F.lit("status").alias("field"),
        F.lit(ENRICHED_STATUS).alias("new_value"),
        F.col("created_at").alias("requested_at"),
        F.lit(0).cast("long").alias("seq"),
    )


def _replace_counts(df: DataFrame, batch_id: int, out: str) -> None:
    slot = batch_id % 2
    numbered = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    numbered.write.mode("overwrite").parquet(f"{out}/counts/slot={slot}")
    # The mark is written last; readers trust a slot only with its mark.
    mark = df.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
    mark.write.mode("overwrite").parquet(f"{out}/marks/slot={slot}")


def stream_counts(
    rows: DataFrame, column: str, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Running counts per value; each batch writes the counts so far.

    The state has one row per value of ``column``. Batches take turns in two
    folders, so one always holds complete counts and no more pile up.
    """
    counts = rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count"))
    return _write_counts(counts, out, checkpoint, every)


def stream_label_counts(
    arrivals: DataFrame,
    moves: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Running counts of tickets per label that follow their moves.

    ``arrivals`` has the ``label`` of each new ticket. ``moves`` has the
    ``old_value`` and ``new_value`` of each applied change, as a stream of status
    changes writes them: a move takes one from the old label and adds one to the new,
    so a ticket is counted under one label, whatever the order of the two streams.
    """
    steps = F.array(
        F.struct(F.col("old_value").alias("label"), F.lit(-1).alias("step")),
        F.struct(F.col("new_value").alias("label"), F.lit(1).alias("step")),
    )
    moved = moves.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    moved = moved.select(F.explode(steps).alias("s")).select("s.label", "s.step")
    rows = arrivals.select("label", F.lit(1).alias("step")).unionByName(moved)
    counts = rows.groupBy("label").agg(F.sum("step").alias("count"))
    return _write_counts(counts.where(F.col("count") != 0), out, checkpoint, every)


def _write_counts(counts: DataFrame, out: str, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = counts.writeStream.outputMode("complete").foreachBatch(
        lambda df, n: _replace_counts(df, n, out)
    )
    return start(writer, checkpoint, every)


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts of the newest batch that is complete, as they are now.

    They are copied, a row per label, as a later batch takes over their folder; if
    another batch ended meanwhile they are read again.
    """

    def newest_batch() -> int:
        return spark.read.parquet(f"{out}/marks").agg(F.max("batch_id")).first()[0]

    newest = newest_batch()
    while True:
        slot = spark.read.parquet(f"{out}/counts/slot={newest % 2}")
        copied = pinned(slot.where(F.col("batch_id") == newest).drop("batch_id"))
        before, newest = newest, newest_batch()
        if newest == before:
            return copied
