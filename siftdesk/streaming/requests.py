"""Overrides and status changes as they come, with old values carried by state.

The state of a (ticket, field) is the value that the last request left; before
the first request it is the table's value. Requests are checked against the
tables as in a batch. Requests of a micro-batch take effect in the order of
(requested_at, seq) and micro-batches one after the other: if they are cut in
that order, the outcome is that of one batch.

Inside a micro-batch the value before a request is that of the row before it.
What earlier micro-batches have left lies in a ledger, a run of the last values
per micro-batch, merged by tiers: a micro-batch reads the folders of its own
tickets, and no row leaves the JVM. What a micro-batch has applied and refused is
written aside and gets its final name at the end, so readers see all of it or
nothing, and one that is run again finds it there. A stream that began with
Spark's keyed state must begin anew.

The tables are those of the start of the stream, read by every micro-batch; the
audit trail and the current table follow from the written rows. All requests of
a micro-batch for one field of one ticket meet in a task, so a micro-batch is
bounded by the files it takes.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftdesk.constants import OVERRIDABLE_FIELDS, SYSTEM_AGENT
from siftdesk.functions import text
from siftdesk.operators import changes
from siftdesk.operators.sequences import HotKeys
from siftdesk.session import exists, move, pinned, remove
from siftdesk.streaming import ledger
from siftdesk.streaming.jobs import start

APPLIED, REFUSED = "applied", "refused"

#: On a stream keys are not counted ahead.
_NONE_HOT = HotKeys("ticket_id", None, 0)

_STRING = T.StringType()
_HELD = T.StructType([T.StructField("field", _STRING), T.StructField("value", _STRING)])

#: (valid requests with ``now_value``, refused ones) of a written micro-batch; the
#: second argument is a folder for frames that are used twice.
Split = Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]


def _newest(held: DataFrame) -> DataFrame:
    """Of the values of a (ticket, field) the one of the last micro-batch."""
    value = F.max_by("value", "batch_id").alias("value")
    newest = held.groupBy("ticket_id", "field").agg(F.max("batch_id").alias("batch_id"), value)
    return newest.select("ticket_id", "batch_id", *_HELD.fieldNames())


def with_old_values(requests: DataFrame, held: DataFrame | None) -> DataFrame:
    """Valid requests (ticket_id, field, new_value, requested_at, seq, agent_id,
    now_value) of a micro-batch with ``old_value``, and ``latest`` on the last one of
    each (ticket, field). ``held`` has the ``value`` that earlier requests left."""
    keys, columns = ["ticket_id", "field"], ["new_value", "agent_id", "requested_at", "seq"]
    window = Window.partitionBy(*keys).orderBy(*[F.col(name).asc_nulls_last() for name in changes.ORDER])
    chained = requests.select(
        *keys,
        *columns,
        "now_value",
        F.lag("new_value").over(window).alias("_before"),
        F.lead(F.lit(True)).over(window).isNull().alias("latest"),
    )
    if held is not None:
        chained = chained.join(held.select(*keys, F.col("value").alias("_held")), keys, "left")
    else:
        chained = chained.withColumn("_held", F.lit(None).cast("string"))
    old = F.coalesce("_before", "_held", "now_value")
    return chained.select(*keys, *columns, old.alias("old_value"), "latest")


def apply_batch(batch: DataFrame, batch_id: int, *, out: str, split: Split) -> None:
    """Apply one micro-batch into a folder of its own and list the values it leaves.

    One that is run again keeps the folder it finds, and does not read what it has
    listed itself.
    """
    spark, key = batch.sparkSession, batch.schema["ticket_id"].dataType
    values, done, scratch = f"{out}/_values", f"{out}/batch_id={batch_id}", f"{out}/_batch-{batch_id}"
    try:
        with ledger.pushing(spark):
            ledger.merge(spark, values, key, batch_id, _HELD, _newest)
            if not exists(spark, done):
                remove(spark, scratch)
                asked = pinned(batch, scratch)
                valid, refused = split(asked, scratch)
                ids = asked.select("ticket_id").where("ticket_id is not null")
                held = ledger.listed(ids, batch_id, values, _HELD)
                applied = with_old_values(valid, None if held is None else _newest(held))
                kinds = [applied.withColumn("kind", F.lit(APPLIED)), refused.withColumn("kind", F.lit(REFUSED))]
                rows = kinds[0].unionByName(kinds[1], allowMissingColumns=True)
                rows.write.partitionBy("kind").parquet(f"{scratch}/rows")
                move(spark, f"{scratch}/rows", done)
        written = f"ticket_id {key.simpleString()}, field string, new_value string, latest boolean, kind string"
        left = spark.read.schema(written).parquet(done).where((F.col("kind") == APPLIED) & F.col("latest"))
        # Listed last: the ledger names only what is there.
        ledger.add(left.withColumnRenamed("new_value", "value"), batch_id, values, _HELD)
    finally:
        remove(spark, scratch)


def _stream(requests: DataFrame, split: Split, out: str, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = requests.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, out=out, split=split))
    return start(writer, checkpoint, every)


def stream_overrides(
    tickets: DataFrame,
    enrichments: DataFrame,
    requests: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Apply a stream of override requests; see ``changes.apply_overrides``."""

    def split(asked: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        checked = pinned(changes.checked_overrides(tickets, enrichments, asked, _NONE_HOT), folder)
        valid = checked.where(F.col("reason").isNull()).drop("reason")
        valued = changes.with_table_value(valid, enrichments, "ticket_id", OVERRIDABLE_FIELDS, _NONE_HOT)
        return valued, checked.where(F.col("reason").isNotNull())

    return _stream(requests, split, out, checkpoint, every)


def stream_status_changes(
    tickets: DataFrame, requests: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Apply a stream of status and assignment requests; see ``changes.apply_status_changes``."""

    def split(asked: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        # The tickets are joined once, for the checks and the values of both outcomes.
        return changes.split_statuses(pinned(changes.checked_statuses(tickets, asked, _NONE_HOT), folder))

    return _stream(requests, split, out, checkpoint, every)


def _rows(spark: SparkSession, out: str, kind: str) -> DataFrame:
    return spark.read.parquet(out).where(F.col("kind") == kind).drop("kind")


def read_applied(spark: SparkSession, out: str) -> DataFrame:
    """Applied changes with their old value, a log for ``changes.current_state``."""
    names = ["ticket_id", "field", "old_value", "new_value", "agent_id", "requested_at", "seq"]
    return _rows(spark, out, APPLIED).select(*names)


def override_actions(spark: SparkSession, out: str) -> DataFrame:
    """The audit rows of a stream of overrides."""
    return changes.audit_rows(read_applied(spark, out), "override", F.col("agent_id"))


def status_actions(spark: SparkSession, out: str) -> DataFrame:
    """The audit rows of a stream of status changes: only a status that differs."""
    applied = read_applied(spark, out).where(F.col("field") == "status")
    moved = applied.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return changes.audit_rows(moved, "status_change", text.agent_or_system(F.col("agent_id"), SYSTEM_AGENT))


def stream_status_moves(spark: SparkSession, out: str) -> DataFrame:
    """The status moves that a stream of status changes writes, as a stream of their own
    for ``jobs.stream_label_counts``."""
    schema = spark.read.parquet(out).schema
    rows = spark.readStream.schema(schema).parquet(out)
    return rows.where((F.col("kind") == APPLIED) & (F.col("field") == "status")).select("old_value", "new_value")


def read_refused(spark: SparkSession, out: str) -> DataFrame:
    return _rows(spark, out, REFUSED).drop("old_value", "latest", "batch_id")
