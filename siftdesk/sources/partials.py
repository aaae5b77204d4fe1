"""Figures per day folder, so that a dashboard after an append reads new folders only.

For every day of a table in day folders there is a folder of partial figures: rows
per label of each measure, and the cost. They add up, so the dashboard is a fold
over some dozens of rows per day whatever the size of the tables. Appending
rows works out the days of those rows again, from their folders alone, which may be
repeated after a stop.

The folders have rows as they came. Applied changes take one from the old label
and add one to the new; a batch of changes is a small folder under its own name,
which the same batch replaces when it is run again.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftdesk import schemas
from siftdesk.constants import FINISHED_STATUSES, URGENT_SEVERITIES
from siftdesk.operators.metrics import summary_row
from siftdesk.session import exists
from siftdesk.sources.tables import DAY, append_rows

#: The labels that are counted, per table.
MEASURES = {
    "tickets": (schemas.TICKETS, ("status",)),
    "ai_enrichments": (schemas.ENRICHMENTS, ("severity", "category")),
    "agent_actions": (schemas.ACTIONS, ("action_type",)),
}
_COUNTS = "measure string, label string, n long, cost decimal(38,6)"
_MOVING = ("status", "severity", "category")


def _no_cost() -> Column:
    return F.lit(0).cast("decimal(38,6)")


def day_figures(rows: DataFrame, name: str) -> DataFrame:
    """(day, measure, label, n, cost) of rows with ``day``; one scan, summed before
    the shuffle. The cost stands with the first measure."""
    measures = MEASURES[name][1]
    labels = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("label")) for m in measures]
    cost = _no_cost()
    if name == "ai_enrichments":
        paid = F.when(F.col("_m.measure") == measures[0], F.col("estimated_cost").cast("decimal(28,6)"))
        cost = F.coalesce(F.sum(paid), F.lit(0)).cast("decimal(38,6)")
    return (
        rows.withColumn("_m", F.explode(F.array(*labels)))
        .groupBy(DAY, "_m.measure", "_m.label")
        .agg(F.count("*").alias("n"), cost.alias("cost"))
    )


def refresh(spark: SparkSession, name: str, table: str, path: str, days: list | None = None) -> None:
    """Work out the figures of a table's day folders again, of all or of ``days``."""
    whole = T.StructType([*MEASURES[name][0].fields, T.StructField(DAY, T.DateType())])
    rows = spark.read.schema(whole).parquet(table)
    if days is not None:
        rows = rows.where(F.col(DAY).isin(days))
    writer = day_figures(rows, name).hint("rebalance", DAY).write.partitionBy(DAY).mode("overwrite")
    mode = "static" if days is None else "dynamic"
    writer.option("partitionOverwriteMode", mode).parquet(f"{path}/days/table={name}")


def append_counted(df: DataFrame, name: str, table: str, path: str) -> list:
    """Append rows to a table in day folders and bring its figures up to date; the
    days that were read."""
    dates = df.select(F.to_date("created_at").alias(DAY)).distinct()
    days = sorted(row[0] for row in dates.collect())  # as many as the calendar has
    append_rows(df, table)
    refresh(df.sparkSession, name, table, path, days)
    return days


def record_moves(log: DataFrame, path: str, batch: str) -> None:
    """Take applied changes into account; ``log`` has override_field, old_value, new_value."""
    moved = log.where(
        F.col("override_field").isin(*_MOVING) & ~F.col("old_value").eqNullSafe(F.col("new_value"))
    )
    steps = F.array(
        F.struct(F.col("old_value").alias("label"), F.lit(-1).alias("step")),
        F.struct(F.col("new_value").alias("label"), F.lit(1).alias("step")),
    )
    sums = (
        moved.select(F.col("override_field").alias("measure"), F.explode(steps).alias("s"))
        .groupBy("measure", "s.label")
        .agg(F.sum("s.step").alias("n"))
    )
    # One row per label.
    sums.withColumn("cost", _no_cost()).coalesce(1).write.mode("overwrite").parquet(f"{path}/moves/batch={batch}")


def figures(spark: SparkSession, path: str) -> DataFrame:
    """(measure, label, n, cost) over all days and changes."""
    names = [field.split()[0] for field in _COUNTS.split(", ")]
    parts = spark.read.schema(_COUNTS).parquet(f"{path}/days").select(*names)
    if exists(spark, f"{path}/moves"):
        parts = parts.unionByName(spark.read.schema(_COUNTS).parquet(f"{path}/moves").select(*names))
    return parts.groupBy("measure", "label").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))


def counts(spark: SparkSession, path: str, measure: str) -> DataFrame:
    """Rows per label of a measure, as the tables have them now."""
    mine = figures(spark, path).where((F.col("measure") == measure) & (F.col("n") != 0))
    return mine.select("label", F.col("n").alias("count"))


def dashboard_summary(spark: SparkSession, path: str) -> DataFrame:
    """``metrics.dashboard_summary`` with every override row counted, from the figures."""

    def rows(measure: str, condition: Column | None = None) -> Column:
        mine = F.col("measure") == measure
        mine = mine if condition is None else mine & condition
        return F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0))

    label = F.col("label")
    sums = figures(spark, path).agg(
        rows("status").alias("total_tickets"),
        rows("status", ~label.isin(*FINISHED_STATUSES)).alias("open_tickets"),
        F.struct(
            rows("severity").alias("n"),
            rows("severity", label.isin(*URGENT_SEVERITIES)).alias("urgent"),
            F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"),
        ).alias("e"),
        rows("action_type", label == "override").alias("overridden"),
    )
    return summary_row(sums)
