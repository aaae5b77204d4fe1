"""Reading and writing the three tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftdesk import schemas
from siftdesk.session import exists


DAY = "day"


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    days: tuple[str, str] | None = None,
) -> DataFrame:
    """A table of fixed schema; nothing is inferred from the files.

    ``days`` are the first and last day to read of a table in day folders; the
    others are not opened.
    """
    table = spark.read.schema(schema).format(fmt).load(path)
    if days is not None:
        table = table.where(F.col(DAY).between(*[F.to_date(F.lit(day)) for day in days]))
    return table.select(*schema.fieldNames())


def read_tickets(spark: SparkSession, path: str, fmt: str = "parquet", **more) -> DataFrame:
    return read_table(spark, path, schemas.TICKETS, fmt, **more)


def read_enrichments(spark: SparkSession, path: str, fmt: str = "parquet", **more) -> DataFrame:
    return read_table(spark, path, schemas.ENRICHMENTS, fmt, **more)


def read_actions(spark: SparkSession, path: str, fmt: str = "parquet", **more) -> DataFrame:
    return read_table(spark, path, schemas.ACTIONS, fmt, **more)


def register_views(tickets: DataFrame, enrichments: DataFrame, actions: DataFrame) -> None:
    """Make the tables available to ``spark.sql`` under their own names."""
    tickets.createOrReplaceTempView("tickets")
    enrichments.createOrReplaceTempView("ai_enrichments")
    actions.createOrReplaceTempView("agent_actions")


def _write(df: DataFrame, path: str, fmt: str, mode: str, by_day: str | None) -> None:
    if by_day is None:
        df.write.mode(mode).format(fmt).save(path)
        return
    # One task takes few days, and several tasks a large one.
    dated = df.withColumn(DAY, F.to_date(by_day)).hint("rebalance", DAY)
    dated.write.mode(mode).partitionBy(DAY).format(fmt).save(path)


def has_day_folders(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether the table at ``path`` is laid out in folders of one day each."""
    if not exists(spark, path):
        return False
    key = T.StructType([T.StructField("id", T.StringType())])
    return DAY in spark.read.schema(key).format(fmt).load(path).columns


def append_rows(
    df: DataFrame, path: str, fmt: str = "parquet", by_day: str = "created_at"
) -> None:
    """Add rows in the layout the table has; ``by_day`` names the time that a
    table in day folders is laid out by."""
    folders = has_day_folders(df.sparkSession, path, fmt)
    _write(df, path, fmt, "append", by_day if folders else None)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", by_day: str | None = None) -> None:
    """Write ``df`` as the whole table, in folders of one day each if ``by_day`` names a timestamp."""
    _write(df, path, fmt, "overwrite", by_day)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Write ``df`` as a catalog table bucketed and sorted by ``key``.

    Tickets bucketed by ``id`` and their enrichments and actions bucketed by
    ``ticket_id`` into as many buckets are joined without a shuffle.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def clear_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> None:
    """Empty the tables, children before parents."""
    for name, schema in (
        ("agent_actions", schemas.ACTIONS),
        ("ai_enrichments", schemas.ENRICHMENTS),
        ("tickets", schemas.TICKETS),
    ):
        replace_table(spark.createDataFrame([], schema), paths[name], fmt)


def json_record(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return df.select(json_record(*df.columns).alias("record"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def inline_values(spark: SparkSession, column: str, values: tuple[str, ...]) -> DataFrame:
    """A one-column relation of constants, in the given order."""
    rows = ", ".join(f"('{value}')" for value in values)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({column})")
