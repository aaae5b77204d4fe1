"""Tickets stored in ranges of the list's order, with fences to find any page.

``save_paged`` writes a folder per range of (created_at, id) and one small row per
range: its rows, the rows before it, its first and last key. A page however far
down, the page after a key and the total then cost the fences and the folders
that hold the page's rows.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftdesk.operators.listing import after_cursor, is_ascending, order_tickets

RANGE = "range"
_KEYS = ("created_at", "id")


def save_paged(df: DataFrame, path: str, ranges: int | None = None) -> None:
    """Write the tickets and their fences; without ``ranges`` as many as the
    session has shuffle partitions."""
    ranged = df.repartitionByRange(ranges, *_KEYS) if ranges else df.repartitionByRange(*_KEYS)
    placed = ranged.withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *_KEYS)
    placed.write.partitionBy(RANGE).mode("overwrite").parquet(f"{path}/rows")
    # From what was written: bounds of ranges come from a sample.
    whole = T.StructType([*df.schema.fields, T.StructField(RANGE, T.IntegerType())])
    key = F.struct(*_KEYS)
    sizes = (
        df.sparkSession.read.schema(whole)
        .parquet(f"{path}/rows")
        .groupBy(RANGE)
        .agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    )
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    sizes.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/fences")


def read_fences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/fences")


def total(spark: SparkSession, path: str) -> int:
    """Number of tickets, from the fences alone."""
    return read_fences(spark, path).agg(F.sum("n")).first()[0] or 0


def _ranges(spark: SparkSession, path: str, schema: T.StructType, numbers: list[int]) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])
    rows = spark.read.schema(whole).parquet(f"{path}/rows")
    return rows.where(F.col(RANGE).isin(numbers)).select(*schema.fieldNames())


def _numbered(df: DataFrame, order: str, first: int) -> DataFrame:
    """Rows of one page with their number in the whole list."""
    keys = [F.asc(k) if is_ascending(order) else F.desc(k) for k in _KEYS]
    return df.withColumn("row", (F.row_number().over(Window.orderBy(*keys)) + first).cast("long"))


def read_page(
    spark: SparkSession, path: str, schema: T.StructType, page: int, size: int, order: str = "desc"
) -> DataFrame:
    """The tickets of page ``page`` from 1, with ``row``; none behind the last page."""
    if page < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    count = total(spark, path)
    start, stop = (page - 1) * size, min(page * size, count)
    low, high = (start, stop) if is_ascending(order) else (count - stop, count - start)
    meets = (F.col("before") < high) & (F.col("before") + F.col("n") > low)
    # A range has a row at least, so a page meets as many as it has rows at most.
    met = read_fences(spark, path).where(meets).select(RANGE, "before").collect() if low < high else []
    rows = _ranges(spark, path, schema, [r[0] for r in met])
    skip = low - min((r[1] for r in met), default=low)
    keys = rows.select(*_KEYS).orderBy(*_KEYS).offset(skip).limit(max(high - low, 0))
    found = [r[0] for r in keys.select("id").collect()] if met else []
    return order_tickets(_numbered(rows.where(F.col("id").isin(found)), order, start), order)


def read_after(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    created_at,
    ticket_id,
    limit: int,
    order: str = "desc",
) -> DataFrame:
    """The next ``limit`` tickets after a key in the list's order."""
    fences = read_fences(spark, path)
    key = F.struct(F.lit(created_at).alias("created_at"), F.lit(ticket_id).alias("id"))
    if is_ascending(order):
        ahead = fences.where(F.col("last") > key)
        edge = ahead.agg(F.min_by(F.col("before") + F.col("n"), RANGE)).first()[0]
        near = ahead.where(F.col("before") < F.lit(edge) + limit)
    else:
        ahead = fences.where(F.col("first") < key)
        edge = ahead.agg(F.max_by("before", RANGE)).first()[0]
        near = ahead.where(F.col("before") + F.col("n") > F.lit(edge) - limit)
    numbers = [] if edge is None else [r[0] for r in near.select(RANGE).collect()]
    rows = _ranges(spark, path, schema, numbers)
    return order_tickets(after_cursor(rows, F.lit(created_at), F.lit(ticket_id), order), order).limit(limit)
