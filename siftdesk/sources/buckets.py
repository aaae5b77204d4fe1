"""Tables in folders by a hash of the key, updated in place.

An update reads and rewrites the folders that hold a changed row and leaves the
files of all others alone. Every folder is replaced as a whole when the job ends
(dynamic partition overwrite). A job that stops while folders are being replaced
is run again with the same changes: folding them a second time gives the same
rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftdesk.operators.changes import current_state
from siftdesk.session import children, pinned, remove, work_dir

BUCKET = "bucket"
#: A few hundred folders suit tables up to some hundred GB; a table keeps its number.
BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _writer(df: DataFrame, mode: str):
    """Rows dealt so that a small folder gets one file and a large one several."""
    return df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", mode)


def save_in_buckets(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Write ``df`` as the whole table at ``path``."""
    _writer(df.withColumn(BUCKET, bucket_of(F.col(key), buckets)), "static").parquet(path)


def read_in_buckets(
    spark: SparkSession, path: str, schema: T.StructType, only: list[int] | None = None
) -> DataFrame:
    """The table, or the rows of some of its folders; the others are not opened."""
    whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    table = spark.read.schema(whole).parquet(path)
    if only is not None:
        table = table.where(F.col(BUCKET).isin(only))
    return table.select(*schema.fieldNames())


def update_in_buckets(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    changes: DataFrame,
    fields: tuple[str, ...],
    key: str = "id",
    buckets: int = BUCKETS,
) -> list[int]:
    """Fold a change log (see ``current_state``) into the table; the folders rewritten.

    Changes for keys that the table has not got are ignored, as are folders that
    hold no row. The log is written down once, as it decides which folders are
    read and what becomes of them.
    """
    scratch = work_dir(spark, "update")
    try:
        log = pinned(changes, scratch)
        # At most one number per folder comes to the driver.
        numbers = log.select(bucket_of(F.col("ticket_id"), buckets).alias(BUCKET)).distinct()
        there = set(children(spark, path))
        touched = sorted(r[0] for r in numbers.collect() if f"{BUCKET}={r[0]}" in there)
        if touched:
            state = current_state(read_in_buckets(spark, path, schema, touched), log, fields, key)
            _writer(state.withColumn(BUCKET, bucket_of(F.col(key), buckets)), "dynamic").parquet(path)
        return touched
    finally:
        remove(spark, scratch)
