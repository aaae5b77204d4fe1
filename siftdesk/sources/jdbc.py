"""Tables of a relational database over JDBC."""

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_on: str,
    lower,
    upper,
    splits: int,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """Read ``table`` in ``splits`` parts of the column ``split_on``.

    The bounds only place the cuts, rows beyond them are read as well. There is
    no default: without them one task would read the whole table.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = (
        reader.option("fetchsize", fetch_size)
        .option("partitionColumn", split_on)
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", splits)
    )
    return reader.options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
