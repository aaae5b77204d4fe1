"""Which tickets a stream has done, found again at a cost that history does not raise.

Beside an id a ledger may hold more columns, such as the last value of a field;
``more`` names them, and ``fold`` says what a merged run keeps of several rows.

Every batch adds a *run*: its ids, sorted, in folders by a hash of the id. When a
tier has ``RUNS`` runs they are merged into one of the next tier, so a bucket has
some files per tier and tiers grow with the logarithm of the number of batches;
an id is rewritten once per tier. Files carry Bloom filters and are sorted by
id: a batch opens the folders of its own ids, and in them reads the row groups
that can hold one.

A run counts once its job is committed. A merged run is written before those it
replaces are removed; in between ids are listed twice, which changes nothing.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftdesk.session import children, is_complete, remove, setting

#: Folders of a run; a stream must keep the number it began with.
BUCKETS = 64
#: Runs of a tier that are merged into one of the next.
RUNS = 8
#: Up to so many ids of a batch reach the scan as literals.
FEW_IDS = 2000

_NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)$")
_IN_LIST = "spark.sql.parquet.pushdown.inFilterThreshold"
_WITH_BLOOM = {
    "parquet.bloom.filter.enabled#ticket_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


@dataclass(frozen=True, order=True)
class Run:
    """The ids of the batches ``first`` to ``last``."""

    tier: int
    first: int
    last: int

    def path(self, ledger: str) -> str:
        return f"{ledger}/run-{self.tier}-{self.first}-{self.last}"

    def holds(self, other: "Run") -> bool:
        return self.tier > other.tier and self.first <= other.first and other.last <= self.last


_IDS_ALONE = T.StructType([])


def schema(key: T.DataType, more: T.StructType = _IDS_ALONE) -> T.StructType:
    return T.StructType([T.StructField("ticket_id", key), T.StructField("batch_id", T.LongType()), *more])


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def runs(spark: SparkSession, ledger: str) -> list[Run]:
    """The committed runs, without those that a merged one has taken in."""
    named = [_NAME.match(name) for name in children(spark, ledger)]
    found = [Run(*map(int, match.groups())) for match in named if match]
    found = [run for run in found if is_complete(spark, run.path(ledger))]
    return sorted(run for run in found if not any(other.holds(run) for other in found))


def _write(ids: DataFrame, path: str) -> None:
    # Adaptive execution gives a small bucket one file and cuts a large one.
    dealt = ids.select("*", bucket("ticket_id").alias("bucket")).hint("rebalance", "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "ticket_id")
    writer = ordered.write.mode("overwrite").options(**_WITH_BLOOM)
    writer.option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def _read(spark: SparkSession, columns: T.StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(columns).option("recursiveFileLookup", "true").parquet(*folders)


def add(ids: DataFrame, batch_id: int, ledger: str, more: T.StructType = _IDS_ALONE) -> None:
    """List the ``ticket_id`` of a batch; a repeated batch replaces its own run."""
    numbered = ids.select("ticket_id", F.lit(batch_id).cast("long").alias("batch_id"), *more.fieldNames())
    _write(numbered, Run(0, batch_id, batch_id).path(ledger))


def merge(
    spark: SparkSession,
    ledger: str,
    key: T.DataType,
    before: int,
    more: T.StructType = _IDS_ALONE,
    fold: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Merge full tiers of batches before ``before``, which can no longer be repeated."""
    standing = runs(spark, ledger)
    tier = 0
    while any(run.tier >= tier for run in standing):
        mine = [run for run in standing if run.tier == tier and run.last < before]
        if len(mine) >= RUNS:
            made = Run(tier + 1, mine[0].first, mine[-1].last)
            paths = [run.path(ledger) for run in mine]
            _write(fold(_read(spark, schema(key, more), paths)), made.path(ledger))
            standing = [run for run in standing if run not in mine] + [made]
        tier += 1
    kept = {run.path(ledger).rsplit("/", 1)[1] for run in runs(spark, ledger)}
    for name in children(spark, ledger):
        match = _NAME.match(name)
        # Replaced runs, and what a job that was stopped has left of an old one.
        if match and name not in kept and int(match.group(3)) < before:
            remove(spark, f"{ledger}/{name}")


def files_of(spark: SparkSession, ledger: str, buckets: list[int], without: int | None = None) -> list[str]:
    """The folders of these buckets in all runs but that of the batch ``without``."""
    wanted = {f"bucket={number}" for number in buckets}
    folders = []
    for run in runs(spark, ledger):
        if run != Run(0, without, without):
            path = run.path(ledger)
            folders += [f"{path}/{name}" for name in children(spark, path) if name in wanted]
    return folders


def listed(
    ids: DataFrame, batch_id: int, ledger: str, more: T.StructType = _IDS_ALONE
) -> DataFrame | None:
    """What other batches have listed, read as far as it can concern ``ids``, a
    frame of one column that may repeat; None if there is nothing."""
    spark, key = ids.sparkSession, ids.schema[0]
    if all(run == Run(0, batch_id, batch_id) for run in runs(spark, ledger)):
        return None
    few = [row[0] for row in ids.distinct().limit(FEW_IDS + 1).collect()]
    asked = spark.createDataFrame([(k,) for k in few], T.StructType([key])) if len(few) <= FEW_IDS else ids
    touched = [row[0] for row in asked.select(bucket(key.name)).distinct().collect()]
    there = files_of(spark, ledger, touched, batch_id)
    if not there:
        return None
    known = _read(spark, schema(key.dataType, more), there)
    return known.where(F.col("ticket_id").isin(few)) if len(few) <= FEW_IDS else known


def unseen(batch: DataFrame, batch_id: int, ledger: str) -> DataFrame:
    """Rows of the batch whose ``id`` no other batch has listed."""
    ids = batch.select(F.col("id").alias("_id")).where("_id is not null")
    known = listed(ids, batch_id, ledger)
    if known is None:
        return batch
    known = known.select("ticket_id")
    seen = known.join(ids, F.col("ticket_id") == F.col("_id"), "left_semi").distinct()
    return batch.join(seen, batch["id"] == seen["ticket_id"], "left_anti")


def pushing(spark: SparkSession):
    """While this is open, a batch's ids reach Parquet's own filters one by one."""
    return setting(spark, _IN_LIST, str(FEW_IDS))
