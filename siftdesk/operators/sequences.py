"""Per-key steps that survive a very frequent key.

A window or a join by key puts all rows of a key into one task. The hottest
keys are therefore counted first and taken out:

* For order-dependent steps their rows are cut into slices of neighbours by a
  range partitioning on (key, order). The window works inside a slice, and
  what it needs from earlier slices comes from one summary row per slice.
* For joins against a side with one row per key, the hot keys are joined apart,
  with that side's few rows of them.

The hot keys are written to the shared folder and joined like any other frame,
so there may be any number of them; one with a null key is a key like the rest.
"""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftdesk.session import pinned

HOT_ROWS = 1_000_000

_SLICE = "_slice"


@dataclass(frozen=True)
class HotKeys:
    """The keys of one column with more than ``hot_rows`` rows, null included."""

    column: str
    keys: DataFrame | None
    slices: int

    def _join(self, df: DataFrame, how: str) -> DataFrame:
        keys = self.keys.select(F.col(self.column).alias("_hot"))
        return df.join(keys, df[self.column].eqNullSafe(keys["_hot"]), how)

    def rest(self, df: DataFrame) -> DataFrame:
        return df if self.keys is None else self._join(df, "left_anti")

    def only(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_semi")


def find_hot(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> HotKeys:
    """Count the rows per key and write down those with more than ``hot_rows``."""
    counts = df.groupBy(column).count().where(F.col("count") > hot_rows)
    found = pinned(counts)
    rows = found.agg(F.sum("count")).first()[0]
    if rows is None:
        return HotKeys(column, None, 0)
    return HotKeys(column, found.select(column), rows // hot_rows + 1)


def _sliced(df: DataFrame, hot: HotKeys, groups: list[str], order: list[Column]) -> DataFrame:
    """Rows of the hot keys with their slice number.

    The bounds of the slices come from a sample, so the numbers are pinned:
    a second computation could cut elsewhere.
    """
    keyed = [F.col(name) for name in groups]
    ranged = hot.only(df).repartitionByRange(hot.slices, *keyed, *order)
    return pinned(ranged.withColumn(_SLICE, F.spark_partition_id()))


def _joined(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Each row with its slice's summary; null keys are equal to each other."""
    keyed = summary.withColumnsRenamed({name: f"_of_{name}" for name in by})
    same = reduce(and_, [df[name].eqNullSafe(keyed[f"_of_{name}"]) for name in by])
    return df.join(keyed, same).drop(*[f"_of_{name}" for name in by])


def with_previous(
    df: DataFrame, groups: list[str], order: list[str], value: str, hot: HotKeys
) -> DataFrame:
    """Add ``prev_value``, the value one row earlier in the group; null on the first row.

    The hot column is one of ``groups``. ``order`` must be unique in a group
    and ``value`` free of nulls.
    """

    def lagged(frame: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return frame.withColumn("prev_value", F.lag(value).over(window))

    # Partitioned by the one key, the window needs no shuffle of its own and
    # neither do later joins and sums by that key.
    usual = lagged(hot.rest(df).repartition(hot.column), groups)
    if hot.keys is None:
        return usual
    sliced = _sliced(df, hot, groups, [F.col(name) for name in order])
    by = [*groups, _SLICE]
    last = sliced.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*groups).orderBy(_SLICE))
    carried = last.select(*by, before.alias("_before"))
    rest = _joined(lagged(sliced, by), carried, by)
    rest = rest.withColumn("prev_value", F.coalesce("prev_value", "_before"))
    return usual.unionByName(rest.select(*usual.columns))


def with_position(
    df: DataFrame, groups: list[str], order: list[Column], hot: HotKeys
) -> DataFrame:
    """Add ``position``, counting a group's rows from 1 in the given order."""

    def numbered(frame: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return frame.withColumn("position", F.row_number().over(window).cast("long"))

    usual = numbered(hot.rest(df), groups)
    if hot.keys is None:
        return usual
    sliced = _sliced(df, hot, groups, order)
    by = [*groups, _SLICE]
    earlier = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*by).agg(F.count("*").alias("_rows"))
    offset = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    rest = _joined(numbered(sliced, by), sizes.select(*by, offset.alias("_offset")), by)
    rest = rest.withColumn("position", F.col("position") + F.col("_offset"))
    return usual.unionByName(rest.select(*usual.columns))


def lookup(df: DataFrame, side: DataFrame, hot: HotKeys, how: str = "left") -> DataFrame:
    """Join to ``side``, which has at most one row per key of the hot column.

    A null key finds nothing and never takes part in the join.
    """
    keyed = df.where(F.col(hot.column).isNotNull())
    joined = hot.rest(keyed).join(side, hot.column, how)
    if hot.keys is not None:
        # The side's rows of the hot keys are as few as those keys.
        joined = joined.unionByName(hot.only(keyed).join(hot.only(side), hot.column, how))
    if how == "left":
        unkeyed = df.where(F.col(hot.column).isNull())
        joined = joined.unionByName(unkeyed, allowMissingColumns=True)
    return joined


def with_global_position(df: DataFrame, order: list[Column], slices: int | None = None) -> DataFrame:
    """Add ``position``, counting all rows from 1 in the given order.

    Rows are cut into ranges of neighbours, numbered inside each and moved on by
    the rows of the ranges before; no task sees more than its range. The order
    must be total for the numbers to be the same every time.
    """
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    # The bounds come from a sample, so the slice numbers are pinned.
    sliced = pinned(ranged.withColumn(_SLICE, F.spark_partition_id()))
    sizes = sliced.groupBy(_SLICE).agg(F.count("*").alias("_rows"))
    # One row per slice.
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(_SLICE).alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    own = F.row_number().over(Window.partitionBy(_SLICE).orderBy(*order))
    numbered = sliced.withColumn("position", own.cast("long"))
    joined = numbered.join(offsets, F.col(_SLICE) == F.col("_of"))
    return joined.withColumn("position", F.col("position") + F.col("_offset")).select(*df.columns, "position")
