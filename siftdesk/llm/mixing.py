"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times that the mix should take it.
Among all rates from 0 to a cap that give each source its target of words,
those nearest to one (least sum of r log r - r) are exponentially tilted:
``r = min(cap, exp(tilt * size))`` with one tilt per source. The tilts maximise
a concave dual, or minimise its convex negative, whose gradient is what a
source's words still lack and whose curvature is a sum over documents. Newton
iterations find them; each is one distributed pass over counts per (source,
size), which say all that the rates depend on. Steps are taken on the logarithm
of the constraint and fall back to halving a bracket that is known to hold the
solution.

Rates become whole copies by comparing their fractions with a hash of the
document plus a shift per source and class of sizes. The shifts are read off a
histogram, large documents first: what they miss of their words is made up by
smaller ones, so a source misses its target by some words of its smallest
documents.

Sums that steer the iterations are of decimals, so the order in which tasks end
changes no digit, and reruns agree whatever the number of partitions. The table
of sources is a frame like any other: it is joined, not collected.

Defined results: a null or empty text has size zero, rate and copies one and
takes no words; null is a source of its own, the last one; rows that repeat are
rounded each for itself, in any order, as they are alike; an empty table gives
an empty result. A source as large as its target keeps each document once.
Columns other than id, text and source are not read.
"""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftdesk.operators.sequences import find_hot, with_position

from .common import empty_if_null, pinned, ship_package

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a target that may be missed by the rates, as a share of it.
TOLERANCE = 1e-9
ITERATIONS = 200

#: Fractions are compared as whole numbers of so many bits, in bins of so many.
_BITS, _FINE = 40, 28


def _exact(value: Column) -> Column:
    """A double of at most a few units as a decimal, whose sums have no order."""
    return value.cast("decimal(18,15)")


def sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, size, draw): the words of each text and a hash in [0, 2^40).

    The hash is of the row's values. Rows alike in all of them are numbered
    first, so that they draw apart; which of them draws what makes no difference.
    """
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), empty_if_null(text_col).alias("text")
    )
    rows = pinned(
        picked.select(
            "doc_id",
            "source",
            words.alias("size"),
            F.xxhash64("doc_id", F.col("source").isNull(), "source", "text").alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    numbered = with_position(rows, ["key"], [F.col("row")], find_hot(rows, "key"))
    draw = F.shiftrightunsigned(F.xxhash64("key", "position"), 64 - _BITS)
    return numbered.select("doc_id", "source", "size", draw.alias("draw"))


def source_targets(counts: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size, n).

    Sources in order of code points, null last, take the weights in turn. A
    target stops at ``cap`` times its source's size, and the others share what
    it leaves over.
    """
    totals = pinned(
        counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    )
    # Sources are far fewer than documents; their order is one sort of names.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    weighed = pinned(totals.withColumn("weight", weight.cast("long")))
    limit = F.col("source_size") * cap
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        open_ = limit > F.col("weight") * level if level else F.lit(True)
        row = weighed.agg(
            F.sum(F.when(~open_, limit)).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("open")
        ).first()
        # Filling a source only raises the level of the others.
        raised = (total - (row["full"] or 0)) / row["open"] if row["open"] else level
        if raised <= level:
            break
        level = raised
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null being one; what ``right`` adds comes last."""
    other = right.withColumnRenamed("source", "_source")
    same = left["source"].eqNullSafe(other["_source"])
    return left.join(other, same, how).drop("_source")


def rate(cap: int = CAP) -> Column:
    """The rate of a document from ``size`` and its source's ``tilt``, null where all are at the cap."""
    tilted = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size")))
    return F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(cap)).otherwise(tilted)


def tilts(counts: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, tilt): the solution of the dual, from (source, size, n)."""
    spans = counts.where("size > 0").groupBy("source").agg(
        F.min("size").alias("smallest"), F.max("size").alias("largest")
    )
    ratio = F.col("target") / F.col("source_size")
    state = _same_source(targets.where("source_size > 0"), spans).select(
        "source",
        "source_size",
        "target",
        # With all documents at the cap there is nothing to solve.
        (F.col("target") >= F.col("source_size") * cap).alias("full"),
        F.lit(0.0).alias("tilt"),
        # A lower rate of the smallest, or the cap for it, bounds the tilt.
        F.when(ratio < 1, F.log(ratio) / F.col("smallest")).otherwise(0.0).alias("low"),
        F.when(ratio > 1, F.log(F.lit(float(cap))) / F.col("smallest")).otherwise(0.0).alias("high"),
        F.lit(False).alias("done"),
    )
    state = pinned(state)
    for _ in range(ITERATIONS):
        moving = state.where("not full and not done")
        if moving.isEmpty():
            break
        terms = _same_source(counts.where("size > 0"), moving.select("source", "tilt", "source_size"))
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        share = F.col("size") * F.col("tilt")
        slope = F.when(share < F.log(F.lit(float(cap))), rate(cap) * F.col("size") / F.col("source_size"))
        sums = terms.groupBy("source").agg(
            F.sum(words * _exact(rate(cap))).cast("double").alias("got"),
            F.sum(words * _exact(F.coalesce(slope, F.lit(0.0)))).cast("double").alias("slope"),
        )
        gap = F.log(F.col("got") / F.col("target"))
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        # d log(got) / d tilt = slope / got, of which source_size was taken out.
        step = gap * F.col("got") / (F.col("slope") * F.col("source_size"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - step)
        inside = (newton > F.col("lower")) & (newton < F.col("upper"))
        middle = (F.col("lower") + F.col("upper")) / 2
        met = (F.abs(gap) <= tolerance) | (F.col("upper") - F.col("lower") <= F.abs(middle) * 1e-15)
        moved = (
            _same_source(state, sums, "left")
            .withColumns({"lower": F.coalesce(low, "low"), "upper": F.coalesce(high, "high")})
            .withColumn("met", F.col("done") | F.coalesce(met, F.lit(False)))
        )
        stays = F.col("got").isNull() | F.col("met")
        tilt = F.when(stays, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(middle))
        state = pinned(
            moved.select(
                "source", "source_size", "target", "full", tilt.alias("tilt"),
                F.col("lower").alias("low"), F.col("upper").alias("high"), F.col("met").alias("done"),
            )
        )
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def size_class() -> Column:
    """Sizes within a factor of two, by their number of binary digits."""
    return F.length(F.bin("size"))


def _choose_shifts(source_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One source's shifts per class, from (source, class, bin, words, wanted).

    Large documents come first. What a class takes too much or too little is
    made up by the next, smaller ones.
    """
    table = pa.Table.from_batches(source_rows)
    source = table.column("source")[0]
    kind, bins, words = (table.column(c).to_numpy() for c in ("class", "bin", "words"))
    wanted = [Decimal(x) for x in table.column("wanted").to_pylist()]
    made, carry = [], Decimal(0)
    for one in sorted(set(kind.tolist()), reverse=True):
        at = np.flatnonzero(kind == one)
        at = at[np.argsort(bins[at])]
        need = carry + sum(wanted[i] for i in at.tolist())
        summed = [0, *np.cumsum(words[at]).tolist()]
        cut = min(range(len(summed)), key=lambda i: (abs(summed[i] - need), i))
        edge = int(bins[at[cut - 1]]) + 1 if cut else int(bins[at[0]])
        made.append((one, edge << _FINE))
        carry = need - summed[cut]
    columns = [pa.array([source.as_py()] * len(made), pa.string())]
    columns += [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["source", "class", "shift"])


def shifts(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, class, shift): rows whose ``distance`` is below it take one copy more.

    ``rated`` has source, size, rate, whole (the rate rounded down) and distance
    (the hash less the rate's fraction, in units of 2^-40). A source has at most
    some forty classes of 8192 bins, whatever its number of documents.
    """
    ship_package(rated.sparkSession)
    free = rated.where((F.col("whole") < cap) & (F.col("size") > 0))
    part = F.col("size").cast("decimal(20,0)") * _exact(F.col("rate") - F.col("whole"))
    binned = free.groupBy(
        F.col("source").cast("string").alias("source"),
        size_class().alias("class"),
        F.shiftright("distance", _FINE).alias("bin"),
    ).agg(F.sum("size").alias("words"), F.sum(part).cast("string").alias("wanted"))
    return binned.groupBy("source").applyInArrow(_choose_shifts, "source string, class int, shift long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken.

    The texts are read once; all that follows works on the written sizes.
    """
    rows = pinned(sizes(docs, id_col, text_col, source_col))
    counts = pinned(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = pinned(source_targets(counts, weights, cap))
    solved = pinned(_same_source(targets, tilts(counts, targets, cap), "left"))
    rated = _same_source(rows, solved).withColumn("rate", rate(cap))
    fraction = F.col("rate") - F.floor("rate")
    rated = rated.withColumns(
        {
            "whole": F.floor("rate"),
            "distance": F.col("draw") - F.floor(fraction * float(1 << _BITS)),
        }
    )
    shifted = pinned(shifts(rated, cap))
    own = rated.withColumn("class", size_class())
    at = shifted.toDF("_source", "_class", "shift")
    same = own["source"].cast("string").eqNullSafe(at["_source"]) & (own["class"] == at["_class"])
    decided = own.join(at, same, "left")
    more = (F.col("distance") < F.col("shift")) & (F.col("whole") < cap) & (F.col("size") > 0)
    copies = F.col("whole") + F.coalesce(more.cast("long"), F.lit(0))
    return decided.withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
