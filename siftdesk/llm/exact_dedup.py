"""Exact deduplication with a heavy-hitter split.

Texts are equal when their SHA-256 over UTF-8 after lower-casing A-Z is equal.
One Misra-Gries summary per task finds the digests that can hold more than a
small share of all rows. A second pass counts these candidates exactly and
picks their winners, which are broadcast: rows of frequent digests are decided
map-side and never meet in one task. All other digests take
an ordinary shuffle: they are summed by task and by digest, and joined back.

The summaries keep ``counters`` entries per task. An entry's count is below the
true one by n / (counters + 1) at most, n being all rows, and the counts of all
entries sum to n at most. So at most ``counters`` + 1 digests reach
n / (counters + 1), which bounds the broadcast at any size of the input, and
every digest with 2n / (counters + 1) rows is among them.

Defined results: a null text counts as empty; of equal texts the row with the
largest id stays, a null id being the smallest; of rows that repeat an id and a
text exactly one stays; an empty table gives an empty result. Other columns are
not read by ``mark`` and pass through ``dedup`` whatever their names are.
"""

import hashlib
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import pinned, ship_package, utf8

COUNTERS = 1000


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each text, A-Z lower-cased, as 32 bytes."""
    ship_package(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def digest(batches):
        for batch in batches:
            sums = [hashlib.sha256(t.lower()).digest() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.binary())], ["doc_id", "digest"]
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(digest, f"doc_id {kind}, digest binary")


def misra_gries(frame: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(column, estimate): a summary of ``counters`` entries per task, summed.

    A task merges the value counts of a batch into its summary, then lowers
    every entry by the (counters + 1)-th largest count and drops what reaches
    zero, which is the mergeable form of the Misra-Gries step.
    """

    def summarise(batches):
        held: dict = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            [column, "estimate"],
        )

    parts = frame.select(column).mapInArrow(summarise, f"{column} binary, estimate long")
    return parts.groupBy(column).agg(F.sum("estimate").alias("estimate"))


def mark(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept.

    The digests are written to the shared folder with a row number each, so the
    texts are read once and repeated rows can be told apart.
    """
    rows = pinned(
        text_digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    )
    total = rows.count()
    candidates = (
        misra_gries(rows, "digest", counters)
        .where(F.col("estimate") * (counters + 1) >= total)
        .select("digest")
    )
    best = F.max(F.struct("doc_id", "row"))
    winners = pinned(
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
    )
    frequent = rows.join(F.broadcast(winners), "digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Summed by task first: a digest just too rare for the summaries still has many rows.
    groups = others.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    rest = others.join(groups, "digest")
    return frequent.select(rest.columns).unionByName(rest).select(
        "doc_id",
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """``docs`` without the rows that lose, all columns as they were.

    Rows that repeat both id and text differ at most in other columns; any one
    of them stays.
    """
    kept = (
        mark(docs, id_col, text_col, counters)
        .where("kept")
        .select(F.col("doc_id").alias("kept_id"), F.lower(F.hex("digest")).alias("kept_sha"))
    )
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    lowered = F.translate(
        F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit("")),
        string.ascii_uppercase,
        string.ascii_lowercase,
    )
    key = F.col(f"c{names.index(id_col)}")
    marked = plain.withColumns({"own_id": key, "own_sha": F.sha2(lowered, 256)})
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha"))
    return (
        marked.join(kept, same, "left_semi")
        .dropDuplicates(["own_id", "own_sha"])
        .select(*plain.columns)
        .toDF(*names)
    )
