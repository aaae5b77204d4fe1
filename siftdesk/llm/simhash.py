"""SimHash near-duplicates by a tiled exact comparison.

Fingerprints: a text is lower-cased in A-Z and split at ASCII white space; each
shingle of consecutive words is hashed by XXH64 (seed 42, UTF-8), and a bit of
the fingerprint is set if it is set in over half the hashes. Texts with fewer
words have one shingle; texts without words have fingerprint zero.

Links: distinct fingerprints are range-sorted by the population counts of their
halves and quarters and cut into tiles. Two fingerprints within the radius
differ by at most the radius in every population count, so a tile is compared
only with the tiles whose counts reach that far. Inside a pair of tiles the same
test on quarters skips blocks, and the rest is compared exactly by numpy:
exclusive-or, bit count, threshold. A pair of tiles gives back a spanning
forest of its links, at most one row per fingerprint, never all links, and no
connection is lost by that.

Components: the forests are merged in rounds. A fingerprint with several parents
keeps the smallest and links the others to it; after the last round paths are
halved until they end in roots. Each round is written to the shared folder.

The comparisons grow with the square of the distinct fingerprints by the nature
of the method; equal texts cost nothing extra, as they share a fingerprint.

Defined results: a null text is empty; all texts without words are one
component; rows that repeat an id are equal to each other by fingerprint; a
null id is never the smallest, unless the component has no other (then null);
an empty table gives an empty result. Other columns are not read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_texts, pinned, shuffle_partitions

WORDS = 4
RADIUS = 4
TILE = 1 << 15
BLOCK = 256
PIECE = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a UTF-8 text, unsigned."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][words - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        octets = hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs, one row per input row.

    The columns in ``also`` stand between the two.
    """
    names = ["doc_id", *also]
    kinds = ", ".join(f"{name} {docs.schema[name].dataType.simpleString()}" for name in names)

    def work(rows):
        for *own, text in rows:
            fp = fingerprint(text, words)
            yield *own, fp - (1 << 64) if fp >> 63 else fp

    return map_texts(docs.select(*names, "text"), work, f"{kinds}, fp long")


def _ones(low: int, width: int) -> Column:
    mask = (1 << width) - 1
    return F.bit_count(F.shiftright("fp", low).bitwiseAND(F.lit(mask)))


def tiles(distinct: DataFrame, count: int, tile: int = TILE) -> DataFrame:
    """(tile, low, high, fps): sorted fingerprints and the range of their counts.

    A tile is a partition of the range sort, so tiles are numbered in the order
    of the upper half's population count.
    """
    order = [_ones(32, 32), _ones(0, 32), _ones(48, 16), _ones(16, 16), F.col("fp")]
    ranged = distinct.select("fp").repartitionByRange(max(1, -(-count // tile)), *order)

    def gather(batches):
        fps = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if fps:
            held = sort_by_counts(np.concatenate(fps).astype(np.int64).view(np.uint64))
            upper = np.bitwise_count(held >> np.uint64(32))
            yield pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([TaskContext.get().partitionId()], pa.int64()),
                    "low": pa.array([int(upper.min())], pa.int32()),
                    "high": pa.array([int(upper.max())], pa.int32()),
                    "fps": pa.array([held.tobytes()], pa.binary()),
                }
            )

    return ranged.mapInArrow(gather, "tile long, low int, high int, fps binary")


def quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, a row each, as int16."""
    return np.bitwise_count(fps.view(np.uint16)).reshape(-1, 4).astype(np.int16)


def sort_by_counts(fps: np.ndarray) -> np.ndarray:
    q = quarters(fps)
    order = np.lexsort((fps, q[:, 1], q[:, 3], q[:, 0] + q[:, 1], q[:, 2] + q[:, 3]))
    return fps[order]


def components(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..size-1 under the given links: the smallest node reachable."""
    label = np.arange(size)
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def forest(first: np.ndarray, second: np.ndarray | None, radius: int, block: int = BLOCK):
    """(child, parent) fingerprints: a spanning forest of the links within the
    radius between two tiles, or inside one where ``second`` is None."""
    own = second is None
    second = first if own else second
    ends = [np.minimum(np.arange(0, len(x), block) + block, len(x)) for x in (first, second)]
    boxes = []
    for x in (first, second):
        q, at = quarters(x), np.arange(0, len(x), block)
        boxes.append((np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)))
    (low_a, high_a), (low_b, high_b) = boxes
    apart = np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None])
    near = np.maximum(apart, 0).sum(axis=2) <= radius
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    base = 0 if own else len(first)
    size = base + len(second)

    def settle() -> None:
        nonlocal held
        label = components(size, np.concatenate(left), np.concatenate(right))
        child = np.flatnonzero(label != np.arange(size))
        left[:], right[:] = [child], [label[child]]
        held = 0

    for i, j in zip(*np.nonzero(near)):
        if own and j < i:
            continue
        a0, b0 = i * block, j * block
        a, b = first[a0 : ends[0][i]], second[b0 : ends[1][j]]
        close = np.bitwise_count(a[:, None] ^ b[None]) <= radius
        if own and i == j:
            close &= ~np.eye(len(a), dtype=bool)
        if not close.any():
            continue
        u, v = np.nonzero(close)
        if len(u) > 4 * block:  # many links between few: keep a forest of them
            label = components(len(a) + len(b), u, v + len(a))
            child = np.flatnonzero(label != np.arange(len(label)))
            both = np.concatenate([np.arange(len(a)) + a0, np.arange(len(b)) + b0 + base])
            u, v = both[child], both[label[child]]
        else:
            u, v = u + a0, v + b0 + base
        left.append(u)
        right.append(v)
        held += len(u)
        if held > 2_000_000:
            settle()
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    settle()
    fps = (first if own else np.concatenate([first, second])).view(np.int64)
    child, root = left[0], right[0]
    smallest = fps.copy()
    np.minimum.at(smallest, root, fps[child])
    parent = smallest[root]
    # The first node of a component need not be its smallest fingerprint.
    heads = np.unique(root)
    child = np.concatenate([fps[child], fps[heads]])
    parent = np.concatenate([parent, smallest[heads]])
    return child[child != parent], parent[child != parent]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(child, parent): forests that connect what lies within the radius."""
    spark = distinct.sparkSession
    made = pinned(tiles(distinct, distinct.count(), tile))
    # At most 33 counts of an upper half exist.
    reach = (
        made.select("tile", F.explode(F.sequence("low", "high")).alias("ones"))
        .groupBy("ones")
        .agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
        .collect()
    )
    first, last = [0] * 33, [-1] * 33
    for ones in range(33):
        first[ones] = min((r["first"] for r in reach if r["ones"] >= ones), default=0)
        last[ones] = max((r["last"] for r in reach if r["ones"] <= ones), default=-1)

    def looked_up(values: list[int], at: Column) -> Column:
        bounded = F.greatest(F.lit(0), F.least(F.lit(32), at))
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), bounded + 1)

    # Both tiles of a pair come to the pair: (a, b) with a >= b.
    before = made.select(
        F.col("tile").alias("a"),
        F.explode(
            F.sequence(looked_up(first, F.col("low") - radius), F.col("tile"))
        ).alias("b"),
        "tile",
        "fps",
    )
    after = made.select("tile", "fps", looked_up(last, F.col("high") + radius).alias("end")).where(
        F.col("end") > F.col("tile")
    )
    after = after.select(
        F.explode(F.sequence(F.col("tile") + 1, F.col("end"))).alias("a"),
        F.col("tile").alias("b"),
        "tile",
        "fps",
    )
    pairs = before.unionByName(after).repartition(4 * shuffle_partitions(spark), "a", "b")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(x, np.uint64) for x in frame["fps"]]
        own = frame["a"].iloc[0] == frame["b"].iloc[0]
        if not own and len(found) < 2:  # the other tile number has no rows
            return pd.DataFrame({"child": [], "parent": []}, dtype="int64")
        child, parent = forest(found[0], None if own else found[1], radius)
        return pd.DataFrame({"child": child, "parent": parent})

    return pairs.groupBy("a", "b").applyInPandas(compare, "child long, parent long")


def roots(edges: DataFrame) -> DataFrame:
    """(fp, root): for each fingerprint that is a child, its component's smallest."""
    edges = pinned(edges.distinct())
    while True:
        tree = pinned(edges.groupBy("child").agg(F.min("parent").alias("parent")))
        other = edges.join(tree.withColumnRenamed("parent", "least"), "child").where(
            F.col("parent") != F.col("least")
        )
        other = pinned(
            other.select(F.col("parent").alias("child"), F.col("least").alias("parent")).distinct()
        )
        if other.isEmpty():
            break
        edges = pinned(tree.unionByName(other).distinct())
    while True:
        up = tree.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = pinned(
            tree.join(up, "parent", "left").select(
                "child",
                F.coalesce("above", "parent").alias("parent"),
                F.col("above").isNotNull().alias("moved"),
            )
        )
        tree = jumped.select("child", "parent")
        if jumped.where("moved").isEmpty():
            return tree.select(F.col("child").alias("fp"), F.col("parent").alias("root"))


def with_roots(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``distinct``, a row per fingerprint, with the root of its component."""
    tree = roots(links(distinct, radius, tile))
    heads = tree.select(F.col("root").alias("fp"), "root").distinct()
    members = tree.unionByName(heads)
    return pinned(
        distinct.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs`` (doc_id, text)."""
    rows = pinned(fingerprints(docs, words))
    distinct = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    known = with_roots(distinct, radius, tile)
    smallest = pinned(known.groupBy("root").agg(F.min("first").alias("component_id")))
    named = pinned(known.join(smallest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keepers(
    docs: DataFrame, row: str, words: int = WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(row): of each component one row of ``docs`` (doc_id, text and ``row``).

    It is the one with the smallest doc_id, any id being before null; of several
    that with the smallest fingerprint, then the smallest ``row``, a column that
    must be written with ``docs`` and differ in every row.
    """
    rows = fingerprints(docs, words, also=(row,))
    # Nulls come first among structs.
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", row)
    distinct = pinned(rows.groupBy("fp").agg(F.min(best).alias("best")))
    known = with_roots(distinct, radius, tile)
    return known.groupBy("root").agg(F.min("best").alias("best")).select(F.col(f"best.{row}"))
