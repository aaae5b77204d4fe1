"""Packing documents into fixed-length token sequences.

Every document's ids, with the end id behind them, are cut into full sequences
and one remainder. Pieces go to randomised groups of some 2000 pieces, so a
group is bounded whatever the input holds: the number of groups follows the
number of rows and bytes, and a piece's group depends on its place in the input
alone, never on a key. In each group the pieces are packed first-fit
decreasing. A tournament tree over the bins' free space finds the first bin
with room in logarithmic time. Bins that stay notably short are topped up by
cutting the pieces of the emptiest ones, which leaves about one short bin a
group.

Each id lies in exactly one piece. A null text is empty and has the end id
only. Rows that repeat are packed each for itself; a null doc_id stays null; an
empty table gives no pieces. Other columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batches, empty_if_null, map_texts
from .tokens import encoder, library_words, word_bpe_path
from .tokens import pack as packed_ids

LENGTH = 4096
END_ID = 2
GROUP_PIECES = 2048
SLACK = 16


class FreeSpace:
    """A tournament tree of the bins' free space: each node holds its larger child."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(1, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; the bin's number."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        bin_number = node - self.leaves
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return bin_number


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``, which come in descending order."""
    space = FreeSpace(len(sizes), capacity)
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = space.place(size)
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def padding(used: int, length: int = LENGTH) -> int:
    """Tokens of padding that a sequence of ``used`` ids takes."""
    return 0 if used & (used - 1) == 0 else length - used


def top_up(bins: list[list[tuple]], length: int, slack: int) -> list[list[tuple]]:
    """Fill bins short by more than ``slack`` from the emptiest bins.

    A bin is a list of (piece, from, to); a piece is cut where the gap is full.
    """
    used = [sum(b - a for _, a, b in parts) for parts in bins]
    short = [i for i in range(len(bins)) if padding(used[i], length) > slack]
    short.sort(key=lambda i: (-used[i], i))
    first, last = 0, len(short) - 1
    while first < last:
        to, source = short[first], short[last]
        gap = length - used[to]
        while gap and bins[source]:
            piece, a, b = bins[source].pop()
            take = min(gap, b - a)
            bins[to].append((piece, a, a + take))
            if take < b - a:
                bins[source].append((piece, a + take, b))
            gap -= take
            used[source] -= take
            used[to] += take
        if not bins[source]:
            last -= 1
        if not gap:
            first += 1
    return [parts for parts in bins if parts]


def pieces(docs: DataFrame, groups: int, path: str, length: int, end_id: int) -> DataFrame:
    """(group, doc_id, start, doc_tokens, ids): full sequences and remainders."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows):
        encode = encoder(path, "library", library_words).encode
        place, number, end = TaskContext.get().partitionId(), 0, packed_ids([end_id])
        for some in batches(rows, texts=4096):
            for (doc_id, _), ids in zip(some, encode([text for _, text in some])):
                ids += end
                size = len(ids) // 4
                for start in range(0, size, length):
                    group = zlib.crc32(f"{place}:{number}".encode()) % groups
                    number += 1
                    yield group, doc_id, start, size, ids[4 * start : 4 * (start + length)]

    schema = f"group long, doc_id {kind}, start long, doc_tokens long, ids binary"
    return map_texts(docs, work, schema, rows=1000)


def pack(
    docs: DataFrame,
    path: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    slack: int = SLACK,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text. ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit integers. Sequence ids are unique; offsets of
    a sequence have no gaps.
    """
    path = path or word_bpe_path()
    docs = docs.select("doc_id", "text")
    size = docs.agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(empty_if_null("text"))).alias("bytes")
    ).first()
    # About four bytes make a token here; more tokens only make groups larger.
    expected = size["rows"] + (size["bytes"] or 0) // (4 * length)
    groups = max(1, -(-expected // group_pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )

    def pack_group(table: pa.Table) -> pa.Table:
        ids, starts = table.column("ids").to_pylist(), table.column("start").to_pylist()
        # As Python values, long ids stay whole beside a null.
        docs_of = table.column("doc_id").to_pylist()
        # The order of arrival is not fixed; a full order makes reruns equal.
        order = sorted(
            range(len(ids)),
            key=lambda i: (
                -len(ids[i]),
                docs_of[i] is not None,
                0 if docs_of[i] is None else docs_of[i],
                starts[i],
                zlib.crc32(ids[i]),
            ),
        )
        sizes = [len(ids[i]) // 4 for i in order]
        bins = [[(i, 0, sizes[i]) for i in one] for one in first_fit_decreasing(sizes, length)]
        bins = top_up(bins, length, slack)
        rows = [(order[i], a, b, n) for n, one in enumerate(bins) for i, a, b in one]
        at, a, b, n = (np.array(c, dtype=np.int64) for c in zip(*rows))
        taken = b - a
        before = np.cumsum(taken) - taken
        firsts = np.flatnonzero(np.diff(n, prepend=-1))
        offset = before - np.repeat(before[firsts], np.diff(firsts, append=len(n)))
        places = pa.array(at)
        group = table.column("group")[0].as_py()
        columns = {
            "doc_id": table.column("doc_id").take(places),
            "start": pa.array(np.array(starts, dtype=np.int64)[at] + a),
            "length": pa.array(taken),
            "ids": pa.array([ids[i][4 * x : 4 * y] for i, x, y, _ in rows], pa.binary()),
            "doc_tokens": table.column("doc_tokens").take(places),
            "sequence_id": pa.array((group << 32) + n),
            "offset": pa.array(offset),
        }
        return pa.table(columns)

    cut = pieces(docs, groups, path, length, end_id)
    return cut.groupBy("group").applyInArrow(pack_group, schema)
