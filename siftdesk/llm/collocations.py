"""Phrase collocation mining over counting quotient filters.

A phrase of two to four words counts where its words follow each other within a
piece of a text. Word numbers make phrases small: every task cuts its texts into
parts of some million words and writes each as numbers of its own, with the
words behind them. Counted over all parts, words that are too rare for any
phrase drop out (a phrase is no more frequent than its words); the others get
numbers that hold everywhere, and those of each part travel to it by a join. No
dictionary is broadcast.

Each part packs its phrases and counts them in one counting quotient filter per
phrase length (see ``quotient_filter``), cut into slices by the top bits of the
mixed phrase. Mixed bits are even, so no slice is large because a phrase is
common. Slices of up to 256 parts meet in a group and are merged in order; with
more parts, merged filters are cut finer and merged again, so a group has a
bounded number of slices and entries at any size of the input.

Defined results: a null or empty text has no words; a null language counts as
``und``; rows that repeat count each for itself; an empty table gives no rows.
Only the text and the language are read, whatever other columns there are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import empty_if_null, map_texts, pinned, ship_package
from .quotient_filter import Counts, Layout, counted, cut, decode, encode, merge

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
COVER = 80
NO_LANGUAGE = "und"

#: Words of a part, and parts whose filters meet in one merge.
PART_WORDS = 1 << 20
FAN = 256
#: Bytes of a text that are split at once.
SLICE = 1 << 22

#: A byte that no UTF-8 text holds marks where a piece ends.
_BREAK = b"\xff"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(
    0xFF if b in _ENDS else 0x20 if b == 0x09 else b | 0x20 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and marks of piece ends of a text, some megabytes at a time."""
    plain = text.translate(_PLAIN)
    start = 0
    while start < len(plain):
        end = start + SLICE
        if end < len(plain):
            # A slice ends before white space, or before the next one there is.
            found = max(plain.rfind(b" ", start + 1, end), plain.rfind(_BREAK, start + 1, end))
            if found < 0:
                after = [at for at in (plain.find(b" ", end), plain.find(_BREAK, end)) if at >= 0]
                found = min(after, default=len(plain))
            end = found
        yield plain[start:end].replace(_BREAK, b" \xff ").split()
        start = end


class Part:
    """Words of a stretch of texts, numbered from one; zero ends a piece.

    The first ``skip`` words stand in the part before and are only there for
    phrases that go on.
    """

    def __init__(self, held: list[tuple[str, bytes]]):
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = []
        self.ids: list[np.ndarray] = []
        self.skip = self.size = len(held)
        for language, word in held:
            self.ids.append(np.array([self._number(language, word)], np.uint32))

    def _number(self, language: str, word: bytes) -> int:
        known = self.numbers.setdefault(language, {_BREAK: 0})
        if word not in known:
            self.words.append((language, word))
            known[word] = len(self.words)
        return known[word]

    def add(self, language: str, some: list[bytes]) -> None:
        known = self.numbers.setdefault(language, {_BREAK: 0})
        for word in set(some).difference(known):
            self.words.append((language, word))
            known[word] = len(self.words)
        self.ids.append(np.fromiter(map(known.__getitem__, some), np.uint32, len(some)))
        self.size += len(some)

    def rows(self, number: int) -> Iterator[tuple]:
        """(part, language, word, local, n, skip, ids): one row of numbers, then one per word."""
        ids = np.concatenate(self.ids)
        # All lowest bytes first: the highest are zeros and vanish when compressed.
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
        yield number, None, None, None, None, self.skip, planes.tobytes()
        n = np.bincount(ids[self.skip :], minlength=len(self.words) + 1).tolist()
        for local, (language, word) in enumerate(self.words, 1):
            yield number, language, word, local, n[local], None, None


def parts(docs: DataFrame, lang_col: str, text_col: str, part_words: int = PART_WORDS) -> DataFrame:
    """The texts as numbered words, see ``Part.rows``."""
    picked = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        empty_if_null(text_col).alias("text"),
    )

    def work(rows):
        number, part = TaskContext.get().partitionId() << 32, Part([])
        for language, text in rows:
            for some in tokens(text):
                # A long slice fills several parts; the last words go along.
                for start in range(0, len(some), part_words):
                    piece = some[start : start + part_words]
                    part.add(language, piece)
                    if part.size >= part_words:
                        yield from part.rows(number)
                        number += 1
                        part = Part([(language, w) for w in tail(part, language)])
            part.add(language, [_BREAK])
        if part.size > part.skip:
            yield from part.rows(number)

    schema = "part long, lang string, word binary, local long, n long, skip int, ids binary"
    return map_texts(picked, work, schema, texts=("text",), rows=20_000)


def tail(part: Part, language: str) -> list[bytes]:
    """The words since the last end of a piece, three at most."""
    last = np.concatenate(part.ids[-MAX_WORDS:])[1 - MAX_WORDS :].tolist()
    for i in reversed(range(len(last))):
        if last[i] == 0:
            last = last[i + 1 :]
            break
    return [part.words[number - 1][1] for number in last]


def numbered(frame: DataFrame, name: str) -> DataFrame:
    """Rows with numbers from one, without gaps and without sorting them."""
    rows = pinned(frame.withColumn("_at", F.monotonically_increasing_id()))
    place = F.shiftright("_at", 33)
    sizes = rows.groupBy(place.alias("_place")).agg(F.count("*").alias("_rows"))
    # One row per partition of the frame.
    before = F.sum("_rows").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_place", F.coalesce(before, F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    found = rows.join(offsets, place == F.col("_place"))
    return found.select(*frame.columns, (F.col("_offset") + within + 1).alias(name))


def _slices(layout: Layout, some: Counts, top: int) -> Iterator[tuple]:
    for bucket, entries in cut(layout, some, top):
        yield layout.words, bucket, encode(layout, entries, top)


def count_part(numbers: np.ndarray, skip: int, width: int, longest: int) -> Iterator[tuple[Layout, Counts]]:
    """Counts of a part's phrases; a phrase counts in the part that holds its last word."""
    for words in range(2, longest + 1):
        layout = Layout(words, width)
        starts = len(numbers) - words + 1
        columns = [numbers[max(0, skip - words + 1) + i : starts + i] for i in range(words)]
        whole = np.logical_and.reduce([column > 0 for column in columns])
        sides = layout.pack([column[whole] for column in columns])
        del whole, columns
        sides = layout.permute(*sides)
        yield layout, counted(layout, *sides)


def phrase_counts(
    written: DataFrame,
    words: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = MAX_WORDS,
    fan: int = FAN,
) -> DataFrame:
    """(w1, w2, w3, w4, f): numbers of the words of frequent phrases, zero behind them.

    ``written`` is what ``parts`` gives and ``words`` has lang, word, number.
    """
    ship_package(written.sparkSession)
    width = max(16, (words.agg(F.max("number")).first()[0] or 0).bit_length())
    if width > 32:
        raise ValueError("more than 2^32 frequent words")
    shards = written.where("ids is not null").count()
    #: Slices are cut by so many bits more before each merge.
    bits = max(1, (min(fan, 256) - 1).bit_length())
    schema = "words int, bucket long, shard long, entries binary"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["words", "bucket", "shard", "entries"]
        )

    def count(given: pa.Table, known: pa.Table) -> pa.Table:
        made = []
        local = known.column("local").to_numpy()
        lookup = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
        lookup[local] = known.column("number").to_numpy()
        for part, skip, ids in zip(*[given.column(c).to_pylist() for c in ("part", "skip", "ids")]):
            numbers = np.frombuffer(ids, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)
            # Words behind the last frequent one have no place in the look-up.
            numbers = lookup[np.where(numbers < len(lookup), numbers, 0)]
            for layout, found in count_part(numbers, skip, width, longest):
                made += [(words, bucket, part, entries) for words, bucket, entries in _slices(layout, found, bits)]
        table = pa.Table.from_batches([batch(made)])
        # The worker goes on to other groups; what Arrow has freed is given back.
        pa.default_memory_pool().release_unused()
        return table

    ids = written.where("ids is not null").select("part", "skip", "ids")
    local = (
        written.where("word is not null")
        .select("part", "lang", F.col("word").cast("string").alias("word"), "local")
        .join(words.select("lang", "word", "number"), ["lang", "word"])
        .select(F.col("part").alias("of_part"), "local", "number")
    )
    filters = ids.groupBy("part").cogroup(local.groupBy("of_part")).applyInArrow(count, schema)
    filters = filters.withColumn("shard", F.xxhash64("shard"))

    def merging(top: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            length, bucket, shard = (table.column(c)[0].as_py() for c in ("words", "bucket", "shard"))
            layout = Layout(length, width)
            pa.default_memory_pool().release_unused()
            held = [decode(layout, data, top, bucket) for data in table.column("entries").to_pylist()]
            all_ = merge(layout, held)
            if not last:
                finer = min(top + bits, width)
                return pa.Table.from_batches(
                    [batch([(w, b, shard, e) for w, b, e in _slices(layout, all_, finer)])]
                )
            often = all_.n >= min_count
            columns = layout.unpack(*layout.restore(all_.left[often], all_.right[often]))
            columns += [np.zeros(int(often.sum()), np.uint64)] * (MAX_WORDS - length)
            columns.append(all_.n[often])
            return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns)})

        return run

    names = ["w1", "w2", "w3", "w4", "f"]
    top = bits
    while True:
        shards = max(1, -(-shards // fan))
        last = shards == 1
        grouped = filters.withColumn("shard", F.pmod("shard", F.lit(shards))).groupBy("words", "bucket", "shard")
        out = ", ".join(f"{name} long" for name in names) if last else schema
        filters = grouped.applyInArrow(merging(top, last), out)
        if last:
            return filters
        top = min(top + bits, width)


def _phrase(*columns: str) -> Column:
    return F.filter(F.array(*columns), lambda w: w > 0)


def scored(phrases: DataFrame, words: DataFrame, scale: int = SCALE) -> DataFrame:
    """(phrase, a, l, r, score): every phrase at its lowest-scoring cut.

    ``phrases`` has (phrase, f), the phrase as a list of word numbers; ``words``
    has (number, n). All parts of a frequent phrase are as frequent, so the joins
    find them all.
    """
    known = phrases.unionByName(words.select(F.array("number").alias("phrase"), F.col("n").alias("f")))
    cuts = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns(
        {
            "head": F.slice("phrase", F.lit(1), F.col("k")),
            "rest": F.slice("phrase", F.col("k") + 1, F.size("phrase")),
        }
    )
    heads = known.select(F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = known.select(F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(
        f"cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))"
        " div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    )
    joined = cuts.join(heads, "head").join(rests, "rest").withColumn("score", score)
    lowest = joined.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """(phrase): those that mostly stand inside one longer phrase."""
    inner = [
        F.when(F.size("phrase") >= start + length, F.slice("phrase", start + 1, length))
        for length in range(2, MAX_WORDS)
        for start in range(0, MAX_WORDS - length + 1)
    ]
    whole = F.col("phrase")
    parts_of = F.filter(F.array(*inner), lambda p: p.isNotNull() & (F.size(p) < F.size(whole)))
    longer = (
        phrases.select(F.explode(parts_of).alias("phrase"), F.col("f").alias("outer_f"))
        .groupBy("phrase")
        .agg(F.max("outer_f").alias("outer_f"))
    )
    f, outer = (F.col(c).cast("decimal(20,0)") for c in ("f", "outer_f"))
    return phrases.join(longer, "phrase").where(outer * 100 >= f * cover).select("phrase")


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    part_words: int = PART_WORDS,
    fan: int = FAN,
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    written = pinned(parts(docs, lang_col, text_col, part_words))
    totals = pinned(
        written.where("word is not null")
        .groupBy("lang", F.col("word").cast("string").alias("word"))
        .agg(F.sum("n").alias("n"))
    )
    sizes = totals.groupBy("lang").agg(F.sum("n").alias("all_words"))
    words = pinned(numbered(totals.where(F.col("n") >= min_count), "number"))
    found = phrase_counts(written, words, min_count, fan=fan)
    phrases = pinned(found.select(_phrase("w1", "w2", "w3", "w4").alias("phrase"), "f"))
    kept = scored(phrases, words).join(covered(phrases), "phrase", "left_anti")
    spelled = kept.select("*", F.posexplode("phrase").alias("place", "number")).join(words.select("number", "lang", "word"), "number")
    listed = spelled.groupBy("phrase", "a", "l", "r", "score").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("listed")
    )
    text = F.array_join(F.transform("listed", lambda w: w["word"]), " ")
    ranked = pinned(listed.select("lang", text.alias("phrase"), "a", "l", "r", "score"))
    # The best of all are among the best of each share of the phrases.
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    for shares in (1024, 32, 1):
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        order = Window.partitionBy("lang", "share").orderBy(*best)
        ranked = ranked.withColumn("share", share).withColumn("rank", F.row_number().over(order).cast("long"))
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score"
    )
