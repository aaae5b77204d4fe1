"""Grouping of spelling variants by pivotal grams.

Words one edit apart (one code point inserted, deleted or replaced) are found
without comparing all words. Every word's bigrams are put in one global order,
rare ones first. Its *prefix* are the first three bigrams in that order, with
all further places of the third one. Its *pivots* are two bigrams of the prefix
that share no letter, the rarest such pair, chosen by dynamic programming.

One edit destroys one of two disjoint bigrams at most. So of two words one edit
apart, the one whose prefix ends earlier in the global order (both, if they end
alike) has a pivot that stands in the other one's prefix: the surviving bigram
comes no later than the end of either prefix. Its place is the same or moved by
the one letter that the other word has more or less, and as the edit lies on one
side of it, the letters on the other side are the same. Each pivot is therefore
looked up under six exact keys (bigram, place, length, side and the letters
there), and what is found is verified.

The words have at most 90 different letters, so there are at most 8100 bigrams
and their order fits in every task at any size of the input. Words that stand
in very many texts are counted in the tasks first.

Defined results: a null or empty text has no words; a null id counts as an
empty one in the damage rule; rows that repeat count each for itself; an empty
table gives no words. Only the id and the text are read, whatever other columns
there are.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from .common import empty_if_null, map_texts, pinned

MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
PREFIX = 3
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 300_000
#: Bytes of a text that are split at once.
SLICE = 1 << 22

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: ASCII letters lower-cased, other ASCII as spaces; what lies above stays.
_SEPARATED = bytes(
    b if b > 127 else (b | 32 if (b | 32) in _LETTERS else 32) for b in range(256)
)
#: All of UTF-8 beyond ASCII but U+00C0 to U+00FF, which begin with byte C3.
_OTHER = re.compile(rb"(?:[\xc2\xc4-\xf7][\x80-\xbf]*)+")


def runs(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased letter runs of a text, some megabytes at a time."""
    plain = text.translate(_SEPARATED)
    if not plain.isascii():
        plain = _OTHER.sub(b" ", plain)
    start = 0
    while len(plain) - start > SLICE:
        end = plain.find(b" ", start + SLICE)
        if end < 0:
            break
        yield plain[start:end].split()
        start = end
    yield plain[start:].split()


def letters(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")


def damaged(run: bytes, check: int) -> bytes:
    """The run without its letter number ``check`` modulo its length."""
    text = run.decode("utf-8")
    at = check % len(text)
    return (text[:at] + text[at + 1 :]).encode("utf-8")


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    damage: int | None = None,
) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough.

    With ``damage``, a run loses a letter where the CRC-32 of ``<id>:<run>`` is
    a multiple of it, before its length is looked at.
    """
    picked = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        empty_if_null(text_col).alias("text"),
    )

    def work(rows):
        held: dict[bytes, int] = {}
        for key, text in rows:
            start = zlib.crc32(key + b":")
            for some in runs(text):
                for run, n in Counter(some).items():
                    if damage and not (check := zlib.crc32(run, start)) % damage:
                        run = damaged(run, check)
                    if len(run) >= min_letters and letters(run) >= min_letters:
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD_WORDS:
                    yield from held.items()
                    held = {}
        yield from held.items()

    counted = map_texts(picked, work, "word binary, n long", texts=("key", "text"), rows=20_000)
    return (
        counted.groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
        .select(F.col("word").cast("string").alias("word"), "n")
    )


def gram_order(words: DataFrame) -> dict[str, int]:
    """The rank of every bigram, rare ones first; at most 8100 of them."""
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select(
        F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram")
    )
    counted = grams.groupBy("gram").count().collect()
    ranked = sorted((row["count"], row["gram"]) for row in counted)
    return {gram: rank for rank, (_, gram) in enumerate(ranked)}


def choose_pivots(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The two bigrams (rank, place) that share no letter and are rarest together.

    By place, ``first[j]`` is the rarest of the first ``j`` bigrams; a second
    pivot is joined to the rarest that ends before it. The sum of ranks decides.
    """
    placed = sorted(prefix, key=lambda gram: gram[1])
    first: list[tuple[int, int]] = []
    best, pair = None, []
    behind = 0  # bigrams known to end before the one looked at
    for j, gram in enumerate(placed):
        while placed[behind][1] + 2 <= gram[1]:
            behind += 1
        if behind:
            other = first[behind - 1]
            if best is None or other[0] + gram[0] < best:
                best, pair = other[0] + gram[0], [other, gram]
        first.append(min(first[-1], gram) if j else gram)
    return pair


def letter_mask(word: str) -> int:
    """Up to three of each of 21 classes of letters, a bit each.

    One letter more or less changes one bit at most, so one edit changes two.
    """
    mask = 0
    for letter in word:
        bit = 1 << ord(letter) % 21 * 3
        for _ in range(3):
            if not mask & bit:
                mask |= bit
                break
            bit <<= 1
    return mask


def signature(word: str, order: dict[str, int]) -> tuple[int, list, list]:
    """(rank of the prefix's end, prefix, pivots), bigrams as (rank, place)."""
    grams = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = grams[PREFIX - 1][0]
    end = PREFIX
    while end < len(grams) and grams[end][0] == last:
        end += 1
    prefix = grams[:end]
    return last, prefix, choose_pivots(prefix)


def signatures(words: DataFrame) -> DataFrame:
    """(word, n, length, last, mask, prefix, pivots); a bigram is rank * 2^32 + place."""
    order = gram_order(words)

    def work(rows):
        for word, n in rows:
            last, prefix, pivots = signature(word, order)
            coded = [[(rank << 32) + place for rank, place in some] for some in (prefix, pivots)]
            yield word, n, len(word), last, letter_mask(word), *coded

    schema = "word string, n long, length int, last int, mask long, prefix array<long>, pivots array<long>"
    return map_texts(words.select("word", "n"), work, schema, texts=())


#: How a pivot may stand in a word one edit away: places moved, letters more, and
#: whether the letters before it (or those behind it) are then the same in both.
_WAYS = (
    (0, 0, True),
    (0, 0, False),
    (0, 1, True),
    (1, 1, False),
    (0, -1, True),
    (-1, -1, False),
)


def _key(gram: Column, length: Column, before: Column, word: Column, place: Column) -> Column:
    """One number for a bigram at a place, the word's length and its letters on one side."""
    side = F.when(before, F.substring(word, F.lit(1), place)).otherwise(
        F.substring(word, place + 3, F.char_length(word))
    )
    return F.xxhash64(gram, length, before, side)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words one edit apart, each once and in one order.

    ``words`` has (word, n); words of fewer than five letters are not meant. The
    one edit lies before the pivot or behind it, so the letters on the other side
    are the same: they are part of the key, and hot bigrams make no large groups.
    """
    signed = pinned(signatures(words))
    ways = F.array(*[
        F.struct(F.lit(moved).alias("moved"), F.lit(more).alias("more"), F.lit(before).alias("before"))
        for moved, more, before in _WAYS
    ])
    sides = F.array(F.lit(True), F.lit(False))
    place = F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    asking = (
        signed.select("word", "n", "length", "last", "mask", F.explode("pivots").alias("gram"))
        .select("*", F.explode(ways).alias("way"))
        .select(
            _key(
                F.col("gram") + F.col("way.moved"),
                F.col("length") + F.col("way.more"),
                F.col("way.before"),
                F.col("word"),
                place,
            ).alias("key"),
            F.col("word").alias("a"),
            F.col("n").alias("n_a"),
            F.col("last").alias("last_a"),
            F.col("mask").alias("mask_a"),
        )
    )
    indexed = (
        signed.select("word", "n", "length", "last", "mask", F.explode("prefix").alias("gram"))
        .select("*", F.explode(sides).alias("before"))
        .select(
            _key(F.col("gram"), F.col("length"), F.col("before"), F.col("word"), place).alias("key"),
            F.col("word").alias("b"),
            F.col("n").alias("n_b"),
            F.col("last").alias("last_b"),
            F.col("mask").alias("mask_b"),
        )
    )
    # The letters tell most candidates off before their order is compared.
    alike = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    one_apart = (F.col("last_a") <= F.col("last_b")) & alike & (F.levenshtein("a", "b", 1) == 1)
    # Sizes known before the lists are unfolded say nothing, so nothing is broadcast.
    found = asking.hint("merge").join(indexed, "key").where(one_apart)
    first = F.col("a") < F.col("b")
    ordered = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("n_a", "n_b"))]
    ordered += [F.when(first, F.col(y)).otherwise(F.col(x)).alias(y) for x, y in (("a", "b"), ("n_a", "n_b"))]
    return found.select(*ordered).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, for words with a form.

    A form has at least twice the count of its word, so there are no rings. Every
    round doubles the steps followed; five rounds follow 32.
    """
    links = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = pinned(links.join(on, "root", "left"))
        links = jumped.select("word", F.coalesce("further", "root").alias("root"))
        if jumped.where("further is not null").isEmpty():
            return links


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    damage: int | None = None,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest ``n``, the smallest in code-point order
    of several, if it has at least ``ratio`` times the word's; ``root`` is where
    forms lead to. ``min_letters`` is five at least: shorter words have no three
    bigrams to choose pivots from.
    """
    if min_letters < MIN_LETTERS or ratio < 2:
        raise ValueError("min_letters must be at least 5 and ratio at least 2")
    words = pinned(word_counts(docs, id_col, text_col, min_letters, min_count, damage))
    pairs = near_pairs(words)
    ends = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]
    either = pairs.select(F.inline(F.array(*ends)))
    best = either.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"),
    )
    large = F.col("near_n") >= F.col("n") * ratio
    judged = pinned(
        judged.select(
            "word", "n", "n_near",
            F.when(large, F.col("near")).alias("form"),
            F.when(large, F.col("near_n")).alias("form_n"),
        )
    )
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
