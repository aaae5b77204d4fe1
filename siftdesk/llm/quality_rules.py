"""Quality rules: a decision list learned from labelled text statistics.

Every text is measured once. The labelled rows teach an ordered list of rules by
sequential covering: a rule grows by the threshold condition with the greatest
information gain on two thirds of the sample, is pruned from its end on the
other third, and is kept if it is precise there; what it covers is set aside and
the next rule is grown. The list becomes one ordered Spark conditional
expression over the statistics, so it can be read, logged and changed by hand.

Learning sees at most ``sample`` labelled rows (those with the smallest hash of
their id), of which only the statistics travel to the driver: a few numbers a
row. Measuring and deciding cover all rows.

Defined results: a null text has no words; a text without words has all shares
zero; labels that are null or belong to no row are not used; with no labels, or
none of one kind, the list is empty and only the base rules reject. Rows that
repeat are decided each for itself; learning takes an id once, a bad label wins. Other columns are not read by ``measure``
and pass through ``keep_good``.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import pinned, ship_package

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SAMPLE = 20_000
MAX_RULES = 24
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVER = 5

_SPACE = b" \t\n\v\f\r"
_TAIL = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_UPPER = bytes(range(65, 91))

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct long, n_upper long, n_digits long, n_marks long"
)


def _count(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first one included."""
    if len(words) <= window:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][window - 1 :]
    first: dict[bytes, int] = {}
    again: list[int] = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        at = first.setdefault(joined[a:b], i)
        if at != i:
            again.append(at)
            again.append(i)
    if not again:
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(again))
    steps[at] += 1
    steps[at + window] -= 1
    return int((np.cumsum(steps) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of a UTF-8 text, in the order of ``COUNTS``."""
    words = text.split()
    solid = text.translate(None, _SPACE)
    seen, dup_lines, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    return (
        len(words),
        len(solid) - _count(solid, _TAIL),
        _count(text, SYMBOLS),
        dup_lines,
        repeated_words(words),
        lines,
        len(set(words)),
        _count(text, _UPPER),
        _count(text, b"0123456789"),
        _count(text, b"!?"),
    )


def _measure(texts: pd.Series) -> pd.DataFrame:
    found = [counts(t.encode("utf-8") if t else b"") for t in texts]
    return pd.DataFrame(found, columns=[c.split()[0] for c in COUNTS.split(", ")])


def text_counts(text: str | Column = "text") -> Column:
    """The counts of a text column as a struct."""
    return F.pandas_udf(_measure, COUNTS)(text)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS``, one row per row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", text_counts().alias("counts")).select("doc_id", "counts.*")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """What the rules are made of, by name."""
    return {
        "words": F.col("n_words").cast("double"),
        "lines": F.col("n_lines").cast("double"),
        "chars_per_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "repeated_line_share": _share("n_dup_lines", "n_lines"),
        "repeated_word_share": _share("n_repeat_words", "n_words"),
        "distinct_word_share": _share("n_distinct", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.cut if self.above else x <= self.cut

    def column(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Which of ``rows`` (a mask) the rule covers."""
    for condition in rule:
        rows = rows & condition.holds(values)
    return rows


def _cuts(x: np.ndarray) -> np.ndarray:
    """All midpoints between neighbouring values."""
    found = np.unique(x)
    return (found[1:] + found[:-1]) / 2


def best_condition(values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray):
    """The condition with the greatest gain among ``rows``, or None."""
    p0, n0 = int((bad & rows).sum()), int((~bad & rows).sum())
    if not p0 or not n0:
        return None
    start, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for name, column in values.items():
        x, y = column[rows], bad[rows]
        cuts = _cuts(x)
        if not len(cuts):
            continue
        order = np.argsort(x, kind="stable")
        at = np.searchsorted(x[order], cuts, side="right")
        positives = np.concatenate([[0], np.cumsum(y[order])])[at]
        for above in (False, True):
            p = p0 - positives if above else positives
            all_ = len(x) - at if above else at
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(all_, 1)) - start), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, above, float(cuts[i]))
    return found


def grow(values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        condition = best_condition(values, bad, rows)
        if condition is None:
            break
        rule += (condition,)
        rows = rows & condition.holds(values)
    return rule


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best balance on held-back rows."""
    best, kept = -2.0, rule
    for size in range(1, len(rule) + 1):
        covered = covers(rule[:size], values, rows)
        p, n = int((bad & covered).sum()), int((~bad & covered).sum())
        worth = (p - n) / (p + n + 1)
        if worth > best + 1e-12:
            best, kept = worth, rule[:size]
    return kept


def learn(
    values: dict[str, np.ndarray],
    bad: np.ndarray,
    held_back: np.ndarray,
    min_precision: float = MIN_PRECISION,
    min_cover: int = MIN_COVER,
) -> list[Rule]:
    """Rules for ``bad`` rows, in order; ``held_back`` marks the rows for pruning."""
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = grow(values, bad, left & ~held_back)
        if not rule:
            break
        rule = prune(rule, values, bad, left & held_back)
        covered = covers(rule, values, left)
        tested = covers(rule, values, left & held_back)
        if (
            covered.sum() < min_cover
            or not tested.any()
            or bad[covered].mean() < min_precision
            or bad[tested].mean() < min_precision
        ):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def chosen_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label_id, quality): at most ``sample`` labels, those with the smallest hash."""
    marks = labels.select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("quality")
    )
    return (
        marks.where("quality is not null and label_id is not null")
        .groupBy("label_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )


def labelled_sample(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Features, bad flags and held-back flags of a bounded sample of labelled rows."""
    names = list(features())
    chosen = chosen_labels(labels, sample)
    stats = F.struct(*[column.alias(name) for name, column in features().items()])
    rows = (
        measured.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .groupBy("label_id", "quality")
        .agg(F.min(stats).alias("stats"))
        .select(F.xxhash64("label_id").alias("place"), "quality", "stats.*")
        .toPandas()
        .sort_values(["place", *names], ignore_index=True)
    )
    values = {name: rows[name].to_numpy(np.float64) for name in names}
    held_back = (rows["place"].to_numpy(np.int64) % 3) == 0
    return values, rows["quality"].to_numpy(np.float64) == 0, held_back


def learn_rules(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The decision list for ``labels`` (doc_id, quality: 0 is bad)."""
    return learn(*labelled_sample(measured, labels, sample))


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    columns, found = features(), None
    for number, rule in enumerate(rules, 1):
        holds = rule[0].column(columns)
        for condition in rule[1:]:
            holds = holds & condition.column(columns)
        found = F.when(holds, number) if found is None else found.when(holds, number)
    return F.lit(None).cast("int") if found is None else found


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def decide(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Counts and verdict of every row: ``COUNTS``, base_failed, rule, kept.

    The counts are written to the shared folder: the texts are read once.
    """
    measured = pinned(measure(docs))
    rules = learn_rules(measured, labels, sample)
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("rule", first_rule(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that a base rule or the list rejects.

    The rules are learned from the labelled rows of ``docs`` first; then one
    pass measures, decides and lets through, all columns as they were.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    # At most ``sample`` ids, so the texts stay where they are.
    known = F.broadcast(chosen_labels(labels, sample))
    taught = plain.join(known, F.col(key) == F.col("label_id"), "left_semi")
    taught = taught.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rules = learn_rules(pinned(measure(taught)), labels, sample)
    counted = plain.withColumn("counts", text_counts(text)).select(*plain.columns, "counts.*")
    left = counted.where(~base_failed() & first_rule(rules).isNull())
    return left.select(*plain.columns).toDF(*names)
