"""Toxicity: a linear classifier with a counterfactual penalty.

A document's features are its words with their beginnings and ends, hashed; the
value of a feature is the sum of log(1 + count) over the document's distinct
words that have it, so a word adds one number to the score whatever it is made
of and scoring is one look-up per distinct word.

Learning: of the labelled rows at most ``sample`` (smallest hash of the id) are
taken. Feature counts per class are summed by Spark, and the ``kept`` features
that tell the classes apart best are weighted by logistic regression. In
labelled sentences that mention a group (the identity terms below) the mention
is swapped for another group's; the loss adds the squared change of the score
sentence by sentence, so opposite swaps do not cancel and words that only name a group cannot carry weight and neutral mentions are not
taken for toxic ones.

Scores read the text alone. Defined results: null texts are empty; an empty text
scores the intercept; labels that are null or belong to no row are not used;
without labels of both kinds every score is the share of toxic labels (0 with
none). Rows that repeat are scored each for itself; learning takes an id once. Other columns are not read by ``score`` and pass through
``keep_clean``.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_texts, pinned, ship_package
from .tokens import Cache

SAMPLE = 20_000
SPACE = 1 << 20
KEPT = 4096
MIN_DOCS = 5
RIDGE = 1.0
COUNTERFACTUAL = 10.0
STEPS = 300

#: Words that name groups, by kind; a swap stays inside a kind.
IDENTITY_TERMS = {
    "women men girls boys": "gender",
    "woman man girl boy": "gender, one",
    "gay lesbian straight bisexual transgender queer": "orientation",
    "muslims christians jews hindus buddhists atheists catholics": "belief",
    "muslim christian jewish hindu buddhist atheist catholic": "belief, one",
    "black white asian african latino arab european american": "origin",
    "immigrants refugees foreigners migrants natives": "arrival",
    "old young elderly disabled deaf blind": "state",
    "frauen männer mädchen jungen": "gender, de",
    "muslime christen juden hindus katholiken": "belief, de",
    "ausländer flüchtlinge einwanderer deutsche": "arrival, de",
    "femmes hommes filles garçons": "gender, fr",
    "musulmans chrétiens juifs hindous catholiques": "belief, fr",
    "immigrés réfugiés étrangers français": "arrival, fr",
    "mujeres hombres chicas chicos": "gender, es",
    "musulmanes cristianos judíos hindúes católicos": "belief, es",
    "inmigrantes refugiados extranjeros españoles": "arrival, es",
}

SWAPS: dict[bytes, list[bytes]] = {}
for _terms in IDENTITY_TERMS:
    _group = [term.encode() for term in _terms.split()]
    for _term in _terms.split():
        _others = [other for other in _group if other != _term.encode()]
        # Words are lower-cased in A-Z alone, so other capitals are keys of their own.
        _capital = "".join(c if c.isascii() else c.upper() for c in _term)
        SWAPS[_term.encode()] = SWAPS[_capital.encode()] = _others

#: Everything but ASCII letters and digits and non-ASCII bytes parts words.
_PARTING = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_SENTENCE_ENDS = bytes.maketrans(b"!?\n", b"...")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PARTING).split()


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed: the word, its beginnings of 3 to 8 bytes, its ends of 4 and 5."""
    parts = [b"=" + word]
    parts += [b"^" + word[:n] for n in range(3, 9) if len(word) >= n]
    parts += [b"$" + word[-n:] for n in (4, 5) if len(word) >= n]
    return tuple({zlib.crc32(p) % SPACE for p in parts})


def feature_values(words: list[bytes]) -> dict[int, float]:
    found: dict[int, float] = {}
    for word, count in Counter(words).items():
        value = math.log1p(count)
        for feature in word_features(word):
            found[feature] = found.get(feature, 0.0) + value
    return found


def swapped_changes(text: bytes) -> Iterator[dict[int, float]]:
    """How the features of each sentence that mentions a group change if it
    mentions another; nothing for texts without identity terms."""
    if SWAPS.keys().isdisjoint(words_of(text)):
        return
    for sentence in text.translate(_SENTENCE_ENDS).split(b"."):
        words = words_of(sentence)
        if SWAPS.keys().isdisjoint(words):
            continue
        change: dict[int, float] = {}
        swapped = []
        for word in words:
            others = SWAPS.get(word)
            swapped.append(others[zlib.crc32(sentence) % len(others)] if others else word)
        for sign, version in ((1.0, swapped), (-1.0, words)):
            for feature, value in feature_values(version).items():
                change[feature] = change.get(feature, 0.0) + sign * value
        yield {feature: value for feature, value in change.items() if abs(value) > 1e-9}


@dataclass
class Model:
    """An intercept, the weights of hashed features, and how many swapped
    sentences the penalty saw."""

    intercept: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    swapped: int = 0

    def word_weight(self, word: bytes) -> float:
        weights = self.weights
        return sum(weights.get(feature, 0.0) for feature in word_features(word))

    def score(self, text: bytes, known: Cache) -> float:
        total = self.intercept
        for word, count in Counter(words_of(text)).items():
            weight = known.get(word)
            if weight is None:
                weight = self.word_weight(word)
                known.put(word, weight)
            if weight:
                total += weight * math.log1p(count)
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, total))))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that learning does not see: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic): at most ``sample`` labelled rows outside the held-out fold.

    The ids are chosen before the texts are joined, so no more texts are moved.
    Of rows with one id the smallest text is taken, and toxic wins.
    """
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic is not null and label_id is not null").where(~held_out("label_id"))
    chosen = (
        marks.groupBy("label_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")
    )
    one = texts.groupBy("label_id", "toxic").agg(F.min("text").alias("text"))
    return one.select("text", "toxic")


def choose_features(rows: DataFrame, kept: int | None = KEPT) -> list[int]:
    """The features that tell toxic rows from others best, by their z-score.

    None keeps all that occur in ``MIN_DOCS`` rows of the sample.
    """

    def count(pairs):
        sums: dict[int, list[int]] = {}
        for text, toxic in pairs:
            found = set()
            for word in set(words_of(text)):
                found.update(word_features(word))
            for feature in found:
                held = sums.setdefault(feature, [0, 0])
                held[0] += 1
                held[1] += toxic == 1
        for feature, (n, bad) in sums.items():
            yield feature, n, bad

    total = rows.agg(F.count("*").alias("n"), F.sum(F.expr("int(toxic = 1)")).alias("bad")).first()
    n_all, n_bad = total["n"], total["bad"] or 0
    if not n_bad or n_bad == n_all:
        return []
    rate = n_bad / n_all
    sums = map_texts(rows.select("text", "toxic"), count, "feature int, n long, bad long", rows=50_000)
    worth = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    best = (
        sums.groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .where(F.col("n") >= MIN_DOCS)
        .orderBy(worth.desc(), "feature")
    )
    if kept is not None:
        best = best.limit(kept)
    return [r["feature"] for r in best.collect()]


class Sparse:
    """Rows of feature values, for products with a weight vector."""

    def __init__(self, rows: list, columns: list, values: list, shape: tuple[int, int]):
        self.row = np.array(rows, np.int64)
        self.column = np.array(columns, np.int64)
        self.value = np.array(values, np.float64)
        self.shape = shape

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.shape[0])

    def transposed_dot(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * rows[self.row], self.shape[1])


def fit(x: Sparse, toxic: np.ndarray, change: Sparse, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated gradient steps.

    Loss: mean log loss + RIDGE |w|^2 / 2n + COUNTERFACTUAL * mean (change . w)^2 / 2.
    """
    n, size = x.shape
    pairs = max(1, change.shape[0])

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        error = 1.0 / (1.0 + np.exp(-np.clip(x.dot(w) + b, -40, 40))) - toxic
        grown = x.transposed_dot(error) / n + RIDGE * w / n
        if change.shape[0]:
            grown += COUNTERFACTUAL * change.transposed_dot(change.dot(w)) / pairs
        return grown, float(error.mean())

    # Steps of each weight are scaled by a bound on its curvature.
    width = np.maximum(x.dot(np.ones(size)), 1.0)
    curve = np.bincount(x.column, np.abs(x.value) * width[x.row], size) / (4 * n) + RIDGE / n
    if change.shape[0]:
        spread = np.bincount(change.row, np.abs(change.value), change.shape[0])
        curve += (
            COUNTERFACTUAL
            * np.bincount(change.column, np.abs(change.value) * spread[change.row], size)
            / pairs
        )
    rate = min(max(toxic.mean(), 1e-6), 1 - 1e-6)
    w, b = np.zeros(size), float(np.log(rate / (1 - rate)))
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        grown_w, grown_b = gradient(ahead_w, ahead_b)
        next_w, next_b = ahead_w - grown_w / (2 * curve), ahead_b - 2 * grown_b
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / following
        ahead_w = next_w + momentum * (next_w - w)
        ahead_b = next_b + momentum * (next_b - b)
        w, b, t = next_w, next_b, following
    return b, w


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kept: int | None = KEPT
) -> Model:
    """A model from the labelled rows of ``docs`` outside the held-out fold."""
    rows = pinned(labelled(docs, labels, sample))
    chosen = choose_features(rows, kept)
    if not chosen:
        mean = rows.agg(F.avg(F.expr("int(toxic = 1)"))).first()[0] or 0.0
        rate = min(max(mean, 1e-9), 1 - 1e-9)
        return Model(intercept=float(np.log(rate / (1 - rate))))
    place = {feature: i for i, feature in enumerate(chosen)}

    def vectors(pairs):
        for text, toxic in pairs:
            own = [(feature_values(words_of(text)), 0)]
            for values, kind in own + [(change, 1) for change in swapped_changes(text)]:
                held = [(place[f], v) for f, v in values.items() if f in place]
                if held or not kind:
                    yield kind, int(toxic == 1), [i for i, _ in held], [v for _, v in held]

    made = map_texts(
        rows, vectors, "kind int, toxic int, at array<int>, value array<float>", rows=2000
    ).toPandas()
    # Arrival order is not fixed; sums of floats depend on it.
    made = made.assign(order=[zlib.crc32(np.asarray(a, np.int32).tobytes()) for a in made["at"]])
    made = made.sort_values(["order", "toxic"], kind="stable", ignore_index=True)
    sides = []
    for kind in (0, 1):
        part = made[made["kind"] == kind]
        at = [np.asarray(a, np.int64) for a in part["at"]]
        row = np.repeat(np.arange(len(part)), [len(a) for a in at])
        column = np.concatenate(at) if at else []
        value = np.concatenate([np.asarray(v) for v in part["value"]]) if at else []
        sides.append(Sparse(row, column, value, (len(part), len(chosen))))
    toxic = made.loc[made["kind"] == 0, "toxic"].to_numpy(np.float64)
    intercept, weights = fit(sides[0], toxic, sides[1])
    return Model(intercept, dict(zip(chosen, weights.tolist())), sides[1].shape[0])


def score_column(model: Model, text: str | Column = "text") -> Column:
    """The model's score of a text column, 0 to 1."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Cache(200_000)
        for texts in batches:
            yield pd.Series([model.score(t.encode("utf-8") if t else b"", known) for t in texts])

    return F.pandas_udf(score, "double")(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    ship_package(docs.sparkSession)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", F.expr("int(score >= 0.5)"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they were."""
    ship_package(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    clean = plain.where(score_column(model, f"c{names.index(text_col)}") < 0.5)
    return clean.toDF(*names)
