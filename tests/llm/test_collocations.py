import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftdesk.llm import collocations
from siftdesk.llm.quotient_filter import Layout, counted, cut, decode, encode, merge

SCHEMA = "text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) >= 2 and a >= min_count}
        kept = []
        for p, a in cands.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in cands.items()):
                continue
            score, _, l, r = min(
                (2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, n=150):
    draw = random.Random(seed)
    vocabulary = ["The", "of", "Été", "x\x01", "x", "a-b", "中文", "\x00", "q'"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        words = [w + draw.choice(["", "", "", ",", ".\n"]) for w in words]
        if draw.random() < 0.5:
            words += ["New", "York", "City", "Hall"] * 2
        rows.append((draw.choice([" ", "\t", "  "]).join(words), draw.choice(["en", "en", None, "und", "de"])))
    return rows + [(None, "en"), ("", None), (" ,;\n", "de"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, part_words, fan", [(1, 1 << 20, 256), (2, 100, 5), (3, 30, 8)])
def test_brute_force(spark, seed, part_words, fan):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations.mine(frame, min_count=2, top=40, part_words=part_words, fan=fan)
    expected = brute(rows, 2, 40)
    assert len(expected) > 60
    assert sorted(map(tuple, got.collect())) == expected


def test_empty_table_and_other_columns(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], SCHEMA)).collect() == []
    frame = spark.createDataFrame([("a b. " * 30, "x", 1, 1, 1)], SCHEMA + ", word int, part int, n int")
    assert [tuple(r) for r in collocations.mine(frame).collect()] == [("x", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_slices_lose_nothing(monkeypatch):
    text = ("Ab c,dé\tf " * 40 + "x" * 90 + "." + "y" * 50).encode()
    whole = [w for some in collocations.tokens(text) for w in some]
    monkeypatch.setattr(collocations, "SLICE", 16)
    assert [w for some in collocations.tokens(text) for w in some] == whole


def test_large_numbers_are_exact(spark):
    big = 10**15
    phrases = spark.createDataFrame([([1, 2], big)], "phrase array<long>, f long")
    words = spark.createDataFrame([(1, 3 * big + 1), (2, big)], "number long, n long")
    (row,) = collocations.scored(phrases, words).collect()
    assert row.score == 2_000_000 * big // (4 * big + 1)


@pytest.mark.parametrize("words, width", [(2, 16), (3, 16), (4, 16), (3, 25), (4, 32)])
def test_filter_keeps_everything(words, width):
    draw = np.random.default_rng(words * width)
    layout = Layout(words, width)
    columns = [draw.integers(1, min(2**width, 60), 5000).astype(np.uint64) for _ in range(words)]
    expected = Counter(zip(*[c.tolist() for c in columns]))
    mixed = layout.permute(*layout.pack(columns))
    halves = [counted(layout, mixed[0][s], mixed[1][s]) for s in (slice(0, 1700), slice(1700, None))]
    for top in (0, 5, 16):
        again = []
        for half in halves:
            pieces = [(decode(layout, encode(layout, some, top), top, prefix)) for prefix, some in cut(layout, half, top)]
            again.append(merge(layout, pieces))
            for a, b in zip((again[-1].left, again[-1].right, again[-1].n), (half.left, half.right, half.n)):
                assert a.tolist() == b.tolist()
        both = merge(layout, again)
        back = layout.unpack(*layout.restore(both.left, both.right))
        assert Counter(dict(zip(zip(*[c.tolist() for c in back]), both.n.tolist()))) == expected


def test_large_counters():
    layout = Layout(2, 16)
    left = np.repeat(np.array([1, 2, 3], np.uint64), [1, 255, 70_000])
    some = counted(layout, left, left)
    assert decode(layout, encode(layout, some)).n.tolist() == [1, 255, 70_000]
