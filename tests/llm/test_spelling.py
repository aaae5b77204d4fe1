import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from siftdesk.llm import spelling

SCHEMA = "doc_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a != b and 2 or 0
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    rest = short[i + 1 :] if len(short) == len(long) else short[i:]
    return 1 if rest == long[i + 1 :] else 2


def brute(rows, damage):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            check = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if damage and check % damage == 0:
                at = check % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if edits(w, x) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    made = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        made[w] = (form[w], root, words[w], len(near[w]), form[w] and words[form[w]])
    return made


def found(frame, **more):
    rows = spelling.variants(frame, **more).collect()
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(made) == len(rows)
    return made


@pytest.mark.parametrize("letters, damage", [("ab", None), ("abcé", 7), ("aaab×÷ÿ", 3)])
def test_brute_force(spark, letters, damage):
    draw = random.Random(len(letters))
    vocabulary = ["".join(draw.choices(letters, k=draw.randint(4, 9))) for _ in range(250)]
    rows = []
    for i in range(120):
        words = [draw.choice(vocabulary[: draw.choice([20, 250])]) for _ in range(40)]
        words = [w.upper() if draw.random() < 0.1 and "ÿ" not in w else w for w in words]
        rows.append((i if i % 9 else None, draw.choice([" ", "1", "_", "中", "€ ", "¿"]).join(words)))
    rows += [(None, None), (3, ""), (3, None), rows[5], rows[5]]
    expected = brute(rows, damage)
    assert expected and any(v[0] for v in expected.values())
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), damage=damage) == expected


def test_chains_ties_and_very_long_words(spark):
    long = "x" * 3000
    text = " ".join(
        ["stone"] * 3 + ["stones"] * 6 + ["stoned"] * 6 + ["stoner"] * 30 + ["stoners"] * 60
        + [long] * 3 + [long + "y"] * 6
    )
    got = found(spark.createDataFrame([(1, text)], SCHEMA))
    assert got["stones"] == ("stoner", "stoners", 6, 4, 30) or got["stones"][0] == "stoners"
    assert got == brute([(1, text)], None)
    assert got[long][0] == long + "y"


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(1, None), (2, "tiny")], SCHEMA)) == {}
    frame = spark.createDataFrame([(1, "spell " * 4, 1, 1, 1)], SCHEMA + ", word int, n int, gram int")
    assert found(frame) == {"spell": (None, "spell", 4, 0, None)}


def test_slices_lose_nothing(monkeypatch):
    text = ("Abc déf," * 50 + "x" * 40 + " end").encode()
    whole = [w for some in spelling.runs(text) for w in some]
    monkeypatch.setattr(spelling, "SLICE", 16)
    assert [w for some in spelling.runs(text) for w in some] == whole


def test_pivots_are_the_rarest_disjoint_pair():
    draw = random.Random(4)
    for _ in range(500):
        places = draw.sample(range(8), draw.randint(3, 6))
        prefix = [(draw.randint(0, 20), place) for place in places]
        pairs = [p for p in itertools.combinations(prefix, 2) if abs(p[0][1] - p[1][1]) >= 2]
        chosen = spelling.choose_pivots(prefix)
        assert abs(chosen[0][1] - chosen[1][1]) >= 2
        assert sum(g[0] for g in chosen) == min(a[0] + b[0] for a, b in pairs)
