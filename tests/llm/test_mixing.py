import math
import random

import pytest

from siftdesk.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def rate(size, tilt, cap=3):
    return min(cap, math.exp(min(tilt * size, 9.0))) if size else 1.0


def solve(sizes, target, cap=3):
    """The tilt by halving an interval."""
    low, high = -60.0, 60.0
    for _ in range(300):
        middle = (low + high) / 2
        if sum(s * rate(s, middle, cap) for s in sizes) < target:
            low = middle
        else:
            high = middle
    return low


def level_targets(sizes, weights, cap=3):
    """Targets by resharing what full sources leave over, round by round."""
    total, full, share = sum(sizes), set(), {}
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        share = {i: left * w / weight for i, w in enumerate(weights) if i not in full}
        over = {i for i, x in share.items() if x > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def corpus(seed=1, n=600):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = draw.choice(["a", "a", "a", "b", "c", None, "é", "Z"])
        rows.append((i, " ".join(["w"] * draw.choice([0, 1, 3, 8, 20, 50])), source))
    rows += [(None, None, "a"), (5, "w w", "a"), (5, "w w", "a"), (None, "w " * 30, None), (n, "w\tw\x0bw", "tiny")]
    return rows


def test_rates_and_targets_by_brute_force(spark):
    rows = corpus()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_source = {}
    for _, text, source in rows:
        by_source.setdefault(source, []).append(len((text or "").split()))
    names = sorted([s for s in by_source if s is not None]) + [None]
    totals = [sum(by_source[s]) for s in names]
    targets = level_targets(totals, [(5, 2, 1)[i % 3] for i in range(len(names))])
    expected = {total: target for total, target in zip(totals, targets)}
    taken = {}
    for row in got:
        assert row.target == pytest.approx(expected[row.source_size], rel=1e-12)
        assert row.taken == row.copies * row.size and 0 <= row.copies <= 3
        taken[row.source_size] = taken.get(row.source_size, 0) + row.taken
    for name, total, target in zip(names, totals, targets):
        tilt = solve(by_source[name], target)
        for row in got:
            if row.source_size == total and target < 3 * total:
                assert row.rate == pytest.approx(rate(row.size, tilt), rel=1e-6)
                assert row.copies in (math.floor(row.rate), math.floor(row.rate) + 1)
        assert abs(taken[total] - target) <= 0.02 * target + 3


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(seed=2)
    first = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(1))
    random.Random(3).shuffle(rows)
    second = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7))
    key = lambda row: str(tuple(row))
    assert sorted(first.collect(), key=key) == sorted(second.collect(), key=key)


def test_alike_rows_are_rounded_apart(spark):
    rows = [(None, "w w", "a")] * 100 + [(i, "w w", "b") for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("doc_id is null").collect()
    # 5/7 of 400 words are 285.7 for 200 words of the source.
    assert sum(row.taken for row in got) in (285, 286)
    assert {row.copies for row in got} == {1, 2}


def test_full_sources_and_empty_ones(spark):
    rows = [(1, "w", "a"), (2, "w " * 1000, "b"), (3, "", "c"), (4, None, "c")]
    got = {row.doc_id: row for row in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].target == 3.0 and got[1].taken == 3
    assert got[2].target == 998.0
    assert got[3].target == 0.0 and got[3].size == 0 and got[4].taken == 0


def test_empty_table_and_other_columns(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame(
        [(1, "a b", "s", 9, 9, 9, 9)], SCHEMA + ", size long, rate long, _source long, tilt long"
    )
    (row,) = mixing.mix(frame).collect()
    assert (row["size"], row["taken"]) == (2, 2)
    only_null = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert [row.taken for row in mixing.mix(only_null).collect()] == [0]
