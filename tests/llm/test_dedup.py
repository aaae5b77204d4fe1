"""Operators 1, 3 and 5 against plain Python."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftdesk.llm import exact_dedup, line_dedup, simhash

SCHEMA = "doc_id long, text string, kept string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def upper_ascii(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("counters", [2, 1000])
def test_exact_groups(spark, counters):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Hot", "hOT", "hot"])) for i in range(300)]
    rows += [(300 + i, f"Text {i % 40}") for i in range(200)]
    rows += [(900, None), (901, ""), (None, "alone"), (None, "hot"), (902, "É"), (903, "é")]
    rows += [(905, "twice"), (905, "twice")]
    rng.shuffle(rows)
    got = exact_dedup.mark(table(spark, rows).repartition(5), counters=counters).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(upper_ascii(t)).digest(), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[bytes(r.digest)]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert r.kept <= (r.doc_id == best)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_columns(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c"), (4, "c"), (4, "c"), (4, "d"), (None, "e")]
    left = exact_dedup.dedup(table(spark, rows))
    assert left.columns == ["doc_id", "text", "kept", "digest"]
    want = [(2, "a B"), (4, "c"), (4, "d"), (None, "e")]
    assert sorted(((r[0], r[1]) for r in left.collect()), key=repr) == sorted(want, key=repr)


def test_frequent_digests_are_found(spark):
    rows = [(i, "a" if i % 3 == 0 else str(i)) for i in range(3000)]
    digests = exact_dedup.text_digests(table(spark, rows).repartition(7))
    found = exact_dedup.misra_gries(digests, "digest", 9).where(F.col("estimate") * 10 >= 3000)
    hot = hashlib.sha256(b"a").digest()
    assert hot in {bytes(r.digest) for r in found.collect()} and found.count() <= 10


def brute_lines(rows, least=40, docs=5):
    holders = {}
    space = b" \t\n\v\f\r"

    def key(line):
        k = line.encode().strip(space).lower()
        return k if len(k.decode()) >= least else None

    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                holders.setdefault(key(line), set()).add(i)
    last = {
        k: max((i for i in ids if i is not None), default=None)
        for k, ids in holders.items()
        if len(ids) >= docs
    }
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (4, 3)])
def test_lines_against_brute_force(spark, batches, fan):
    rng = random.Random(2)
    long = [f"line {i} " + "äbc" * (12 + i % 3) for i in range(30)]
    rows = []
    for i in range(150):
        lines = [rng.choice([*long, "short", "", "x" * 39, "y" * 40]) for _ in range(rng.randint(0, 8))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.1 else x) for x in lines]
        lines += ["z" * 50] * rng.randint(0, 2)
        rows.append((i, "\n".join(lines)))
    rows += [(None, "y" * 40), (None, "z" * 50 + "\n"), (200, None), (201, ""), (7, "z" * 50), (7, "z" * 50)]
    left = line_dedup.dedup_documents(table(spark, rows), batches=batches, fan=fan)
    assert left.columns == ["doc_id", "text", "kept", "digest", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in left.collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)
    assert any(r[3] for r in got)


def test_store_gives_fresh_lines_and_merges_runs(spark):
    store = line_dedup.LineStore(spark, fan=2)

    def batch(*pairs):
        return spark.createDataFrame([(i, k.encode()) for i, k in pairs], "doc_id long, key binary")

    fresh = [
        {bytes(r.key).decode() for r in store.add(batch(*b)).collect()}
        for b in ([(1, "a"), (2, "a"), (1, "b")], [(3, "a"), (3, "c")], [(4, "d"), (4, "b")], [(5, "a")])
    ]
    assert fresh == [{"a", "b"}, {"c"}, {"d"}, set()]
    assert [len(level) for level in store.levels] == [0, 0, 1]
    totals = {bytes(r.key).decode(): (r.n_docs, r.last_doc) for r in store.totals().collect()}
    assert totals == {"a": (4, 5), "b": (2, 4), "c": (1, 3), "d": (1, 4)}
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_rows_of_one_id_keep_lists_of_their_own(spark):
    """A third of the rows without an id: no list is that of them all."""
    lines = [f"shared line {i} " + "x" * 40 for i in range(60)]
    rows = [(i, lines[i % 60] + "\n" + lines[(i + 1) % 60]) for i in range(400)]
    rows += [(None, lines[i % 60] + f"\nown {i}") for i in range(200)]
    drops = line_dedup.dropped_lines(table(spark, rows).select("doc_id", "text"))
    assert drops.agg(F.max(F.size("drops"))).first()[0] <= 2
    left = line_dedup.dedup_documents(table(spark, rows)).collect()
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in left]
    assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)


def test_store_is_opened_again(spark, tmp_path):
    def batch(*pairs):
        return spark.createDataFrame([(i, k.encode()) for i, k in pairs], "doc_id long, key binary")

    store, path = line_dedup.LineStore(spark, fan=2), str(tmp_path / "manifest")
    store.add(batch((1, "a"), (2, "a")))
    store.add(batch((3, "b")))
    store.save(path)
    store.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    again = line_dedup.LineStore.open(spark, path)
    assert {bytes(r.key) for r in again.add(batch((4, "a"), (4, "c"))).collect()} == {b"c"}
    totals = {bytes(r.key).decode(): (r.n_docs, r.last_doc) for r in again.totals().collect()}
    assert totals == {"a": (3, 4), "b": (1, 3), "c": (1, 4)}
    again.close()


def test_merging_with_runs_does_not_shuffle_them(spark):
    store = line_dedup.LineStore(spark)
    rows = spark.createDataFrame([(1, b"a"), (2, b"b")], "doc_id long, key binary")
    store.add(rows)
    plan = store.spark.table(store.levels[0][0]).join(
        store.spark.table(store.levels[0][0]).withColumnRenamed("n_docs", "m"), "key"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        store.close()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_fingerprint(text, words=4):
    parts = upper_ascii(text).split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    arr = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(fps))]


def check_components(got, fps, ids, radius=4):
    root = brute_components(fps, radius)
    smallest = {}
    for r, i in zip(root, ids):
        if i is not None and (r not in smallest or i < smallest[r]):
            smallest[r] = i
    want = [(i, f, smallest.get(r)) for i, f, r in zip(ids, fps, root)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprints_are_those_of_spark(spark):
    text = "The Quick  brown\tfox jumps\vover é"
    words = "the quick brown fox jumps over é".split()
    shingles = [" ".join(words[i : i + 4]) for i in range(4)]
    frame = spark.createDataFrame([(s,) for s in shingles], "s string")
    hashes = [r[0] & (1 << 64) - 1 for r in frame.select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash.fingerprint(text.encode(), 4) == want


def test_near_duplicates_of_texts(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(200)) for _ in range(30)]
    texts = [*base, *(b.upper() for b in base[:10]), *(b + " tail" for b in base)]
    texts += [None, "", " \n", "one two", "One  two", "a b c d", "w " * 70_000]
    rows = [(None if i == 3 else i % 90, t) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(table(spark, rows), tile=16).collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert len(set(fps)) < len(fps)
    check_components([(r[0], r[1] & (1 << 64) - 1, r[2]) for r in got], fps, [i for i, _ in rows])


@pytest.mark.parametrize("tile", [8, 64, 1 << 15])
def test_links_over_tiles(spark, tile):
    """Chains and dense clusters of fingerprints, with tiles of all sizes."""
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):  # walk on from random members: long chains
        fp = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            fp ^= 1 << bit
        fps.append(fp)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    tree = simhash.roots(simhash.links(distinct, 4, tile))
    root = {r.fp: r.root for r in tree.collect()}
    assert len(root) == tree.count()
    want = brute_components(fps)
    groups = {}
    for f, r in zip(signed, want):
        groups.setdefault(r, set()).add(f)
    got = {}
    for f in signed:
        got.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_dense_blocks():
    rng = np.random.default_rng(5)
    near = np.uint64(0xF0F0F0F0F0F0F0F0) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    far = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    fps = simhash.sort_by_counts(np.unique(np.concatenate([near, far])))
    child, parent = simhash.forest(fps, None, 4, block=64)
    label = simhash.components(
        len(fps),
        np.searchsorted(np.sort(fps.view(np.int64)), child),
        np.searchsorted(np.sort(fps.view(np.int64)), parent),
    )
    order = np.sort(fps.view(np.int64)).view(np.uint64)
    want = brute_components(order.tolist())
    assert len(set(label.tolist())) == len(set(want))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.mark(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == 0
    assert line_dedup.dedup_documents(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
