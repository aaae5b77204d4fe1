"""Operators 4, 6 and 9 against brute force, and that 4 and 6 run no Python."""

import base64
import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftdesk.llm import license_scan, queries, url_lists, warc

PYTHON = re.compile("Python|Pandas|Arrow|ExistingRDD")


def final_plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def brute_scan(text, phrases, templates, threshold):
    def words_of(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    text = text or ""
    words, places, labels = words_of(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    more, best = set(), 0.0
    for line in text.split("\n"):
        held = set(words_of(line))
        for label, template in templates.items():
            t = set(words_of(template))
            if len(held & t) >= threshold * len(t):
                more.add(label)
                best = max(best, len(held & t) / len(t))
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | more)),
        1.0 if places else best,
    )


def licence_texts():
    rng = random.Random(10)
    pool = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()})
    pool += ["CC", "by", "cc", "All", "rights", "RESERVED", "x", "é", "\n", "\n", "Kit", "4.0", "ccby"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for template in license_scan.TEMPLATES.values():
        words = template.split()
        for _ in range(20):
            some = [w for w in words if rng.random() < 0.9]
            rng.shuffle(some)
            texts.append("before\n" + " ".join(some) + " more\nafter")
    return [*texts, None, "", "cc by cc by", "Cc-BY", "KCC by", "general public\nlicense", "cc " * 30_000 + "by"]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_scan_against_brute_force(spark, threshold):
    texts = licence_texts()
    phrases = license_scan.PHRASES | {"x x": "double"}
    docs = spark.createDataFrame(
        [(i, t, "a", 1) for i, t in enumerate([*texts, "x x x x"])],
        "doc_id long, text string, words string, score int",
    )
    found = license_scan.scan(docs, phrases=phrases, threshold=threshold)
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    for i, t in enumerate([*texts, "x x x x"]):
        want = brute_scan(t, phrases, license_scan.TEMPLATES, threshold)
        assert got[i][:-1] == want[:-1] and got[i][-1] == pytest.approx(want[-1]), (t, got[i], want)
    assert not PYTHON.search(final_plan(found.drop("x")).replace("LogicalRDD", ""))


def test_scan_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "all rights reserved")] * 2 + [(None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=repr)
    assert got == [
        (1, 3, 1, 0, 0, "reserved", "reserved", 1.0),
        (1, 3, 1, 0, 0, "reserved", "reserved", 1.0),
        (None, 0, 0, None, None, "", "", 0.0),
    ]
    assert license_scan.scan(docs.limit(0)).count() == 0


MIT_HEADER = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD_HEADER = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""


def brute_runs(text, threshold):
    """Every run of words against every template, besides the lines."""
    labels = set(filter(None, brute_scan(text, {}, license_scan.TEMPLATES, threshold)[5].split(",")))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    for label, template in license_scan.TEMPLATES.items():
        t = re.findall("[a-z0-9]+", template.lower())
        size = int(len(t) / threshold + 1e-9)
        for i in range(len(words)):
            if len(set(words[i : i + size]) & set(t)) >= threshold * len(set(t)):
                labels.add(label)
    return ",".join(sorted(labels))


def test_scan_across_lines(spark):
    notices = [
        (MIT_HEADER, "mit-grant", 1.0),
        (BSD_HEADER, "bsd", 1.0),
        ("x\nReleased under\nthe MIT License\ny", "mit", 1.0),
        ("Released under" + "\nz" * 20 + "\nthe MIT License", "", 0.0),
    ]
    texts = [t for t, _, _ in notices] + [t for t in licence_texts() if t and len(t) < 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_scan.scan(docs, phrases={"no such phrase": "none"}, across_lines=True)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, (_, label, score) in enumerate(notices):
        assert (got[i].labels, got[i].score) == (label, score)
    for i, text in enumerate(texts):
        assert got[i].labels == brute_runs(text, 0.8), text
    assert not PYTHON.search(final_plan(found).replace("LogicalRDD", ""))


def test_query_finds_wrapped_notices(spark, tmp_path):
    rows = [(1, MIT_HEADER), (2, BSD_HEADER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op4_license_scan"](spark, str(tmp_path))
    assert {r.doc_id: r.labels for r in found.collect()} == {1: "mit-grant", 2: "bsd"}


ALIKE = [
    ("Released under the BSD License", ""),
    ("Released under the\nBSD License", ""),
    ("Released under the MIT License", "mit"),
    ("Licensed under CC BY-SA 4.0", "cc-by"),
    ("Licensed under\nCC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl"),
    ("This work is licensed under the GNU\nGeneral Public License, version 3", "gpl,gpl-3"),
    ("MIT\nRedistribution of notes\nReleased under the BSD License", "mit"),
]


def test_telling_words_and_the_sql(spark, tmp_path):
    import duckdb

    texts = [t for t, _ in ALIKE] + [MIT_HEADER, BSD_HEADER, *licence_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op4_license_scan"](spark, str(tmp_path))
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    for i, (text, labels) in enumerate(ALIKE[:-1]):
        assert got[i][5] == labels, text
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ", ".join(found.columns)
    want = base.execute(f"SELECT {names} FROM ({queries.ORACLE['op4_license_scan']})").fetchall()
    assert len(want) == len(got) == len(texts)
    for doc_id, *row in want:
        assert got[doc_id][:-1] == tuple(row[:-1]), texts[doc_id]
        assert got[doc_id][-1] == pytest.approx(row[-1])
    assert sum("mit" in r[5] for r in got.values()) > 10


DAY = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute_active(url, at, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[^/?#]*)?([^?#]*)", url or "")
    if not m or not m[1].rstrip(".") or at is None:
        return []
    host = m[1].lower().rstrip(".")
    path = [s for s in m[2].split("/") if s]
    active = []
    latest = {}
    for name, pattern, action, since in entries:
        if None in (name, pattern, since) or action not in ("add", "remove") or since > at:
            continue
        h, *segs = pattern.split("/")
        key = (name, h.lower().rstrip("."), tuple(s for s in segs if s))
        step = (since, action == "remove")
        latest[key] = max(latest.get(key, step), step)
    for (name, h, segs), (_, removed) in latest.items():
        covers = host == h and tuple(path[: len(segs)]) == segs if segs else (
            host == h or host.endswith("." + h)
        )
        if covers and not removed:
            active.append(name)
    return active


def test_lists_against_brute_force(spark):
    rng = random.Random(11)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "X.org", "y.x.org.", "local", "d.net"]
    paths = ["", "/", "/p", "/p/q", "/p//q/r?x=/z", "/P", "/pq", "?u=/p", "#/p", ":80/p/q"]
    patterns = [*hosts, "com", "a.com/p", "B.a.com/p/q/", "x.org/P", "d.net/p/q/r", "local/p"]
    entries = [
        (rng.choice(["s", "t"]), rng.choice(patterns), rng.choice(["add", "add", "remove"]), day(rng.randrange(60)))
        for _ in range(150)
    ]
    entries += [(None, "a.com", "add", DAY), ("s", None, "add", DAY), ("s", "a.com", "drop", DAY)]
    entries += [("s", "a.com", "add", None), ("u", "d.net", "add", day(5)), ("u", "d.net", "remove", day(5))]
    captures = [
        (i, rng.choice(["http://", "HTTPS://u:p@", "ftp://"]) + rng.choice(hosts) + rng.choice(paths), day(rng.randrange(70)))
        for i in range(600)
    ]
    captures += [(900, None, DAY), (901, "no url", DAY), (902, "http:///p", DAY), (903, "http://a.com", None), (None, "http://a.com", day(50))]
    captures += [(5, "http://a.com/p", day(40))] * 3
    frame = spark.createDataFrame(
        [(*c, "k") for c in captures], "page_id long, url string, fetched_on date, key string"
    )
    listed = spark.createDataFrame(entries, "list string, pattern string, action string, dated_on date")
    found = url_lists.evaluate(frame, listed)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = []
    for page, url, at in captures:
        active = brute_active(url, at, entries)
        want.append((page, url, at, len(active), ",".join(sorted(set(active))), bool(active)))
    assert got == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 100
    assert not PYTHON.search(final_plan(found).replace("LogicalRDD", ""))


def test_top_level_domains_are_hosts_too(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.evil.zip/", DAY), (2, "http://zip/p", DAY), (3, "http://zip.com/", DAY)],
        "page_id long, url string, fetched_on date",
    )
    entry = "list string, pattern string, action string, dated_on date"
    for pattern, blocked in (("ZIP.", {1, 2}), ("evil.zip", {1}), ("zip.com", {3})):
        listed = spark.createDataFrame([("s", pattern, "add", DAY)], entry)
        found = url_lists.evaluate(captures, listed).where("blocked").collect()
        assert {r.page_id for r in found} == blocked


def test_lists_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame([("s", "a.com", "add", DAY)], "list string, pattern string, action string, dated_on date")
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert [r.blocked for r in url_lists.evaluate(captures, entries.limit(0)).collect()] == [False]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def brute_records(rows, least):
    last, out = {}, []
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            last[data] = max(last.get(data, page), page)
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        target = last.get(data, page) if len(data) >= least else page
        out.append((page, len(data), digest, "response" if target == page else "revisit", None if target == page else target))
    return out


@pytest.mark.parametrize("least,shard,size", [(0, 64 << 20, 16 << 20), (3, 20_000, 2_000), (0, 3_000, 1)])
def test_archives_round_trip(spark, tmp_path, least, shard, size):
    rng = random.Random(12)
    bodies = ["", "é", "ab", "<p>\r\n\r\n</p>" * 30, *("x" * rng.randint(0, 3000) for _ in range(20))]
    rows = [(i * rng.choice([1, 7919]), rng.choice(["http://a/b c\r\nd", None, "http://é/"]), rng.choice(bodies)) for i in range(300)]
    rows += [(None, None, None), (10**12, "u", "only"), (1, "u", "y" * 3_000_000)]
    folder = str(tmp_path / "archive")
    manifest = warc.write_archives(pages_of(spark, rows).repartition(4), folder, least, shard, size).collect()
    records = warc.read_archives(spark, folder).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=repr) == sorted(brute_records(rows, least), key=repr)
    html = {}
    for page, _, text in rows:
        html.setdefault(page, []).append((text or "").encode())
    assert all(bytes(r.payload) in html[r.page_id] for r in records if r.record_type == "response")
    files = {p.name: p.read_bytes() for p in (tmp_path / "archive").glob("*.warc.gz")}
    assert {m.name: (m.bytes, m.sha1) for m in manifest} == {
        n: (len(b), hashlib.sha1(b).hexdigest()) for n, b in files.items()
    }
    assert sum(m.records for m in manifest) == len(rows)
    assert not (tmp_path / "archive" / "_temporary").exists()
    again = str(tmp_path / "again")
    warc.write_archives(pages_of(spark, rows).repartition(7), again, least, shard, size)
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.warc.gz")}


def test_lost_attempts_leave_nothing(spark, tmp_path):
    (tmp_path / "archive" / "_temporary").mkdir(parents=True)
    (tmp_path / "archive" / "_temporary" / "lost-0-0").write_bytes(b"half a member")
    rows = [(1, "u", "a"), (2, "u", "b")]
    warc.write_archives(pages_of(spark, rows), str(tmp_path / "archive"))
    assert warc.read_archives(spark, str(tmp_path / "archive")).count() == 2
    assert not (tmp_path / "archive" / "_temporary").exists()


def test_damage_is_seen(spark, tmp_path):
    folder = tmp_path / "archive"
    warc.write_archives(pages_of(spark, [(1, "u", "abc")]), str(folder))
    path = next(folder.glob("*.warc.gz"))
    data = next(warc.members(path.read_bytes())).replace(b"abc", b"abd")
    path.write_bytes(warc.gzip_member(data))
    with pytest.raises(Exception, match="wrong block digest"):
        warc.read_archives(spark, str(folder)).collect()


def test_empty_archive(spark):
    assert warc.round_trip(pages_of(spark, []).limit(0)).count() == 0


def test_records_are_in_order_of_the_page(spark, tmp_path):
    rows = [(i, "u", str(i)) for i in range(100)]
    warc.write_archives(pages_of(spark, rows).repartition(5), str(tmp_path / "a"), shard_bytes=30_000)
    ids = []
    for path in sorted((tmp_path / "a").glob("*.warc.gz")):
        ids += [warc.parse(m)[0] for m in warc.members(path.read_bytes())]
    assert ids == list(range(100))


@pytest.mark.parametrize("same", ["page", "null id", "id"])
def test_a_third_of_the_rows_under_one_id(spark, tmp_path, same):
    """Heavy ids and payloads are split, far ids do not matter, shards do not overlap."""
    hot = {
        "page": lambda i: (5, "u", ""),
        "null id": lambda i: (None, "u", f"{i % 7}"),
        "id": lambda i: (5, "u", "x" * i),
    }[same]
    rows = [(i * 3, "v", f"{i % 40}") for i in range(400)]
    rows += [hot(i) for i in range(200)] + [(10**17, "far", "a"), (-(10**17), "far", "b")]
    folder = tmp_path / "a"
    shard = 20 * warc.RECORD_OVERHEAD
    manifest = warc.write_archives(pages_of(spark, rows).repartition(3), str(folder), shard_bytes=shard).collect()
    records = warc.read_archives(spark, str(folder)).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=repr) == sorted(brute_records(rows, 0), key=repr)
    sizes, last = {}, None
    for m in manifest:
        sizes[m.shard] = sizes.get(m.shard, 0) + m.records
    assert len(sizes) >= len(rows) // 40 and max(sizes.values()) <= 60
    for path in sorted(folder.glob("*.warc.gz")):
        ids = [warc.parse(m)[0] for m in warc.members(path.read_bytes())]
        ids = [-(10**18) if i is None else i for i in ids]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]


def test_sizes_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_SHARD_BYTES", 1)
    monkeypatch.setattr(warc, "SHARDS", 10)
    pairs = warc.weighed_pairs(warc.digested(pages_of(spark, [(i, "u", f"{i}") for i in range(500)])))
    borders, shards, _ = warc.shard_borders(pairs)
    assert 10 <= shards <= 11 and len(borders) == shards
