"""Operators 7 and 10 against the tokenizers library and exact round trips."""

import hashlib
import json
import random
import zlib
from array import array

import pytest

from siftdesk.llm import bpe, packing, queries, tokens

POOL = "aAaabBbeeetth nsréßÀ́ \u0085 \x1c'sdmlv!?.,<>|Ω漢字😀Σİ1234½\t\n"


def wild_texts(count=300, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 80))) for _ in range(count)]
    return [
        *made,
        "",
        "the<|endoftext|>And<|startoftext|>x <|endoftext",
        "'S'll'RE ''s",
        "x" * 5000,
        "!?" * 2000 + "'s",
        "The quick brown fox. " * 3000,
        "é ́e Ω İstanbul ΑΣ",
    ]


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.word_bpe_path())


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library):
    path = tokens.word_bpe_path()
    texts = wild_texts(3000)
    want = [library_ids(library, t) for t in texts]
    for words in (bpe.dp_words, tokens.library_words):
        small = tokens.ChunkEncoder(path, words(path), chunks=50, words=50)
        assert small.encode([t.encode() for t in texts]) == [tokens.pack(w) for w in want]
    assert all(
        bpe.decode(ids, path) == library.decode(ids, skip_special_tokens=False) for ids in want
    )


def tiny_vocabulary(tmp_path, merges):
    """A byte-level vocabulary with word ends and just these merges."""
    letters = tokens.byte_letters()
    vocab = {t: i for i, t in enumerate([*letters, *(c + "</w>" for c in letters)])}
    for left, right in merges:
        vocab[left + right] = len(vocab)
    spec = json.loads(open(tokens.word_bpe_path(), encoding="utf-8").read())
    spec["model"] |= {"vocab": vocab, "merges": [list(m) for m in merges]}
    spec["added_tokens"] = [t | {"id": len(vocab) + i} for i, t in enumerate(spec["added_tokens"])]
    path = tmp_path / "tiny.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "merges",
    [
        [("a", "a"), ("aa", "a"), ("aa", "a</w>"), ("a", "b")],
        [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a</w>"), ("ba", "b</w>"), ("ab", "ab")],
        [("b", "b"), ("a", "bb"), ("a", "b"), ("ab", "b</w>"), ("bb", "bb"), ("bb", "a")],
    ],
)
def test_every_short_word_of_tiny_vocabularies(tmp_path, merges):
    path = tiny_vocabulary(tmp_path, merges)
    coder, library = bpe.PrefixBpe(path), tokens.load(path)
    for size in range(1, 10):
        for n in range(1 << size):
            word = "".join("ab"[n >> i & 1] for i in range(size))
            assert coder.encode(word) == library.encode(word, add_special_tokens=False).ids, word


def docs_of(spark, texts):
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_encoding_query(spark, library):
    rows, docs = docs_of(spark, [*wild_texts(), None, "again", "again"])
    want = []
    for i, t, _ in rows:
        ids = library_ids(library, t)
        packed = array("I", ids).tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.token_digests(docs.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    full = bpe.encode_texts(docs).collect()
    assert sorted(len(r.ids) // 4 for r in full) == sorted(w[1] for w in want)
    assert all(hashlib.sha256(r.ids).hexdigest() in {w[2] for w in want} for r in full)


def check_packing(pieces, rows, library, length):
    expected = {}
    for i, t, _ in rows:
        expected.setdefault(i, []).append([*library_ids(library, t), 2])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = list(memoryview(p.ids).cast("I"))
        assert len(ids) == p.length > 0
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == expected.keys()
    for i, many in expected.items():
        found = sorted(by_doc[i], key=lambda x: x[0])
        assert sum(len(ids) for _, ids, _ in found) == sum(map(len, many))
        if len(many) == 1:
            at = 0
            for start, ids, total in found:
                assert (start, total) == (at, len(many[0])) and ids == many[0][at : at + len(ids)]
                at += len(ids)
    used = []
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        used.append(at)
    return sum(packing.padding(u, length) for u in used), sum(used)


@pytest.mark.parametrize("length,group", [(4096, 2048), (64, 100), (7, 10_000)])
def test_packing_holds_every_id_once(spark, library, length, group):
    rows, docs = docs_of(spark, [*wild_texts(400, seed=3), None, "again", "again"])
    made = packing.pack(docs.repartition(3), length=length, group_pieces=group)
    assert made.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    padded, used = check_packing(made.collect(), rows, library, length)
    assert padded <= max(length, 0.01 * used) * (1 + used // (group * length))


def test_first_fit_decreasing_against_plain_search():
    rng = random.Random(6)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, free = [], []
        for i, size in enumerate(sizes):
            at = next((b for b, room in enumerate(free) if room >= size), len(bins))
            if at == len(bins):
                bins.append([])
                free.append(100)
            bins[at].append(i)
            free[at] -= size
        assert packing.first_fit_decreasing(sizes, 100) == bins


def test_groups_do_not_follow_keys(spark):
    docs = spark.createDataFrame([(1, "same text")] * 500, "doc_id long, text string")
    cut = packing.pieces(docs, 5, tokens.word_bpe_path(), 4096, 2)
    sizes = [r["count"] for r in cut.groupBy("group").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 200


def test_packing_query_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op7_packing(spark, str(tmp_path)).collect()}
    assert rows[2].ids_crc32 == zlib.crc32(array("I", [2]).tobytes()) and rows[2].doc_tokens == 1
    assert rows[1].sequence_id == rows[2].sequence_id
    assert {rows[1].offset, rows[2].offset} == {0, rows[1].length}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0 and bpe.token_digests(empty).count() == 0


def test_long_ids_beside_a_null_one(spark):
    rows = [(2**60 + 1, "a b c"), (None, "d"), (5, "e"), (2**60 + 3, None)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in packed} == {2**60 + 1, None, 5, 2**60 + 3}
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_words_together_are_the_words_one_by_one():
    path = tokens.word_bpe_path()
    words = tokens.library_words(path)
    draw = random.Random(9)
    some = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(1, 14))) for _ in range(9000)]
    some = list(dict.fromkeys(some)) + ["été", "9", "'s", "!?", "中文"]
    library = tokens.load(path)
    assert [list(tokens.unpack(x)) for x in words(some)] == [
        library.encode(w, add_special_tokens=False).ids for w in some
    ]


def test_words_go_to_the_model_alone(monkeypatch):
    path = tokens.word_bpe_path()
    library = tokens.load(path)
    want = [library.encode(w, add_special_tokens=False).ids for w in ("plain", "été", "'s")]

    class ModelOnly:
        model = library.model

    monkeypatch.setattr(tokens, "load", lambda _: ModelOnly)
    assert [list(tokens.unpack(x)) for x in tokens.library_words(path)(["plain", "été", "'s"])] == want


def test_caches_stay_bounded_and_let_long_chunks_go(library):
    path = tokens.word_bpe_path()
    small = tokens.ChunkEncoder(path, tokens.library_words(path), chunks=20, words=20)
    for n in range(40):
        texts = [f"w{n} common {'x' * 100} <|endoftext|> q{n}", f"common v{n}!"]
        want = [tokens.pack(library_ids(library, t)) for t in texts]
        assert small.encode([t.encode() for t in texts]) == want
        halves = [small.chunks.young, small.chunks.old, small.words.young, small.words.old]
        assert max(map(len, halves)) <= 20 + 10
        assert all(len(key) <= tokens.LONGEST for half in halves for key in half)
    # A batch far beyond the limit is let go as a whole when the next one comes.
    small.encode([" ".join(f"z{n}" for n in range(500)).encode()])
    small.encode([b"one"])
    assert len(small.chunks.old) <= 30


def test_plain_words_are_taken_apart_without_python(library, monkeypatch):
    coder = tokens.ChunkEncoder(tokens.word_bpe_path(), tokens.library_words(tokens.word_bpe_path()))
    seen, pieces = [], coder._pieces
    monkeypatch.setattr(coder, "_pieces", lambda chunk: seen.append(chunk) or pieces(chunk))
    texts = ["Plain ÉTÉ, straße... \t über!?)", ".,; Zaubergarten plain\nplain. it's x1 ¿que? Ωm éa\u0301"]
    want = [tokens.pack(library_ids(library, t)) for t in texts]
    for _ in range(2):
        assert coder.encode([t.encode() for t in texts]) == want
    assert sorted(seen) == sorted(["it's", "x1", "¿que?", "Ωm", "éa\u0301"]) == sorted(coder.chunks.young)


def test_texts_of_nothing_and_of_broken_utf8(library):
    coder = tokens.ChunkEncoder(tokens.word_bpe_path(), tokens.library_words(tokens.word_bpe_path()))
    assert coder.encode([b"", b" \t\n", b""]) == [b""] * 3
    broken = [b"one \xe2\x82 two\xff", b"\xed\xa0\x80", b"", b"caf\xc3 caf\xc3\xa9"]
    want = [tokens.pack(library_ids(library, t.decode("utf-8", "replace"))) for t in broken]
    assert coder.encode(broken) == want


def test_plain_letters_are_words_of_the_library(library):
    coder = tokens.ChunkEncoder(tokens.word_bpe_path(), tokens.library_words(tokens.word_bpe_path()))
    letters, tail = tokens._LETTERS, tokens._TAIL
    texts = [c + "a" + c + t for c in letters for t in ("", *tail)] + [t + u for t in tail for u in tail]
    texts += [chr(c) * 2 + chr(c + 1) for c in range(1, 0x250)]
    want = [tokens.pack(library_ids(library, t)) for t in texts]
    assert coder.encode([t.encode() for t in texts]) == want
