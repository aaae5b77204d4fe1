"""The pipeline against its operators by brute force, and the lists of queries."""

import ast
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from siftdesk.llm import line_dedup, packing, queries, simhash, tokens

REPO = Path(__file__).parents[2]
SMALL = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules",
        "toxicity",
        "line_dedup",
        "simhash_near_dedup",
        "packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
    found = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert {int(n.split("_")[0][2:]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    for path in REPO.glob("siftdesk/**/*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else []
            if isinstance(node, ast.ImportFrom):
                names = [node.module or ""]
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


@pytest.fixture
def corpus(spark, tmp_path):
    """Documents with a known fate at each stage, and labels that teach it."""
    rng = random.Random(13)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "en", "or")]

    def sentence(n=40):
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))

    rows, labels, fate = [], [], {}

    def add(text, kind):
        fate[len(rows)] = kind
        rows.append((len(rows), text, "en", "s", len(text)))

    shared = "this line is shared by several of the documents here and long"
    for i in range(120):
        add(sentence(), "clean")
    for i in range(60):
        add(sentence(20) + " idiot scum " + sentence(20), "toxic")
    for i in range(60):
        add(" ".join(w + "###" for w in sentence(40).split()), "bad")
    for i in range(8):
        add(sentence() + "\n" + shared + "\n" + sentence(), "shared")
    long = sentence(3000)
    add(long, "clean")
    add(long + " tail", "copy")
    add("too short", "short")
    for i, kind in fate.items():
        if kind in ("clean", "toxic", "bad"):
            labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), fate, {r[0]: r[1] for r in rows}


def test_every_stage_takes_effect(spark, corpus):
    sf_dir, fate, texts = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs = corpus_pipeline.pinned(docs)
            seen.append({r.doc_id: r for r in docs.collect()})
    kinds = [{k: sum(fate[i] == k for i in rows) for k in set(fate.values())} for rows in seen]
    assert kinds[0]["bad"] == 0 and kinds[0]["short"] == 0
    assert kinds[0]["clean"] == 121 and kinds[0]["toxic"] == 60
    assert kinds[1]["toxic"] == 0 and kinds[1]["clean"] == 121
    holders = [i for i in seen[2] if "this line is shared" in seen[2][i].text]
    assert holders == [max(i for i, k in fate.items() if k == "shared")]
    assert all(r.n_chars == len(r.text) for r in seen[2].values())
    assert kinds[3]["copy"] == 0 and kinds[3]["clean"] == 121 and kinds[3]["shared"] == 8
    library = tokens.load(tokens.word_bpe_path())
    packed = docs.collect()
    assert "ids" not in docs.columns
    for i, row in seen[3].items():
        mine = [p for p in packed if p.doc_id == i]
        total = len(library.encode(row.text, add_special_tokens=False).ids) + 1
        assert sum(p.length for p in mine) == total == mine[0].doc_tokens
    assert {p.doc_id for p in packed} == set(seen[3])


def test_run_gives_the_last_stage(spark, corpus):
    sf_dir, _, _ = corpus
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids_crc32",
    ]
    assert got.where(F.col("length") <= 0).count() == 0 and got.count() > 100


def test_stages_take_empty_and_null_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", 0), (2, "a " * 30, "en", "s", 60)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        folder = tmp_path / str(len(given))
        docs.write.parquet(str(folder / "documents.parquet"))
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        labels.write.parquet(str(folder / "labels.parquet"))
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(folder))
            assert made.count() >= (0 if not given else 0)
        assert line_dedup.dedup_documents(docs).count() == len(given)
        assert simhash.near_duplicates(docs).count() == len(given)
        assert packing.pack(docs).select("doc_id").count() == len(given)


def test_every_group_of_near_copies_keeps_one_row(spark):
    """Missing and repeated ids cost no group its last document."""
    rng = random.Random(17)
    texts = {k: " ".join(rng.choice("abcdefghij") * 3 for _ in range(200)) for k in "ABCDEFG"}
    rows = [
        (3, "A"), (5, "A"), (5, "B"), (5, "B"),  # B has no member but the repeated id
        (None, "A"), (None, "C"), (None, "C"), (None, "D"), (None, "E"),
        (9, "E"), (8, "F"), (8, "G"),
    ]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given = [(i, texts[k] + (" tail" if n % 2 else ""), "en", k, n) for n, (i, k) in enumerate(rows)]
    docs = spark.createDataFrame(given, schema).repartition(3)
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    got = left.collect()
    assert sorted(((r.source, r.doc_id) for r in got)) == [
        ("A", 3), ("B", 5), ("C", None), ("D", None), ("E", 9), ("F", 8), ("G", 8),
    ]
    assert {tuple(r) for r in got} <= set(given)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet{'/*' if Path(SMALL, table + '.parquet').is_dir() else ''}')")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    theirs = sorted((tuple(row[names.index(c)] for c in sorted(names)) for row in want.fetchall()), key=repr)
    frame = queries.QUERIES[name](spark, SMALL)
    mine = sorted((tuple(row[c] for c in sorted(frame.columns)) for row in frame.collect()), key=repr)
    assert sorted(frame.columns) == sorted(names) and mine == theirs


def test_workers_need_not_find_the_package(tmp_path):
    """Run from another folder, without PYTHONPATH: the modules are sent along."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
from siftdesk.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", queries.op10_bpe(spark, {SMALL!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]


def test_columns_pass_through_whatever_their_names(spark):
    line = "a line that stands in very many of the documents, word for word"
    rows = [(i, f"{line}\nown words {i} of a text number {i * 7919} alone", 7, 8, "l", "d", i, None) for i in range(6)]
    names = "doc_id long, text string, _row long, row long, _lines string, _dropped string, drops long, c0 long"
    docs = spark.createDataFrame(rows, names)
    left = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, left, "")
    assert left.columns == kept.columns == docs.columns
    for frame in (left, kept):
        for r in frame.collect():
            assert (r._row, r.row, r._lines, r._dropped, r.drops, r.c0) == (7, 8, "l", "d", r.doc_id, None)
    assert sum(line in r.text for r in left.collect()) == 1
