"""License scans: an exact set-similarity join of text blocks with templates.

A block is a line of a text. A template matches a block that contains at least
``threshold`` of the template's distinct words. All words of the templates are
ordered by the number of documents that hold them, rarest first, counted over
the whole table. In this order

* prefix filter: a match shares a word among the first |T| - a + 1 words of the
  template and the first |B| - a + 1 of the block, a being the overlap needed;
* length filter: the block has at least a words of templates;
* positional filter: the words behind a shared one must suffice for a;

and what passes is verified by its full overlap. A pair is taken at its first
shared word alone, so none comes twice. Words of no template never count in an
overlap and are left out of the blocks, which changes no result. The template
index is broadcast: its size is that of the templates given.

With ``across_lines`` runs of consecutive words are blocks too, whatever line
breaks they hold, so a notice that is wrapped is measured as a whole. For a
template of m words a run has m / ``threshold`` words at most. It is a block of the
same join, for that template alone, if it begins with a word of the template (any
other holds no more of it) and as many of the template's words as the overlap needs
lie within it. Runs of a text with the same words are one block.

The texts are read once: the words of templates and phrases and their places are
written to the shared folder, a row number beside them, and all else works on those.

Short notices of different licences share most of their words, so a template can
name telling words; after the check of the overlap a block or run must hold them all.

Besides, phrases are looked up as consecutive words. Words are
runs of ASCII letters, digits and non-ASCII characters; only A-Z are lower-cased.
Everything is built from DataFrame functions.

Defined results: a null text is empty and has no words; without any place,
first_word and last_word are null, the labels empty strings and, if no template
matches, the score 0; rows that repeat are scanned each for itself; an empty
table gives an empty result. Other columns are not read.
"""

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import pinned

#: Runs of word characters before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "mit": "Released under the MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files"
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
}

THRESHOLD = 0.8

#: Words without which a block is another licence's notice, however alike.
TELLING = {"mit": "mit", "apache-2.0": "apache 2", "gpl-3": "3", "cc-by-nc-4.0": "nc 4"}


#: A block that any template may match; others name theirs.
ANY = "-"


def template_words(text: str) -> list[str]:
    """Distinct words of an ASCII template, in order."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))


def _one_of(word: Column, words: list[str]) -> Column:
    return F.lower(word).isin(words) & (F.octet_length(word) == F.char_length(word))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def word_frequencies(read: DataFrame) -> dict[str, int]:
    """In how many documents each word of ``held`` occurs."""
    counted = read.select(F.explode("held").alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}  # as many rows as words


def template_index(templates: dict[str, list[str]], order: list[str], threshold: float):
    """Per template: words in the global order, overlap needed, length of its prefix."""
    rank = {word: i for i, word in enumerate(order)}
    index = {}
    for label, words in templates.items():
        words = sorted(words, key=rank.__getitem__)
        needed = max(1, math.ceil(threshold * len(words) - 1e-9))
        index[label] = (words, needed, len(words) - needed + 1)
    return index


def _index_rows(index: dict, telling: dict[str, str]) -> Column:
    rows = [
        F.struct(
            F.lit(str(number)).alias("number"),
            F.lit(word).alias("word"),
            F.lit(i).alias("i"),
            F.lit(label).alias("label"),
            F.lit(needed).alias("needed"),
            _strings(words).alias("words"),
            _strings(telling.get(label, "").split()).alias("telling"),
        )
        for number, (label, (words, needed, prefix)) in enumerate(index.items())
        for i, word in enumerate(words[:prefix])
    ]
    return F.inline(F.array(*rows))


def run_length(text: str, threshold: float) -> int:
    """The most words that a run for a template has."""
    return int(len(re.findall(r"[a-z0-9]+", text.lower())) / threshold + 1e-9)


def run_blocks(own: str, number: int, needed: int, length: int) -> Column:
    """The runs that hold ``needed`` places of a template's words, as "number words".

    The column ``own`` has the places and words (at, word) of the template's words.
    """

    def block(first: Column, k: Column) -> Column:
        inside = F.filter(
            F.slice(own, k + 1, F.lit(length)), lambda o: o["at"] < first["at"] + length
        )
        met = F.array_sort(F.array_distinct(F.transform(inside, lambda o: o["word"])))
        long_enough = F.get(own, k + (needed - 1))["at"] < first["at"] + length
        return F.when(long_enough, F.concat_ws(" ", F.lit(str(number)), met))

    return F.array_compact(F.transform(own, block))


def phrase_places(phrase: str) -> Column:
    """Where the words of the phrase stand consecutively, from 0."""
    parts = phrase.split()
    count, words = len(parts), F.col("flat")

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k in range(1, count):
            found = found & (F.get(words, i + k) == parts[k])
        return found

    # Few texts hold the longest word; only they are walked through.
    possible = F.array_contains("held", max(parts, key=len)) & (F.size("flat") >= count)
    at = F.filter(F.sequence(F.lit(0), F.size("flat") - count), here)
    return F.when(possible, at).otherwise(F.array().cast("array<int>"))


def read_texts(docs: DataFrame, marked: list[str], phrases: dict[str, str], least: int) -> DataFrame:
    """What the scan needs of the texts, written once: doc_id, row, n_words, the
    ``places`` of the phrases, the distinct marked words ``held``, those of each
    line with ``least`` of them, and their places in texts with ``least``."""
    by_line = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda line: F.transform(
            F.regexp_extract_all(line, F.lit(WORD), F.lit(0)),
            lambda w: F.when(_one_of(w, marked), F.lower(w)),
        ),
    )
    # Lower-cased marked words, null for any other. The row number also keeps
    # them from being worked out again per use.
    read = (
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), by_line.alias("by_line")
        )
        .withColumn("flat", F.flatten("by_line"))
        .withColumn("held", F.array_distinct(F.array_compact("flat")))
    )
    lines = F.transform("by_line", lambda ws: F.array_distinct(F.array_compact(ws)))
    hits = F.array_compact(
        F.transform(
            "flat",
            lambda w, i: F.when(w.isNotNull(), F.struct(i.alias("at"), w.alias("word"))),
        )
    )
    return pinned(
        read.select(
            "doc_id",
            "row",
            F.size("flat").cast("long").alias("n_words"),
            F.array(*[phrase_places(phrase) for phrase in phrases]).alias("places"),
            "held",
            F.filter(lines, lambda line: F.size(line) >= least).alias("lines"),
            F.when(F.size("held") >= least, hits).alias("hits"),
        )
    )


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    across_lines: bool = False,
    telling: dict[str, str] | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    ``score`` is the greatest share of a template found in a block, 1 where a
    phrase occurs, and 0 where nothing does. ``telling`` has, by label, words of
    the template that a block must hold whatever its share.
    """
    telling = telling or {}
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    sets = {label: template_words(text) for label, text in templates.items()}
    vocabulary = sorted({word for words in sets.values() for word in words})
    marked = sorted({*vocabulary, *(word for phrase in phrases for word in phrase.split())})
    least = min(max(1, math.ceil(threshold * len(words) - 1e-9)) for words in sets.values())
    read = read_texts(docs, marked, phrases, least)
    frequency = word_frequencies(read)
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    index = template_index(sets, order, threshold)

    made = [F.transform("lines", lambda line: F.concat_ws(" ", F.lit(ANY), line))]
    if across_lines:
        # Written out as columns: inside a lambda they would be worked out per word.
        for n, (label, (words, needed, _)) in enumerate(index.items()):
            own = F.filter("hits", lambda h: h["word"].isin(words))
            read = read.withColumn(f"own{n}", F.when(F.size(own) >= needed, own))
            runs = run_blocks(f"own{n}", n, needed, run_length(templates[label], threshold))
            made.append(F.coalesce(runs, F.array().cast("array<string>")))
    based = read.select(
        "doc_id", "row", "n_words", "places", F.array_distinct(F.concat(*made)).alias("blocks")
    )
    labels = list(phrases.values())
    base = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(
                    _strings(labels),
                    lambda label, i: F.when(F.size(F.get("places", i)) > 0, label),
                ),
                lambda label: label.isNotNull(),
            )
        )
    )
    everywhere = F.flatten("places")
    based = based.select(
        "doc_id",
        "row",
        "n_words",
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        base.alias("base"),
        F.explode_outer("blocks").alias("spelled"),
    )
    based = based.withColumn("parts", F.split("spelled", " ")).withColumns(
        {
            "of": F.get("parts", F.lit(0)),
            "block": F.array_intersect(_strings(order), F.slice("parts", 2, len(marked))),
        }
    )
    prefix = F.slice("block", 1, F.greatest(F.size("block") - least + 1, F.lit(0)))
    probes = based.select("*", F.posexplode_outer(prefix).alias("j", "probe"))
    rows = spark.range(1).select(_index_rows(index, telling))
    left = F.size("block") - F.col("j") - 1
    common = F.array_intersect("block", "words")
    match = (
        (F.col("probe") == F.col("word"))
        & F.col("of").isin(F.lit(ANY), F.col("number"))
        & (F.size("block") >= F.col("needed"))
        & (F.col("j") <= F.size("block") - F.col("needed"))
        & (1 + F.least(left, F.size("words") - F.col("i") - 1) >= F.col("needed"))
        & (F.get(common, F.lit(0)) == F.col("probe"))
        & (F.size(common) >= F.col("needed"))
        & (F.size(F.array_except("telling", "block")) == 0)
    )
    found = probes.join(F.broadcast(rows), match, "left").select(
        "row",
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base",
        "label",
        (F.size(common) / F.size("words")).alias("share"),
    )
    per_row = found.groupBy(
        "row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"
    ).agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    return per_row.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
