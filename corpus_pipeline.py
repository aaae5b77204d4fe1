"""The corpus pipeline: stages over documents, each written and read again."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftdesk.llm import line_dedup, packing, quality_rules, simhash, toxicity
from siftdesk.llm.common import pinned, read_table


def _places(names: list[str]) -> list[str]:
    return [f"c{i}" for i in range(len(names))]


def _by_place(docs: DataFrame) -> DataFrame:
    """Columns named by their place, so that no added one has the name of another."""
    return docs.toDF(*_places(docs.columns))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the learned rules and the base rules accept."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without the lines that repeat elsewhere."""
    names = docs.columns
    left = line_dedup.dedup_documents(docs)
    left = _by_place(left).select(*_places(names)).toDF(*names)
    if "n_chars" not in names:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near duplicates one row stays.

    It is that of the smallest doc_id; rows without an id come last. Every group
    keeps a row, whatever ids are missing or repeat: rows are told apart by a
    number written with them. The texts are shuffled once, by that number, at
    every size of the input.
    """
    names = docs.columns
    rows = pinned(_by_place(docs).withColumn("row", F.monotonically_increasing_id()))
    own = [F.col(f"c{names.index(name)}").alias(name) for name in ("doc_id", "text")]
    kept = pinned(simhash.keepers(rows.select(*own, "row"), "row", words=4, radius=4))
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*_places(names)).toDF(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of the packed sequences."""
    packed = packing.pack(docs, length=4096, end_id=2)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", keep_good_quality),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("packing", pack_sequences),
]

#: Learned stages and token ids are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = pinned(docs)
    return docs
