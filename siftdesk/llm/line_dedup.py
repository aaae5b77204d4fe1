"""Line deduplication over levelled sorted runs of line hashes.

A `LineStore` holds runs: tables bucketed and sorted by line hash, one row per
line with the number of documents that hold it and the largest of their ids.
The documents come in batches. A batch's line hashes are grouped once and
written as a run in the same buckets; the merge joins with the runs already
there need no shuffle and split the batch into fresh lines, which no run holds,
and repeats. The fresh lines are the batch's own run; the repeats only add to
lines of earlier runs. Whenever a level holds ``fan`` runs they are merged into
one of the next level, so a batch meets few runs however many came before.

After the last batch, a line's total is its one fresh row plus its repeats.
Lines found in enough documents lose every occurrence but those in the largest
document id that holds them. Lines with a large share of all occurrences are
broadcast (their counts sum to the occurrences, so at most ``1 / HOT_SHARE`` of
them exist); all others are joined by shuffle, split by adaptive execution.

The runs outlive the session: ``save`` writes down which runs lie in which
level, and ``open`` takes them up again for further batches.

Hashes are MD5 over the line's key, 128 bits. The lines that a row loses depend
on its id and text alone, so they are gathered by id and MD5 of the text: however
many rows share an id, the null one included, no list is longer than the lines of
one text. Documents reach a batch by a hash
of their id, so rows that share an id are one document and meet in one batch;
all null ids are one document, smaller than any other. Null and empty texts
have one empty line. Empty tables give empty results.
"""

import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftdesk.session import remove

from .common import ASCII_SPACE, map_texts, pinned, shuffle_partitions, work_dir

MIN_CODE_POINTS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FAN = 3
HOT_SHARE = 1000


def line_key(line: bytes, min_code_points: int) -> bytes | None:
    """The hash of a UTF-8 line; None if its key is too short to count."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_code_points:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_code_points:
        return None
    return hashlib.md5(key).digest()


def line_hashes(docs: DataFrame, batches: int, min_code_points: int) -> DataFrame:
    """(batch, doc_id, digest, key): each long enough line of a row once; the
    digest is that of the whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows):
        for doc_id, text in rows:
            batch = zlib.crc32(str(doc_id).encode()) % batches
            keys = {line_key(line, min_code_points) for line in text.split(b"\n")} - {None}
            digest = hashlib.md5(text).digest() if keys else None
            for key in keys:
                yield batch, doc_id, digest, key

    return map_texts(
        docs.select("doc_id", "text"),
        work,
        f"batch int, doc_id {kind}, digest binary, key binary",
        rows=20_000,
    )


class LineStore:
    """Levelled runs of (key, n_docs, last_doc, fresh), bucketed by key."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []
        self.folders: dict[str, str] = {}

    def _write(self, frame: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.folders[name] = work_dir(self.spark, "line-run")
        (
            frame.write.bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", self.folders[name])
            .saveAsTable(name)
        )
        return name

    def close(self) -> None:
        """Drop the runs; frames that still read them end here."""
        for name, folder in self.folders.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, folder)
        self.folders.clear()

    def save(self, path: str) -> None:
        """Write down the levels and runs; the runs' own files stay where they are."""
        fields = self.spark.table(self.repeats[0]).schema if self.repeats else []
        made = {
            "buckets": self.buckets,
            "fan": self.fan,
            "levels": self.levels,
            "repeats": self.repeats,
            "folders": self.folders,
            "columns": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields),
        }
        row = self.spark.range(1).select(F.lit(json.dumps(made)).alias("manifest"))
        row.coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "LineStore":
        """The store that was saved at ``path``, its runs known to this session."""
        made = json.loads(spark.read.schema("manifest string").json(path).first()["manifest"])
        store = cls(spark, made["fan"], made["buckets"])
        store.levels, store.repeats = made["levels"], made["repeats"]
        store.folders = made["folders"]
        for name, folder in store.folders.items():
            if not spark.catalog.tableExists(name):
                spark.sql(
                    f"CREATE TABLE {name} ({made['columns']}) USING parquet CLUSTERED BY (key) "
                    f"SORTED BY (key) INTO {store.buckets} BUCKETS LOCATION '{folder}'"
                )
        return store

    def forget(self) -> None:
        """Take the runs out of this session's catalog; their files stay."""
        for name in self.folders:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name).where("fresh") for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of (doc_id, key); return its fresh lines."""
        batch = (
            lines.groupBy("key", "doc_id")
            .agg(F.lit(1).alias("one"))
            .groupBy("key")
            .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        )
        held = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("key", F.lit(True).alias(f"in{i}")), "key", "left")
            held = held | F.coalesce(F.col(f"in{i}"), F.lit(False))
        name = self._write(batch.select("key", "n_docs", "last_doc", (~held).alias("fresh")))
        self.levels[0].append(name)
        self.repeats.append(name)
        self._compact()
        return self.spark.table(name).where("fresh")

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fan:
                return
            merged = self.spark.table(level[0]).where("fresh")
            for name in level[1:]:
                merged = merged.unionByName(self.spark.table(name).where("fresh"))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._write(merged.repartition(self.buckets, "key")))
            level.clear()

    def totals(self) -> DataFrame:
        """(key, n_docs, last_doc) over all batches, one row per line."""
        later = None
        for name in self.repeats:
            part = self.spark.table(name).where("not fresh").select("key", "n_docs", "last_doc")
            later = part if later is None else later.unionByName(part)
        later = later.groupBy("key").agg(
            F.sum("n_docs").alias("more"), F.max("last_doc").alias("later_doc")
        )
        later = pinned(later)
        found = None
        for run in self.runs():
            part = run.join(later, "key", "left").select(
                "key",
                (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "later_doc").alias("last_doc"),
            )
            found = part if found is None else found.unionByName(part)
        return found


def dropped_lines(
    docs: DataFrame,
    min_code_points: int = MIN_CODE_POINTS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, digest, drops): for texts that lose lines, the hashes they lose."""
    spark = docs.sparkSession
    folder = work_dir(spark, "line-hashes")
    try:
        made = line_hashes(docs, batches, min_code_points)
        made.write.partitionBy("batch").parquet(folder)
        lines = spark.read.schema(made.schema).parquet(folder)
        store = LineStore(spark, fan)
        try:
            for batch in range(batches):
                store.add(lines.where(F.col("batch") == batch).drop("batch", "digest"))
            repeated = pinned(store.totals().where(F.col("n_docs") >= min_documents))
        finally:
            store.close()
        return pinned(_drops(lines, repeated))
    finally:
        remove(spark, folder)


def _drops(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    total = lines.count()
    is_hot = F.col("n_docs") * HOT_SHARE >= total
    hot, rest = repeated.where(is_hot), repeated.where(~is_hot)
    lost = ~F.col("doc_id").eqNullSafe(F.col("last_doc"))
    hot_drops = lines.join(F.broadcast(hot), "key").where(lost).select("doc_id", "digest", "key")
    drops = lines.join(rest, "key").where(lost).select("doc_id", "digest", "key")
    return (
        hot_drops.unionByName(drops)
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("key").alias("drops"))
    )


def dedup_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with the remaining lines as text, and n_lines and n_dropped behind.

    One row per input row, all other columns as they were, whatever their
    names. ``options`` are those of ``dropped_lines``.
    """
    min_code_points = options.get("min_code_points", MIN_CODE_POINTS)
    names = docs.columns
    at, key = names.index(text_col), f"c{names.index(id_col)}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = plain.select(F.col(key).alias("doc_id"), F.col(f"c{at}").alias("text"))
    drops = dropped_lines(own, **options).toDF("in_doc", "of_text", "drops")
    digest = F.unhex(F.md5(F.coalesce(plain[f"c{at}"], F.lit("")).cast("binary")))
    # Texts and drops meet by shuffle at every size: the drops grow with the input.
    same = plain[key].eqNullSafe(drops["in_doc"]) & (digest == drops["of_text"])
    joined = plain.join(drops.hint("merge"), same, "left").select(*plain.columns, "drops")

    def work(rows):
        for *row, drop in rows:
            lines = left = row[at].split(b"\n")
            if drop:
                gone = set(drop)
                left = [x for x in lines if line_key(x, min_code_points) not in gone]
            row[at] = b"\n".join(left).decode("utf-8", "replace")
            yield *row, len(lines), len(lines) - len(left)

    schema = T.StructType(
        plain.schema.fields
        + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    made = map_texts(joined, work, schema, texts=(f"c{at}",), rows=1000)
    return made.toDF(*names, "n_lines", "n_dropped")
