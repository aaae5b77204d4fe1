"""A deterministic, sharded WARC writer and its reader.

Writing: shards are ranges of (page id, payload digest) of about equal size. The
bytes of every such pair are added up along their order: inside range partitions,
plus what lies before each of them. Where the sum passes a multiple of the shard
size a shard begins, so the borders depend on the pages alone, however the ids are
spread. Rows that share both id and payload and outweigh a shard get shards of
their own and are dealt to them by row number. There are some thousands of shards
at most, as their size grows with the table. A task writes its shard in order, a
gzip member per record, and rolls to the next file
when the compressed size is reached. Every file is written under a temporary
name of its own attempt. Spark's commit of the manifest rows decides which
attempt counts; then the files of the manifest get their final names, which can
be repeated safely, and the manifest is stored beside them. Files that no
manifest names are leftovers of lost attempts and are removed.

The pages are read twice, for their digests and for the records, and payloads are
shuffled once: which pages are revisits is worked out from the digests, and reaches
the writer as a note sorted before the page.

Records: of pages with equal payloads the one with the largest id is a response,
the others are revisits that refer to it; payloads below ``min_payload`` bytes
are always responses. Payload and block digests are SHA-1 in base32, computed
from the bytes written. Reading recomputes them and fails if one differs.

Files are reached through ``pyarrow.fs``, so the folder may be in any store that
it knows. Memory: one record at a time when writing, one file of 256 MB at most
when reading.

Defined results: a null html is an empty payload; a null url is written as
``about:blank``; rows that repeat an id and a payload are responses all; a null
page id is smaller than any other and is read back as null; an empty table makes
an empty archive. Equal pages give equal files however they are partitioned, but
for rows of one id and payload that outweigh a shard: which of these lies in which
of their shards follows their place in the input. Other columns are not read.
"""

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import map_texts, pinned, ship_package, work_dir

#: The size of a shard grows with the table once there would be more than these.
SHARDS = 16384
LEAST_SHARD_BYTES = 64 << 20
LEAST_FILE_BYTES, MOST_FILE_BYTES = 16 << 20, 256 << 20
RECORD_OVERHEAD = 1024
MIN_PAYLOAD = 0
#: The table has no capture times; records need one, and it must not vary.
CAPTURED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard int, part int, temporary string, name string, records long, bytes long, sha1 string"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"


def record(page_id, url, payload: bytes, target, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" if revisit else (
        http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    )
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", _uri(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(target, digest)),
            ("X-Refers-To-Page", str(target)),
        ]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without a time, so equal data give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digested(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest), null payloads as empty ones."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1("html")))


def weighed_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, n, bytes, slice): one row per id and payload.

    Slices are ranges of (page_id, digest); they are written once, as the borders
    between them come from a sample.
    """
    size = F.octet_length("html")
    pairs = pages.groupBy("page_id", "digest").agg(
        F.max(size).cast("long").alias("size"),
        F.count("*").alias("n"),
        F.sum(size + RECORD_OVERHEAD).alias("bytes"),
    )
    sliced = pairs.repartitionByRange(F.col("page_id").asc_nulls_first(), "digest")
    return pinned(sliced.withColumn("slice", F.spark_partition_id()))


def revisits(pairs: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, target): the pairs that refer to another page's record."""
    shared = (
        pairs.where(F.col("size") >= min_payload)
        .groupBy("digest")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("ids"))
        .where("ids > 1")
        .select("digest", "target")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("target"))
    return pairs.join(shared, "digest").where(other).select("page_id", "digest", "target")


def _key(page_id: int | None, digest: bytes) -> tuple:
    return page_id is not None, page_id or 0, digest


def shard_borders(
    pairs: DataFrame, shard_bytes: int | None = None
) -> tuple[list[tuple], int, int]:
    """[(key, shard, parts)] in order of the key, the number of shards, their size.

    A shard holds the pairs from its key to the next one; a pair that outweighs
    a shard has ``parts`` shards.
    """
    slices = pairs.groupBy("slice").agg(F.sum("bytes").alias("bytes")).orderBy("slice").collect()
    total = sum(r["bytes"] for r in slices)  # a row per shuffle partition
    shard_bytes = shard_bytes or max(LEAST_SHARD_BYTES, -(-total // SHARDS))
    offsets, before = [], 0
    for r in slices:
        offsets.append((r["slice"], before))
        before += r["bytes"]
    spark = pairs.sparkSession
    offset = F.broadcast(spark.createDataFrame(offsets, "slice int, offset long"))
    order = Window.partitionBy("slice").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    until = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    summed = pairs.withColumn("until", until).join(offset, "slice")
    based = summed.select(
        F.struct("page_id", "digest").alias("key"),
        F.floor((F.col("offset") + F.col("until") - F.col("bytes")) / shard_bytes).alias("base"),
        F.when(F.col("bytes") > shard_bytes, F.least("n", F.ceil(F.col("bytes") / shard_bytes)))
        .otherwise(0)
        .alias("parts"),
    )
    # Sums pass a multiple of the size, and pairs outweigh it, SHARDS times at most.
    first = (
        based.groupBy("base", F.when(F.col("parts") > 0, F.col("key")).alias("heavy"))
        .agg(F.min("key").alias("key"), F.max("parts").alias("parts"))
        .collect()
    )
    borders, shards = [], 0
    for key, parts in sorted((_key(*r["key"]), max(r["parts"], 1)) for r in first):
        borders.append((key, shards, parts))
        shards += parts
    return borders, max(shards, 1), shard_bytes


def finder(spark: SparkSession, borders: list[tuple]) -> Callable[[str, str], Column]:
    """A function of (page_id, digest): the first shard of a pair and how many it has."""
    ship_package(spark)
    keys = [key for key, _, _ in borders]
    kind = pa.struct([("shard", pa.int32()), ("parts", pa.int32())])

    @F.arrow_udf("shard int, parts int")
    def find(page_ids: pa.Array, digests: pa.Array) -> pa.Array:
        found = []
        for page_id, digest in zip(page_ids.to_pylist(), digests.to_pylist()):
            _, shard, parts = borders[bisect.bisect_right(keys, _key(page_id, digest)) - 1]
            found.append({"shard": shard, "parts": parts})
        return pa.array(found, kind)

    return find


def place(pages: DataFrame, notes: DataFrame, borders: list[tuple]) -> DataFrame:
    """(shard, page_id, digest, kind, url, html, target): notes (kind 0) and pages (1)."""
    find = finder(pages.sparkSession, borders)
    at = find("page_id", "digest")
    placed = pages.withColumn("at", at)
    names = ("page_id", "digest", "kind", "url", "html", "target")
    page = placed.withColumns({"kind": F.lit(1), "target": F.lit(None).cast("long")})
    one = page.where("at.parts = 1").select(F.col("at.shard").alias("shard"), *names)
    parts = [one]
    if any(n > 1 for _, _, n in borders):
        # The rows of heavy pairs are written once, so that their numbers stay.
        many = pinned(
            page.where("at.parts > 1").withColumn("row", F.monotonically_increasing_id())
        )
        dealt = F.pmod(F.xxhash64("row"), F.col("at.parts")).cast("int")
        parts.append(many.select((F.col("at.shard") + dealt).alias("shard"), *names))
    everywhere = F.expr("explode(sequence(at.shard, at.shard + at.parts - 1))")
    empty = {"kind": F.lit(0), "url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}
    noted = notes.withColumn("at", at).withColumns({**empty, "shard": everywhere})
    parts.append(noted.select("shard", *names))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame,
    folder: str,
    min_payload: int = MIN_PAYLOAD,
    shard_bytes: int | None = None,
    file_bytes: int | None = None,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the manifest.

    Sizes that are not given follow from the size of the table.
    """
    spark = pages.sparkSession
    pages = digested(pages)
    pairs = weighed_pairs(pages)
    borders, shards, shard_bytes = shard_borders(pairs, shard_bytes)
    if file_bytes is None:
        file_bytes = min(max(LEAST_FILE_BYTES, shard_bytes // 4), MOST_FILE_BYTES)
    order = ["shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url"]
    sorted_ = (
        place(pages, revisits(pairs, min_payload), borders)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(*order)
    )

    def write(rows):
        store, root = _store(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt = uuid.uuid4().hex
        out, at, noted = None, None, None

        def close():
            out.close()
            name = f"pages-{at[0]:06d}-{at[1]:04d}.warc.gz"
            return (*at, temporary, name, records, size, digest.hexdigest())

        for shard, page_id, sha1, kind, url, html, target in rows:
            if kind == 0:
                noted = (shard, page_id, sha1), target
                continue
            revisit = noted is not None and noted[0] == (shard, page_id, sha1)
            if out is not None and (shard != at[0] or size >= file_bytes):
                yield close()
                out = None
            if out is None:
                at = (shard, at[1] + 1 if at and at[0] == shard else 0)
                temporary = f"_temporary/{attempt}-{at[0]}-{at[1]}"
                out = store.open_output_stream(f"{root}/{temporary}", compression=None)
                records, size, digest = 0, 0, hashlib.sha1()
            member = gzip_member(record(page_id, url, html, noted[1] if revisit else None, revisit))
            out.write(member)
            digest.update(member)
            records, size = records + 1, size + len(member)
        if out is not None:
            yield close()

    manifest = pinned(map_texts(sorted_, write, MANIFEST, texts=("html",), rows=1))

    def commit(rows):
        store, root = _store(folder)
        for row in rows:
            source, final = f"{root}/{row[2]}", f"{root}/{row[3]}"
            if store.get_file_info(source).type != pafs.FileType.NotFound:
                store.move(source, final)
            elif store.get_file_info(final).type == pafs.FileType.NotFound:
                raise FileNotFoundError(f"{row[3]} was written, but is gone")
            yield row

    committed = map_texts(manifest, commit, MANIFEST, texts=(), rows=100)
    committed.write.mode("overwrite").parquet(f"{folder}/manifest")
    store, root = _store(folder)
    if store.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def members(data: bytes):
    """The uncompressed gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        made = [unpacker.decompress(view[at : at + (1 << 20)])]
        end = at + (1 << 20)
        while not unpacker.eof:
            if end >= len(data):
                raise ValueError("a gzip member is cut off")
            made.append(unpacker.decompress(view[end : end + (1 << 20)]))
            end += 1 << 20
        at = min(end, len(data)) - len(unpacker.unused_data)
        yield b"".join(made)


def parse(data: bytes) -> tuple:
    """One record as (page_id, url, payload_bytes, digest, type, refers_to, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4:
        raise ValueError(f"record {fields['WARC-Record-ID']} has the wrong length")
    block = rest[:length]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"].removeprefix("sha1:") != base32_sha1(block):
        raise ValueError(f"record {fields['WARC-Record-ID']} has the wrong block digest")
    payload, size = None, int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest or len(payload) != size:
            raise ValueError(f"record {fields['WARC-Record-ID']} has the wrong payload")
    page_id, target = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return (
        None if page_id is None else int(page_id),
        fields["WARC-Target-URI"],
        size,
        digest,
        fields["WARC-Type"],
        None if target is None else int(target),
        payload,
    )


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive: ``RECORD``; payload is null in revisits, and
    everywhere if ``payloads`` is false. Every digest is checked."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc.gz")
        .load(folder)
        .select("content")
    )

    def records(rows):
        for (content,) in rows:
            for data in members(content):
                row = parse(data)
                yield row if payloads else (*row[:-1], None)

    return map_texts(files, records, RECORD, texts=("content",), rows=500)


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write ``pages`` to a new folder in the shared one and read them back."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    write_archives(pages, folder, min_payload)
    return read_archives(spark, folder, payloads=False)
