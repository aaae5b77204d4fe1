"""Small helpers shared by the corpus operators."""

import atexit
import os
import shutil
import site
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftdesk.session import pinned, work_dir

__all__ = [
    "batches",
    "empty_if_null",
    "map_texts",
    "pinned",
    "read_table",
    "ship_package",
    "shuffle_partitions",
    "work_dir",
]

#: What `bytes.split()` and `bytes.strip()` take as white space.
ASCII_SPACE = b" \t\n\v\f\r"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the workers, once per application.

    Functions of the package travel by name. Where it is installed, on
    PYTHONPATH or in the working folder, workers find it by themselves.
    """
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages()]
    app = spark.sparkContext.applicationId
    if str(root) in known or app in _shipped:
        return
    _shipped.add(app)
    # Spark serves this file to the executors as long as the driver lives.
    folder = tempfile.mkdtemp(prefix="siftdesk-modules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "siftdesk-modules.zip")
    with zipfile.ZipFile(archive, "w") as file:
        # Folders too: one without __init__ is found by its own entry alone.
        for path in [root / "siftdesk", *sorted((root / "siftdesk").rglob("*"))]:
            if path.suffix == ".py" or path.is_dir() and path.name != "__pycache__":
                file.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterable[tuple], texts: int = 256, size: int = 4_000_000) -> Iterator[list]:
    """(id, text) rows some at a time: bounded in number and in bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += len(row[1])
        if len(held) >= texts or weight >= size:
            yield held
            held, weight = [], 0
    if held:
        yield held


def map_texts(
    frame: DataFrame,
    work: Callable[[Iterable[tuple]], Iterator[tuple]],
    schema: str | T.StructType,
    texts: tuple[str, ...] = ("text",),
    rows: int = 2000,
) -> DataFrame:
    """``mapInArrow`` over rows: ``work`` turns an iterator of input tuples into
    an iterator of output tuples; the columns in ``texts`` come as UTF-8 bytes.

    Output is cut into batches of ``rows``, so that the memory of a task does
    not depend on the number of rows it makes.
    """
    ship_package(frame.sparkSession)
    names = frame.columns
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        def inputs():
            for batch in batches:
                columns = [
                    utf8(batch.column(i)) if name in texts else batch.column(i).to_pylist()
                    for i, name in enumerate(names)
                ]
                yield from zip(*columns)

        made: list[tuple] = []
        for row in work(inputs()):
            made.append(row)
            if len(made) >= rows:
                yield _batch(made, arrow)
                made = []
        if made:
            yield _batch(made, arrow)

    return frame.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
