"""Session settings and the one place that writes intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowsieve", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators are written for.

    On a cluster leave ``master`` unset and set ``spark.checkpoint.dir`` to a shared folder.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    session = builder.getOrCreate()
    ship(session)
    return session


_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowsieve-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    # One process on one machine, as in tests: its own temporary folder, without touching the session's settings.
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="flowsieve-")
    return _local[application]


SMALL_ROWS = 20_000_000
_written: list = []


def drop_durable() -> None:
    """Remove the intermediate tables written so far. Results not yet saved can no longer be read after it."""
    while _written:
        filesystem, path = _written.pop()
        filesystem.delete(path, True)


def _new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/flowsieve-{tag}-{uuid.uuid4().hex}"


def _remember(spark: SparkSession, path: str, make: bool = False) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        filesystem.mkdirs(target)
    filesystem.deleteOnExit(target)
    _written.append((filesystem, target))


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new empty folder in the shared one. It goes away when the driver ends, or by ``drop_durable``."""
    path = _new_path(spark, tag)
    _remember(spark, path, make=True)
    return path


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A small table over all cores; a large one as it is."""
    if rows > SMALL_ROWS:
        return df
    return df.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // 250)))


# A reader unpacks a whole row group of up to 4,096 rows at once; rows of half a megabyte each need small groups, and a writer that looks at their size often.
WIDE = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 8_000_000) -> Iterator[None]:
    """While it is open, what is written passes to Python in Arrow batches of about ``size`` bytes (Spark's own limit is 64 MB, held on both sides by every
    task, and buffers double as they grow). The session's setting is put back."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def durable(df: DataFrame, tag: str, rows: int | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later passes neither recompute it
    nor depend on the executors that made it. The files go away when the driver ends, or by
    ``drop_durable``.

    A small table may sit in a single input split. If ``rows`` says it is small, it is spread first, so that heavy passes
    over it use all cores; a large table has enough splits and is not shuffled. ``wide`` is for tables whose rows hold whole blocks of points or sets.
    """
    spark = df.sparkSession
    if rows is not None:
        df = spread(df, rows)
    path = _new_path(spark, tag)
    df.write.options(**(WIDE if wide else {})).parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)
