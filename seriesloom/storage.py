"""Shared-folder storage for intermediate tables.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir`` (or set with
``SparkContext.setCheckpointDir``), so they outlive any executor. Like Spark's own checkpoints they
stay until the retention policy of that folder removes them; ``released_tables`` removes those of
one run at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Folders that each machine of a cluster has for itself.
MACHINE_LOCAL = ("/tmp/", "/var/tmp/", "/dev/shm/")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_folder: str | None = None
_runs: list[list[str]] = []


def _one_machine(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named for this session; a temporary one in local mode only."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:  # a session over the network has no context
        context = getattr(spark, "sparkContext", None)
        named = context and context.getCheckpointDir()
    if named:
        parsed = urlparse(named)
        on_machine = parsed.scheme in ("", "file") and f"{parsed.path}/".startswith(MACHINE_LOCAL)
        if on_machine and not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"{named} is local to each machine; name a folder every executor can reach")
        return named.rstrip("/")
    if not _one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="seriesloom-")
    return _local_folder


def new_path(spark: SparkSession) -> str:
    """An unused path in the shared folder, noted for ``released_tables``."""
    path = f"{shared_folder(spark)}/seriesloom-{uuid.uuid4().hex}"
    for paths in _runs:
        paths.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def early_cleanup(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of the actions inside go when each action ends: nothing reads them again."""
    return settings(spark, {_CLEANUP: "true"})


def small_batches(spark: SparkSession, rows: int = 500) -> AbstractContextManager[None]:
    """Actions inside read Parquet and feed Python in batches of at most ``rows`` rows, for rows with long texts."""
    now = {key: int(spark.conf.get(key, "0")) for key in _BATCH_ROWS}
    return settings(spark, {key: str(min(n, rows) if n > 0 else rows) for key, n in now.items()})


def bounded_batches(spark: SparkSession, rows: int = 500, max_bytes: int = 2_000_000) -> AbstractContextManager[None]:
    """Actions inside read Parquet in batches of at most ``rows`` rows and feed Python in batches of about ``max_bytes``.

    Narrow rows go to Python as many at a time as ever. A limit of bytes that the session has stays.
    """
    key = _BATCH_ROWS[1]
    return settings(spark, {key: str(min(int(spark.conf.get(key, str(rows))), rows)),
                            _BATCH_BYTES: spark.conf.get(_BATCH_BYTES, None) or str(max_bytes)})


def written_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    Unlike a cached DataFrame the result is fixed: losing an executor cannot make
    Spark recompute non-deterministic columns (partition ids, row ids) differently.
    """
    spark = df.sparkSession
    path = new_path(spark)
    with early_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released_tables(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the intermediate tables stored inside it.

    Results read inside the block must be written or counted there; lazy ones lose their tables.
    """
    paths: list[str] = []
    _runs.append(paths)
    try:
        yield
    finally:
        _runs.remove(paths)
        for path in paths:
            remove(spark, path)
