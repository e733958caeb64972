"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
#: Intermediate tables that are still there.
_TABLES: list[tuple[SparkSession, str]] = []


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests on one machine) a
    local folder is made, set on the session and removed at exit.  On a cluster a missing
    setting is an error, as executors could not read each other's local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    _LOCAL_DIRS.append(path[7:])
    return path


def materialize(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint, but stays columnar and
    compressed, and outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path  # type: ignore[attr-defined]
    _TABLES.append((spark, path))
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``materialize`` result that nothing reads any more."""
    path = getattr(df, "_loom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _TABLES[:] = [t for t in _TABLES if t[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at its end all intermediate tables made inside.

    Results are lazy, so what is wanted of them has to be written or collected inside.
    """
    before = {path for _, path in _TABLES}
    try:
        yield
    finally:
        for spark, path in [t for t in _TABLES if t[1] not in before]:
            _delete(spark, path)
        _TABLES[:] = [t for t in _TABLES if t[1] in before]


@contextmanager
def shared_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """The path of a new folder in the shared folder, deleted at the end with what is in it."""
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written or collected inside go as soon as it is, not when the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@atexit.register
def _clean() -> None:
    for spark, path in _TABLES:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; its folder is the cluster's to clean
            break
    for path in _LOCAL_DIRS:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
