"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Rows up to which a lookup side is small enough to hint as a broadcast. Such
# rows are a few hundred bytes, so the bound keeps a broadcast near 100 MB;
# beyond it no hint is given and Spark sorts and merges instead.
BROADCAST_ROWS = 300_000

_local_scratch: dict[str, str] = {}


def build_session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries were tuned with."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.sql.session.timeZone", "UTC")
        # Hour files can be small; more of them then share a task.
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tidelog-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never used before."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidelog/{app}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, the same on every machine."""
    fs, target = _file_system(spark, path)
    return str(fs.makeQualified(target).toString())


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a path this library wrote, on whatever file system holds it."""
    fs, target = _file_system(spark, path)
    return bool(fs.delete(target, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return bool(fs.exists(target))


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern (for folder names, not for data files)."""
    fs, target = _file_system(spark, pattern)
    return [str(status.getPath().toString()) for status in fs.globStatus(target) or []]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that is not there yet; False if somebody else made it first."""
    fs, target = _file_system(spark, path)
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    # The whole file appears under its name at once. A rename onto a name that is taken fails.
    done = not fs.exists(target) and fs.rename(hidden, target)
    if not done:
        fs.delete(hidden, False)
    return bool(done)
