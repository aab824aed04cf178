"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

def local_session(app: str = "tidewatch", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session or its context.

    Where neither is set, the warehouse folder. A path does not tell whether a folder of
    the file system is mounted everywhere, so on a cluster a small table is written there and
    read again before the first use; a folder that loses rows is refused.
    """
    path = _configured(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidewatch"
    path = path.rstrip("/")
    known = (spark.sparkContext.applicationId, path)
    if known not in _SHARED:
        if not spark.sparkContext.master.startswith("local"):
            _probe(spark, path)
        _SHARED.add(known)
    return path


#: (application, folder) that this process found to be shared.
_SHARED: set[tuple[str, str]] = set()


def _configured(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``, or the folder of ``SparkContext.setCheckpointDir``."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)


def _probe(spark: SparkSession, path: str) -> None:
    """Fail if rows written by many tasks to ``path`` do not come back whole."""
    probe = f"{path}/probe-{uuid.uuid4().hex}"
    many = max(2, 2 * spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, many, 1, many).write.parquet(probe)
        found = spark.read.schema("id long").parquet(probe).repartition(many).count()
    except Exception as exc:
        raise RuntimeError(f"cannot write and read {path}; set spark.checkpoint.dir to a folder that all executors share") from exc
    finally:
        _delete(spark, probe)
    if found != many:
        raise RuntimeError(f"{path} gave back {found} of {many} rows; set spark.checkpoint.dir to a folder that all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tasks(spark: SparkSession) -> int:
    """Tasks after a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where a table feeds several consumers or where an iterative plan must
    not grow. Lost executors re-read files; nothing is recomputed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for made in _SCRATCH:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written inside each open :func:`scratch`.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, every table that :func:`materialize` wrote inside.

    A job that returns a lazy result reads these tables until the result is
    written, so the caller that writes it opens this.
    """
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            _delete(spark, path)


def release(df: DataFrame) -> None:
    """Remove the files of a table :func:`materialize` wrote, once nothing reads it.

    Anything outside the shared folder is left alone.
    """
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop_path(f"{shared_dir(spark)}/tables")
    for file in df.inputFiles()[:1]:
        folder = hadoop_path(file).getParent()
        if folder.getParent().toUri().getPath() == root.toUri().getPath():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
