"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables written by `stored`, by application.
_written: dict[str, list[str]] = {}


def local_session(cores: str = "*", app: str = "reviewloom") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in its settings.

    A temporary folder is only used by a local master, where driver and
    executors are one process; elsewhere the setting is required.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(shared)
        return shared
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="reviewloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several later steps read, and for cutting the plan of a
    loop: the table survives lost executors and is scanned column by column.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reviewloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def count_stored(spark: SparkSession) -> int:
    """Tables that `stored` has written in this application."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def discard_stored(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables that `stored` wrote after the first `keep`; returns how many.

    For the end of a run, when all results that rest on these tables are written;
    `keep` is count_stored() at its start, so that other work keeps its tables.
    """
    written = _written.get(spark.sparkContext.applicationId, [])
    paths = written[keep:]
    del written[keep:]
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
