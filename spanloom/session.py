"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
_OWN: dict[str, str] = {}


def session(app: str = "spanloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE and UTC. What a cluster or spark-submit has set stays; only ``shuffle_partitions`` given here counts more.

    Off local masters the package is sent to the executors, which need it for the rules that run in Python.
    """
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit, whose settings the JVM knows
        SparkContext._ensure_initialized()
    told = SparkConf()
    ours = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in ours.items():
        if not told.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not _local(spark):
        ship(spark)
    return spark


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors: the driver serves an archive of it, which is deleted when the driver ends."""
    here = os.path.dirname(os.path.abspath(__file__))
    at = tempfile.mkdtemp(prefix="spanloom-")
    atexit.register(shutil.rmtree, at, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(at, "spanloom"), "zip", os.path.dirname(here), os.path.basename(here)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder is made on a local master only; on a cluster no machine's own folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # a core setting can't be changed in a running session, so the folder is remembered here
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spanloom-")
        found = _OWN[app]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until :func:`forget`, for the frames made from it are read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, so never whole in the driver's memory: the join is by sorting.

    For sides that grow with the input. Spark takes a table of :func:`materialize` for as large as its compressed file, and
    exploded rows for as few as those before, so it would broadcast sides a hundred times its threshold.
    """
    return df.hint("merge")


def forget(spark: SparkSession) -> int:
    """Delete the tables written so far, when no frame made from them will be read again; how many there were."""
    n = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
