"""Session settings and durable intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. Shuffle partition counts are left to
# the cluster: AQE joins small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go with the tables that use them
}

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else one below the warehouse.

    On a cluster a warehouse on the driver's own disk is no such folder, and an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        own_disk = warehouse.startswith("file:") or "://" not in warehouse
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = f"{warehouse}/eventloom-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _place(spark: SparkSession, path: str):
    """Hadoop's path and file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; what is written there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


@contextmanager
def passing_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for ``written``, which goes with all in it when the block ends.

    Inside, Spark deletes the shuffle files of a query when that query ends, and not when the
    driver collects garbage. Tables made inside should be run once only, or written and read.
    """
    before = spark.conf.get(DROP_SHUFFLES)
    path = fresh_path(spark, name)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield path
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
        place, files = _place(spark, path)
        files.delete(place, True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as compressed columns in the shared folder, which take far less room than checkpointed rows."""
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else fresh_path(spark, "columns")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage.

    Needed where several readers must see the very same rows in the very same
    partitions, also after an executor is lost.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
