"""Session settings the expressions rely on, and where durable intermediate data goes."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# All are runtime SQL settings; none touches memory, cores or the cluster layout.
SETTINGS = {
    # Naive mail dates count as UTC.
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key: the last one wins, as for header maps.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Batches for Python workers: bounded in rows and, as texts are whole, in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # Let AQE split a skewed join even where that costs one more exchange.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams on the executors' disks, not in their heaps; checkpoints hold the changes.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_removed_at_end: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application that every executor can reach.

    It lies in the folder that ``spark.checkpoint.dir`` names, or in the warehouse, which is
    shared as well.  It is removed when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/heedline-work"
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("executors can't reach the warehouse on the driver's machine; set spark.checkpoint.dir to a shared folder")
    folder = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _removed_at_end:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _removed_at_end.add(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that must not be computed twice (classifier calls) or that several outputs
    read: a lost executor re-reads the table instead of redoing the work.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def folders_open(spark: SparkSession, n: int) -> Iterator[None]:
    """Writes of this block: a task holds up to ``n`` folders open, instead of sorting whole rows by folder.

    For rows in no order; those of further folders are sorted, by their folder alone.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)
