"""Structured Streaming ingest of the landing folder."""

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from heedline import schemas
from heedline.operators.pending import new_deliveries
from heedline.session import configure, durable, folder_names
from heedline.sources import landing
from heedline.sources.runs import Table

# Partition columns of the message log: which stream wrote a row, in which micro-batch.
_LOG = T.StructType(
    [*schemas.MESSAGES.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
)


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.RAW_MESSAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def without_recent_repeats(raw: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeated ids arriving within ``delay`` of each other.

    Time is the arrival, not the date of the mail: late and undated mail is never behind the
    watermark.  State holds the ids of one delay only, in RocksDB on the executors' disks, with
    change logs as checkpoints; later repeats are caught by the stored-id test of the sink, so
    nothing is lost or doubled by the bound.
    """
    configure(raw.sparkSession)
    timed = raw.withColumn("arrived", F.current_timestamp())
    return timed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["id"])


# Which stream and micro-batch stored an id.
_INDEX = T.StructType([T.StructField("id", T.StringType()), *_LOG.fields[-2:]])


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_LOG).parquet(folder)


def stored_log(spark: SparkSession, folder: str) -> DataFrame:
    """The ingested messages; ids are unique over all streams and batches."""
    return schemas.align(_log(spark, folder), schemas.MESSAGES)


def id_index(spark: SparkSession, folder: str) -> Table:
    """The index of a log; one that was written before there were indexes gets its own now."""
    index = Table(spark, f"{folder}/_ids", _INDEX, ["id"])
    if index.is_new() and any(n.startswith("stream=") for n in folder_names(spark, folder)):
        index.append(_log(spark, folder).select(*_INDEX.names))
    return index


def ingest(
    raw: DataFrame,
    folder: str,
    checkpoint: str,
    as_of: dt.datetime,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the messages of each micro-batch whose id is not stored yet.

    A batch owns one sub-folder and overwrites it, so a batch replayed after a failure leaves
    the same rows.  Nothing else is rewritten.  Which ids are stored is kept in an index by hash
    buckets beside the log, in which a batch reads the buckets of its ids alone; ids that the batch
    itself has put there, before a failure, do not count.  Mail of any age is taken as long as its
    id is unknown.  One stream at a time may write to a folder; each checkpoint writes under a name
    of its own.
    """
    spark = raw.sparkSession
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    index = id_index(spark, folder)
    empty = spark.createDataFrame([], _LOG)
    empty.write.mode("append").partitionBy("stream", "batch").parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batches = [int(n[6:]) for n in folder_names(spark, f"{folder}/stream={stream}") if n.startswith("batch=")]
        if max(batches, default=-1) > batch_id:
            raise RuntimeError(f"{folder} holds later batches of {checkpoint}; was the checkpoint reset?")
        rows = batch.select(*schemas.RAW_MESSAGES.names)
        ids = durable(rows.select("id").where(F.col("id").isNotNull()).distinct(), "batch-ids")
        known = durable(index.stored(ids, ["stream", "batch"]), "known-ids")
        own = (F.col("stream") == stream) & (F.col("batch") == batch_id)
        fresh = new_deliveries(rows, known.where(~own).select("id"))
        target = f"{folder}/stream={stream}/batch={batch_id}"
        landing.flatten_messages(fresh, F.lit(as_of)).write.mode("overwrite").parquet(target)
        stored = spark.read.schema(schemas.MESSAGES).parquet(target).select("id")
        index.append(
            stored.join(known.where(own), "id", "left_anti").select("id", F.lit(stream).alias("stream"), F.lit(batch_id).alias("batch"))
        )

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def weekly_counts(events: DataFrame, time: str, lateness: str = "7 days") -> DataFrame:
    """Rows per Monday-based week and type; the streaming twin of the week grouping.

    Windows are aligned to the epoch, a Thursday; four days on is a Monday.
    """
    timed = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", lateness)
    week = F.window("at", "7 days", "7 days", "4 days")
    return timed.groupBy(week.alias("week"), "event_type").agg(F.count(F.lit(1)).alias("rows"))
