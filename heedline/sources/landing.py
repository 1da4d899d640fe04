"""What arrives from outside: raw messages, attachment bodies, document files
(SURVEY S1, S7, S8, H11)."""

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline import schemas
from heedline.functions import dates, payload, text
from heedline.operators.joins import BROADCAST_KEYS, cut_down
from heedline.session import durable, new_folder
from heedline.sources.runs import Table

# Raised whenever the text that is hashed changes; stored rows of older versions are hashed again.
HASH_VERSION = 2
# What staging adds to a raw record: its time, a digest of all else, a name of the row, its day.
MILLIS, DIGEST, ROW, DAY = "__millis", "__digest", "__row", "__day"
# Blocks of 32,768 rows that may go to every task as bits, 4 KB each, so 32 MB of them.
BROADCAST_BLOCKS = 8_000
_LOAD, _BLOCK, _BITS = "__load", "__block", "__bits"
# Years 1 to 9999.
_FIRST_MILLIS, _LAST_MILLIS = -62_135_596_800_000, 253_402_300_799_999
# Files that are opened by name, and so pass through the driver, at a time.
NAMED_FILES = 10_000
_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("load", T.LongType()),
    ]
)
_HASHED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("modified", T.TimestampType()),
    ]
)


def raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """Landed messages, one JSON object per line; the payload is read as VARIANT."""
    return spark.read.schema(schemas.RAW_MESSAGES).json(path)


def raw_attachments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_ATTACHMENTS).json(path)


def dated(raw: DataFrame) -> DataFrame:
    """``raw`` with ``MILLIS``: when a record was sent by the feed, or, where that can't be read, by its date header."""
    if MILLIS in raw.columns:
        return raw
    feed = F.col("internalDate").try_cast("long")
    if "payload" not in raw.columns:
        return raw.withColumn(MILLIS, feed)
    header = F.when(feed.isNull(), payload.first_header(payload.headers_of("payload"), "Date"))
    marked = raw.withColumn("__date", header)
    return marked.withColumn(MILLIS, F.coalesce(feed, dates.mail_epoch("__date") * 1000)).drop("__date")


def staged(raw: DataFrame, folder: str | None = None, load: int = 0, by_day: bool = True) -> DataFrame:
    """``raw`` written once, by day, with its time (``MILLIS``), a digest and a name for every row.

    What follows reads columns of Parquet: look-back windows prune by day, and repeats are told
    apart by digests, without a payload being read.  Without ``by_day`` payloads are written where
    they are read, for those who take all days.  Payloads are base64, so files are zstd.
    """
    if MILLIS in raw.columns:
        return raw
    others = [F.to_json(F.col(c)) if kind == "variant" else F.col(c).cast("string") for c, kind in raw.dtypes if c != "id"]
    row = F.concat_ws("-", F.lit(load), F.monotonically_increasing_id())
    marked = dated(raw).withColumns({DIGEST: F.xxhash64(*others), ROW: row})
    # Times beyond the years that dates have count as the first or the last day.
    within = F.when(F.col(MILLIS).isNotNull(), F.greatest(F.lit(_FIRST_MILLIS), F.least(F.lit(_LAST_MILLIS), MILLIS)))
    placed = marked.withColumn(DAY, F.timestamp_millis(within).cast("date"))
    folder = folder or new_folder(raw.sparkSession, "staged")
    if by_day:
        writer = placed.hint("rebalance", DAY).write.partitionBy(DAY)
    else:
        writer = placed.write
    writer.mode("overwrite").option("compression", "zstd").parquet(folder)
    return raw.sparkSession.read.schema(placed.schema).parquet(folder)


class Landing:
    """A landing folder of raw messages and what was staged of it; files are read once.

    Files are told apart by path, time and length.  A file that changed is staged again, so its
    records become further deliveries.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str):
        self.spark, self.path, self.folder = spark, path, folder
        self.files = Table(spark, f"{folder}/files", _FILES, ["path"])

    def _loads(self) -> int:
        return self.files.read().agg(F.coalesce(F.max("load") + 1, F.lit(0))).first()[0]

    def take_in(self) -> int:
        """Stage the files that are new; how many these were."""
        listed = changed_files(self.spark, self.path, self.files)
        names, load = [r["path"] for r in listed.select("path").toLocalIterator()], self._loads()
        for at in range(0, len(names), NAMED_FILES):
            some = names[at : at + NAMED_FILES]
            # A load that was not recorded, for the job failed, is written over.
            staged(self.spark.read.schema(schemas.RAW_MESSAGES).json(exactly(some)), f"{self.folder}/rows/load={load}", load)
            done = listed.where(F.col("path").isin(some)) if len(names) > len(some) else listed
            self.files.upsert(done.withColumn("load", F.lit(load).cast("long")), [F.col("modified")])
            load += 1
        return len(names)

    def read(self) -> DataFrame:
        """All staged records, with the columns that ``staged`` adds."""
        kinds = [*schemas.RAW_MESSAGES.fields, T.StructField(MILLIS, T.LongType()), T.StructField(DIGEST, T.LongType())]
        schema = T.StructType([*kinds, T.StructField(ROW, T.StringType()), T.StructField(DAY, T.DateType()), T.StructField("load", T.LongType())])
        loads = self._loads()
        if not loads:
            return self.spark.createDataFrame([], T.StructType(schema.fields[:-1]))
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/rows")
        return rows.where(F.col("load") < loads).drop("load")


def exactly(names: list[str]) -> list[str]:
    """Paths that stand for one file each, whatever characters they have; see ``local_path`` for those without a scheme."""
    quoted = [re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names]
    return [f"file:{n}" if n.startswith("/") else n for n in quoted]


def changed_files(spark: SparkSession, path: str, known: Table) -> DataFrame:
    """(path, modified, length) of the files below ``path`` that ``known`` lacks; no file is opened."""
    listed = _files(spark, path).select("path", F.col("modificationTime").alias("modified"), "length")
    fresh = listed.join(known.read().select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
    return durable(fresh, "changed-files")


def picked(raw: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows of staged ``raw`` that ``picks`` lists by id and name (``ROW``), each once; picks are stored.

    Too many for a broadcast list go to every task as bits, one for each row of a load, so that payloads
    are picked where they are read.  If the picks lie too far apart for that, or names are not unique,
    rows meet by a shuffle.
    """
    n = picks.count()
    if n <= BROADCAST_KEYS:
        return cut_down(raw, picks, ["id", ROW], n)
    number = F.substring_index(ROW, "-", -1).cast("long")
    blocks, place = {_LOAD: F.substring_index(ROW, "-", 1), _BLOCK: F.bitmap_bucket_number(number)}, F.bitmap_bit_position(number)
    placed = picks.select(*[value.alias(name) for name, value in blocks.items()], place.alias("place"))
    if placed.select(*blocks).distinct().count() <= BROADCAST_BLOCKS:
        # Places are narrower than half-filled blocks of every task.
        bits = placed.repartition(*blocks).groupBy(*blocks).agg(F.bitmap_construct_agg("place").alias(_BITS))
        octet = F.conv(F.hex(F.substring(F.col(_BITS), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = raw.withColumns(blocks).join(F.broadcast(durable(bits, "picked-rows")), list(blocks))
        found = met.where(F.getbit(octet, (place % 8).cast("int")) == 1).select(*raw.columns)
        # All picks are among them.
        if found.count() == n:
            return found
    return cut_down(raw, picks, ["id", ROW], n)


def within_days(raw: DataFrame, as_of: Column | str | dt.date, days: int) -> DataFrame:
    """Messages sent on or after ``as_of - days`` (S1); of staged ones only those days are read."""
    day = dates.cutoff(as_of, days)
    since = F.unix_millis(day.cast("timestamp"))
    if MILLIS in raw.columns:
        return raw.where((F.col(DAY) >= F.date_sub(day.cast("date"), 1)) & (F.col(MILLIS) >= since))
    return dated(raw).where(F.col(MILLIS) >= since).drop(MILLIS)


def flatten_messages(raw: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """Raw records to rows of the messages table (N7).  A pure projection: no shuffle."""
    read = raw.withColumns(
        {"raw_payload": F.to_json(F.col("payload")), "headers": payload.headers_of("payload")}
    )
    headers = F.col("headers")
    staged = read.select(
        "id",
        F.col("threadId").alias("thread_id"),
        F.coalesce("labelIds", F.array().cast("array<string>")).alias("label_ids"),
        "snippet",
        *[
            payload.first_header(headers, header).alias(column)
            for header, column in (
                ("Subject", "subject"),
                ("From", "from_addr"),
                ("To", "to_addr"),
                ("Message-ID", "message_header_id"),
                ("Date", "date"),
            )
        ],
        payload.part_tree("payload", "raw_payload").alias("parts"),
        "raw_payload",
    )
    bodies = staged.withColumns(
        {"body_text": payload.body_text(F.col("parts")), "body_html": payload.body_html(F.col("parts"))}
    )
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of)
    rows = bodies.withColumn("mail", dates.mail_date("date")).withColumns(
        {
            "synced_at": stamp.cast("timestamp"),
            "body_hash": text.body_hash(),
            "internal_date": dates.epoch_of(F.col("mail")),
            "date_wall": F.col("mail.wall"),
            "hash_version": F.lit(HASH_VERSION),
        }
    )
    return schemas.align(rows, schemas.MESSAGES)


def documents(spark: SparkSession, path: str, manifest: str | None = None) -> DataFrame:
    """Document files with the hash of their bytes.

    The bytes stay out of the result: a later stage reads them again for the few that need it.
    With a ``manifest`` folder the hashes are kept there, and only files are read that are new or
    have another time or length than when they were hashed.
    """
    if manifest is None:
        return _hashed(_files(spark, path)).drop("file", "modified")
    known = Table(spark, manifest, _HASHED, ["file"])
    listed = _files(spark, path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    key = ["file", "modified", "size_bytes"]
    fresh = durable(listed.join(known.read().select(*key), key, "left_anti"), "changed-files")
    n = fresh.count()
    if n:
        files = fresh.select(F.col("file").alias("path"))
        known.upsert(durable(_hashed(_named(spark, path, files, n)), "hashed-files"), [F.col("modified")])
    # Files that are gone have no place in the result.
    return known.read().join(listed, key, "left_semi").select("path", "content_hash", "size_bytes")


def document_contents(spark: SparkSession, path: str, hashed: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from wanted hashes to their (content_hash, content), for classifiers that want bytes.

    Which file stands for a content is settled on paths and hashes (``hashed``, or ``documents``);
    then only those files are opened.
    """

    def fetch(wanted: DataFrame) -> DataFrame:
        known = documents(spark, path) if hashed is None else hashed
        wanted = durable(wanted.select("content_hash").distinct(), "wanted-hashes")
        picks = cut_down(known, wanted, ["content_hash"]).groupBy("content_hash").agg(F.min("path").alias("path"))
        picks = durable(picks, "wanted-files")
        files = _named(spark, path, picks.select("path"), picks.count()).select(local_path("path").alias("path"), "content")
        return files.join(F.broadcast(picks) if picks.count() <= BROADCAST_KEYS else picks, "path").select("content_hash", "content")

    return fetch


def _hashed(files: DataFrame) -> DataFrame:
    return files.select(
        local_path("path").alias("path"),
        F.sha2("content", 256).alias("content_hash"),
        F.col("length").alias("size_bytes"),
        F.col("path").alias("file"),
        F.col("modificationTime").alias("modified"),
    )


def _named(spark: SparkSession, path: str, wanted: DataFrame, n: int) -> DataFrame:
    """The ``wanted`` files: by name up to NAMED_FILES, beyond that those of the folder that are among them."""
    if n <= NAMED_FILES:
        names = [r["path"] for r in wanted.collect()]
        return spark.read.format("binaryFile").load(exactly(names)) if names else _files(spark, path).limit(0)
    return cut_down(_files(spark, path).withColumn("__local", local_path("path")), wanted.select(local_path("path").alias("__local")), ["__local"], n)


def _files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path)


def local_path(c: Column | str) -> Column:
    """'file:/a' and 'file:///a' as '/a'; other schemes are kept."""
    return F.regexp_replace(text.col(c), "^file:/+", "/")
