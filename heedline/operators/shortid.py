"""Collision-free short ids over all messages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedline import constants as C
from heedline.functions.ids import base32_hash
from heedline.functions.text import filled, left

# Bits 0-19 of the hash, a million buckets of equal weight.
_BUCKET_CHARS = 4


def _shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two 52-character hashes."""
    positions = F.sequence(F.lit(1), F.lit(C.SHORT_ID_MAX))
    same = F.transform(positions, lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference > 0, first_difference - 1).otherwise(C.SHORT_ID_MAX)


def short_id_length(ids: DataFrame, safety: int = 1) -> DataFrame:
    """One row, one column ``n``: the prefix length that tells all ids apart, plus ``safety``.

    In sorted order the longest common prefix of the whole set is found between neighbours, and
    neighbours that share four characters sit in one bucket.  Hashes are uniform, so buckets
    are even; one pass replaces a distinct count per candidate length.
    """
    longest = longest_shared(hashes_of(ids)).agg(F.max("longest").alias("longest"))
    return longest.select(length_for("longest", safety).alias("n"))


def hashes_of(ids: DataFrame) -> DataFrame:
    """(bucket, h): the distinct hashes of ids, in buckets by their first characters."""
    hashes = ids.where(filled("id").isNotNull()).select(base32_hash("id").alias("h")).distinct()
    return hashes.select(left("h", _BUCKET_CHARS).alias("bucket"), "h")


def longest_shared(hashes: DataFrame) -> DataFrame:
    """(bucket, longest): the longest prefix that two hashes of a bucket share; no row for a bucket of one."""
    in_bucket = Window.partitionBy("bucket").orderBy("h")
    neighbours = hashes.select("bucket", "h", F.lag("h").over(in_bucket).alias("previous"))
    shared = _shared_prefix(F.col("h"), F.col("previous")).cast("int")
    return neighbours.where(F.col("previous").isNotNull()).groupBy("bucket").agg(F.max(shared).alias("longest"))


def length_for(longest: Column | str, safety: int = 1) -> Column:
    """Length of short ids when the longest shared prefix of a bucket is ``longest`` (none: NULL)."""
    longest = F.col(longest) if isinstance(longest, str) else longest
    n = F.greatest(F.coalesce(longest, F.lit(0)) + 1, F.lit(C.SHORT_ID_MIN))
    return F.least(n + safety, F.lit(C.SHORT_ID_MAX)).cast("int")


def short_ids(ids: DataFrame, safety: int = 1) -> DataFrame:
    """(id, short_id) for every id.  The length is a scalar subquery of the same plan."""
    length = short_id_length(ids, safety).scalar()
    known = ids.where(filled("id").isNotNull())
    return known.select("id", F.substring(base32_hash("id"), F.lit(1), length).alias("short_id"))


def short_id_column(messages: DataFrame, safety: int = 1, length: int | None = None) -> Column:
    """Short id as an expression over ``id``: the length comes from all ``messages``, or is known
    (``sources.shortids``), the hash from the row itself, so rows need no join to a map of every id."""
    length = short_id_length(messages.select("id"), safety).scalar() if length is None else F.lit(length)
    return F.substring(base32_hash("id"), F.lit(1), length)


def with_short_id(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """Join rows to an id map; ids missing from it get a fixed-length hash prefix."""
    joined = rows.join(id_map, "id", "left")
    fallback = left(base32_hash("id"), C.SHORT_ID_FALLBACK)
    return joined.withColumn("short_id", F.coalesce("short_id", fallback))
