"""The length of short ids, kept up as ids come in.

Short ids are as long as the longest prefix that any two ids' hashes share asks for.  The hashes are
stored in buckets by their first characters, and with each bucket the longest prefix shared in it.  New
ids are compared with the hashes of their own buckets alone; all others stay unread, so a view needs no
pass over all ids.  Ids are never taken away.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline.operators.shortid import hashes_of, length_for, longest_shared
from heedline.session import durable
from heedline.sources.runs import Table

_HASHES = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("h", T.StringType())])
_LONGEST = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("longest", T.IntegerType())])


class ShortIds:
    def __init__(self, spark: SparkSession, folder: str):
        self.hashes = Table(spark, f"{folder}/hashes", _HASHES, ["bucket", "h"], lookup=["bucket"])
        self.longest = Table(spark, f"{folder}/longest", _LONGEST, ["bucket"])

    def take_in(self, ids: DataFrame) -> None:
        """``ids`` (id), of which any may be known."""
        new = durable(hashes_of(ids), "new-hashes")
        buckets = durable(new.select("bucket").distinct(), "new-buckets")
        stored = durable(self.hashes.stored(buckets), "stored-hashes")
        new = durable(new.join(stored, ["bucket", "h"], "left_anti"), "unknown-hashes")
        # Buckets that nothing new has come to keep what they have.
        changed = stored.join(new.select("bucket").distinct(), "bucket", "left_semi").unionByName(new)
        longest = durable(longest_shared(changed), "longest-shared")
        self.hashes.append(new)
        self.longest.upsert(longest, [F.col("longest")])

    def length(self, safety: int = 1) -> int:
        return self.longest.read().agg(length_for(F.max("longest"), safety).alias("n")).first()["n"]
