"""Which messages and documents are open, failed or done, kept up by increments.

``pending`` works these sets out by joining all messages and documents with the whole cache.  Here
three tables keep what those joins find, and an increment changes only what it touches:

* ``marks``: for every message id and content hash, how many attempts failed and how many did not.
  A new cache row adds to the marks of its id and hash, one that is written over is taken off.
* ``items``: every message and document with its hash and the marks that it has.
* ``twins``: the items of each hash, by which a change of its marks finds them.

A new item takes up the marks of its id and hash; new marks go to the items that they are about.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline.functions.gist import error_is_set
from heedline.functions.text import model_matches
from heedline.session import durable
from heedline.sources.runs import Table

_COUNTS = [T.StructField("failed", T.LongType()), T.StructField("good", T.LongType())]
_MARKS = T.StructType([T.StructField("mark", T.StringType()), *_COUNTS])
_ITEM = [T.StructField(c, T.StringType()) for c in ("item", "kind", "id", "hash")]
_ITEMS = T.StructType([*_ITEM, *_COUNTS])
_TWINS = T.StructType([T.StructField("hash", T.StringType()), T.StructField("item", T.StringType())])
MESSAGE, DOCUMENT = "email", "pdf"


def _of_id(c: Column | str) -> Column:
    return F.concat(F.lit("i:"), c)


def _of_hash(c: Column | str) -> Column:
    return F.concat(F.lit("h:"), c)


class Standing:
    """The state of all work for one cache key: any gist model, or with ``gist`` unset the model ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "", gist: bool = True):
        self.spark, self.folder, self.key, self.gist = spark, folder, key, gist
        self.marks = Table(spark, f"{folder}/marks", _MARKS, ["mark"])
        self.items = Table(spark, f"{folder}/items", _ITEMS, ["item"])
        self.twins = Table(spark, f"{folder}/twins", _TWINS, ["hash", "item"], lookup=["hash"])

    # ---- what is asked

    def open(self, kind: str) -> DataFrame:
        """(id, hash) of items that nothing was tried for."""
        return self._having(kind, (F.col("failed") == 0) & (F.col("good") == 0))

    def failed(self, kind: str) -> DataFrame:
        """(id, hash) of items for which every attempt failed."""
        return self._having(kind, (F.col("failed") > 0) & (F.col("good") == 0))

    def _having(self, kind: str, state: Column) -> DataFrame:
        return self.items.read().where((F.col("kind") == kind) & state).select("id", "hash")

    # ---- what changes

    def take_in(self, items: DataFrame | None = None, added: DataFrame | None = None, replaced: DataFrame | None = None) -> None:
        """An increment: ``items`` (kind, id, hash) that are new or changed, cache rows that were
        ``added``, and those that they ``replaced``."""
        touched = None
        if items is not None:
            items = items.where(F.col("id").isNotNull()).select(F.concat_ws(":", "kind", "id").alias("item"), "kind", "id", "hash")
            touched = items = durable(items.dropDuplicates(["item"]), "standing-items")
        if added is not None or replaced is not None:
            others = self._marked(self._change(added, replaced))
            if items is not None:
                # Those of the increment are known better.
                others = others.join(items, "item", "left_anti").unionByName(items)
            touched = durable(others, "standing-touched")
        if touched is None:
            return
        own_id = F.when(F.col("kind") == MESSAGE, _of_id("id"))
        wanted = touched.select("item", F.explode(F.array(own_id, _of_hash("hash"))).alias("mark")).where("mark IS NOT NULL")
        marks = self.marks.current(durable(wanted.select("mark").distinct(), "standing-marks"), ["failed", "good"])
        counts = wanted.join(marks, "mark").groupBy("item").agg(F.sum("failed").alias("failed"), F.sum("good").alias("good"))
        self.items.upsert(touched.join(counts, "item", "left").fillna(0, ["failed", "good"]), [F.col("hash")])
        if items is not None:
            pairs = items.where(F.col("hash").isNotNull()).select("hash", "item")
            known = self.twins.stored(durable(pairs.select("hash").distinct(), "standing-hashes"))
            self.twins.append(durable(pairs.join(known, ["hash", "item"], "left_anti"), "standing-twins"))

    def _marked(self, change: DataFrame) -> DataFrame:
        """The items that changed marks are about, by id or by hash."""
        rest = F.substring("mark", F.lit(3), F.length("mark"))
        by_id = change.where(F.startswith("mark", F.lit("i:"))).select(F.concat(F.lit(f"{MESSAGE}:"), rest).alias("item"))
        hashes = change.where(F.startswith("mark", F.lit("h:"))).select(rest.alias("hash"))
        by_hash = self.twins.stored(hashes).select("item")
        wanted = durable(by_id.unionByName(by_hash).distinct(), "standing-others")
        # The hash of an item may have changed since; its marks are looked up by what it is now.
        return self.items.current(wanted, ["kind", "id", "hash"]).select("item", "kind", "id", "hash")

    def _none(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _change(self, added: DataFrame | None, replaced: DataFrame | None) -> DataFrame:
        """Changes the marks by cache rows that came and went; returns the marks that changed."""
        failed = F.coalesce(error_is_set("extracted_json"), F.lit(False)).cast("long")
        change = self._none(_MARKS)
        for rows, sign in ((added, 1), (replaced, -1)):
            if rows is not None:
                about = F.explode(F.array(_of_id("message_id"), _of_hash("content_hash"))).alias("mark")
                counts = (F.lit(sign) * failed).alias("failed"), (F.lit(sign) * (1 - failed)).alias("good")
                rows = rows.where(model_matches("model_name", self.key, self.gist)).select(about, *counts)
                change = change.unionByName(rows.where("mark IS NOT NULL"))
        total = [F.sum(c).alias(c) for c in ("failed", "good")]
        change = durable(change.groupBy("mark").agg(*total).where("failed <> 0 OR good <> 0"), "standing-change")
        stored = self.marks.current(change.select("mark"), ["failed", "good"])
        self.marks.upsert(change.unionByName(stored).groupBy("mark").agg(*total), [F.col("good")])
        return change

    def rebuild(self, items: DataFrame, cache: DataFrame) -> None:
        """From the whole tables, in place of whatever was kept."""
        for table in (self.marks, self.items, self.twins):
            table.write(self._none(table.schema))
        self.take_in(items, added=cache)

    # ---- which changes of the tables it has seen

    def seen(self) -> dict[str, int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seen.json")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def note(self, numbers: dict[str, int]) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seen.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(numbers).encode()))
        out.close()
