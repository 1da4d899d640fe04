"""Helpers shared by the operators of this subpackage."""

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heedline.session import durable, new_folder

__all__ = [
    "Recent",
    "chunked",
    "dealt",
    "documents",
    "durable",
    "new_folder",
    "numbered",
    "packed",
    "per_process",
    "read_table",
    "released",
    "row_ids",
    "rows_of",
    "small_batches",
    "split_hot",
    "unpacked",
]

ROWS_PER_BUCKET = 200_000
HOT_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def per_process(key, make: Callable):
    """A value kept for the life of a Python worker, so tasks that follow find it again.

    The module of a function sent by value is new in every task; the registry therefore hangs
    on a module that every worker has.
    """
    kept = vars(sys.modules["pyspark"]).setdefault("_heedline_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def released(run: Callable) -> Callable:
    """``run`` (batches to batches); at its end the worker gives back the memory that is free by then.

    Workers live on for the tasks that follow, and would keep as much as their largest task took
    while the joins of later stages fill the executor.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # Where the C library has it.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


class Recent:
    """Values by key, in two generations: what was used of late stays when the bound is reached."""

    def __init__(self, bound: int):
        self.bound, self.now, self.before = bound, {}, {}

    def known(self, keys: set, make: Callable[[list], list]) -> dict:
        """A dictionary that has all ``keys``; ``make`` gives the values of those that are new."""
        if len(self.now) > self.bound:
            self.now, self.before = {}, self.now
        new = []
        for key in keys.difference(self.now):
            found = self.before.get(key)
            if found is None:
                new.append(key)
            else:
                self.now[key] = found
        if new:
            self.now.update(zip(new, make(new)))
        return self.now


def row_ids() -> Iterator[int]:
    """Numbers that are unique over all rows of a stage, for use inside one task."""
    from itertools import count

    from pyspark import TaskContext

    return count(TaskContext.get().partitionId() << 36)


def small_batches(batches: Iterator, rows: int = 128) -> Iterator:
    """Arrow batches cut to few rows, for texts may be long and take many objects each."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def numbered(df: DataFrame, key: str, uid: str, n_rows: int, name: str) -> DataFrame:
    """Numbers the rows of each ``key`` from 0 without gaps, in no particular order.

    A key may hold most of the rows, so each is cut into buckets of about ROWS_PER_BUCKET
    rows (by a hash of ``uid``, which must be unique); rows are numbered within a bucket and
    moved by the counts of the buckets before.
    """
    buckets = 64 + n_rows // ROWS_PER_BUCKET
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    place = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(uid)) - 1
    return (
        dealt.withColumn("__place", place)
        .join(offsets, [key, "__bucket"])
        .withColumn(name, F.col("__place") + F.col("__before"))
        .drop("__bucket", "__place", "__before")
    )


def split_hot(
    left: DataFrame, right: DataFrame, keys: list[str], weight: Column, total: int, how: str = "inner"
) -> DataFrame:
    """Joins ``left`` to ``right`` (unique on ``keys``) when a few keys hold much of ``left``.

    ``weight`` is how many rows of ``left`` a key of ``right`` has.  Keys with at least one
    thousandth of ``total`` rows number a thousand at most, so these go by broadcast; all
    others by a shuffle join.  ``how`` is inner or left.
    """
    bound = max(1, total // HOT_SHARE)
    hot = F.broadcast(right.where(weight >= bound))
    cold = right.where(weight < bound)
    head = left.join(hot, keys)
    rest = left.join(F.broadcast(right.where(weight >= bound).select(*keys)), keys, "left_anti")
    return head.unionByName(rest.join(cold, keys, how))


def dealt(h: np.ndarray, groups: int) -> np.ndarray:
    """The group of each item: a range of hashes, so sorted items are sorted by group."""
    return ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes as steps from one to the next, by bytes of equal rank."""
    steps = np.diff(h, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def chunked(docs: DataFrame, chars: int) -> DataFrame:
    """(chunk, size, rows): rows of ``docs`` with about ``chars`` characters of text, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = row_ids(), [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            data = sink.getvalue()
            columns = [[next(chunk)], [data.size], [pa.compress(data, "zstd", asbytes=True)]]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "size", "rows"])

        for batch in batches:
            for part in small_batches([batch]):
                held.append(part)
                size += part.column("text").nbytes
                if size >= chars:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "chunk long, size long, rows binary")


def rows_of(data: bytes, size: int) -> pa.Table:
    return pa.ipc.open_stream(pa.decompress(data, size, "zstd")).read_all()
