"""A keyed Parquet table that is merged when it is read.

A write is a run: new files with the rows it brings (``__kind=rows``) and, apart from them, the keys
that it replaces in earlier runs (``__kind=gone``).  Nothing that is stored is written again for it.
A row counts unless a later run has its key among the replaced ones; those are few, so reading
is a scan and an anti join of it with a small list, or a scan alone if nothing was replaced.

Runs fall in size: when a run is no longer smaller than half of the one before, they are merged
(but for a few small ones), so a table has as many runs as the logarithm of its rows, a row is
written again as often, and the list of replaced keys stays below half of the rows.

The rows of a run are dealt into buckets by the low bits of a hash of the key.  A run has one bit
more when it has twice the rows, so buckets keep their size as the table grows, and a few keys are
looked up by reading their buckets alone.  Rows of a large run stay in the task that reads them, which
writes a file for each bucket; those of small runs and of runs with many buckets are brought together,
so that files are few.

The current runs are listed in one small file, written anew with each change and put in place by
a rename; a failed job leaves the old list current.  One job at a time may write to a table.
"""

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline import schemas
from heedline.operators.joins import cut_down
from heedline.operators.keyed import newest_of_stored
from heedline.session import durable, folder_names, folders_open

BUCKET_ROWS = 1_000_000
# A run is merged with those after it when it has less than so many times their rows.
RATIO = 2
# So many runs of less than a bucket are left as they are.
FEW = 4
# Runs of at least so many rows in at most so many buckets are written where they are read.
DIRECT_ROWS, DIRECT_BUCKETS = 10_000, 8
KEPT_STATES = 5
_ORDER, _GONE, _KIND, _BUCKET = "__order", "__gone", "__kind", "__bucket"


class Table:
    """One keyed table with a fixed schema; ``stamp`` names a column whose least value a run keeps.

    Rows are dealt and looked up by the columns ``lookup``, which are the key unless they are named.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: T.StructType,
        keys: Sequence[str],
        bucket_rows: int = BUCKET_ROWS,
        stamp: str | None = None,
        lookup: Sequence[str] | None = None,
    ):
        self.spark, self.folder, self.schema, self.keys = spark, folder, schema, list(keys)
        self.bucket_rows, self.stamp = bucket_rows, stamp
        self.lookup = self.keys if lookup is None else list(lookup)

    # ---- the list of runs

    def _fs(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _names(self, path: str) -> list[str]:
        return folder_names(self.spark, f"{self.folder}/{path}".rstrip("/"))

    def _state(self) -> tuple[int, list[dict]]:
        """The number of the last change and the current runs, the oldest first."""
        states = [n for n in self._names("_state") if n.endswith(".json")]
        if not states:
            runs = self._adopted()
            return (max((r["order"] for r in runs), default=-1), runs)
        fs, path = self._fs(f"_state/{states[-1]}")
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return int(states[-1][:-5]), json.loads(text)

    def _commit(self, number: int, runs: list[dict]) -> None:
        fs, temporary = self._fs(f"_state/.{number:012d}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        final = self._fs(f"_state/{number:012d}.json")[1]
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"change {number} of {self.folder} was made by another job")
        for name in [n for n in self._names("_state") if n.endswith(".json")][:-KEPT_STATES]:
            fs.delete(self._fs(f"_state/{name}")[1], False)

    def _adopted(self) -> list[dict]:
        """A table of an older layout, whose folders v=n are whole tables or buckets, as one run."""
        current: dict[str, list[str]] = {}
        versions = sorted((n for n in self._names("") if n.startswith("v=")), key=lambda n: int(n[2:]))
        done = [n for n in versions if "_SUCCESS" in self._names(n)]
        for version in done:
            names = self._names(version)
            if not {"kind=add", "kind=put"} & set(names):
                current = {}
            if any(n.startswith("part-") for n in names):
                current[""] = [version]
            for kind in ("kind=all", "kind=put", "kind=add"):
                for bucket in [b for b in self._names(f"{version}/{kind}") if b.startswith("bucket=")] if kind in names else []:
                    earlier = current.get(bucket, []) if kind == "kind=add" else []
                    current[bucket] = [*earlier, f"{version}/{kind}/{bucket}"]
        if not current:
            return []
        paths = [p for own in current.values() for p in own]
        return [self._described(int(done[-1][2:]), paths, [], self._load(paths).count(), 0, 0)]

    def _described(self, order: int, rows: list[str], gone: list[str], n_rows: int, n_gone: int, bits: int) -> dict:
        run = {"order": order, "rows": rows, "gone": gone, "n_rows": n_rows, "n_gone": n_gone, "bits": bits}
        if self.stamp:
            least = F.min(F.coalesce(self.stamp, F.lit(0)))
            run["stamp"] = self._load(rows).agg(least).first()[0]
        return run

    # ---- reading

    def _load(self, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Runs have folders of their own, which Spark wants read one by one; folders of older layouts have none.
        own = [[p] for p in paths if _KIND in p]
        parts = [*own, [p for p in paths if _KIND not in p]] if len(own) < len(paths) else own
        read = lambda some: self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in some])
        # Columns that older files lack are NULL.
        return reduce(DataFrame.unionByName, [schemas.align(read(some), schema) for some in parts])

    def _live(self, runs: list[dict]) -> DataFrame:
        """Rows of ``runs`` that no later one of them replaces."""
        if not runs:
            return self._load([])
        killers = [r for r in runs[1:] if r["n_gone"]]
        last = max((r["order"] for r in killers), default=-1)
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        parts = [self._load(r["rows"]) for r in runs if r["order"] >= last]
        if killers:
            keys = T.StructType([self.schema[k] for k in self.keys])
            gone = union([self._load(r["gone"], keys).withColumn(_GONE, F.lit(r["order"])) for r in killers])
            gone = gone.groupBy(*self.keys).agg(F.max(_GONE).alias(_GONE)).withColumnsRenamed({k: f"__{k}" for k in self.keys})
            old = union([self._load(r["rows"]).withColumn(_ORDER, F.lit(r["order"])) for r in runs if r["order"] < last])
            same = [F.col(k) == F.col(f"__{k}") for k in self.keys]
            parts.append(old.join(gone, [*same, F.col(_ORDER) < F.col(_GONE)], "left_anti").drop(_ORDER))
        return union(parts)

    def is_new(self) -> bool:
        return not self._state()[1]

    def number(self) -> int:
        """Of the last change; -1 if there was none."""
        return self._state()[0]

    def read(self) -> DataFrame:
        return self._live(self._state()[1])

    def _hash(self) -> Column:
        return F.xxhash64(*self.lookup)

    def _found(self, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Stored rows that ``wanted`` looks up, each with the order of its run."""
        n, found = wanted.count(), []
        for run in self._state()[1]:
            schema, hit = T.StructType([self.schema[c] for c in dict.fromkeys([*self.keys, *self.lookup, *columns])]), None
            if n < 2 ** run["bits"]:
                low = self._hash().bitwiseAND(F.lit(2 ** run["bits"] - 1))
                # At most as many as there are buckets.
                hit = [r["b"] for r in wanted.select(low.alias("b")).distinct().collect()]
                schema = schema.add(_BUCKET, T.LongType())
            rows = self._load(run["rows"], schema).withColumn(_ORDER, F.lit(run["order"]))
            found.append(rows if hit is None else rows.where(F.col(_BUCKET).isin(hit)).drop(_BUCKET))
        if not found:
            return self._load([]).select(*dict.fromkeys([*self.keys, *self.lookup, *columns]), F.lit(0).alias(_ORDER))
        return cut_down(reduce(DataFrame.unionByName, found), wanted.select(*self.lookup), self.lookup, n)

    def stored(self, wanted: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
        """Rows (the keys and ``columns``) that ``wanted`` looks up, from the buckets that can hold them.

        ``wanted`` has distinct rows and is read more than once.  What was replaced is included.
        """
        return self._found(wanted, columns).select(*dict.fromkeys([*self.keys, *columns]))

    def current(self, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
        """As ``stored``, without what was replaced: of each key the row of the last run."""
        rest = [c for c in dict.fromkeys([*self.lookup, *columns]) if c not in self.keys]
        last = F.max_by(F.struct(F.lit(1).alias("__"), *rest), _ORDER).alias("last")
        return self._found(wanted, columns).groupBy(*self.keys).agg(last).select(*self.keys, *[f"last.{c}" for c in rest])

    # ---- writing

    def _write_run(self, number: int, order: int, rows: DataFrame, n_rows: int, gone: DataFrame | None) -> dict:
        bits = max(0, -(-n_rows // self.bucket_rows) - 1).bit_length()
        n_gone = gone.count() if gone is not None else 0
        placed = self._placed(rows, n_rows, bits, gone if n_gone else None)
        with folders_open(placed.sparkSession, DIRECT_BUCKETS + 1):
            writer = placed.write.mode("overwrite").partitionBy(_KIND, _BUCKET)
            writer.option("compression", "zstd").parquet(f"{self.folder}/v={number}")
        paths = [[f"v={number}/{_KIND}={kind}"] if n else [] for kind, n in (("rows", n_rows), ("gone", n_gone))]
        return self._described(order, *paths, n_rows, n_gone, bits)

    def _placed(self, rows: DataFrame, n_rows: int, bits: int, gone: DataFrame | None) -> DataFrame:
        """Rows and replaced keys with their kind and bucket, in the tasks that write them."""
        low = self._hash().bitwiseAND(F.lit(2**bits - 1)).alias(_BUCKET)
        placed = rows.select(*self.schema.names, F.lit("rows").alias(_KIND), low)
        # Few files per bucket, large buckets in several.
        brought = lambda some: some.hint("rebalance", _KIND, _BUCKET)
        direct = n_rows >= DIRECT_ROWS and 2**bits <= DIRECT_BUCKETS
        if gone is not None:
            replaced = schemas.align(gone, self.schema)
            replaced = replaced.select(*self.schema.names, F.lit("gone").alias(_KIND), F.lit(0).cast("long").alias(_BUCKET))
            placed = placed.unionByName(brought(replaced) if direct else replaced)
        return placed if direct else brought(placed)

    def _add(self, rows: DataFrame, n_rows: int, gone: DataFrame | None) -> dict:
        number, runs = self._state()
        runs = [*runs, self._write_run(number + 1, number + 1, rows, n_rows, gone)]
        self._commit(number + 1, runs)
        self._merge(number + 2, runs)
        return runs[-1]

    def _merge(self, number: int, runs: list[dict]) -> None:
        """Merge the last runs if they have grown to the size of the one before."""
        size = [r["n_rows"] + r["n_gone"] for r in runs]
        first = len(runs) - 1
        while first and size[first - 1] < RATIO * sum(size[first:]):
            first -= 1
        some = runs[first:]
        if len(some) < 2 or len(runs) <= FEW and sum(size[first:]) < self.bucket_rows:
            return
        keys, gone = T.StructType([self.schema[k] for k in self.keys]), None
        if first:
            # The first run has no earlier rows to replace.
            gone = durable(self._load([p for r in some for p in r["gone"]], keys).distinct(), "replaced-keys")
        n_rows = sum(r["n_rows"] for r in some)
        merged = self._write_run(number, some[-1]["order"], self._live(some), n_rows, gone)
        merged["n_rows"] = self._load(merged["rows"]).count()
        self._commit(number, [*runs[:first], merged])

    def write(self, rows: DataFrame) -> None:
        """Make ``rows`` the whole table; older files stay until they are removed (``remove_unused``)."""
        rows, number = schemas.align(rows, self.schema), self.number() + 1
        n = rows.count()
        self._commit(number, [self._write_run(number, number, rows, n, None)] if n else [])

    def append(self, rows: DataFrame, n: int | None = None) -> DataFrame:
        """Add rows that hold new keys only, or none; returns them as stored, until ``remove_unused``.

        ``n`` is how many they are, where that is known: they are then computed once, as they are written.
        """
        rows = schemas.align(rows, self.schema)
        n = rows.count() if n is None else n
        return self._load(self._add(rows, n, None)["rows"] if n else [])

    def upsert(self, rows: DataFrame, order: list[Column]) -> None:
        """Write ``rows`` over the table; the greatest ``order`` of a key wins among them."""
        self.put(newest_of_stored(durable(schemas.align(rows, self.schema), "given-rows"), self.keys, order))

    def put(self, fresh: DataFrame) -> None:
        """Write ``fresh`` over the table: one row for a key, with all columns, stored or read from what is."""
        n = fresh.count()
        if n:
            replaced = self.stored(fresh.select(*self.keys)).distinct()
            self._add(fresh, n, durable(replaced, "replaced-keys"))

    def change(self, below: int, rows: Callable[[DataFrame], DataFrame]) -> int:
        """Pass the rows of runs whose stamp is less than ``below`` through ``rows``; how many runs these were.

        Only their files are written anew, run by run; the stamps are in the list of runs.
        """
        number, runs = self._state()
        old = [i for i, r in enumerate(runs) if (r.get("stamp") if r.get("stamp") is not None else below) < below]
        for i in old:
            number += 1
            new = self._write_run(number, runs[i]["order"], rows(self._load(runs[i]["rows"])), runs[i]["n_rows"], None)
            runs[i] = new | {c: runs[i][c] for c in ("gone", "n_gone")}
        if old:
            self._commit(number, runs)
        return len(old)

    def remove_unused(self) -> list[str]:
        """Delete the folders that no current run names; nothing may be reading them."""
        used = {p.split("/")[0] for r in self._state()[1] for p in [*r["rows"], *r["gone"]]}
        unused = [n for n in self._names("") if n.startswith("v=") and n not in used]
        for name in unused:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return unused
