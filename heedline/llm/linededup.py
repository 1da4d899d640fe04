"""Line dedup by levelled sorted runs of line hashes (operator 3).

A line's key is the line without white space at its ends, ASCII letters lower-cased; lines
whose key has fewer than ``min_chars`` code points are never dropped.  ``LineRuns`` keeps what
is known of keys as sorted runs, each bucketed by hash and sorted within the buckets.  A batch
of documents is counted per key and merge-joined against the runs: keys that no run has (the
anti-join) are new and are written with their owner, known ones with their count alone, as one
new run of level 0.  When a level has FANOUT runs, they are merged into one run of the next.
Equal buckets hold equal hashes, so no join or merge of runs shuffles again.

Batches come by falling doc_id, so the owner, the largest doc_id that holds a key, is settled
when the key is first seen; counts are complete when the last batch is in.

A key is two independent 64-bit hashes.  Null and empty texts are one empty line.  Documents
are told apart by doc_id: rows that share one count once and keep or lose the same keys; rows
without doc_id are told apart by their text and come after all others.  Extra columns stay as
they are in ``drop_lines``; an empty table stays empty.  A very long text travels whole, with as
many hashes as it has distinct lines.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heedline.llm.common import durable, new_folder, released, split_hot

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3
# Where the order numbers of rows without doc_id begin.
NO_DOC = -(1 << 63)
KEY = ["h1", "h2"]


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, int] | None]:
    """The hashes of each line's key, None for short keys."""
    import xxhash

    out = []
    for line in text.split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        # At most four bytes a code point, at least one.
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            whole = xxhash.xxh3_128_intdigest(key)
            out.append(((whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)))
    return out


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc): the distinct keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, doc = [], [], []
            for d, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                for key in set(line_keys((text or "").encode("utf-8", "replace"), min_chars)) - {None}:
                    h1.append(key[0])
                    h2.append(key[1])
                    doc.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h1, h2, doc)], [*KEY, "doc"])

    return docs.select(doc_key().alias("doc"), "text").mapInArrow(released(run), "h1 long, h2 long, doc long")


class LineRuns:
    """What is known of line keys: (h1, h2, n_docs, owner), in runs by level.

    Runs are tables in the shared folder; the list of runs is the only state outside them.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.root = new_folder(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, df: DataFrame, level: int) -> None:
        self.written += 1
        name = f"line_run_{self.root.rsplit('-', 1)[-1]}_{self.written}"
        (
            df.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self.root}/{self.written}")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Merge joins of sorted runs; equal buckets meet without a shuffle."""
        runs = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*KEY, F.col("n_docs").alias("n"), F.col("owner").alias("o"))
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            owner = F.greatest("owner", "o").alias("owner")
            runs = runs.hint("merge").join(other, KEY, "full").select(*KEY, n.alias("n_docs"), owner)
        return runs

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of (h1, h2, doc), all documents of which come before earlier ones."""
        fresh = lines.dropDuplicates().groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("owner")
        )
        fresh = fresh.repartition(self.buckets, *KEY)
        for names in self.levels:
            for name in names:
                run = self.spark.table(name).select(*KEY, F.lit(True).alias("seen"))
                # The merge anti-join: an owner stays only on keys that the run doesn't have.
                joined = fresh.hint("merge").join(run, KEY, "left")
                fresh = joined.select(*KEY, "n_docs", F.when(F.col("seen").isNull(), F.col("owner")).alias("owner"))
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(self._merged(names), level + 1)
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            level += 1

    def totals(self) -> DataFrame:
        return self._merged([n for names in self.levels for n in names])

    def close(self) -> None:
        """Forgets the table names; the files stay for readers of ``totals``."""
        for name in [n for names in self.levels for n in names]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def doc_key() -> Column:
    """The document of a row: its doc_id; rows without one go by their text and come last."""
    apart = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 60))
    return F.coalesce(F.col("doc_id"), F.lit(NO_DOC) + apart)


def run_batches(lines: DataFrame, batches: int) -> list[DataFrame]:
    """``lines`` cut by falling document into ``batches`` parts of about equal size."""
    shares = [i / batches for i in range(1, batches)]
    cuts = lines.approxQuantile("doc", shares, 0.01) if shares else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    out, below = [], None
    for cut in [*cuts, None]:
        part = lines
        if below is not None:
            part = part.where(F.col("doc") < below)
        if cut is not None:
            part = part.where(F.col("doc") >= cut)
        out.append(part)
        below = cut
    return out


def drop_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``docs`` without lines that ``min_docs`` documents share, except in the owner of each.

    ``text`` holds the lines that stay (null stays null); ``n_lines`` and ``n_dropped`` are
    added, and take the place of columns of these names.  Names that begin with ``__line_`` are
    the operator's own.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    lines = durable(lines_of(docs, min_chars), "lines")
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in run_batches(lines, batches):
        runs.add(batch)
    shared = durable(runs.totals().where(F.col("n_docs") >= min_docs), "shared-lines")
    runs.close()
    found = split_hot(lines, shared, KEY, F.col("n_docs"), lines.count())
    drops = found.where(F.col("doc") < F.col("owner")).groupBy("doc")
    drops = drops.agg(F.collect_set(F.struct(*KEY)).alias("__line_drops")).withColumnRenamed("doc", "__line_doc")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = batch.column("text").to_pylist(), [], []
            for i, drop in enumerate(batch.column("__line_drops").to_pylist()):
                text = texts[i] or ""
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                if drop:
                    gone = {(d["h1"], d["h2"]) for d in drop}
                    keys = line_keys(text.encode("utf-8", "replace"), min_chars)
                    kept = [x for x, key in zip(text.split("\n"), keys) if key not in gone]
                    n_dropped[-1] = n_lines[-1] - len(kept)
                    texts[i] = "\n".join(kept)
            columns = {f.name: c for f, c in zip(batch.schema, batch.columns) if f.name != "__line_drops"}
            columns["text"] = pa.array(texts, pa.string())
            columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    with_drops = docs.withColumn("__line_doc", doc_key()).join(drops, "__line_doc", "left")
    with_drops = with_drops.select(*docs.columns, "__line_drops")
    return with_drops.mapInArrow(released(strip), schema)


def digests(docs: DataFrame) -> DataFrame:
    kept = F.coalesce("text", F.lit(""))
    return drop_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256")
    )


# ASCII letters only, as for the keys.
SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT lines.*, coalesce(doc_id < owner, false) AS gone FROM lines LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
