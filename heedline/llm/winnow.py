"""Document fingerprints by winnowing (operator 8).

Every run of GRAM code points gets a rolling hash; of every WINDOW hashes in a row the smallest
is kept (the rightmost of equal ones), with its position.  Any passage of GRAM + WINDOW - 1
code points that two texts share is so sure to give them a common hash.  A text that is shorter
than that would keep one hash alone; of such a text all grams of SHORT_GRAM code points are kept,
so that it has its likeness to others as short, and none to longer ones.  A text shorter than
SHORT_GRAM is one gram; the empty text has no hash.  Null counts as empty.

Likeness is the share of distinct hashes that two fingerprints have in common; two empty
fingerprints are alike (1), an empty one and another are not (0).

``with_next`` gives every document the one that follows it by falling doc_id, rows without
doc_id last, equal ids in the order of a hash of their text; after the last comes the first.
Repeated rows follow each other; a single row follows itself; extra columns are ignored; an empty table
gives an empty result.  Very long texts are fingerprinted whole.  Rows that share one doc_id, or have
none, are one range: it is streamed, but by one task.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 24
WINDOW = 41
SHORT_GRAM = 6
BASE = 0x9E3779B97F4A7C15
RANGE_ROWS = 100_000
_ALL = (1 << 64) - 1


class Winnower:
    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, step in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def short(self, n: int) -> bool:
        return n < self.gram + self.window - 1

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """The hash of every gram, rolled by differences of one running sum."""
        n = len(codes)
        gram = min(SHORT_GRAM if self.short(n) else self.gram, n)
        if not n:
            return np.empty(0, np.uint64)
        self.powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate((codes + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[gram:] - sums[: n + 1 - gram]) * self.down[: n + 1 - gram]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(32)

    def fingerprint(self, text: str) -> np.ndarray:
        """(hash, position) rows in the order of the text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = self.hashes(codes)
        if not len(h):
            return np.empty((0, 2), ">u4")
        # The place from the right in the low bits: the minimum is rightmost among equals.
        low = np.uint64(0xFFFFFFFF)
        least = h << np.uint64(32) | (low - np.arange(len(h), dtype=np.uint64))
        window, span = 1 if self.short(len(codes)) else self.window, 1
        while span < window:
            step = min(span, window - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        chosen = least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])]
        return np.stack([chosen >> np.uint64(32), low - (chosen & low)], 1).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(a[:, 0]), np.unique(b[:, 0])
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(gram, window)
        for batch in batches:
            prints = [winnower.fingerprint(t or "").astype(np.int64) for t in batch.column("text").to_pylist()]
            columns = [pa.array([p[:, i] for p in prints], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "hashes", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by ranges and sorted so that every row stands before its next one.

    Adds ``range`` and ``tail``: the tail row of a range is the first of the range below, there
    only to follow the last row.  The text is shuffled once; ranges that are too large for one
    worker are still streamed, one row at a time.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"),
    ).withColumn("tie", F.xxhash64("text"))
    n = docs.count()
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = keyed.agg(F.percentile_approx("place", shares, F.lit(20 * parts))).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), side="left"))

    ranged = keyed.withColumn("range", range_of("place"))
    # One row per range.
    heads = ranged.groupBy("range").agg(F.max(F.struct("place", "tie")).alias("h")).collect()
    order = sorted(r["range"] for r in heads)
    above = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    table = [(r["range"], r["h"]["place"], r["h"]["tie"], above[r["range"]]) for r in heads]
    table = spark.createDataFrame(table, "range int, head long, head_tie long, above int")
    is_head = (F.col("place") == F.col("head")) & (F.col("tie") == F.col("head_tie"))
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    there = F.struct(F.col("above").alias("range"), F.lit(True).alias("tail"))
    dealt = ranged.join(F.broadcast(table), "range").withColumn(
        "to", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))
    )
    return (
        dealt.select("to.range", "to.tail", "doc_id", "text", "place", "tie")
        .repartition(parts, "range")
        .sortWithinPartitions("range", "tail", F.desc("place"), F.desc("tie"))
        .select("range", "tail", "doc_id", "text")
    )


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_text", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def compared(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness (see ``digests``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower, last, rows = Winnower(gram, window), None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")]
            for at, tail, doc_id, text in zip(*columns):
                own = winnower.fingerprint(text)
                if last and last[0] == at:
                    rows.append(_compare(winnower, last, text, own))
                # Only the first of several equal tail rows is needed.
                last = None if tail else (at, doc_id, text, own)
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, _RESULT)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, _RESULT)

    kinds = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string"
    return with_next(docs).mapInArrow(run, f"{kinds}, near_edited double, near_next double")


def _compare(winnower: Winnower, row: tuple, next_text: str, next_print: np.ndarray) -> dict:
    _, doc_id, text, own = row
    cut = len(text) // 3
    edited = text[: len(text) - cut] + next_text[:cut]
    other = winnower.fingerprint(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_text": edited,
        "fingerprint": own.tobytes().hex(),
        "edited_fingerprint": other.tobytes().hex(),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, next_print),
    }


def digests(docs: DataFrame) -> DataFrame:
    """A fingerprint is written as 16 hex digits a hash: the hash and its position."""
    edited = F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    return compared(docs).select(
        "doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
