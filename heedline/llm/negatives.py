"""Hard-negative mining with coordinate pruning in length buckets (operator 12).

For each anchor: its best rows of the same label (positives), and for each of those the best rows
of another label whose score lies in a band below the positive's.  Both are searches for the best
inner products between a floor and a cap.

Vectors are sorted by length and cut into shards, and a shard into buckets of BUCKET rows.  A
bucket keeps, for every coordinate, its rows sorted by that coordinate of their unit vectors.
With a floor on the score, the length of the anchor and the longest length of the bucket, the
angle between an anchor and a row is bounded; so is, for each of the anchor's FOCUS largest
coordinates, the range in which a row can have that coordinate.  The rows inside all these ranges
are the candidates, whose inner products are computed exactly.  Buckets are visited from long to
short, floors rise on the way, and a bucket too short for its floor ends the search.

An anchor first meets its own shard, which gives it floors.  After that only those shards see it
whose longest length and largest and smallest coordinates allow a score at the floor; all others
are left out before anything is sent.  A task holds one shard and the anchors of CHUNK_SHARDS
shards, so no task grows with the table.  At worst (no floor prunes) every anchor meets every
shard: a stated set of queries against all rows, in blocks.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter
vector counts as filled up with zeros.  Rows of the anchor's own id are never found.  Each anchor
row is mined for itself, also if ids repeat; equal vectors are rows of their own, and ties go to
the smaller id.  Scores are whole numbers of 64 bits.  Extra columns are ignored; no rows give no rows.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedline.llm.common import durable, row_ids
from heedline.llm.topk import usable, whole

POSITIVES, NEGATIVES = 5, 3
# Hundredths of the positive's score that a negative's may have.
BAND = (50, 95)
BUCKET = 512
SHARD_ROWS = 8192
CHUNK_SHARDS = 16
FOCUS = 4
# Shards whose outlines are sent to all tasks at once: some 16 MB at 64 dimensions.
OUTLINES = 16_384
# Candidates are gathered if they are fewer than this share of a bucket.
GATHER = 0.3
EPS = 1e-9

_SHARD = "shard long, vec_id binary, label binary, ask binary, codes binary, longest double, low binary, high binary"
_ASK = "uid long, home long, anchor_id long, label long, codes binary, task array<int>, low array<long>, cap array<long>"
_FOUND = "uid long, task int, vec_id long, score long"


class Asks(NamedTuple):
    """Anchors as arrays, and their tasks: the anchor's place, the task's number, its floor and cap."""

    uid: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    of: np.ndarray
    task: np.ndarray
    low: np.ndarray
    cap: np.ndarray

    @classmethod
    def of_table(cls, table: pa.Table, kind: str) -> "Asks":
        column = lambda c: np.array(table.column(c).to_pylist(), np.int64)
        tasks = table.column("task").to_pylist()
        flat = lambda c: np.array([x for own in table.column(c).to_pylist() for x in own], np.int64)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), kind).reshape(table.num_rows, -1)
        of = np.repeat(np.arange(len(tasks)), [len(t) for t in tasks])
        return cls(column("uid"), column("anchor_id"), column("label"), codes, of, flat("task"), flat("low"), flat("cap"))


class LengthBuckets:
    """The rows of a shard, from long to short."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray):
        length = np.sqrt((codes.astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.labels, self.codes, self.length = ids[order], labels[order], codes[order], length[order]

    def buckets(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows of each bucket, their unit vectors, and the sorted list of each coordinate as places."""
        for lo in range(0, len(self.ids), BUCKET):
            rows = slice(lo, lo + BUCKET)
            unit = self.codes[rows] / np.maximum(self.length[rows, None], 1e-300)
            yield rows, unit, np.argsort(unit, 0, kind="stable")

    @staticmethod
    def candidates(unit: np.ndarray, lists: np.ndarray, asked: np.ndarray, theta: np.ndarray):
        """(places in ``asked`` that meet all rows; rows and places in ``asked`` of the pairs that are left).

        ``asked`` are unit vectors, ``theta`` the least cosine.
        """
        some = np.arange(len(asked))
        focus = np.argsort(-np.abs(asked), 1, kind="stable")[:, :FOCUS]
        axis = np.arccos(np.clip(asked[some[:, None], focus], -1, 1))
        spread = np.arccos(np.clip(theta, -1, 1))[:, None]
        low = np.cos(np.minimum(axis + spread, np.pi)) - EPS
        high = np.cos(np.maximum(axis - spread, 0)) + EPS
        first, last = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            values = unit[lists[:, f], f]
            first[at] = np.searchsorted(values, low[at], "left")
            last[at] = np.searchsorted(values, high[at], "right")
        width = last - first
        narrow = width.argmin(1)
        few = width[some, narrow] < GATHER * len(unit)
        rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(few).tolist():
            j = narrow[i]
            own = lists[first[i, j] : last[i, j], focus[i, j]]
            values = unit[own[:, None], focus[i]]
            own = own[((values >= low[i]) & (values <= high[i])).all(1)]
            rows.append(own)
            places.append(np.full(len(own), i))
        return np.flatnonzero(~few), np.concatenate(rows), np.concatenate(places)

    def search(self, asks: Asks, k: int, same: bool):
        """(task's place, row, score) of the ``k`` best rows of each task, of the same label or of another."""
        # Products stay exact as floats below 2**53; beyond that the sums are made in integers.
        peak = float(np.abs(self.codes).max(initial=0)) * float(np.abs(asks.codes).max(initial=0))
        kind = np.float64 if peak * asks.codes.shape[1] < 2**52 else np.int64
        asked, codes = asks.codes.astype(kind), self.codes.astype(kind)
        size = np.sqrt((asks.codes.astype(float) ** 2).sum(1))
        directions = asks.codes / np.maximum(size[:, None], 1e-300)
        n_tasks = np.bincount(asks.of, minlength=len(asks.uid))
        first_task = np.r_[0, np.cumsum(n_tasks)[:-1]]
        least = asks.low.astype(float)
        best_t, best_r, best_s = (np.empty(0, np.int64),) * 3
        for rows, unit, lists in self.buckets():
            floor = np.full(len(asked), np.inf)
            np.minimum.at(floor, asks.of, least)
            reach = size * self.length[rows.start]
            theta = np.where(reach > 0, floor / np.where(reach > 0, reach, 1), np.where(floor <= 0, -1, 2))
            live = np.flatnonzero(theta <= 1 + EPS)
            if not len(live):
                break
            every, r, a = self.candidates(unit, lists, directions[live], theta[live] - EPS)
            a = live[a]
            score = (codes[rows][r] * asked[a]).sum(1)
            all_ = codes[rows] @ asked[live[every]].T
            r2, a2 = np.nonzero(all_ >= floor[live[every]])
            r, a = np.r_[r, r2] + rows.start, np.r_[a, live[every][a2]]
            score = np.r_[score, all_[r2, a2]]
            keep = ((self.labels[r] == asks.labels[a]) == same) & (self.ids[r] != asks.ids[a])
            r, a, score = r[keep], a[keep], score[keep]
            # A row counts for each task of its anchor in whose band it lies.
            times = n_tasks[a]
            t = np.repeat(first_task[a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            r, score = np.repeat(r, times), np.repeat(score, times).astype(np.int64)
            keep = (score >= least[t]) & (score <= asks.cap[t])
            best_t, best_r, best_s = np.r_[best_t, t[keep]], np.r_[best_r, r[keep]], np.r_[best_s, score[keep]]
            order = np.lexsort((self.ids[best_r], -best_s, best_t))
            best_t, best_r, best_s = best_t[order], best_r[order], best_s[order]
            rank = np.arange(len(best_t)) - np.searchsorted(best_t, best_t)
            best_t, best_r, best_s, rank = (x[rank < k] for x in (best_t, best_r, best_s, rank))
            full = rank == k - 1
            least[best_t[full]] = np.maximum(least[best_t[full]], best_s[full])
        return best_t, best_r, best_s


def _shards(batches: Iterator[pa.RecordBatch], dims: int, kind: str) -> Iterator[pa.RecordBatch]:
    shard = row_ids()
    for batch in batches:
        for lo in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(lo, SHARD_ROWS)
            codes = np.zeros((part.num_rows, dims), kind)
            for i, row in enumerate(part.column("codes").to_pylist()):
                codes[i, : len(row)] = row
            whole_ = lambda c, t: np.array(part.column(c).to_pylist(), t).tobytes()
            row = {
                "shard": next(shard),
                "vec_id": whole_("vec_id", np.int64),
                "label": whole_("label", np.int64),
                "ask": whole_("ask", bool),
                "codes": codes.tobytes(),
                "longest": float(np.sqrt((codes.astype(float) ** 2).sum(1)).max()),
                "low": codes.min(0).tobytes(),
                "high": codes.max(0).tobytes(),
            }
            kinds = [pa.int64(), *[pa.binary()] * 4, pa.float64(), *[pa.binary()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], [*row])


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


class Miner:
    """Shards of (vec_id, label, ask, embedding), written once, and searches in them."""

    def __init__(self, vectors: DataFrame):
        known = usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
        codes = whole(F.col("embedding"))
        length = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        coded = vectors.where(known).select(
            "vec_id", F.col("label").cast("long").alias("label"), F.coalesce("ask", F.lit(False)).alias("ask"), codes.alias("codes")
        )
        peak = F.max(F.array_max(F.transform("codes", lambda x: F.abs(x.cast("double")))))
        size = coded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("codes")).alias("d"), peak.alias("peak")).first()
        dims, peak = max(1, size["d"] or 1), size["peak"] or 0.0
        self.kind = kind = "int16" if peak < 2**15 else "int32" if peak < 2**31 else "int64"
        parts = max(1, -(-size["n"] // SHARD_ROWS))
        sorted_ = coded.withColumn("length", length).repartitionByRange(parts, "length", "vec_id")
        sorted_ = sorted_.sortWithinPartitions("length", "vec_id")
        self.shards = durable(sorted_.mapInArrow(lambda b: _shards(b, dims, kind), _SHARD), "negatives-shards")

    def anchors(self) -> DataFrame:
        """(uid, home, anchor_id, label, codes) of the rows that ask."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uid = row_ids()
            for batch in batches:
                for row in batch.to_pylist():
                    at = np.flatnonzero(np.frombuffer(row["ask"], bool))
                    ids, labels = (np.frombuffer(row[c], np.int64)[at] for c in ("vec_id", "label"))
                    codes = np.frombuffer(row["codes"], kind).reshape(len(row["ask"]), -1)
                    columns = [
                        pa.array([next(uid) for _ in at], pa.int64()),
                        pa.array(np.full(len(at), row["shard"]), pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(labels, pa.int64()),
                        pa.array([codes[i].tobytes() for i in at], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "home", "anchor_id", "label", "codes"])

        schema = "uid long, home long, anchor_id long, label long, codes binary"
        return durable(self.shards.select("shard", "vec_id", "label", "ask", "codes").mapInArrow(run, schema), "negatives-anchors")

    def _met(self, blocks: DataFrame, k: int, same: bool) -> DataFrame:
        """What the anchors of ``blocks`` (shard, chunk, asks) find in their shard."""
        kind = self.kind

        def meet(key, shard: pa.Table, asked: pa.Table) -> pa.Table:
            out = {"uid": [], "task": [], "vec_id": [], "score": []}
            if shard.num_rows and asked.num_rows:
                row = shard.to_pylist()[0]
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("vec_id", "label"))
                rows = LengthBuckets(ids, labels, np.frombuffer(row["codes"], kind).reshape(len(ids), -1))
                asks = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in asked.column("asks").to_pylist()])
                asks = Asks.of_table(asks, kind)
                t, r, s = rows.search(asks, k, same)
                out = {"uid": asks.uid[asks.of[t]], "task": asks.task[t], "vec_id": rows.ids[r], "score": s}
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

        blocks = durable(blocks, "negatives-blocks")
        met = blocks.select(F.col("shard").alias("at"), F.col("chunk").alias("part")).distinct()
        left = self.shards.join(met, F.col("shard") == F.col("at")).select("at", "part", "vec_id", "label", "codes")
        grid = left.groupBy("at", "part").cogroup(blocks.groupBy("shard", "chunk"))
        return grid.applyInArrow(meet, _FOUND)

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """The ``k`` best of every task of ``asks``, as (uid, task, vec_id, score, rank)."""
        context, kind = asks.sparkSession.sparkContext, self.kind
        names = [f.split()[0] for f in _ASK.split(", ")]
        asks = asks.select(names)

        def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for home in pc.unique(table.column("home")).to_pylist():
                    own = table.filter(pc.equal(table.column("home"), home))
                    columns = [pa.array([home], pa.int64()), pa.array([0], pa.int64()), pa.array([_stream(own)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "asks"])

        block = "shard long, chunk long, asks binary"
        first = durable(self._met(asks.mapInArrow(at_home, block), k, same), "negatives-home")
        # The k-th score in the own shard is a floor of the k-th score over all.
        floors = first.groupBy("uid", "task").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        floors = floors.where(F.col("n") >= k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("task", "floor"))).alias("floors"))
        raised = F.transform("task", lambda t, i: F.greatest(F.col("low")[i], F.coalesce(F.col("floors")[t], F.col("low")[i])))
        asks = durable(asks.join(floors, "uid", "left").withColumn("low", raised).select(names), "negatives-asks")

        outlines = self.shards.select("shard", "longest", "low", "high").orderBy("shard").toLocalIterator()
        found, at, more = first, 0, True
        while more:
            some = [r for _, r in zip(range(OUTLINES), outlines)]
            more = len(some) == OUTLINES
            if some:
                found = found.unionByName(self._met(self._allowed(asks, context.broadcast(some), at, block), k, same))
            at += len(some)
        best = Window.partitionBy("uid", "task").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)

    def _allowed(self, asks: DataFrame, outlines, at: int, block: str) -> DataFrame:
        """Blocks of anchors for each shard (not their own) whose outline allows a score at their floor."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = outlines.value
            shards = np.array([r["shard"] for r in some], np.int64)
            longest = np.array([r["longest"] for r in some])
            low, high = (np.stack([np.frombuffer(r[c], kind) for r in some]).astype(float) for c in ("low", "high"))
            for batch in batches:
                table = pa.Table.from_batches([batch])
                own = Asks.of_table(table, kind)
                codes, floor = own.codes.astype(float), np.full(batch.num_rows, np.inf)
                np.minimum.at(floor, own.of, own.low)
                home = np.array(batch.column("home").to_pylist(), np.int64)
                size = np.sqrt((codes**2).sum(1))
                for lo in range(0, len(shards), 256):
                    part = slice(lo, lo + 256)
                    bound = np.maximum(codes, 0) @ high[part].T + np.minimum(codes, 0) @ low[part].T
                    bound = np.minimum(bound, size[:, None] * longest[part]) * (1 + np.copysign(EPS, bound))
                    ok = (bound + EPS >= floor[:, None]) & (home[:, None] != shards[part])
                    for j in np.flatnonzero(ok.any(0)).tolist():
                        kept = table.take(pa.array(np.flatnonzero(ok[:, j])))
                        # Anchors of neighbouring shards travel together; the number follows the batch.
                        chunk = (int(home[0]) >> 36) // CHUNK_SHARDS
                        row = [[int(shards[lo + j])], [chunk], [_stream(kept)]]
                        kinds = (pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["shard", "chunk", "asks"])

        return asks.mapInArrow(run, block)


def hard_negatives(
    vectors: DataFrame, ask: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND
) -> DataFrame:
    """For rows of ``vectors`` (vec_id, label, embedding) where ``ask`` holds: their positives with their negatives.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    miner = Miner(vectors.withColumn("ask", ask))
    anchors = miner.anchors()
    whole_range = {"task": F.array(F.lit(0)), "low": F.array(F.lit(-(1 << 62))), "cap": F.array(F.lit((1 << 62)))}
    found = miner.search(anchors.withColumns(whole_range), positives, True)
    found = durable(found.select("uid", F.col("rank").alias("task"), F.col("vec_id").alias("positive_id"), "score"), "negatives-positives")
    # Whole scores within the band; hundredfold scores may be beyond 64 bits.
    share = lambda part: f"cast(score AS decimal(20, 0)) * {part} / 100"
    low, cap = F.expr(f"cast(ceil({share(band[0])}) AS long)"), F.expr(f"cast(floor({share(band[1])}) AS long)")
    tasks = found.select("uid", "task", low.alias("low"), cap.alias("cap"))
    tasks = tasks.where("low <= cap").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("task", "low", "cap"))).alias("tasks"))
    parts = {c: F.col(f"tasks.{c}") for c in ("task", "low", "cap")}
    mined = miner.search(anchors.join(tasks, "uid").withColumns(parts), negatives, False)
    mined = mined.select("uid", "task", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(anchors.select("uid", "anchor_id"), "uid").withColumnRenamed("score", "positive_score")
    return named.join(mined, ["uid", "task"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = """
WITH codes AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
    list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
