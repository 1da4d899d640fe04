"""Exact top-k search by inner product with block-at-a-time pruning (operator 2).

Vectors are laid out in blocks of BLOCK neighbours in range; a block keeps a forward index (its
vectors as a matrix) and the largest and smallest value of every component.  For a query, the
sum over components of the larger of q * max and q * min bounds every score in the block, so a
task visits its blocks by falling bound and scores whole blocks until the bound is below the
query's k-th score (equal bounds are still visited, for ties go to the smaller id).

Blocks are grouped into shards, queries into chunks, and a task holds one shard and one chunk.
First each query meets the shard it lies in, which gives a k-th score to start from; then those
other shards whose largest and smallest components allow a score that reaches it: all others are
left out before anything is sent.  Codes are stored in the smallest kind of number that holds them.
At worst (no bound prunes) every query meets every shard, and the bytes that are sent grow with the
square of the rows: a stated set of queries against all rows, in blocks.

Null vectors and vectors with null, NaN or infinite components take no part; a shorter vector
counts as filled up with zeros.  Rows with equal vectors are rows of their own.
A query never finds rows of its own id; what
queries of one id find is merged before the best k are kept.  Extra columns are ignored; no rows give no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedline.llm.common import durable, row_ids

BLOCK = 64
SHARD_ROWS = 8192
CHUNK_SHARDS = 8
PIVOT_BITS = 8
# Shards whose outlines are sent to all tasks at once: some 4 MB at 64 dimensions and 16 bits.
OUTLINES = 16_384

_ROWS = "shard long, n int, ids binary, codes binary, asks binary, high binary, low binary"
_FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(real, F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def _locality(batches, dims: int, kind: str):
    """Signs of a few fixed projections: near vectors often share them, so bounds get tighter."""
    plane = np.random.default_rng(7).standard_normal((dims, PIVOT_BITS))
    for batch in batches:
        rows = batch.column("codes").to_pylist()
        matrix = np.zeros((len(rows), dims), np.int64)
        for i, row in enumerate(rows):
            matrix[i, : len(row)] = row
        sign = (matrix.astype(float) @ plane > 0) @ (1 << np.arange(PIVOT_BITS))
        raw = pa.array([r.tobytes() for r in matrix.astype(kind)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("ask"), pa.array(sign, pa.int64()), raw],
            ["vec_id", "ask", "sign", "codes"],
        )


def _shards(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    shard = row_ids()
    for batch in batches:
        for lo in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(lo, SHARD_ROWS)
            ids = np.array(part.column("vec_id").to_pylist(), np.int64)
            asks = np.array(part.column("ask").to_pylist(), bool)
            codes = b"".join(part.column("codes").to_pylist())
            matrix = np.frombuffer(codes, kind).reshape(len(ids), -1)
            row = [next(shard), len(ids), ids.tobytes(), codes, asks.tobytes(), matrix.max(0).tobytes(), matrix.min(0).tobytes()]
            names = ["shard", "n", "ids", "codes", "asks", "high", "low"]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


class Blocks:
    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(codes, self.starts, axis=0)
        self.low = np.minimum.reduceat(codes, self.starts, axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """(query, vec_id, score) of up to k rows a query that reach ``floor`` and the k best here."""
        # Products stay exact as floats below 2**53; beyond that the sums are made in integers.
        peak = float(np.abs(self.codes).max(initial=0)) * float(np.abs(queries).max(initial=0))
        kind = np.float64 if peak * queries.shape[1] < 2**52 else np.int64
        q, codes = queries.astype(kind), self.codes.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = up @ self.high.T.astype(kind) + down @ self.low.T.astype(kind)
        out = []
        for i in range(len(q)):
            least, best_s, best_v = floor[i], np.empty(0, kind), np.empty(0, np.int64)
            order = np.argsort(-bounds[i], kind="stable")
            sorted_bounds = bounds[i][order]
            at, step = 0, 4
            while at < len(order) and sorted_bounds[at] >= least:
                blocks = order[at : at + step]
                blocks = blocks[bounds[i][blocks] >= least]
                rows = (self.starts[blocks][:, None] + np.arange(BLOCK)).ravel()
                rows = rows[rows < len(self.ids)]
                scores = codes[rows] @ q[i]
                ok = (scores >= least) & (self.ids[rows] != query_ids[i])
                best_s = np.concatenate([best_s, scores[ok]])
                best_v = np.concatenate([best_v, self.ids[rows[ok]]])
                if len(best_s) > k:
                    top = np.lexsort((best_v, -best_s))[:k]
                    best_s, best_v = best_s[top], best_v[top]
                if len(best_s) == k:
                    least = max(least, best_s.min())
                at, step = at + len(order[at : at + step]), step * 2
            out.append((np.full(len(best_s), query_ids[i]), best_v, best_s.astype(np.int64)))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def _unpacked(row: dict, kind: str):
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["codes"], kind).reshape(len(ids), -1).astype(np.int64)


def _reachable(outlines, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (shard, chunk, ids, codes, floors) of queries for each shard, not their own, that may reach their floor."""
    shards = np.array([r["shard"] for r in outlines], np.int64)
    high, low = (np.stack([np.frombuffer(r[c], kind) for r in outlines]).astype(float) for c in ("high", "low"))
    for batch in batches:
        home, ids = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("home", "query_id"))
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), kind).reshape(len(ids), -1)
        floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()], float)
        q = codes.astype(float)
        for lo in range(0, len(shards), 256):
            part = slice(lo, lo + 256)
            bound = np.maximum(q, 0) @ high[part].T + np.minimum(q, 0) @ low[part].T
            # Sums of floats may be a little low.
            ok = (bound + np.abs(bound) * 1e-9 + 1 >= floor[:, None]) & (home[:, None] != shards[part])
            for j in np.flatnonzero(ok.any(0)).tolist():
                some = ok[:, j]
                row = [int(shards[lo + j]), (int(home[0]) >> 36) // CHUNK_SHARDS]
                row += [ids[some].tobytes(), codes[some].tobytes(), floor[some].tobytes()]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
                names = ["shard", "chunk", "ids", "codes", "floors"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def top_k(vectors: DataFrame, ask: Column, k: int) -> DataFrame:
    """The ``k`` best rows for each row of ``vectors`` (vec_id, embedding) where ``ask`` holds.

    Returns query_id, rank, vec_id, score.
    """
    coded = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.coalesce(ask, F.lit(False)).alias("ask"), whole(F.col("embedding")).alias("codes")
    )
    peak = F.max(F.array_max(F.transform("codes", lambda x: F.abs(x.cast("double")))))
    size = coded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("codes")).alias("d"), peak.alias("peak")).first()
    dims, peak = max(1, size["d"] or 1), size["peak"] or 0.0
    kind = "int16" if peak < 2**15 else "int32" if peak < 2**31 else "int64"
    parts = max(1, -(-size["n"] // SHARD_ROWS))
    signed = coded.mapInArrow(lambda b: _locality(b, dims, kind), "vec_id long, ask boolean, sign long, codes binary")
    ranged = signed.repartitionByRange(parts, "sign", "vec_id").sortWithinPartitions("sign", "vec_id")
    shards = durable(ranged.mapInArrow(lambda b: _shards(b, kind), _ROWS), "topk-shards")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes = _unpacked(row, kind)
                asks = np.frombuffer(row["asks"], bool)
                found = Blocks(ids, codes).search(ids[asks], codes[asks], np.full(asks.sum(), -np.inf), k)
                yield _as_batch(found)

    first = durable(shards.mapInArrow(own, _FOUND), "topk-own")
    # The k-th score in the query's own shard is a floor of the k-th score over all.
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.where(F.col("n") >= k).select("query_id", "floor")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes = _unpacked(row, kind)
                at = np.flatnonzero(np.frombuffer(row["asks"], bool))
                columns = [
                    pa.array(np.full(len(at), row["shard"]), pa.int64()),
                    pa.array(ids[at], pa.int64()),
                    pa.array([codes[i].astype(kind).tobytes() for i in at], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["home", "query_id", "codes"])

    queries = shards.mapInArrow(asked, "home long, query_id long, codes binary")
    queries = queries.join(floors, "query_id", "left")
    queries = durable(queries, "topk-queries")

    def meet(key, blocks: pa.Table, asking: pa.Table) -> pa.Table:
        got = [np.empty(0, np.int64)] * 3
        if blocks.num_rows and asking.num_rows:
            ids, codes = _unpacked(blocks.to_pylist()[0], kind)
            joined = [b"".join(asking.column(c).to_pylist()) for c in ("ids", "codes", "floors")]
            query_ids, floor = np.frombuffer(joined[0], np.int64), np.frombuffer(joined[2], float)
            q = np.frombuffer(joined[1], kind).reshape(len(query_ids), -1).astype(np.int64)
            got = Blocks(ids, codes).search(query_ids, q, floor, k)
        return pa.Table.from_batches([_as_batch(got)])

    found, more = first, True
    # A row for SHARD_ROWS vectors, OUTLINES of them at a time.
    outlines = shards.select("shard", "high", "low").orderBy("shard").toLocalIterator()
    while more:
        some = [r for _, r in zip(range(OUTLINES), outlines)]
        more = len(some) == OUTLINES
        if some:
            sent = vectors.sparkSession.sparkContext.broadcast([r.asDict() for r in some])
            kinds = "shard long, chunk long, ids binary, codes binary, floors binary"
            asked = durable(queries.mapInArrow(lambda b, sent=sent: _reachable(sent.value, kind, b), kinds), "topk-asked")
            met = asked.select(F.col("shard").alias("at"), F.col("chunk").alias("part")).distinct()
            left = shards.join(met, F.col("shard") == F.col("at")).select("at", "part", "ids", "codes")
            grid = left.groupBy("at", "part").cogroup(asked.groupBy("shard", "chunk"))
            found = found.unionByName(grid.applyInArrow(meet, _FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _as_batch(found) -> pa.RecordBatch:
    names = ["query_id", "vec_id", "score"]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in found], names)
