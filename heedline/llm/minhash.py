"""Near-duplicate groups by SuperMinHash, banding, verification and union-find (operator 7).

1. A document's set is its distinct word shingles, as 64-bit hashes.  Documents with equal sets
   become one class at once, so exact copies cost one row each from there on.
2. Every class gets a SuperMinHash signature: each element walks through a permutation of the
   places, and offers (step + fraction) to the place it is at; a document stops when all its
   places are taken, for later steps can't be smaller.
3. Classes that share a band of the signature are candidates.
4. Inside a bucket signatures are compared, block by block.  First, in the buckets of a few
   bands, every member only names its most similar partner of its block; these pairs are verified
   on the full sets and united, in rounds that go on with one member of each group, which brings
   the members of a group together without spreading it out into its pairs.  Then all pairs of a
   bucket whose signatures agree enough and that are still in different groups are verified,
   so every candidate pair is either verified, or inside one group, or far below the threshold.
   Verification runs in blocks too: a set meets some BLOCK of its partners at a time.
   A bucket of texts that are not linked costs the square of its size in comparisons.

The bands are as long as they can be while a pair at the threshold has a probability of at most
MISSED to share none of them.

Null texts and texts without words have an empty set and stand alone.  Equal rows and rows with
equal doc_id are rows of their own; a missing doc_id counts as larger than all others.  Extra
columns are ignored; an empty table gives an empty result.  Of equally similar partners the one with the
smaller number is named; very long texts are one set, held whole by the task that compares it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.llm.common import durable, released, row_ids, small_batches, split_hot

WORDS = 5
THRESHOLD = 80
PLACES = 480
MISSED = 2e-7
# Sets are signed together by size, for small ones take many steps and large ones few: up to
# which size, and how many steps a walk is followed back before its permutation is kept.
SIZES = ((24, 7), (64, 7), (1 << 62, 40))
TOGETHER = 256
# A pair whose signatures agree by this much less than the threshold isn't compared in full:
# six standard deviations of the estimate, which is the tighter the longer the signature.
SLACK = 0.1
BLOCK = 128
CELL = 256
FIRST_BANDS = 6
NO_DOC = (1 << 63) - 1

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct shingle hashes of whole texts; word hashes are remembered, up to a bound."""

    def __init__(self, words: int = WORDS, known: int = 300_000):
        self.words, self.bound, self.known = words, known, {}

    def of(self, text: str) -> np.ndarray:
        import xxhash

        # Splits at ASCII white space and lower-cases ASCII letters, nothing else.
        tokens = text.encode("utf-8", "replace").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for w in {*tokens}.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        width = min(self.words, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``super_minhash`` of sets of any size (not empty), in their order."""
    out, size = np.empty((len(sets), PLACES), np.uint64), np.array([len(s) for s in sets])
    low = 0
    for high, followed in SIZES:
        some = np.flatnonzero((size > low) & (size <= high))
        for i in range(0, len(some), TOGETHER):
            at = some[i : i + TOGETHER]
            out[at] = super_minhash([sets[k] for k in at], PLACES, followed)
        low = high
    return out


def super_minhash(sets: list[np.ndarray], places: int = PLACES, followed: int = 40) -> np.ndarray:
    """Signatures (a row of ``places`` values each) of sets that are not empty."""
    m, full = places, _U((1 << 64) - 1)
    values = np.full((len(sets), m), full)
    flat = values.reshape(-1)
    elements = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    steps: list[np.ndarray] = []
    order = None
    for j in range(m):
        random = _mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        swap = (((random >> _U(32)) * _U(m - j)) >> _U(32)).astype(np.int16) + np.int16(j)
        if order is None:
            # Few steps: follow the swaps back instead of keeping the permutations.
            place = swap.copy()
            for i in range(j - 1, -1, -1):
                np.copyto(place, np.int16(i), where=steps[i] == place)
        else:
            every = np.arange(len(elements))
            place = order[every, swap]
            order[every, swap] = order[:, j]
        offer = _U(j << 32) | (random & _U(0xFFFFFFFF))
        np.minimum.at(flat, row * m + place, offer)
        open_ = (values == full).any(1)
        if not open_.any():
            break
        keep = open_[row]
        steps.append(swap)
        elements, row, steps = elements[keep], row[keep], [s[keep] for s in steps]
        order = None if order is None else order[keep]
        if order is None and j == followed:
            order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
            every = np.arange(len(elements))
            for i, s in enumerate(steps):
                order[every, s], order[every, i] = order[every, i], order[every, s]
    return values


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, doc, text_hash, n, s1, s2, sig): the sets of ``docs`` in short form.

    s1 and s2 stand for the whole set; ``sig`` has one byte a place, null for empty sets.
    """
    names = ["uid", "doc", "text_hash", "n", "s1", "s2", "sig"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    schema = "uid long, doc long, text_hash long, n long, s1 long, s2 long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, uid = Shingler(words), row_ids()
        for batch in batches:
            for part in small_batches([batch], 1024):
                sets = [shingler.of(t or "") for t in part.column("text").to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                sigs = [None] * len(sets)
                if some:
                    values = signatures([sets[i] for i in some])
                    short = (_mix(values) >> _U(56)).astype(np.uint8)
                    for k, i in enumerate(some):
                        sigs[i] = short[k].tobytes()
                whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                columns = [
                    [next(uid) for _ in sets],
                    part.column("doc"),
                    part.column("text_hash"),
                    [len(s) for s in sets],
                    [(x >> 64) - (1 << 63) for x in whole],
                    [(x & ((1 << 64) - 1)) - (1 << 63) for x in whole],
                    sigs,
                ]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return _named(docs).mapInArrow(released(run), schema)


def rows_per_band(threshold: int) -> int:
    share, rows = threshold / 100, 1
    while (1 - share ** (rows + 1)) ** (PLACES // (rows + 1)) <= MISSED:
        rows += 1
    return rows


def bands(sig: str, rows: int) -> Column:
    """A hash of each band of a signature."""
    part = lambda i: F.substring(F.col(sig), i * rows + 1, F.lit(rows))
    return F.transform(F.sequence(F.lit(0), F.lit(PLACES // rows - 1)), lambda i: F.xxhash64(part(i), i))


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(uid, sig, elements) of the classes ``wanted`` (uid, doc, text_hash, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.of(t).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column("uid"), batch.column("sig"), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "sig", "elements"])

    texts = _named(docs).join(wanted, ["doc", "text_hash"]).select("uid", "sig", "text")
    return texts.mapInArrow(released(run), "uid long, sig binary, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``threshold`` hundredths in common."""
    per_hub = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = pairs.join(per_hub, "a").withColumn("block", F.pmod(F.xxhash64("b"), blocks)).drop("n")
    hubs = per_hub.join(sets, F.col("a") == F.col("uid"))
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    hubs = hubs.select("a", "block", "sig", "elements")
    members = dealt.join(sets, F.col("b") == F.col("uid"))
    # New names, for both sides come from the same tables.
    members = members.select(*[F.col(c).alias(f"of_{c}") for c in ("a", "block", "b", "sig", "elements")])

    def compare(hub: pa.Table, others: pa.Table) -> pa.Table:
        kept_a, kept_b = [], []
        if hub.num_rows and others.num_rows:
            a, sig = hub.column("a")[0].as_py(), np.frombuffer(hub.column("sig")[0].as_py(), np.uint8)
            own = np.frombuffer(hub.column("elements")[0].as_py(), np.uint64)
            columns = [others.column(f"of_{c}").to_pylist() for c in ("b", "sig", "elements")]
            for b, other_sig, elements in zip(*columns):
                if (sig == np.frombuffer(other_sig, np.uint8)).mean() < threshold / 100 - SLACK:
                    continue
                other = np.frombuffer(elements, np.uint64)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= threshold * (len(own) + len(other) - both):
                    kept_a.append(a)
                    kept_b.append(b)
        return pa.table({"a": pa.array(kept_a, pa.int64()), "b": pa.array(kept_b, pa.int64())})

    grouped = hubs.groupBy("a", "block").cogroup(members.groupBy("of_a", "of_block"))
    return grouped.applyInArrow(compare, "a long, b long")


def pointed(parents: DataFrame) -> DataFrame:
    """(uid, root) from (uid, root) where roots may have smaller roots themselves."""
    while True:
        up = parents.select(F.col("uid").alias("root"), F.col("root").alias("next"))
        moved = parents.join(up, "root", "left").select(
            "uid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = durable(moved, "minhash-roots")
        parents = moved.select("uid", "root")
        if moved.where("moved").isEmpty():
            return parents


def united(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (uid, root; a node not in it is its own root) after uniting along ``edges`` (a, b).

    Each root hooks on to the smallest root that an edge leads to; repeated until no edge joins
    two groups.
    """
    while True:
        a = roots.select(F.col("uid").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("uid").alias("b"), F.col("root").alias("rb"))
        ends = edges.join(a, "a", "left").join(b, "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
        ends = durable(ends.where("ra <> rb").distinct(), "minhash-ends")
        if ends.isEmpty():
            return roots
        hooks = ends.groupBy(F.greatest("ra", "rb").alias("uid")).agg(F.min(F.least("ra", "rb")).alias("root"))
        hooks = pointed(durable(hooks, "minhash-hooks"))
        to = hooks.select(F.col("uid").alias("root"), F.col("root").alias("to"))
        moved = roots.join(to, "root", "left").select("uid", F.coalesce("to", "root").alias("root"))
        new = hooks.join(roots.select("uid"), "uid", "left_anti")
        roots = durable(moved.unionByName(new), "minhash-roots")


def diagonal(members: DataFrame, seed: int) -> DataFrame:
    """Members (key, size, uid, root, sig) by cell: every member in one block of about CELL of its bucket."""
    block = F.pmod(F.xxhash64("uid", F.lit(seed)), F.ceil(F.col("size") / CELL))
    placed = members.withColumn("block", block)
    return placed.select("key", F.lit(0).alias("band"), F.col("block").alias("first"), F.col("block").alias("second"), "block", "uid", "root", "sig")


def crossing(members: DataFrame) -> DataFrame:
    """Members (key, band, uid, root, sig) by cell: two members of a bucket that differ in root meet in one cell.

    The members of a root that has many in a bucket fill blocks of their own, which meet all blocks
    but those of that root; all others share blocks, which all meet.
    """
    own = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("large", F.col("n") > CELL // 2)
    parts = F.when(F.col("large"), F.ceil(F.col("n") / CELL))
    shared = own.where("NOT large").groupBy("key").agg(F.ceil(F.sum("n") / CELL).alias("shared"))
    named = own.withColumn("parts", parts).join(shared, "key", "left").select("key", "root", "parts", "shared")
    # Blocks are named by a hash of the root they belong to, or of none, and a number.
    block = F.when(F.col("parts").isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("uid"), F.col("parts")))).otherwise(
        F.xxhash64(F.lit(-1), F.pmod(F.xxhash64("root"), F.col("shared")))
    )
    placed = members.join(named, ["key", "root"])
    placed = placed.select("key", "band", "uid", "root", "sig", block.alias("block"), F.when(F.col("parts").isNotNull(), F.col("root")).alias("pure"))
    blocks = placed.select("key", F.col("block").alias("other"), F.col("pure").alias("other_pure")).distinct()
    cells = placed.join(blocks, "key").where(~F.coalesce(F.col("pure") == F.col("other_pure"), F.lit(False)))
    return cells.select(
        "key", "band", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "uid", "root", "sig"
    )


def alike_in_cells(cells: DataFrame, rows: int, least: float, best_only: bool) -> DataFrame:
    """Distinct pairs (a, b) of members of one cell whose signatures agree in a share ``least``.

    Members with one root are no pair.  With ``best_only`` every member names one partner in its
    cell, the most similar one.  Otherwise a pair is named in one bucket, that of the first band of
    ``rows`` places in which its signatures agree, however many they share.
    """
    names = ["key", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = {c: np.array(batch.column(c)) for c in ("key", "band", "first", "second", "block", "uid", "root")}
            part["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, PLACES)
            if held is not None:
                part = {c: np.concatenate([held[c], part[c]]) for c in part}
            new = np.zeros(len(part["key"]), bool)
            for c in names:
                new[1:] |= part[c][1:] != part[c][:-1]
            starts = np.r_[0, np.flatnonzero(new)]
            # The last cell may go on in the next batch.
            held = {c: v[starts[-1] :] for c, v in part.items()}
            yield _as_pairs(part, starts[:-1], starts[1:], rows, least, best_only)
        if held is not None:
            yield _as_pairs(held, np.array([0]), np.array([len(held["key"])]), rows, least, best_only)

    dealt = cells.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def _as_pairs(part: dict, starts: np.ndarray, ends: np.ndarray, rows: int, least: float, best_only: bool) -> pa.RecordBatch:
    found = [np.empty((0, 2), np.int64)]
    sizes = ends - starts
    for n in np.unique(sizes[sizes > 1]):
        x, y = np.triu_indices(int(n), 1)
        lows = starts[sizes == n]
        step = max(1, 20_000 // len(x))
        for lo in range(0, len(lows), step):
            some = lows[lo : lo + step, None]
            found.append(_alike(part, (some + x).ravel(), (some + y).ravel(), rows, least, best_only))
    pairs = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _alike(part: dict, x: np.ndarray, y: np.ndarray, rows: int, least: float, best_only: bool) -> np.ndarray:
    uid, root, sig, block = part["uid"], part["root"], part["sig"], part["block"]
    # In a cell of two blocks, pairs inside one block have been met in the cell of that block.
    across = (part["first"][x] == part["second"][x]) | (block[x] != block[y])
    keep = (root[x] != root[y]) & across
    x, y = x[keep], y[keep]
    share, n_bands = np.empty(len(x)), PLACES // rows
    keep = np.zeros(len(x), bool)
    for i in range(0, len(x), 20_000):
        equal = sig[x[i : i + 20_000]] == sig[y[i : i + 20_000]]
        share[i : i + 20_000] = equal.mean(1)
        own = share[i : i + 20_000] >= least
        if not best_only:
            first = equal[own, : n_bands * rows].reshape(-1, n_bands, rows).all(2).argmax(1)
            own[own] = first == part["band"][x[i : i + 20_000][own]]
        keep[i : i + 20_000] = own
    x, y, share = x[keep], y[keep], share[keep]
    if best_only and len(x):
        own, other, both = np.r_[x, y], np.r_[y, x], np.r_[share, share]
        order = np.lexsort((uid[other], -both, own))
        own, other = own[order], other[order]
        first = np.r_[True, own[1:] != own[:-1]]
        x, y = own[first], other[first]
    a, b = np.minimum(uid[x], uid[y]), np.maximum(uid[x], uid[y])
    return np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)


def groups(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(uid, root) of all classes in groups of two and more, from bucket ``members``.

    Those have key, size, uid and band.  First, in the buckets of a few bands, members name partners
    block by block; the pairs are verified and united.  A bucket of several blocks then keeps one
    member of each root, and is dealt again, until it fits into a block or a round finds nothing:
    a group of any size comes together in a few rounds with a row for each member and round.
    At last all pairs of a bucket are met that have different roots.
    """
    rows, none = rows_per_band(threshold), members.sparkSession.range(0)
    # Empty tables that need no Python worker to be read.
    roots = none.select(F.col("id").alias("uid"), F.col("id").alias("root"))
    tested = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    signed_, least = sets.select("uid", "sig"), threshold / 100 - SLACK

    def standing(some: DataFrame) -> DataFrame:
        return some.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))

    def met(cells: DataFrame, best_only: bool) -> bool:
        nonlocal roots, tested
        alike = alike_in_cells(cells, rows, least, best_only)
        pairs = durable(alike.join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        edges = durable(verified(pairs, sets, threshold), "minhash-edges")
        roots, tested = united(roots, edges), tested.unionByName(pairs)
        return not edges.isEmpty()

    first = members.where(F.col("band") < FIRST_BANDS).select("key", "size", "uid")
    now, turn = standing(first), 0
    while met(diagonal(now.join(signed_, "uid"), turn), True):
        # Buckets of one block have met whole; the others go on with one member of each root.
        several = standing(first.where(F.col("size") > CELL))
        one = several.groupBy("key", "root").agg(F.min("uid").alias("uid"))
        sizes = one.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        now = durable(one.join(sizes, "key"), "minhash-left")
        first, turn = now.select("key", "size", "uid"), turn + 1
        if now.isEmpty():
            break
    now = standing(members)
    spans = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    now = now.join(spans.where("lo <> hi").select("key"), "key", "left_semi")
    met(crossing(durable(now.select("key", "band", "uid", "root"), "minhash-left").join(signed_, "uid")), False)
    return roots


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first) of every row.

    ``component_id`` is the smallest doc_id of the group; ``first`` holds for one row of it.
    """
    all_ = durable(signed(docs, words), "minhash-signed")
    some = all_.where("n > 0")
    classes = some.groupBy("s1", "s2").agg(
        F.min(F.struct("doc", "uid")).alias("least"), F.count(F.lit(1)).alias("copies")
    )
    classes = durable(classes, "minhash-classes")
    heads = some.join(classes.select("s1", "s2", F.col("least.uid").alias("uid")), ["s1", "s2", "uid"])
    heads = durable(heads.select("uid", "doc", "text_hash", "sig"), "minhash-heads")
    banded = heads.select("uid", F.posexplode(bands("sig", rows_per_band(threshold))).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = durable(banded.join(shared, "key"), "minhash-members")
    wanted = heads.join(members.select("uid").distinct(), "uid")
    sets = durable(full_sets(docs, wanted, words).dropDuplicates(["uid"]), "minhash-sets")
    roots = groups(members, sets, threshold)

    named = classes.select("s1", "s2", "copies", "least.doc", "least.uid").join(roots, "uid", "left")
    named = durable(named.withColumn("root", F.coalesce("root", "uid")), "minhash-named")
    least = named.groupBy("root").agg(F.min(F.struct("doc", "uid")).alias("head"))
    component = named.join(least, "root").select("s1", "s2", "copies", "head")
    rows = all_.select("uid", "doc", "text_hash", "n", "s1", "s2")
    found = split_hot(rows.where("n > 0"), component, ["s1", "s2"], F.col("copies"), all_.count())
    own = F.struct("doc", "uid")
    whole = found.select("uid", "doc", "text_hash", "n", "head").unionByName(
        rows.where("n = 0").select("uid", "doc", "text_hash", "n", own.alias("head"))
    )
    real = lambda c: F.when(c != NO_DOC, c)
    return whole.select(
        real(F.col("doc")).alias("doc_id"),
        "text_hash",
        F.col("n").alias("n_shingles"),
        real(F.col("head.doc")).alias("component_id"),
        (F.col("uid") == F.col("head.uid")).alias("first"),
    )


def components(docs: DataFrame, threshold: int) -> DataFrame:
    found = near_duplicates(docs, threshold=threshold)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), elements AS (SELECT doc_id, unnest(s) AS e FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""
