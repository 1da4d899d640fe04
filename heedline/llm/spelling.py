"""Spelling variants by dynamic programming along a sorted vocabulary (operator 11).

Words are counted over all texts.  Two words are near if one inserted, deleted or replaced code
point turns one into the other.  The partners of a word are found in sorted lists: the row of
the edit matrix for a prefix, cut to the band of one edit, serves every word with that prefix,
so the scan goes on from the row of the prefix that a word has in common with the one before
(its LCP), and when a row has no cell below two, all words that share that prefix are skipped.

A word of length L and a near word share their first (L - 1) // 2 code points, or as many of the
last ones as are left of L - 1.  So a word only meets the stretch of the vocabulary that begins
like it, and the stretch of the vocabulary of reversed words that ends like it.  Both lists are
cut into ranges of about RANGE words; a task holds one range, and the words that look for
partners in it stream by.  All scans of a block of words go on in step, each at its own place.

What a word needs of its partners (how many, and the most frequent) is added up range by range,
so pairs are never listed.  Forms are followed to the root by pointer doubling; as the count at
least doubles from a word to its form, paths are no longer than the logarithm of the largest.

Null and empty texts have no words.  Equal rows count as often as they occur; a missing doc_id
counts as an empty one.  Words of any length are compared whole.  Equally frequent forms are
settled by code-point order.  Extra columns are ignored; an empty table gives an empty result.
"""

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline.llm.common import durable

RUNS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
# One in so many runs loses a letter, by a hash of document and run.
MISPRINT = 97
FLUSH = 400_000
KNOWN_RUNS = 300_000
RANGE = 4096
RANGES_PER_TASK = 4
# Up to which depth the end of a stretch with a common prefix is looked up in a table.
DEPTH = 64
# Cells of the band that a block of scans may hold.
CELLS = 1 << 21


def misprinted(run: bytes, doc: int, misprint: int = MISPRINT) -> bytes:
    """A lower-cased run, without one letter if its hash with the document says so."""
    h = zlib.crc32(run, doc)
    if h % misprint:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, known, total = re.compile(RUNS).findall, {}, Counter()

        def flush():
            words = [w.decode() for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for own, n in Counter(runs(text)).items():
                    low = known.get(own)
                    if low is None:
                        if len(known) > KNOWN_RUNS:
                            known.clear()
                        low = known[own] = own.encode().lower()
                    if len(own) >= min_length:
                        total[misprinted(low, start)] += n
                if len(total) > FLUSH:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def head_length(length: int) -> int:
    """How many first code points a near word shares, if it does not share the rest of the last ones."""
    return (length - 1) // 2


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row (they are below 256), where each starts, and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    # Spare places, for the band looks one place beyond the end.
    return np.frombuffer("".join(words).encode("latin-1") + bytes(4), np.uint8), np.r_[0, np.cumsum(size)[:-1]], size


class SortedList:
    """Sorted distinct words, and for each the LCP with the one before it."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.start, self.size = _flat(words)
        count, self.depth = len(words), int(min(DEPTH, self.size.max(initial=0)))
        self.lcp = np.zeros(count + 1, np.int64)
        wide = np.zeros((count, DEPTH + 1), np.uint8)
        for d in range(self.depth):
            some = np.flatnonzero(self.size > d)
            wide[some, d] = self.codes[self.start[some] + d]
        other = wide[1:] != wide[:-1]
        self.lcp[1:count] = np.where(other.any(1), other.argmax(1), DEPTH)
        for i in np.flatnonzero(self.lcp[:count] >= DEPTH).tolist():
            a, b = (np.frombuffer(w.encode("latin-1"), np.uint8) for w in words[i - 1 : i + 1])
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.lcp[i] = int(differ.argmax()) if differ.any() else n
        # next[d, i]: the first place after i whose LCP is below d; nothing goes on past the end.
        self.lcp[0] = self.lcp[count] = 0
        places = np.where(self.lcp[None, 1:] < np.arange(self.depth + 1)[:, None], np.arange(1, count + 1), count)
        self.next = np.minimum.accumulate(places[:, ::-1], 1)[:, ::-1]

    def near(self, asked: list[str], heads: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``asked``, place in the list) one edit apart that share the head of the word asked for."""
        lows = [bisect_left(self.words, w[:h]) for w, h in zip(asked, heads)]
        highs = [bisect_right(self.words, w[:h] + "￿") for w, h in zip(asked, heads)]
        found, at = [], 0
        order = sorted(range(len(asked)), key=lambda i: len(asked[i]))
        while at < len(order):
            # Blocks of words of much the same length, so that their bands fit.
            rows = max(1, CELLS // (3 * (len(asked[order[at]]) + 3)))
            some = order[at : at + rows]
            while len(some) > 1 and len(some) * 3 * (len(asked[some[-1]]) + 3) > 2 * CELLS:
                some = some[: len(some) // 2]
            at += len(some)
            pick = lambda values, some=some: np.array([values[i] for i in some], np.int64)
            q, w = self._scan([asked[i] for i in some], pick(heads), pick(lows), pick(highs))
            found.append((np.array(some, np.int64)[q], w))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2

    def _scan(self, asked: list[str], depth: np.ndarray, place: np.ndarray, high: np.ndarray):
        text, first, length = _flat(asked)
        # band[scan, d]: distances of the word's first d code points from the first d - 1, d, d + 1 of the one asked for.
        band = np.full((len(asked), int(length.max()) + 3, 3), 2, np.uint8)
        every = np.arange(len(asked))
        band[every, depth] = (1, 0, 1)
        band[every[depth == 0], 0, 0] = 2
        live = np.flatnonzero(place < high)
        hits_q, hits_w = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        # Below 0: the scan is on a word whose prefix of that length is already too far.
        dead = np.zeros(len(asked), np.int64)
        while len(live):
            p, d, n = place[live], depth[live], length[live]
            size = self.size[p]
            ended = (d == size) & (dead[live] == 0)
            if ended.any():
                own, gap = live[ended], (n - size)[ended]
                near = (np.abs(gap) <= 1) & (band[own, d[ended], np.clip(gap + 1, 0, 2)] == 1)
                hits_q.append(own[near])
                hits_w.append(p[ended][near])
            # Words that are too short or too long can be left at once; what they share stays known.
            leave = ended | (np.abs(n - size) > 1) & (dead[live] == 0)
            step = ~leave & (dead[live] == 0)
            if step.any():
                own = live[step]
                p_, d_, n_ = p[step], d[step], n[step]
                letter, at, b = self.codes[self.start[p_] + d_], first[own] + d_, band[own, d_]
                # The place before the first letter belongs to no prefix; its cell is 2 already.
                low = np.minimum(b[:, 0] + (text[np.maximum(at - 1, 0)] != letter), b[:, 1] + 1)
                mid = np.minimum(np.minimum(b[:, 1] + (text[at] != letter), b[:, 2] + 1), low + 1)
                top = np.minimum(b[:, 2] + (text[np.minimum(at + 1, len(text) - 1)] != letter), mid + 1)
                row = np.stack([np.where(d_ > n_, 2, low), np.where(d_ + 1 > n_, 2, mid), np.where(d_ + 2 > n_, 2, top)], 1)
                row = np.minimum(row, 2).astype(np.uint8)
                band[own, d_ + 1] = row
                depth[own] = d_ + 1
                far = (row > 1).all(1)
                dead[own[far]] = d_[far] + 1
            # On to the next word, or past all words with the prefix that is too far.
            known = dead[live]
            go = leave | (known > 0)
            own, p_, known = live[go], p[go], known[go]
            new = np.where((known > 0) & (known <= self.depth), self.next[np.minimum(known, self.depth), p_], p_ + 1)
            place[own] = new
            depth[own] = np.minimum(depth[own], self.lcp[new])
            dead[own] = np.where(self.lcp[new] < known, 0, known)
            live = live[place[live] < high[live]]
        return np.concatenate(hits_q), np.concatenate(hits_w)


def _cuts(words: DataFrame, key, n: int) -> list[str]:
    """The first key of each range, one for about RANGE words, so they take a few bytes a thousand words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(range(-at % RANGE, len(keys), RANGE), pa.int64()))], ["key"])
            at += len(keys)

    parts = max(1, n // (8 * RANGE))
    ordered = words.select(key.alias("key")).repartitionByRange(parts, "key").sortWithinPartitions("key")
    return sorted(r["key"] for r in ordered.mapInArrow(run, "key string").collect())


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of ``words`` (word, n) by range: near words there and the most frequent of them."""
    n = words.count()
    cuts = [_cuts(words, F.col("word"), n), _cuts(words, F.reverse("word"), n)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each range (asks 0) and those that look for partners in it (asks 1)."""
        for batch in batches:
            out = []
            for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for side, own in enumerate(cuts):
                    key = word[::-1] if side else word
                    out.append((side, bisect_right(own, key) - 1, 0, key, count))
                    head = head_length(len(word))
                    head = key[: len(word) - 1 - head] if side else key[:head]
                    for at in range(max(0, bisect_right(own, head) - 1), bisect_right(own, head + "￿")):
                        out.append((side, at, 1, key, count))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["side", "range", "asks", "key", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, counts, list_ = None, [], [], None
        for batch in batches:
            place = np.stack([np.array(batch.column(c)) for c in ("side", "range", "asks")], 1)
            cut = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(place)]):
                if lo == hi:
                    continue
                side, at, asks = place[lo].tolist()
                own = batch.column("key").slice(lo, hi - lo).to_pylist()
                if (side, at) != here:
                    here, keys, counts, list_ = (side, at), [], [], None
                if not asks:
                    keys += own
                    counts.append(np.array(batch.column("n").slice(lo, hi - lo)))
                elif keys:
                    if list_ is None:
                        list_ = SortedList(keys)
                        n_of, plain = np.concatenate(counts), [k[::-1] if side else k for k in keys]
                        rank = np.empty(len(keys), np.int64)
                        rank[sorted(range(len(keys)), key=plain.__getitem__)] = np.arange(len(keys))
                    yield found(list_, own, side, n_of, plain, rank)

    def found(list_: SortedList, own: list[str], side: int, n_of, plain, rank) -> pa.RecordBatch:
        heads = [len(w) - 1 - head_length(len(w)) if side else head_length(len(w)) for w in own]
        q, w = list_.near(own, heads)
        if side:
            # Pairs that share the first code points as well are found in the other list.
            asked = [k[::-1] for k in own]
            first = [asked[a][: head_length(len(asked[a]))] for a in q.tolist()]
            other = np.array([not plain[b].startswith(f) for f, b in zip(first, w.tolist())], bool)
            q, w = q[other], w[other]
        else:
            asked = own
        order = np.lexsort((rank[w], -n_of[w], q))
        q, w = q[order], w[order]
        who, at, times = np.unique(q, return_index=True, return_counts=True)
        columns = [
            pa.array([asked[i] for i in who.tolist()], pa.string()),
            pa.array(times.astype(np.int64)),
            pa.array(n_of[w[at]].astype(np.int64)),
            pa.array([plain[i] for i in w[at].tolist()], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])

    dealt = words.select("word", "n").mapInArrow(deal, "side int, range int, asks int, key string, n long")
    # By number, for adaptive execution goes by bytes, and these take little room and much time.
    tasks = max(1, sum(map(len, cuts)) // RANGES_PER_TASK)
    dealt = dealt.repartition(tasks, "side", "range").sortWithinPartitions("side", "range", "asks", "key")
    return dealt.mapInArrow(scan, "word string, n_near long, best_n long, best string")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), which has no circles: each path's end."""
    parents = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = parents.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = parents.join(up, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = durable(moved, "spelling-roots")
        parents = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return parents


def variants(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = durable(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    enough = -F.col("best.less") >= 2 * F.col("n")
    known = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    known = durable(known, "spelling-near")
    roots = rooted(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(docs: DataFrame) -> DataFrame:
    """The words of all texts with their forms and roots."""
    return variants(counted(docs)).select("word", "form", "root", "n", "n_near", "form_n")
