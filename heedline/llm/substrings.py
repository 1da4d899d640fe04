"""Removal of repeated passages by difference-cover anchors (operator 13).

A passage of ``words`` words that also starts elsewhere, in any document, is a repeat; every word
that a repeat covers goes.  COVER is a difference cover modulo PERIOD: for any two positions
there is a shift below PERIOD that brings both on to a place of the cover.  So wherever two
passages are equal, one shift below PERIOD hits a cover place in both, and the anchor, the
``words`` - PERIOD + 1 words from there on, lies inside both and is the same.

1. Only the anchors at cover places of each document are hashed (a third of all places).  Their
   hashes are dealt into groups, which answer with a bit for each: does it occur again?
2. A repeated anchor is extended: the passages that hold it at a shift below PERIOD are the
   candidates.  Their hashes over all words (96 bits) are dealt and answered the same way.
3. Words covered by repeated passages go.

Texts are cut into chunks; a task holds one chunk or one group of hashes.  Equal hashes of a chunk
travel as one with a mark, so a passage that is in a third of all documents is one item a chunk.

Null and empty texts and white space have no words.  Rows are documents of their own: two rows with
equal text, or one doc_id, repeat each other.  Very long texts are a chunk of their own.  Extra
columns are ignored; an empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline.llm.common import chunked, dealt, durable, packed, per_process, rows_of, unpacked

WORDS = 35
PERIOD, COVER = 13, (0, 1, 3, 9)
# Characters of text in a chunk, unless the last 128 texts have more.
CHUNK = 6_000_000
# Hashes that a group has at most, about.
GROUP = 1_000_000
KNOWN_WORDS = 300_000

_U = np.uint64
# Odd numbers whose powers weigh the words of a passage.
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in _BASES)

_ASKED = "chunk long, group long, n long, h binary, more binary, twice binary"
_TOLD = "chunk long, group long, n long, again binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Passages:
    """The words of a chunk of texts in a row, with hashes of stretches of them."""

    def __init__(self, texts: list[str | None], words: int = WORDS):
        import xxhash

        known: dict[bytes, int] = per_process("passage-words", dict)
        self.words, self.tokens, parts = words, [], []
        for text in texts:
            own = (text or "").encode("utf-8", "replace").split()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in {*own}.difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            self.tokens.append(own)
            parts.append(np.fromiter(map(known.__getitem__, own), _U, len(own)))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.n = int(self.sizes.sum())
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.place = np.arange(self.n) - np.repeat(self.starts, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.place
        hashes = np.concatenate(parts) if parts else np.empty(0, _U)
        self.sums, self.backs = [], []
        for base, inverse in zip(_BASES, _INVERSES):
            power = np.cumprod(np.r_[_U(1), np.full(max(0, self.n - 1), base)], dtype=_U)[: self.n]
            self.sums.append(np.r_[_U(0), np.cumsum(hashes * power, dtype=_U)])
            self.backs.append(np.cumprod(np.r_[_U(1), np.full(max(0, self.n - 1), inverse)], dtype=_U)[: self.n])

    def hashes(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """Hashes of the ``length`` words from each place on, wherever they stand."""
        sums = self.sums[which]
        return _mix((sums[at + length] - sums[at]) * self.backs[which][at] + _U(length))

    def anchors(self) -> np.ndarray:
        """Places of anchors that lie inside some passage."""
        covered = np.isin(self.place % PERIOD, COVER)
        return np.flatnonzero(covered & (self.left >= self.words - PERIOD + 1) & (self.place + self.left >= self.words))

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Places of passages that hold one of ``anchors`` at a shift below PERIOD."""
        marked = np.zeros(self.n + PERIOD, np.int64)
        marked[anchors] = 1
        upto = np.r_[0, np.cumsum(marked)]
        some = np.flatnonzero(self.left >= self.words)
        return some[upto[some + PERIOD] > upto[some]]

    def covered(self, passages: np.ndarray) -> np.ndarray:
        """Which words lie in one of ``passages``."""
        change = np.zeros(self.n + 1, np.int64)
        np.add.at(change, passages, 1)
        np.add.at(change, passages + self.words, -1)
        return np.cumsum(change)[:-1] > 0


class Items:
    """Distinct hashes in order; ``more`` tells apart what has one hash."""

    def __init__(self, h: np.ndarray, more: np.ndarray, groups: int):
        order = np.lexsort((more, h))
        h, more = h[order], more[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (more[1:] != more[:-1])][: len(h)]
        first = np.flatnonzero(new)
        self.h, self.more, self.twice = h[first], more[first], np.diff(np.r_[first, len(h)]) > 1
        self.item_of = np.empty(len(h), np.int64)
        self.item_of[order] = np.cumsum(new) - 1
        self.groups = dealt(self.h, groups)

    def requests(self, chunk: int, wide: bool) -> pa.RecordBatch:
        own, first = np.unique(self.groups, return_index=True)
        spans = [*zip(first.tolist(), [*first[1:].tolist(), len(self.h)])]
        columns = [
            pa.array([chunk] * len(own), pa.int64()),
            pa.array(own),
            pa.array([b - a for a, b in spans], pa.int64()),
            pa.array([packed(self.h[a:b]) for a, b in spans], pa.binary()),
            pa.array([self.more[a:b].tobytes() if wide else b"" for a, b in spans], pa.binary()),
            pa.array([np.packbits(self.twice[a:b]).tobytes() for a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "group", "n", "h", "more", "twice"])


def _bits(n: list[int], data: list[bytes]) -> np.ndarray:
    """The bits of several rows, one after the other."""
    parts = [np.unpackbits(np.frombuffer(d, np.uint8), count=k) for k, d in zip(n, data)]
    return np.concatenate([np.empty(0, np.uint8), *parts]).astype(bool)


def _answered(asked: pa.Table) -> pa.Table:
    """For each item of a group, whether it was asked for by two chunks, or occurs twice in one."""
    n = asked.column("n").to_pylist()
    h = np.concatenate([unpacked(d, k) for k, d in zip(n, asked.column("h").to_pylist())])
    more = np.frombuffer(b"".join(asked.column("more").to_pylist()), np.uint32)
    items = Items(h, more if len(more) else np.zeros(len(h), np.uint32), 1)
    again = items.twice.copy()
    again[items.item_of[_bits(n, asked.column("twice").to_pylist())]] = True
    parts = np.split(again[items.item_of], np.cumsum(n)[:-1])
    told = pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())
    return pa.table({"chunk": asked.column("chunk"), "group": asked.column("group"), "n": asked.column("n"), "again": told})


def _told(answers: pa.Table, kind: int) -> np.ndarray:
    """The bits of the answers of one kind, in the order of the items."""
    rows = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("group")
    return _bits(rows.column("n").to_pylist(), rows.column("again").to_pylist())


class Candidates:
    """Anchors and passages of a chunk, the latter as soon as it is known which anchors occur again."""

    def __init__(self, passages: Passages, groups: int):
        self.passages, self.groups, self.at = passages, groups, passages.anchors()
        h = passages.hashes(self.at, passages.words - PERIOD + 1)
        self.anchors = Items(h, np.zeros(len(h), np.uint32), groups)

    def extend(self, again: np.ndarray) -> Items:
        self.windows = self.passages.around(self.at[again[self.anchors.item_of]])
        more = (self.passages.hashes(self.windows, self.passages.words, 1) >> _U(32)).astype(np.uint32)
        return Items(self.passages.hashes(self.windows, self.passages.words), more, self.groups)


def _passages(rows: pa.Table, words: int) -> Passages:
    return Passages(rows.column("text").to_pylist(), words)


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words of every row that no repeat covers, joined by one space.

    ``words`` must be at least PERIOD, so that anchors have a word.
    """
    if words < PERIOD:
        raise ValueError(f"passages need {PERIOD} words at least")
    chunks = durable(chunked(docs.select("doc_id", "text"), CHUNK), "substrings-chunks")
    # A word takes two characters at least, and a third of the words begin an anchor.
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = 1 + size * len(COVER) // (2 * PERIOD * GROUP)

    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                yield row["chunk"], rows_of(row["rows"], row["size"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in each(batches):
            yield Candidates(_passages(rows, words), groups).anchors.requests(chunk, False)

    def extend(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows_of(chunk.column("rows")[0].as_py(), chunk.column("size")[0].as_py())
        found = Candidates(_passages(rows, words), groups)
        items = found.extend(_told(answers, 0))
        return pa.Table.from_batches([items.requests(chunk.column("chunk")[0].as_py(), True)])

    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows_of(chunk.column("rows")[0].as_py(), chunk.column("size")[0].as_py())
        passages = _passages(rows, words)
        found = Candidates(passages, groups)
        items = found.extend(_told(answers, 0))
        gone = passages.covered(found.windows[_told(answers, 1)[items.item_of]])
        ends = np.cumsum(passages.sizes)
        removed = np.r_[0, np.cumsum(gone)]
        texts = [
            b" ".join(compress(own, ~gone[lo:hi])).decode() for own, lo, hi in zip(passages.tokens, passages.starts, ends)
        ]
        columns = {
            "doc_id": rows.column("doc_id"),
            "n_words": pa.array(passages.sizes),
            "n_removed": pa.array(removed[ends] - removed[passages.starts]),
            "text": pa.array(texts, pa.string()),
        }
        return pa.table(columns)

    def asked(requests: DataFrame, kind: int) -> DataFrame:
        told = durable(requests.groupBy("group").applyInArrow(_answered, _TOLD), "substrings-told")
        return told.withColumn("kind", F.lit(kind))

    anchors = asked(chunks.mapInArrow(ask, _ASKED), 0)
    requests = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, _ASKED)
    answers = anchors.unionByName(asked(requests, 1))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, text string"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, kinds)


def digests(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM words
), repeated AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p:p + 34], ' ')) AS n FROM windows)
  WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM repeated
), placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
