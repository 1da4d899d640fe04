"""Language-model scores from a log-frequency Bloom filter (operator 10).

All words and word pairs of the training texts are counted.  The filter holds each counted pair
once per level up to its quantised log frequency; a count is read back by asking level after
level until one is missing.  Words are kept with their exact counts.

Filter and words are dealt by ranges of hashes into groups whose number follows the size of the
training texts, so that a group has about FILTER_BYTES of bits at most; each is sized by its own
entries and nothing is left out at any size.  Texts are cut into chunks.
The distinct pairs and words of a chunk go to their groups, each group answers from its bits and
words, and the answers go back to the chunk, which is then scored.  A task holds one group or
one chunk.

The score of a token mixes the pair's relative frequency with the smoothed frequency of the
word; the share is the one of SHARES under which the training tokens, each left out of the
counts for itself, are most likely.  The base score takes the word's frequency alone.  Frequent
words (at most HEAD, by their share of all tokens) come from a broadcast table, which spares
their way to the groups.

Null texts count as empty: one end token.  Rows without doc_id are not learned from and are not
held out.  Equal rows are rows of their own; extra columns are ignored; an empty table gives an empty
result.  A very long text is a chunk of its own.  Of equally likely shares the smallest is taken.  Pair
counts are quantised and word counts exact, so the probabilities after a word may not add up to 1.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline.llm.common import chunked, dealt, durable, packed, rows_of, unpacked
from heedline.llm.langid import fold

# Of a group.
FILTER_BYTES = 1 << 20
SLICE_BYTES = 1 << 16
BITS_PER_ENTRY = 12
PROBES = 4
# Levels are powers of the root of two.
STEP = 2**0.5
FIRST_PAIR_LEVEL = 1
HEAD = 65_536
SHARES = (0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
# Bytes of text in a chunk, unless the last 128 texts have more.
CHUNK = 6_000_000
KNOWN_WORDS = 300_000
FLUSH = 5_000_000
START, END = 0x51ED270B7A1F3C95, 0x2545F4914F6CDD1D

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """48 bits, as the high ones: of a billion pairs 4 in a million share theirs, far fewer than the filter takes for others."""
    return _mix(left * _U(0x9E3779B97F4A7C15) ^ _mix(right + _U(0x632BE59BD9B4E019))) & _U(0xFFFFFFFFFFFF0000)


def level_values(levels: int = 200) -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers on it (index 0: none)."""
    out = np.zeros(levels + 1)
    for q in range(1, levels + 1):
        low, high = np.ceil(STEP ** (q - 1) - 1e-9), np.ceil(STEP**q - 1e-9) - 1
        out[q] = (low + high) / 2 if high >= low else STEP ** (q - 1)
    return out


class Words:
    """Hashes of the tokens of a text, the end token last."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        import xxhash

        tokens = text.encode("utf-8", "replace").lower().split()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for w in {*tokens}.difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        out = np.empty(len(tokens) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        out[-1] = END
        return out


PARTS = "group long, pair boolean, items long, h binary, n binary"


def parts_of(pair: bool, h: np.ndarray, n: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows of PARTS from sorted hashes and their counts."""
    of = dealt(h, groups)
    own, first = np.unique(of, return_index=True)
    spans = [*zip(first, [*first[1:], len(h)])]
    columns = [
        pa.array(own),
        pa.array(np.full(len(own), pair)),
        pa.array([b - a for a, b in spans], pa.int64()),
        pa.array([packed(h[a:b]) for a, b in spans], pa.binary()),
        pa.array([pa.compress(n[a:b].astype(np.int64).tobytes(), "zstd", asbytes=True) for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["group", "pair", "items", "h", "n"])


def counted(texts: DataFrame, groups: int) -> DataFrame:
    """PARTS: how often each word and each pair of neighbours occurs in parts of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def flush():
            for pair in (False, True):
                yield parts_of(pair, *np.unique(np.concatenate([h[pair] for h in held]), return_counts=True), groups)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                w = words.of(text or "")
                held.append((w, pair_hash(np.r_[_U(START), w[:-1]], w)))
                size += len(w)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.select("text").mapInArrow(run, PARTS)


class LogFrequencyFilter:
    """Levels of counted pairs in one group, by repeated membership probes."""

    def __init__(self, bits: np.ndarray, first_pair_level: int = FIRST_PAIR_LEVEL):
        self.bits, self.slices, self.first = bits, len(bits) // SLICE_BYTES, first_pair_level
        self.values = level_values()

    @staticmethod
    def probes(h: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        """First place and stride of an item's probes at a level (double hashing)."""
        x = _mix(h + _U(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
        return x >> _U(32), x & _U(0xFFFFFFFF) | _U(1)

    @staticmethod
    def place(start: np.ndarray, stride: np.ndarray, probe: int) -> np.ndarray:
        """A bit of the slice; its size is a power of two."""
        return (start + _U(probe) * stride) & _U(SLICE_BYTES * 8 - 1)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of pairs; 0 for those that are not in the filter.

        Items drop out with the first probe that fails, so most take one probe.
        """
        base = _mix(h ^ _U(START)) % _U(self.slices) * _U(SLICE_BYTES)
        level, at, step = np.zeros(len(h), np.uint8), np.arange(len(h)), 1
        while len(at) and step + self.first <= len(self.values):
            start, stride = self.probes(h[at], step)
            for probe in range(PROBES):
                bit = self.place(start, stride, probe)
                found = (self.bits[base[at] + (bit >> _U(3))] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0
                at, start, stride = at[found], start[found], stride[found]
            level[at] = step + self.first - 1
            step += 1
        return level


def exact(known: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Counts of words from the sorted hashes ``known``; 0 for others."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, n[at], 0)


class StoredGroups:
    """A stored table (group, h, n, bits, tokens, words) of words and filter; ``slices`` is what a group should have."""

    def __init__(self, table: DataFrame, groups: int, slices: int):
        self.table, self.groups, self.slices = table, groups, slices

    def counts(self, h: np.ndarray, pair: bool) -> np.ndarray:
        """Counts of few items, on the driver, group by group; 0 for items that are not known."""
        own, out = dealt(h, self.groups), np.zeros(len(h))
        for row in self.table.toLocalIterator():
            here = own == row["group"]
            if pair:
                model = LogFrequencyFilter(np.frombuffer(row["bits"], np.uint8))
                out[here] = model.values[model.levels(h[here])]
            else:
                out[here] = exact(np.frombuffer(row["h"], np.uint64), np.frombuffer(row["n"], np.int64), h[here])
        return out

    def frequent(self, bound: int) -> dict[int, int]:
        """Words with at least ``bound`` occurrences, by hash."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist()):
                    h, n = np.frombuffer(h, np.int64), np.frombuffer(n, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[n >= bound]) for x in (h, n)], ["h", "n"])

        rows = self.table.select("h", "n").mapInArrow(run, "h long, n long")
        return {r["h"] & (1 << 64) - 1: r["n"] for r in rows.collect()}


def filled(parts: DataFrame, groups: int, slices: int) -> StoredGroups:
    """Words and filter of PARTS; every group takes the slices that its entries need."""

    def fill(part: pa.Table) -> pa.Table:
        columns = [part.column(c).to_pylist() for c in ("pair", "items", "h", "n")]
        both = []
        for pair in (False, True):
            some = [(unpacked(h, k), pa.decompress(n, 8 * k, "zstd", asbytes=True)) for p, k, h, n in zip(*columns) if p == pair]
            h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in some)])
            h, at = np.unique(h, return_inverse=True)
            n = np.frombuffer(b"".join(x for _, x in some), np.int64)
            # Whole numbers are exact to 2**53.
            both.append((h, np.bincount(at, n, len(h)).astype(np.int64)))
        (words, counts), (h, n) = both
        steps = np.floor(np.log(n) / np.log(STEP) + 1e-9).astype(np.int64) + 2 - FIRST_PAIR_LEVEL
        own = max(1, -(-int(steps.sum()) * BITS_PER_ENTRY // (8 * SLICE_BYTES)))
        bits = np.zeros(own * SLICE_BYTES * 8, bool)
        base = _mix(h ^ _U(START)) % _U(own) * _U(SLICE_BYTES * 8)
        for step in range(1, int(steps.max(initial=0)) + 1):
            some = steps >= step
            start, stride = LogFrequencyFilter.probes(h[some], step)
            for probe in range(PROBES):
                bits[(base[some] + LogFrequencyFilter.place(start, stride, probe)).astype(np.int64)] = True
        row = {
            "group": pa.array([part.column("group")[0].as_py()], pa.int64()),
            "h": pa.array([words.tobytes()], pa.binary()),
            "n": pa.array([counts.tobytes()], pa.binary()),
            "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            "tokens": pa.array([int(counts.sum())], pa.int64()),
            "words": pa.array([len(words)], pa.int64()),
        }
        return pa.table(row)

    kinds = "group long, h binary, n binary, bits binary, tokens long, words long"
    return StoredGroups(durable(parts.groupBy("group").applyInArrow(fill, kinds), "lm-groups"), groups, slices)


def build_filter(counts: DataFrame, max_bytes: int = FILTER_BYTES) -> StoredGroups:
    """Words and filter of ``counts`` (pair, h, n), whole, in groups of about ``max_bytes``."""
    level = 1 + F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(STEP)) + 1e-9)
    entries = counts.agg(F.coalesce(F.sum(F.when(F.col("pair"), level).otherwise(1)), F.lit(0))).first()[0]
    needed = max(1, -(-entries * BITS_PER_ENTRY // (8 * SLICE_BYTES)))
    slices = min(needed, max(1, max_bytes // SLICE_BYTES))
    groups = -(-needed // slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.array(batch.column("pair").to_pylist(), bool)
            h, n = np.array(batch.column("h")).view(np.uint64), np.array(batch.column("n"))
            for kind in (False, True):
                some = np.flatnonzero(pair == kind)
                some = some[np.argsort(h[some])]
                yield parts_of(kind, h[some], n[some], groups)

    return filled(counts.select("pair", "h", "n").mapInArrow(run, PARTS), groups, slices)


class Chunk:
    """The tokens of a chunk by its distinct words and pairs, each sorted."""

    def __init__(self, texts: list[str | None], head: np.ndarray, groups: int):
        words = Words()
        tokens = [words.of(t or "") for t in texts]
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        w = np.concatenate(tokens)
        self.words, self.word_of = np.unique(w, return_inverse=True)
        # A text's start is as frequent as its end.
        left, self.left_of = np.r_[_U(START), w[:-1]], np.r_[0, self.word_of[:-1]]
        left[self.starts] = START
        self.left_of[self.starts] = np.searchsorted(self.words, _U(END))
        self.pairs, self.first, self.pair_of = np.unique(pair_hash(left, w), return_index=True, return_inverse=True)
        self.common = exact(head, np.ones(len(head), np.int64), self.words) > 0
        self.rare = np.flatnonzero(~self.common)
        self.word_groups, self.pair_groups = dealt(self.words[self.rare], groups), dealt(self.pairs, groups)


def scored(docs: DataFrame, model: StoredGroups, head: dict[int, int], total: int, distinct: int) -> DataFrame:
    """Per row: tokens, known ones, the base score and the scores under each share.

    ``fit`` has the log probabilities under each share of all training tokens of a chunk, left
    out one by one, on the chunk's first row.
    """
    context, groups = docs.sparkSession.sparkContext, model.groups
    keys = np.array(sorted(head), np.uint64)
    head_ = context.broadcast((keys, np.array([head[k] for k in keys.tolist()], np.int64)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = rows_of(batch.column("rows")[row].as_py(), batch.column("size")[row].as_py())
                chunk = Chunk(rows.column("text").to_pylist(), head_.value[0], groups)
                own = np.unique(np.r_[chunk.word_groups, chunk.pair_groups])
                parts = [pa.array([batch.column("chunk")[row].as_py()] * len(own), pa.int64()), pa.array(own)]
                for h, of in ((chunk.words[chunk.rare], chunk.word_groups), (chunk.pairs, chunk.pair_groups)):
                    spans = [*zip(np.searchsorted(of, own), np.searchsorted(of, own, "right"))]
                    parts.append(pa.array([b - a for a, b in spans], pa.int64()))
                    parts.append(pa.array([packed(h[a:b]) for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(parts, ["chunk", "group", "n_words", "words", "n_pairs", "pairs"])

    def answer(group: pa.Table, asked: pa.Table) -> pa.Table:
        if group.num_rows:
            h, n = (np.frombuffer(group.column(c)[0].as_py(), t) for c, t in (("h", np.uint64), ("n", np.int64)))
            bits = np.frombuffer(group.column("bits")[0].as_py(), np.uint8)
        else:
            h, n, bits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(SLICE_BYTES, np.uint8)
        requests = [asked.column(c).to_pylist() for c in ("n_words", "words", "n_pairs", "pairs")]
        n_words, n_pairs = requests[0], requests[2]
        words = [unpacked(data, k) for k, data in zip(n_words, requests[1])]
        pairs = [unpacked(data, k) for k, data in zip(n_pairs, requests[3])]
        words, pairs = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (words, pairs))
        # All requests at once, for few items cost as many calls as many.
        counts = exact(h, n, words).astype(np.int64)
        levels = LogFrequencyFilter(bits).levels(pairs)
        counts = [x.tobytes() for x in np.split(counts, np.cumsum(n_words)[:-1])] if n_words else []
        levels = [x.tobytes() for x in np.split(levels, np.cumsum(n_pairs)[:-1])] if n_pairs else []
        found = {"counts": pa.array(counts, pa.binary()), "levels": pa.array(levels, pa.binary())}
        return pa.table({"chunk": asked.column("chunk"), "group": asked.column("group")} | found)

    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        keys, n_head = head_.value
        rows = rows_of(chunks.column("rows")[0].as_py(), chunks.column("size")[0].as_py())
        row = {c: rows.column(c).to_pylist() for c in rows.column_names}
        chunk = Chunk(row["text"], keys, groups)
        answers = answers.sort_by("group")
        joined = [b"".join(answers.column(c).to_pylist()) for c in ("counts", "levels")]
        c = exact(keys, n_head, chunk.words).astype(float)
        c[chunk.rare] = np.frombuffer(joined[0], np.int64)
        both = level_values()[np.frombuffer(joined[1], np.uint8)]

        # What a token adds depends on its pair alone.
        right, before = c[chunk.word_of[chunk.first]], c[chunk.left_of[chunk.first]]

        def mixed(both, before, c, total):
            word = (c + 0.5) / (total + 0.5 * (distinct + 1))
            # Without the context the word's own frequency is all there is.
            pair = np.where(before > 0, np.minimum(both / np.maximum(before, 1), 1), word)
            return [np.log10(share * pair + (1 - share) * word) for share in SHARES]

        scores = np.stack([np.add.reduceat(x[chunk.pair_of], chunk.starts) for x in mixed(both, before, right, total)], 1)
        learned = np.repeat(np.array(row["train"], bool), chunk.sizes)
        times = np.bincount(chunk.pair_of[learned], minlength=len(both))
        fit = [float(x @ times) for x in mixed(*(np.maximum(x - 1, 0) for x in (both, before, right, float(total))))]
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        columns = {
            "doc_id": pa.array(row["doc_id"], pa.int64()),
            "train": pa.array(row["train"], pa.bool_()),
            "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64)[chunk.word_of], chunk.starts)),
            "base_score": pa.array(np.add.reduceat(base[chunk.word_of], chunk.starts)),
            "scores": pa.array(list(scores), pa.list_(pa.float64())),
            "fit": pa.array([fit] + [None] * (len(chunk.sizes) - 1), pa.list_(pa.float64())),
        }
        return pa.table(columns)

    chunks = durable(chunked(docs.select("doc_id", "train", "text"), CHUNK), "lm-chunks")
    kinds = "chunk long, group long, n_words long, words binary, n_pairs long, pairs binary"
    asked = chunks.mapInArrow(ask, kinds)
    kinds = "chunk long, group long, counts binary, levels binary"
    answers = model.table.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(answer, kinds)
    kinds = "doc_id long, train boolean, n_tokens long, n_known long, base_score double"
    kinds += ", scores array<double>, fit array<double>"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, kinds)


def language_model_scores(docs: DataFrame, max_bytes: int = FILTER_BYTES) -> DataFrame:
    """Base and model scores of every text, learned from rows with ``train``.

    Input: doc_id, text, train (boolean).
    """
    learned = docs.where("train")
    # Tokens with their ends: at most one for two characters, and one for each text.
    size = learned.agg(F.coalesce(F.sum(F.floor((F.length(F.coalesce("text", F.lit(""))) + 1) / 2) + 1), F.lit(0))).first()[0]
    # A token makes no more than 1.5 entries, as a pair seen twice has three levels.
    groups = max(1, -(-size * 3 * BITS_PER_ENTRY // (2 * 8 * max_bytes)))
    model = filled(counted(learned, groups), groups, max(1, max_bytes // SLICE_BYTES))
    total, distinct = model.table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words")]).first()
    # By their share of the tokens there are at most HEAD such words.
    head = model.frequent(max(1, -(-total // HEAD)))
    rows = durable(scored(docs, model, head, total, distinct), "lm-scores")

    best = rows.agg(*[F.sum(F.col("fit")[i]).alias(f"s{i}") for i in range(len(SHARES))]).first()
    share = max(range(len(SHARES)), key=lambda i: (best[i] is not None, best[i] or 0.0))
    return rows.select(
        "doc_id",
        "train",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        F.col("scores")[share].alias("score"),
    )


def scores(docs: DataFrame) -> DataFrame:
    train = F.coalesce(fold() != 1, F.lit(False)).alias("train")
    held_out = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    found = language_model_scores(docs.select("doc_id", "text", train))
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
