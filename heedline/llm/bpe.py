"""BPE encoding and decoding with a contiguous rank array (operator 6).

Texts are brought to the vocabulary's form (canonical composition, one space for white space,
lower case), cut into words by its pattern, and each distinct word of a batch is encoded:
an array holds the parts of the word and the merge ranks of neighbours; the smallest rank is
searched for, its boundary deleted, and the two ranks beside it looked up again, until no
neighbours can merge.  Words of one length are rows of one matrix, so each of these steps is
one numpy operation for all of them.  Very long words, for which repeated searching would take
quadratic time, keep their ranks in a heap; the result is the same.

Null texts count as empty and give no ids.  Only ``text`` is read; every row gives one row, in
any number and with any other columns, equal ids or none; an empty table gives an empty result.  Very
long texts are encoded whole.  Equal ranks are merged from the left.
"""

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heedline.llm.common import Recent, per_process, small_batches

# Of each generation.
KNOWN_UNITS, KNOWN_WORDS = 250_000, 250_000
# Texts that are encoded together.
GROUP = 256
SHORT_WORD = 128
NO_RANK = 1 << 30
# White space as the vocabulary's normaliser has it (fixed values).
WHITE_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# The vocabulary's own word pattern (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


# The vocabulary's library takes letters and numbers from Unicode 16.  Those that version 16 brought (fixed values):
UNICODE_16 = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D40-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 "
    "113D1 113D3 116D0-116E3 11BC0-11BE0 11BF0-11BF9 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 18CFF "
    "1CCF0-1CCF9 1E5D0-1E5ED 1E5F0-1E5FA"
)
# It takes lower forms from Unicode 17: capitals that versions 16 and 17 brought, and how far on the lower form is (fixed values).
LATER_CAPITALS = (
    "1C89:1 A7CB:-A567 A7CC:1 A7CE:1 A7D2:1 A7D4:1 A7DA:1 A7DC:-A641 10D50-10D65:20 16EA0-16EB8:1B"
)


def _span(text: str) -> range:
    first, _, last = text.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


class Letters:
    """Letters and numbers that are later than the library's, which to it are neither, and later lower forms."""

    def __init__(self):
        import regex

        known = {chr(c) for span in UNICODE_16.split() for c in _span(span)}
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        found = (c for c in regex.findall(r"[\p{L}\p{N}]", points) if unicodedata.category(c) == "Cn")
        self.later = frozenset(found).difference(known)
        self.lower = {}
        for entry in LATER_CAPITALS.split():
            span, _, step = entry.partition(":")
            self.lower.update({c: c + int(step, 16) for c in _span(span)})
        self.capitals = frozenset(map(chr, self.lower))
        self.words, self.words_before = regex.compile(WORDS), None

    def split(self, unit: str) -> list[str]:
        if unit.isascii() or self.later.isdisjoint(unit):
            return self.words.findall(unit)
        if self.words_before is None:
            import regex

            own = f"[{''.join(sorted(self.later))}]"
            pattern = WORDS.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{own})")
            pattern = pattern.replace(r"[\p{L}]+", rf"[\p{{L}}--{own}]+").replace(r"|[\p{N}]|", rf"|[\p{{N}}--{own}]|")
            self.words_before = regex.compile("(?V1)" + pattern)
        return self.words_before.findall(unit)

    def lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Letter by letter where a word end would change the lower form of sigma.
        low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return low if self.capitals.isdisjoint(low) else low.translate(self.lower)


class RankArray:
    """Merge ranks of a vocabulary file and the encoding of words by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + WORD_END] for x in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty)."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            raw = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, length)
            parts = self.inner[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            if length > SHORT_WORD:
                for i, p in zip(rows, parts):
                    out[i] = self.by_heap(p.tolist())
            else:
                self.by_scan(parts, np.array(rows), out)
        return out

    def by_scan(self, parts: np.ndarray, rows: np.ndarray, out: list) -> None:
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), int)
            every = np.arange(len(rows))
            best = ranks[every, at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            going = best < NO_RANK
            for i, p in zip(rows[~going].tolist(), parts[~going]):
                out[i] = p
            rows, parts, ranks, at, best = rows[going], parts[going], ranks[going], at[going], best[going]
            if not len(rows):
                return
            every, column = np.arange(len(rows)), at[:, None]
            parts[every, at] = self.merged[best]
            n = parts.shape[1]
            keep = np.arange(n - 1)
            parts = np.take_along_axis(parts, keep + (keep > column), 1)
            keep = np.arange(n - 2)
            ranks = np.take_along_axis(ranks, keep + (keep >= column), 1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < n - 2))
                where = side[ok]
                ranks[ok, where] = self.ranks(parts[ok, where], parts[ok, where + 1])

    def by_heap(self, parts: list[int]) -> np.ndarray:
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.ranks(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first.tolist()) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = int(self.merged[rank]), -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0:
                    r = int(self.ranks(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r < NO_RANK:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0])


class Codec:
    """Encodes and decodes texts; words, and units between spaces, are remembered, up to a bound."""

    def __init__(self, path: str):
        self.bpe, self.letters = RankArray(path), Letters()
        self.words_known, self.units_known = Recent(KNOWN_WORDS), Recent(KNOWN_UNITS)
        self.white = re.compile(WHITE_SPACE)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")")

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.letters.lowered(self.white.sub(" ", text))

    def _of_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        token = self.bpe.token
        ids = self.bpe.encode([w.encode() for w in words])
        return [(own.astype("<u4").tobytes(), " ".join([token[i] for i in own.tolist()])) for own in ids]

    def _of_units(self, units: list[str]) -> list[tuple[bytes, str]]:
        # Most units are one word: plain letters only.
        words = [[u] if u.isascii() and u.isalpha() else self.letters.split(u) for u in units]
        known = self.words_known.known({w for ws in words for w in ws}, self._of_words)
        out = []
        for ws in words:
            if len(ws) == 1:
                out.append(known[ws[0]])
            else:
                found = [known[w] for w in ws]
                out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text."""
        out = []
        for lo in range(0, len(texts), GROUP):
            split = []
            for text in texts[lo : lo + GROUP]:
                parts = self.cut.split(text) if "<|" in text else [text]
                split.append([p if k % 2 else [*filter(None, self.normal(p).split(" "))] for k, p in enumerate(parts)])
            known = self.units_known.known({u for s in split for p in s[::2] for u in p}, self._of_units)
            for parts in split:
                ids, shown = [], []
                for k, part in enumerate(parts):
                    if k % 2:
                        ids.append(np.array([self.bpe.special[part]], "<u4").tobytes())
                        shown.append(part)
                    elif part:
                        own_ids, own_shown = zip(*map(known.__getitem__, part))
                        ids += own_ids
                        shown += filter(None, own_shown)
                out.append((b"".join(ids), " ".join(shown)))
        return out


def _coded(docs: DataFrame, tokenizer_path: str, schema: str, columns) -> DataFrame:
    """``columns`` of (ids, decoded text) of every row, after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("bpe", tokenizer_path), lambda: Codec(tokenizer_path))
        for batch in batches:
            for part in small_batches([batch], GROUP):
                done = codec.encode([t or "" for t in part.column("text").to_pylist()])
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(done)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``ids`` (little-endian 32-bit numbers) and ``decoded`` to (doc_id, text)."""

    def columns(done: list) -> list[pa.Array]:
        return [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]

    return _coded(docs, tokenizer_path, "ids binary, decoded string", columns)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token counts and digests of what ``encode_and_decode`` gives, taken where it is made."""

    def columns(done: list) -> list[pa.Array]:
        return [
            pa.array([len(ids) // 4 for ids, _ in done], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in done], pa.string()),
            pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in done], pa.string()),
        ]

    return _coded(docs, tokenizer_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
