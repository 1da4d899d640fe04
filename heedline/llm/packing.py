"""Best-fit packing by linear grouping (operator 1).

Documents become token pieces of at most ``capacity`` ids, and the pieces are packed into as
few sequences as possible, in these steps:

1. A histogram of piece lengths (at most ``capacity`` rows) goes to the driver.
2. Large lengths (over ``capacity / SMALL``) are sorted downwards and cut into GROUPS groups of
   equal cardinality; each length is rounded up to the largest of its group.
3. With so few sizes, the fractional packing over configurations is solved to the optimum by
   column generation.  A SHARE of each configuration's multiple is used, without its smallest
   slot: sizes are rounded, so whole configurations leave gaps that nothing fits.
4. Actual pieces are put into the slots of their group, which leaves some room more.
5. What is left, large pieces first and then the small ones, goes downwards by length to the
   sequence with the least room that holds it, counted over the real room of each sequence.

Steps 2, 3 and 5 work on counts by length, so the driver's part does not grow with the data.
Each gives rules "pieces a..b of length x go to sequences from c on, d to each"; tasks apply
the rules to piece numbers that are made without bringing equal lengths together.

Null and empty texts are one piece with the end id alone.  Rows with equal or null doc_id are
packed as rows of their own.  Other columns of the input are ignored; an empty table gives an
empty result.
"""

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heedline.llm.bpe import byte_letters
from heedline.llm.common import durable, numbered, per_process, released, row_ids, small_batches

CAPACITY = 1024
END_ID = 2
GROUPS = 64
SMALL = 8
SHARE = 0.7
# Pieces between spaces whose ids a task remembers; the store is emptied when full.
KNOWN_UNITS = 300_000

# The byte-level split pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "uid long, doc_id long, piece int, start long, length long, ids binary"


def unit_splitter():
    """Splits a text at each single space between two visible characters.

    The byte-level pattern never joins characters across the place before such a space, so the
    ids of a text are the ids of its units one after another, and equal units have equal ids.
    Every unit but the first stands for itself and the space before it.
    """
    import re

    gaps, cut = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")

    def units(text: str) -> list[str]:
        if gaps.search(text) or text[:1].isspace() or text[-1:].isspace():
            return cut.split(text)
        return text.split(" ")

    return units


def byte_encoder(tokenizer_path: str):
    """``ids(texts) -> list of bytes`` for a byte-level vocabulary file.

    The vocabulary's merges are those of its ranks, so tiktoken gives the ids that tokenizers
    gives (held against each other in the tests), in a third of the time.  Texts that may hold a
    special token's string, which tokenizers turns into that token, go to tokenizers itself.
    """
    import json
    from functools import cache
    from struct import pack

    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    del spec, ranks
    # A second vocabulary in memory, which few workers need.
    whole = cache(lambda: Tokenizer.from_file(tokenizer_path))

    def ids(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(s in text for s in special):
                found = whole().encode(text, add_special_tokens=False).ids
            else:
                found = plain.encode_ordinary(text)
            out.append(pack(f"<{len(found)}I", *found))
        return out

    return ids


def token_ids(tokenizer_path: str):
    """``encode(units) -> list of bytes``: the ids of each text, as little-endian 32-bit numbers.

    Texts are given by their units, and few at a time; the first unit of each may be None,
    which stands for nothing.
    """
    ids = per_process(("byte-encoder", tokenizer_path), lambda: byte_encoder(tokenizer_path))
    known: dict[str, bytes] = {}

    def encode(units: list[list[str | None]]) -> list[bytes]:
        if len(known) > KNOWN_UNITS:
            known.clear()
        rest = [u[1:] for u in units]
        new = list(set().union(*rest).difference(known))
        known.update(zip(new, ids([" " + u for u in new])))
        first = ids([u[0] or "" for u in units])
        return [a + b"".join(map(known.__getitem__, r)) for a, r in zip(first, rest)]

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of ``docs`` (doc_id, text): ids, their place in the document, length.

    Longer documents are cut from the end, so only the first piece may be shorter than
    ``capacity``.  ``uid`` is unique over all pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, units, uid = token_ids(tokenizer_path), unit_splitter(), row_ids()
        for batch in small_batches(batches):
            out = [[] for _ in range(6)]
            split = [units(t or "") for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(split)):
                ids += end
                n = len(ids) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for piece, stop in enumerate(ends):
                    row = (next(uid), doc_id, piece, start, stop - start, ids[4 * start : 4 * stop])
                    for column, value in zip(out, row):
                        column.append(value)
                    start = stop
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("uid", "doc_id", "piece", "start", "length", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(released(cut), PIECES)


def best_fill(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The configuration (copies of each size, within ``capacity``) of the highest total value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    w = np.array(sizes)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(w <= room)
        if len(fits):
            got = best[room - w[fits]] + values[fits]
            k = int(got.argmax())
            if got[k] > best[room] + 1e-12:
                best[room], choice[room] = got[k], fits[k]
    copies, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            copies[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), copies


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 400) -> list[tuple[int, np.ndarray]]:
    """Whole multiples of configurations that together use no more than ``demand``.

    The fractional optimum by column generation, each multiple rounded down.
    """
    n, need = len(sizes), np.array(demand, float)
    if not n:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = best_fill(prices, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        level, slope = np.linalg.solve(basis, need), np.linalg.solve(basis, column.astype(float))
        rising = slope > 1e-9
        ratio = np.where(rising, level / np.where(rising, slope, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.linalg.solve(basis, need)
    left, used = np.array(demand), []
    for j in np.argsort(-level):
        column = np.rint(basis[:, j]).astype(int)
        times = min([int(max(0, level[j]) + 1e-6), *(left[column > 0] // column[column > 0]).tolist()])
        if times > 0:
            used.append((times, column))
            left = left - times * column
    return used


def grouping_rules(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple], list[tuple]]:
    """Rules (length, first, last, sequence, each) of the large pieces, and (length, first, last) left.

    ``counts`` has the number of pieces of each length; pieces of a length are numbered from 0.
    """
    total = sum(counts.values())
    spans: list[list[tuple]] = []  # of each group: (length, first, last), longest first
    sizes, room = [], 0
    for length in sorted(counts, reverse=True):
        first = 0
        while first < counts[length]:
            if room == 0:
                room = -(-total // groups)
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    spans.append([])
            last = min(counts[length], first + room)
            spans[-1].append((length, first, last))
            room -= last - first
            first = last
    demand = [sum(b - a for _, a, b in s) for s in spans]
    rules, sequence, place = [], 0, [list(s) for s in spans]
    for multiple, column in configurations(sizes, demand, capacity):
        times = int(multiple * SHARE)
        if column.sum() > 1:
            column[np.flatnonzero(column)[-1]] -= 1
        for g in np.flatnonzero(column):
            each, done = int(column[g]), 0
            while done < times * each:
                length, first, last = place[g][0]
                take = min(last - first, times * each - done)
                # Slot t of this configuration and group belongs to its copy t // each.
                rules.append((length, first, first + take, sequence, each, done))
                done += take
                place[g][0] = (length, first + take, last)
                if first + take == last:
                    place[g].pop(0)
        sequence += times
    return rules, [span for rest in place for span in rest]


def best_fit_rules(items: list[tuple], rooms: dict[int, int], capacity: int) -> list[tuple]:
    """Best fit, downwards by length, of (length, first, last) into sequences with known room.

    ``rooms`` has the number of open sequences by room; they are numbered from 0 upwards by
    room, and new sequences follow.  Rules are as in ``grouping_rules``.
    """
    open_: dict[int, list[tuple]] = {}
    numbers = 0
    for room in sorted(rooms):
        open_[room] = [(numbers, numbers + rooms[room])]
        numbers += rooms[room]
    by_room = sorted(r for r in open_ if r > 0)
    rules = []

    def give_back(room: int, span: tuple) -> None:
        if room > 0 and span[0] < span[1]:
            if not open_.get(room):
                open_[room] = []
                insort(by_room, room)
            open_[room].append(span)

    for length, first, last in sorted(items, reverse=True):
        while first < last:
            at = bisect_left(by_room, length)
            if at == len(by_room):
                each = capacity // length
                span = (numbers, numbers - (-(last - first) // each))
                numbers, room = span[1], capacity
            else:
                room = by_room[at]
                each = room // length
                span = open_[room].pop()
                if not open_[room]:
                    by_room.pop(at)
            full = min((last - first) // each, span[1] - span[0])
            if full:
                rules.append((length, first, first + full * each, span[0], each, 0))
                first += full * each
                give_back(room - each * length, (span[0], span[0] + full))
                give_back(room, (span[0] + full, span[1]))
            else:
                rules.append((length, first, last, span[0], last - first, 0))
                give_back(room - (last - first) * length, (span[0], span[0] + 1))
                give_back(room, (span[0] + 1, span[1]))
                first = last
    return rules


RULES = ["length", "first", "last", "sequence", "each", "done"]


def local_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of numbers, as an Arrow table: rows of Python objects would need Python workers to be read."""
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    schema = pa.schema([(name, pa.int64()) for name in names])
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema))


def placed(numbered_pieces: DataFrame, rules: list[tuple], name: str) -> DataFrame:
    """Applies rules to (length, number).

    The rules are broadcast: their number depends on the capacity and the groups, not on the
    pieces, as each rule ends a span of one length, a configuration slot or a class of room.
    There are at most ``capacity`` lengths, GROUPS slots in each of as many configurations, and for
    every length ``capacity`` classes of room, so with 1024 a million rules of 48 bytes if all occur.
    """
    table = F.broadcast(local_rows(numbered_pieces.sparkSession, rules, RULES))
    number = F.col("number")
    found = numbered_pieces.join(table, "length").where((number >= F.col("first")) & (number < F.col("last")))
    copy = F.floor((number - F.col("first") + F.col("done")) / F.col("each"))
    return found.withColumn(name, F.col("sequence") + copy).drop("first", "last", "sequence", "each", "done")


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (uid, length and any other columns)."""
    narrow = cut.select("uid", "length")
    counts = {r["length"]: r["n"] for r in narrow.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    pieces_ = durable(numbered(narrow, "length", "uid", total, "number"), "pack-numbers")

    large = {x: n for x, n in counts.items() if capacity // SMALL < x < capacity}
    rules, items = grouping_rules(large, capacity, groups)
    items += [(x, 0, n) for x, n in counts.items() if x <= capacity // SMALL]

    by_plan = placed(pieces_, rules, "plan")
    rooms_ = by_plan.groupBy("plan").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms_ = durable(rooms_, "pack-rooms")
    rooms = {r["room"]: r["n"] for r in rooms_.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for room in sorted(rooms):
        starts.append((room, before))
        before += rooms[room]
    spark = cut.sparkSession
    starts_ = F.broadcast(local_rows(spark, starts, ["room", "before"]))  # a row per room
    sequences = numbered(rooms_, "room", "plan", before, "at").join(starts_, "room")
    sequences = sequences.select("plan", (F.col("before") + F.col("at")).alias("sequence_id"))

    rest = best_fit_rules(items, rooms, capacity)
    opened = max([before, *(s - (-(b - a + d) // e) for _, a, b, s, e, d in rest)])
    rest.append((capacity, 0, counts.get(capacity, 0), opened, 1, 0))
    found = ["uid", "length", "sequence_id"]
    chosen = by_plan.join(sequences, "plan").select(*found).unionByName(placed(pieces_, rest, "sequence_id").select(*found))
    ordered = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    # Places are settled on narrow rows; ids move once.
    places = chosen.select("uid", "sequence_id", offset)
    return cut.join(places, "uid").select(*[c for c in cut.columns if c != "uid"], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences, from packed pieces that still have their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    joined = F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))")
    spans = F.expr("transform(parts, p -> struct(p.doc_id, p.piece, p.offset, p.length))")
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", joined.alias("ids"), spans.alias("spans"))


def packed_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece with the checksum of its ids and its place, and with the ids if they are asked for.

    ``sequences`` joins pieces with ids to packed sequences.
    """
    cut = pieces(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return pack(durable(cut if with_ids else cut.drop("ids"), "pack-pieces"), capacity).select(*kept)
