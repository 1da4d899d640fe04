"""The operators of heedline.llm against brute force, on small tables with every odd case."""

import collections
import hashlib
import math
import re
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heedline.llm import bpe, chat, common, langid, linededup, lm, minhash, packing, tokencount, topk, winnow

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "Short.",
    "The same line of text, long enough to count\nand another one",
    "The same line of text, long enough to count\n  THE SAME LINE OF TEXT, LONG ENOUGH TO COUNT \nown",
    "the same line of text, long enough to count",
    "double  spaces and\ttabs \n and   three,  before<|endoftext|> and  after <|startoftext|>x",
    "Ünïcödé ΣΑΣ ΟΔΟΣ İstanbul é  wide space 12345 don't 'll ²½ 中文字 🎉🎉",
    "x" * 5000 + " " + "word " * 3000,
    "line   sep \x1c odd \x85 white",
    "12345 67890 !!!",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a repeated id, a missing id, and an extra column named like a result."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    rows += [(5, ODD[5], "en", "s", 0), (7, "other text under the same id", None, None, None), (None, "no id", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    clash = ("n_lines", "n_dropped", "score", "lang_pred", "uid", "length", "n_tokens", "train", "first", "sequence_id")
    clash += ("doc", "edits", "key", "root", "sig", "h1", "owner", "range", "tail", "chunk", "group", "ids", "row", "t")
    return frame.select("*", *[F.lit("extra").alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


# 1: packing


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing_holds_every_token_once(request, which):
    frame = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter()
    for doc_id, text in texts_of(frame):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for piece, end in enumerate(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)):
            want[doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start = end
    rows = packing.packed_documents(frame, BYTE_BPE).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 1024)


def check_sequences(rows, capacity, slack=0.0):
    by_sequence = collections.defaultdict(list)
    for sequence, offset, length in rows:
        by_sequence[sequence].append((offset, length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    # No worse than plain best fit by falling length.
    rooms, n = [], 0
    for length in sorted((r[2] for r in rows), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            n += 1
            rooms.append(capacity - length)
    assert len(by_sequence) <= n * (1 + slack)


def test_packing_rules_of_many_lengths():
    rng = np.random.default_rng(3)
    counts = collections.Counter(rng.integers(129, 1024, 4000).tolist())
    rules, left = packing.grouping_rules(counts, 1024)
    load, seen = collections.Counter(), collections.Counter()
    for length, first, last, sequence, each, done in rules:
        for number in range(first, last):
            load[sequence + (number - first + done) // each] += length
            seen[length] += 1
    for length, first, last in left:
        seen[length] += last - first
    assert seen == counts and max(load.values()) <= 1024
    # Groups place much of it, and best fit puts the rest where it wastes next to nothing.
    assert sum(b - a for _, a, b in left) < 0.7 * 4000
    rest = packing.best_fit_rules(left, collections.Counter(1024 - x for x in load.values()), 1024)
    opened = max([len(load), *(s - (-(b - a + d) // e) for _, a, b, s, e, d in rest)])
    assert opened < 1.03 * sum(x * n for x, n in counts.items()) / 1024


def test_sequences_hold_the_ids_of_their_pieces(spark, docs, tmp_path):
    cut = packing.durable(packing.pieces(docs.limit(20), BYTE_BPE), "test-pieces")
    packed = packing.pack(cut)
    ids = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in cut.collect()}
    for row in packing.sequences(packed).collect():
        assert bytes(row["ids"]) == b"".join(ids[s["doc_id"], s["piece"]] for s in row["spans"])


# 2: top-k


def brute_top_k(rows, k):
    usable = [
        (i, [math.floor(256.0 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 400])
def test_top_k_is_exact_with_ties(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    # A third of all rows are one vector; some don't take part; one is shorter.
    rows += [(1000 + i, [0.5] * 8) for i in range(n // 2)]
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7)]
    rows += [(None, [1.0] * 8), (2200, [0.25] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = topk.top_k(frame.repartition(4), F.col("vec_id") % 50 == 0, 5)
    padded = [(i, v if v is None else [*v, *[0.0] * (8 - len(v))]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_top_k(padded, 5)


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect() == []


# 3: line dedup


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or doc == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_line_dedup(request, which):
    frame = request.getfixturevalue(which)
    rows = [(d if d is not None else -1, t) for d, t in texts_of(frame)]
    got = [(r[0] if r[0] is not None else -1, *r[1:]) for r in linededup.digests(frame).collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_line_dedup_keeps_other_columns(odd):
    kept = linededup.drop_lines(odd)
    assert {"lang", "source", "uid"} <= set(kept.columns) and kept.count() == odd.count()
    assert kept.where("n_dropped > 0 and text is null").count() == 0
    assert kept.where("text is null").count() == 1


def test_runs_compact_and_agree_with_one_count(spark, docs):
    lines = linededup.durable(linededup.lines_of(docs, 20), "test-lines")
    runs = linededup.LineRuns(spark, 4, fanout=2)
    for batch in linededup.run_batches(lines, 5):
        runs.add(batch)
    assert sum(len(level) for level in runs.levels) < 5
    want = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)), F.max("doc"))
    assert sorted(map(tuple, runs.totals().collect())) == sorted(map(tuple, want.collect()))
    runs.close()


# 4: preferences


def test_preferences_of_odd_turns(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "assistant", "b"),
        (2, 0, "user", "only a question"),
        (3, 0, "assistant", "hello"), (3, 0, "assistant", "hello"),
        (4, None, None, None), (4, 1, "assistant", ""), (4, 1, "user", "tie"),
        (None, 0, "user", "lost"),
        (5, 0, "user", "x" * 100_000), (5, 1, "assistant", "🎉"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = {r["conv_id"]: r for r in chat.preference_rows(frame).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    first = got[1]
    assert first["n_prompt_turns"] == 3
    assert first["prompt"] == turn("user", "q") + turn("assistant", "a") + turn("user", "q2")
    assert first["chosen"] == turn("assistant", "b") and first["rejected"] == turn("assistant", "a")
    for row in got.values():
        for side in ("chosen", "rejected"):
            spans = [tuple(map(int, s.split("+"))) for s in row[f"{side}_spans"].split(",") if s]
            assert all(row[side][a : a + n].endswith("<|im_end|>\n") for a, n in spans)
            assert len(spans) == row[side].count("<|im_start|>assistant\n")
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["n_prompt_turns"]) == ("", "", 1)
    # The repeated answer stands for the former one, so both sides are equal.
    assert got[3]["n_prompt_turns"] == 2
    assert got[4]["prompt"].startswith("<|im_start|>\n<|im_end|>\n")


def test_preferences_of_given_sides(spark):
    kind = f"id long, chosen {chat.TURNS}, rejected {chat.TURNS}"
    a, b = ("user", "q"), ("assistant", "x")
    frame = spark.createDataFrame([(1, [a, b], [a]), (2, None, [a]), (3, [b], [a, b])], kind)
    got = {r["id"]: r for r in chat.format_preferences(frame, "id").collect()}
    assert [got[i]["n_prompt_turns"] for i in (1, 2, 3)] == [1, 0, 0]
    assert got[1]["rejected"] == "" and got[2]["chosen"] == "" and got[3]["chosen_spans"][0]["start"] == 22
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_rows(empty).collect() == []


# 5: language ID


def test_language_on_held_out_rows(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predictions(docs.withColumn("score", F.lit("x"))).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in langid.predictions(odd.where("doc_id <> 7 or lang is not null")).collect()}
    for i, text in enumerate(ODD):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[i]["lang_pred"] == "und") == (not letters)
    assert rows[None]["held_out"] is True
    assert langid.predictions(none).collect() == []


def test_gradients_are_those_of_the_loss():
    network = langid.Network.new(["a", "b", "c"], hidden=4)
    network.params = {k: v.astype(np.float64) for k, v in network.params.items()}
    raw, target = np.frombuffer(b"hello world!", np.uint8).reshape(3, 4), np.array([0, 1, 2])

    def loss():
        p = network.log_probabilities(raw)
        return -p[np.arange(3), :, target].sum() / raw.size

    rng = np.random.default_rng(0)
    for name, grad in network.gradients(raw, target).items():
        value = network.params[name]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name.startswith("in"):
                at = (int(raw.ravel()[rng.integers(0, raw.size)]), at[1])
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            # States are kept in single precision.
            assert abs((up - down) / 2e-5 - grad[at]) < 2e-3


# 6: BPE


def expected_codes(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_bpe_equals_the_library(request, which):
    frame = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for doc_id, text in texts_of(frame):
        ids, decoded = expected_codes(text, tokenizer)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(frame, WORD_BPE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_of_all_kinds_of_letters():
    tokenizer, codec = Tokenizer.from_file(WORD_BPE), bpe.Codec(WORD_BPE)
    rng = np.random.default_rng(5)
    alphabet = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(150)]
    texts += ["a" * n for n in (127, 128, 129, 700)] + ["abcab" * 90 + "ß"]
    for text, (ids, decoded) in zip(texts, codec.encode(texts)):
        want, shown = expected_codes(text, tokenizer)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == shown


# 7: near duplicates


def brute_groups(rows, threshold):
    def lower(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    big = 1 << 63
    least = {g: min(rows[i][0] if rows[i][0] is not None else big for i in range(len(rows)) if group[i] == g) for g in set(group)}
    named = [least[g] if least[g] != big else None for g in group]
    return sorted(((d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, named)), key=str)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_near_duplicates(request, which):
    frame = request.getfixturevalue(which)
    got = [tuple(r) for r in minhash.components(frame, 85).collect()]
    assert sorted(got, key=str) == brute_groups(texts_of(frame), 85)


@pytest.fixture(scope="module")
def near_copies(spark):
    """One large group of near copies, many below the threshold of each other, and clean texts."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 4))):
            words[at] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, " ".join(f"u{rng.integers(0, 10**6)}" for _ in range(60))) for i in range(50)]
    rows += [(900 + i, " ".join(base)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("cell", [16, 256])
def test_near_copies_in_one_large_group(near_copies, cell, monkeypatch):
    # Small cells cut the group's buckets into many blocks.
    monkeypatch.setattr(minhash, "CELL", cell)
    got = [tuple(r) for r in minhash.components(near_copies, 85).collect()]
    assert sorted(got, key=str) == brute_groups(texts_of(near_copies), 85)


def test_members_of_different_roots_meet_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 8)
    rng = np.random.default_rng(5)
    # A root with much of its bucket, another with a good deal, and many small ones.
    roots = [0] * 90 + [1] * 20 + rng.integers(2, 40, 60).tolist()
    rows = [(key, 0, uid + 1000 * key, root, b"s") for key in (1, 2) for uid, root in enumerate(roots[:: key])]
    members = spark.createDataFrame(rows, "key long, band int, uid long, root long, sig binary")
    cells = collections.defaultdict(set)
    for r in minhash.crossing(members).collect():
        cells[r["key"], r["first"], r["second"]].add((r["block"], r["uid"], r["root"]))
    met = collections.Counter()
    for (_, first, second), own in cells.items():
        for a in own:
            for b in own:
                if a[1] < b[1] and a[2] != b[2] and (first == second or a[0] != b[0]):
                    met[a[1], b[1]] += 1
    want = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and a[3] != b[3]}
    assert set(met) == want and set(met.values()) == {1}
    # The rows of the large root meet what is not theirs, not each other.
    assert sum(map(len, cells.values())) < len(rows) * 40


def test_a_group_in_one_bucket_comes_together_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 8)
    made = []
    keep = minhash.alike_in_cells

    def counted(*args):
        found = keep(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(minhash, "alike_in_cells", counted)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:200], f"own{i}", *words[200:]])) for i in range(160)]
    got = minhash.components(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r["component_id"] for r in got} == {0}
    # A pair for a member, band and round; not one for each block that it could meet.
    assert sum(made) < 2 * 160 * minhash.FIRST_BANDS


def test_near_duplicates_name_one_row_each(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert minhash.components(none, 85).collect() == []


def test_signature_is_that_of_the_sequential_walk():
    sets = [np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 700)]
    m = 48
    got = minhash.super_minhash(sets, m)
    # Sets of all sizes signed together are as when signed alone, by either way.
    alone = np.concatenate([minhash.super_minhash([s], minhash.PLACES, 3) for s in sets])
    assert (minhash.signatures(sets) == alone).all()
    for own, row in zip(sets, got):
        want = [1 << 64] * m
        for element in own:
            order = list(range(m))
            for j in range(m):
                x = int(minhash._mix(np.array([(int(element) + (j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
                k = j + ((x >> 32) * (m - j) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], j << 32 | x & 0xFFFFFFFF)
        assert row.tolist() == want


# 8: fingerprints


def gram_hashes(text, gram):
    """Gram by gram, term by term."""
    codes, n = np.array([ord(c) + 1 for c in text], np.uint64), len(text) - gram + 1
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h += codes[i : i + n] * np.uint64(pow(winnow.BASE, i, 1 << 64))
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).tolist()


def brute_fingerprint(text, gram=winnow.GRAM, window=winnow.WINDOW):
    if len(text) < gram + window - 1:
        gram, window = min(winnow.SHORT_GRAM, len(text)), 1
    hashes = gram_hashes(text, gram) if text else []
    chosen = []
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i : i + window]
        at = max(j for j in range(len(part)) if part[j] == min(part)) + i
        if not chosen or chosen[-1] != (hashes[at], at):
            chosen.append((hashes[at], at))
    return chosen


def near(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_fingerprints(request, which):
    frame = request.getfixturevalue(which)
    rows = texts_of(frame)
    # Ids that occur once, apart from those whose next row is one of several.
    got = {r["doc_id"]: r for r in winnow.digests(frame).collect()}
    rows = sorted({(d if d is not None else -1, t or "") for d, t in rows}, reverse=True)
    ids = collections.Counter(d for d, _ in rows)
    for (doc, text), (after, next_text) in zip(rows, [*rows[1:], rows[0]]):
        if ids[doc] > 1 or ids[after] > 1:
            continue
        row = got[doc if doc >= 0 else None]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + next_text[:cut]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (brute_fingerprint(t) for t in (text, edited, next_text))
        assert row["n_chars"] == len(text)
        assert row["fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in own)
        assert row["edited_fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in other)
        assert row["near_edited"] == pytest.approx(near(own, other)) and row["near_next"] == pytest.approx(near(own, following))


def test_fingerprints_of_one_row_and_none(spark, none, odd):
    one = spark.createDataFrame([(3, "abcdefghi " * 9)], "doc_id long, text string")
    row = winnow.digests(one).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 90
    assert winnow.digests(none).collect() == []
    assert winnow.digests(odd).count() == odd.count()
    assert winnow.fingerprints(odd).count() == odd.count()


def test_short_texts_are_like_their_edited_forms(spark):
    rows = [(i, f"short text number {i} that has its own end") for i in range(6)] + [(9, "tiny"), (8, "tiny"), (10, "")]
    got = {r["doc_id"]: r for r in winnow.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["near_edited"] > 0.3 for i in range(1, 6)) and got[9]["near_next"] == 1.0


def test_shared_passages_are_always_found():
    rng = np.random.default_rng(2)
    letters = [chr(97 + i) for i in range(26)]
    winnower = winnow.Winnower()
    for _ in range(50):
        shared = "".join(rng.choice(letters, winnow.GRAM + winnow.WINDOW - 1))
        a, b = ("".join(rng.choice(letters, 300)) + shared + "".join(rng.choice(letters, 99)) for _ in range(2))
        assert near(winnower.fingerprint(a).tolist(), winnower.fingerprint(b).tolist()) > 0


# 9: token counts


def test_counts_after_edits_equal_full_counts(docs):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    counter = tokencount.Counter(BYTE_BPE)
    rng = np.random.default_rng(9)
    texts = [r["text"] for r in docs.select("text").limit(40).collect()] + [t for t in ODD if t is not None]
    inserts = ["", " ", "  ", "\n", "x", " new words here", "<|endoftext|>", "a  b", "\n\n "]
    for text in texts:
        tree = counter.tree(text)
        assert tree.tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)
        for _ in range(12):
            at, remove = int(rng.integers(-2, len(text) + 3)), int(rng.choice([0, 1, 2, 7, 300]))
            insert = str(rng.choice(inserts))
            lo = min(max(at, 0), len(text))
            want = text[:lo] + insert + text[lo + remove :]
            text, _ = counter.edit(text, tree, at, remove, insert)
            assert text == want and tree.chars == len(text)
            assert tree.tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_only_the_touched_region_is_encoded(spark):
    text = "some words of a long text " * 5000
    frame = spark.createDataFrame([(1, text, [(60_000, 5, "new")])], f"doc_id long, text string, edits {tokencount.EDITS}")
    trees = tokencount.with_trees(frame, BYTE_BPE).select("doc_id", "tree")
    row = tokencount.apply_edits(frame.join(trees, "doc_id"), BYTE_BPE).first()
    assert row["encoded_chars"] < 1000 and row == tokencount.apply_edits(frame, BYTE_BPE).first()
    assert row["n_tokens"] == len(Tokenizer.from_file(BYTE_BPE).encode(row["text"], add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(odd, none):
    assert tokencount.edited_counts(odd, BYTE_BPE).count() == odd.count()
    assert tokencount.edited_counts(none, BYTE_BPE).collect() == []
    assert tokencount.with_trees(odd.select("doc_id", "text"), BYTE_BPE).where("n_tokens is null").count() == 0


# 10: language model


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_base_scores_are_exact(request, which, monkeypatch):
    # A small head sends most words through the join.
    monkeypatch.setattr(lm, "HEAD", 64)
    frame = request.getfixturevalue(which)
    rows = texts_of(frame)
    split = lambda t: [*(t or "").encode().lower().split(), None]
    remainder = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 5
    counts = collections.Counter(w for d, t in rows if remainder(d) not in (1, None) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in rows:
        tokens = split(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[d, remainder(d) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    got = lm.scores(frame).collect()
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    if which == "docs":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 1.05


def test_filter_counts_are_close_and_bounded(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(1 << 62), 1 << 62, 5000)
    n = np.exp(rng.uniform(0, 9, 5000)).astype(int)
    frame = spark.createDataFrame([(True, int(a), int(b)) for a, b in zip(h, n)], "pair boolean, h long, n long")
    model = lm.build_filter(frame)
    got = model.counts(h.view(np.uint64), True)
    kept = n >= 2
    assert (np.abs(np.log2(got[kept] / n[kept])) <= 0.6).mean() > 0.99
    absent = model.counts(rng.integers(-(1 << 62), 1 << 62, 5000).view(np.uint64), True)
    assert (absent > 0).mean() < 0.02
    small = lm.build_filter(frame, max_bytes=2 * lm.SLICE_BYTES // 2)
    assert small.slices == 1


def test_a_filter_over_its_bound_keeps_every_pair(spark):
    rng = np.random.default_rng(5)
    h = rng.integers(-(1 << 62), 1 << 62, 6000)
    n = np.exp(rng.uniform(1, 9, 6000)).astype(int)
    frame = spark.createDataFrame([(True, int(a), int(b)) for a, b in zip(h, n)], "pair boolean, h long, n long")
    small = lm.build_filter(frame, max_bytes=lm.SLICE_BYTES)
    assert small.groups > 1
    got = small.counts(h.view(np.uint64), True)
    assert (got > 0).all()
    assert (np.abs(np.log2(got / n)) <= 0.6).mean() > 0.99


def test_scores_do_not_depend_on_the_bound(docs):
    frame = docs.select("doc_id", "text", (F.col("doc_id") % 5 != 1).alias("train"))
    frame = frame.withColumn("text", F.concat_ws(" ", "text", F.reverse("text")))
    small, large = (
        {r["doc_id"]: r["score"] for r in lm.language_model_scores(frame, max_bytes=b).collect()}
        for b in (lm.SLICE_BYTES, 64 * lm.SLICE_BYTES)
    )
    # False positives differ, as slices do, and one may tell in a short text.
    assert small.keys() == large.keys()
    assert sum(small.values()) == pytest.approx(sum(large.values()), rel=0.005)


def test_pairs_counted_once_are_evidence(spark):
    words = [f"w{i}" for i in range(200)]
    mixed = words[::2] + words[1::2]
    rows = [(1, " ".join(words), True), (2, " ".join(words), False), (3, " ".join(mixed), False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in lm.language_model_scores(frame).collect()}
    assert got[2]["base_score"] == pytest.approx(got[3]["base_score"])
    assert got[2]["score"] > got[3]["score"] + 1


def test_word_counts_are_exact_over_the_bound(spark):
    rng = np.random.default_rng(6)
    h, n = rng.integers(-(1 << 62), 1 << 62, 60_000), rng.integers(1, 2000, 60_000)
    frame = spark.createDataFrame([(False, int(a), int(b)) for a, b in zip(h, n)], "pair boolean, h long, n long")
    words = lm.build_filter(frame, max_bytes=lm.SLICE_BYTES)
    assert words.groups > 1
    assert (words.counts(h.view(np.uint64), False) == n).all()


def test_language_model_of_nothing(none):
    assert lm.scores(none).collect() == []


def test_plain_texts_load_one_vocabulary(monkeypatch):
    def refuse(path):
        raise AssertionError("a second vocabulary")

    whole = Tokenizer.from_file(BYTE_BPE)
    monkeypatch.setattr("tokenizers.Tokenizer.from_file", refuse)
    ids = packing.byte_encoder(BYTE_BPE)
    plain = ["", "some plain words", "  two  spaces ", "naïve 中文"]
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in plain]
    assert ids(plain) == expected
    # Strings of special tokens take it.
    with pytest.raises(AssertionError, match="second"):
        ids(["before<|endoftext|>"])


def test_units_are_not_kept_beyond_a_task():
    encode = packing.token_ids(BYTE_BPE)
    encode([["some", "words", "of one task"]])
    kept = vars(sys.modules["pyspark"])["_heedline_kept"]
    assert not any(key[0] == "units" for key in kept)


def test_rules_need_no_python_worker(spark):
    numbers = spark.range(6).select(F.lit(4).cast("long").alias("length"), F.col("id").alias("number"), F.col("id").alias("uid"))
    for rules, expected in (([], []), ([(4, 1, 5, 7, 2, 1)], [(1, 7), (2, 8), (3, 8), (4, 9)])):
        found = packing.placed(numbers, rules, "plan")
        assert sorted((r["uid"], r["plan"]) for r in found.collect()) == expected
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()


def test_workers_give_back_what_is_free():
    def anonymous():
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"\nAnonymous:\s+(\d+)", file.read())[1]) / 1024

    held = []

    def run(batches):
        many = [bytearray(4000) for _ in range(50_000)]
        # One that stays keeps the heap from shrinking at its end.
        held.append(many[-1])
        yield from batches
        del many

    before = anonymous()
    for _ in run([None]):
        pass
    assert anonymous() - before > 100
    for _ in common.released(run)([None]):
        pass
    assert anonymous() - before < 60
