"""Spelling variants, hard negatives and repeated passages against brute force, on small tables with every odd case."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heedline.llm import negatives, spelling, substrings

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, key string, n int, word string, chunk int, uid int"
CLASH = ("x", 1, "w", 2, 3)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOC_SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 11: spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute_variants(rows):
    total = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    # Words one edit apart are equal once a letter is left out of one or both.
    shorter, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for short in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shorter[short].add(w)
    for own in shorter.values():
        for a, b in itertools.permutations(own, 2):
            if b not in near[a] and one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def check_variants(rows, table):
    want = brute_variants(rows)
    assert want and sorted((tuple(r) for r in spelling.variant_groups(table).collect()), key=str) == want


def test_variants_of_the_table(docs):
    check_variants([(r["doc_id"], r["text"]) for r in docs.collect()], docs)


@pytest.mark.parametrize("size", [7, 4096])
def test_variants_of_odd_texts(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "RANGE", size)
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    # Chains of forms, words with one head, words longer than the table of skips, ties.
    words += ["kettle"] * 40 + ["kettlé"] * 12 + ["kittlé"] * 5 + ["KETTLE"] + ["Ünder", "under", "ünder", "×ander"] * 4
    words += [w for i in range(66) for w in ["z" * 70 + "y" * i, "z" * 69 + "x" + "y" * i] for _ in range(3)]
    words += ["q" * 3000] * 3 + ["q" * 1500 + "p" + "q" * 1499] * 7
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::9])) for i in range(9)] + [(3, None), (3, ""), (None, "no id here, kettle-kettle"), (4, " 12 ")]
    rows += [rows[0], rows[0]]
    check_variants(rows, frame(spark, rows))


def test_scan_finds_what_deletions_find():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 9))) for _ in range(3000)})
    for side in (words, sorted(w[::-1] for w in words)):
        heads = [len(w) // 3 for w in side]
        q, w = spelling.SortedList(side).near(side, heads)
        got = sorted(zip(q.tolist(), w.tolist()))
        by_head = collections.defaultdict(list)
        for j, x in enumerate(side):
            for h in range(len(x) + 1):
                by_head[x[:h]].append(j)
        want = [(i, j) for i, a in enumerate(side) for j in by_head[a[: heads[i]]] if one_edit(a, side[j])]
        assert got == sorted(want)


def test_no_words(spark):
    assert spelling.variant_groups(frame(spark, [(1, None)])).collect() == []
    assert spelling.variant_groups(frame(spark, [(1, "x")]).limit(0)).collect() == []


# 12: hard negatives


def brute_negatives(rows, asks, positives=5, negatives_=3):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    rows = [r for r in rows if all(x is not None and np.isfinite(x) for x in r[2])]
    dims = max((len(r[2]) for r in rows), default=0)
    codes = [[int(np.floor(256 * float(np.float32(x)))) for x in r[2]] + [0] * (dims - len(r[2])) for r in rows]
    out = []
    for a, code in zip(rows, codes):
        if not asks(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(code, c)), r[0], r[1]) for r, c in zip(rows, codes) if r[0] != a[0]]
        scored.sort()
        for minus, positive, _ in [s for s in scored if s[2] == a[1]][:positives]:
            kept = [s for s in scored if s[2] != a[1] and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(a[0], positive, k, s[1], -minus, -s[0]) for k, s in enumerate(kept[:negatives_], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(64, 16), (8192, 512)])
@pytest.mark.parametrize("scale", [1.0, 3e4, 1e6])
def test_negatives(spark, monkeypatch, sizes, scale):
    monkeypatch.setattr(negatives, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(negatives, "BUCKET", sizes[1])
    monkeypatch.setattr(negatives, "OUTLINES", 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = []
    for i in range(500):
        v = centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=5) * 0.3
        rows.append((i, int(rng.integers(3)), [float(np.float32(x * scale)) for x in v]))
    same = [0.5 * scale, 0.25 * scale, 0.0, 0.0, 0.0]
    rows += [(600 + i, i % 3, same) for i in range(40)] + [(50, 1, rows[50][2])]
    rows += [(700, None, same), (None, 1, same), (702, 1, None), (703, 1, [1.0, None]), (704, 2, [float("nan")])]
    rows += [(705, 2, [float("inf")]), (706, 1, []), (750, 1, [0.0] * 5), (708, 2, [scale]), (800, 2, [-scale, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    table = table.select("*", *[F.lit("extra").alias(c) for c in ("ask", "uid", "shard", "codes", "length")]).repartition(3)
    got = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0).collect()
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    assert len(want) > 50 and sorted(tuple(r) for r in got) == want


def test_candidates_lose_nothing_and_prune():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 8))
    rows[:100] = rows[0] + rng.normal(size=(100, 8)) * 0.05
    unit = rows / np.sqrt((rows**2).sum(1))[:, None]
    theta = np.full(400, 0.95)
    every, r, a = negatives.LengthBuckets.candidates(unit, np.argsort(unit, 0), unit, theta)
    met = {*zip(r.tolist(), a.tolist())} | {(i, j) for j in every.tolist() for i in range(400)}
    cosine = unit @ unit.T
    assert {*zip(*(x.tolist() for x in np.nonzero(cosine >= 0.95)))} <= met
    assert len(met) < 400 * 400 / 3


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(table, F.lit(True)).collect() == []


# 13: repeated passages


def brute_repeats(rows, words=35):
    texts = [(doc_id, (text or "").encode().split()) for doc_id, text in rows]
    starts = collections.Counter(tuple(w[i : i + words]) for _, w in texts for i in range(len(w) - words + 1))
    out = []
    for doc_id, w in texts:
        gone = set()
        for i in range(len(w) - words + 1):
            if starts[tuple(w[i : i + words])] > 1:
                gone.update(range(i, i + words))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((doc_id, len(w), len(gone), kept))
    return sorted(out, key=str)


def odd_passages():
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = {n: fresh(n) for n in (34, 35, 36, 50, 200)}
    rows = [(i, f"{fresh(rng.randrange(40))}\n{passages[n]}\t{fresh(rng.randrange(40))}") for i, n in enumerate([*passages] * 5)]
    rows += [(50 + i, passages[200]) for i in range(30)]
    # Inside one document: back to back, overlapping itself, and one word over and over.
    rows += [(100, f"{passages[36]} {passages[36]}"), (101, "again " * 300), (102, " ".join(["a b c d e f g"] * 30)), (103, "a " * 34)]
    rows += [(110, None), (111, ""), (112, " \n\t "), (None, passages[50]), (None, None), (100, f"{fresh(5)} {passages[35]}")]
    rows += [(120, fresh(100) + "\x1f\x85  \x0b\x0cé 中文 " + passages[50].upper()), (121, fresh(90_000) + " " + passages[34])]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("chunk", [20_000, substrings.CHUNK])
def test_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "GROUP", 5000)
    rows = odd_passages()
    got = substrings.without_repeats(frame(spark, rows, 5)).collect()
    want = brute_repeats(rows)
    assert sum(r[2] for r in want) > 3000 and sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("words", [13, 21])
def test_repeats_of_other_lengths(spark, docs, words):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + odd_passages()
    got = substrings.without_repeats(frame(spark, rows), words).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, words)


def test_cover_meets_every_shift():
    for i, j in itertools.product(range(substrings.PERIOD), repeat=2):
        both = [(i + k) % substrings.PERIOD in substrings.COVER and (j + k) % substrings.PERIOD in substrings.COVER for k in range(substrings.PERIOD)]
        assert any(both)


def test_no_passages(spark):
    assert substrings.without_repeats(frame(spark, [(1, "x")]).limit(0)).collect() == []
    with pytest.raises(ValueError):
        substrings.without_repeats(frame(spark, [(1, "x")]), 12)
