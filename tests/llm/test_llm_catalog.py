"""Registered queries of heedline.llm: SQL twins, and the pipeline stage by stage."""

import collections
import hashlib
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heedline.llm import catalog

sys.path.insert(0, str(Path(__file__).parent))

from test_llm_operators import brute_groups, brute_lines  # noqa: E402


def components_of(rows, threshold):
    """The component of each row; rows are renumbered, for ids may repeat."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    found = {d: c for d, _, c, _ in brute_groups(numbered, threshold)}
    return [found[i] for i in range(len(rows))]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(str(row) for row in cursor.fetchall())


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra_schema = docs.schema
    extra = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 34 !!", "en", "s", 8)]
    copy = docs.where("length(text) > 200").limit(1)
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(copy)
    docs = docs.unionByName(copy.withColumn("doc_id", F.lit(10**6).cast("long"))).withColumn("first", F.lit("extra"))
    words = docs.where("length(text) > 900").limit(1).first()["text"].split(" ")
    near = [(10**7 + i, " ".join([*words[:60], f"own{i}", *words[61:]]), "en", "s", 0) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(near, extra_schema).withColumn("first", F.lit("near")))
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "language_id":
            # Only what has no letter goes.
            assert docs.where("doc_id < 0").count() == 0 and docs.count() == sizes[0] - 3
        after = {(r["doc_id"], r["text"]) for r in docs.collect()} if name != "packing" else set()
        if name == "line_dedup":
            digests = {(d, digest) for d, _, _, digest in brute_lines(before)}
            got = {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in after}
            assert got <= digests and {d for d, _ in digests - got} <= {d for d, t in before if d not in dict(after)}
        if name == "near_duplicates":
            groups = collections.defaultdict(set)
            once = sorted(set(before), key=str)
            for (doc_id, text), component in zip(once, components_of(once, 80)):
                groups[component].add((doc_id, text))
            # One document of each group, the one with the smallest id, and there were near copies.
            assert all(len(own & after) == 1 and min(own)[0] in {d for d, _ in own & after} for own in groups.values())
            assert len(after) == len(groups) and max(map(len, groups.values())) >= 4
            texts = collections.Counter(r["text"] for r in docs.collect())
            assert max(texts.values()) == 1
            ids = {r["doc_id"] for r in docs.collect()}
        sizes.append(docs.count())
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == ids
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in packed)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_documents_of_blank_lines_go(spark):
    text = "The same line of text, long enough to count\n \t\r\n\r"
    docs = spark.createDataFrame([(i, text, "en", "s", 0) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()] == [3]
