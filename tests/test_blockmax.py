"""Keyword top-k by block bounds against the exhaustive join."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import blockmax, bm25

SF = os.environ.get("SPARK_GRAFT_SF_DIR", "/root/testdata/sf0.1")


def passages(rng, n, vocabulary, most):
    ranks = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, ranks, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("part_rows,block_rows,waves,ids", [(10_000, 64, 32, "long"), (40, 4, 4, "string"), (70, 1, 2, "long")])
def test_same_rows_as_the_join(spark, tmp_path, part_rows, block_rows, waves, ids):
    """Ties, empty and null texts, one very long text, terms in nearly all texts, queries with repeats and without words."""
    rng = random.Random(part_rows)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = passages(rng, 300, vocabulary, 40) + [None, "", "w3 " * 5000, "w7 w9", "w7 w9", "w7 w9"]
    chunks = spark.createDataFrame([(i * 3, t, "x", 1) for i, t in enumerate(texts)], "chunk_id long, text string, part string, block int")
    chunks = chunks.withColumn("chunk_id", F.col("chunk_id").cast(ids))
    asked = passages(rng, 40, vocabulary, 12) + ["", None, "unknown words", "w0 w0 w0 w1", "w7 w9"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = blockmax.build_blocks(chunks, f"{tmp_path}/i", part_rows=part_rows, block_rows=block_rows)
    hits, counts = blockmax.search_blocks(index, queries, 5, f"{tmp_path}/s", waves=waves)
    want = bm25.search(bm25.build_index(chunks, path=f"{tmp_path}/old"), queries, 5)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in want.select(*hits.columns).collect()}
    assert all(0 < r.scored <= r.met for r in counts.collect())
    assert index.blocks.where(F.size("nos") > block_rows).isEmpty()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "b")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "b")], "query_id long, query string")
    for chunks, asked in ((none, queries), (some, queries.limit(0))):
        path = f"{tmp_path}/{chunks.count()}"
        hits, _ = blockmax.search_blocks(blockmax.build_blocks(chunks, f"{path}/i"), asked, 3, f"{path}/s")
        assert hits.collect() == []


def test_few_postings_are_scored(spark, tmp_path):
    """Whole passages as queries over the documents of the bench."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = blockmax.build_blocks(docs, f"{tmp_path}/i", "doc_id")
    hits, counts = blockmax.search_blocks(index, queries, 10, f"{tmp_path}/s")
    total = counts.agg(F.sum("scored").alias("scored"), F.sum("met").alias("met")).first()
    assert hits.count() == 10 * queries.count()
    if docs.count() >= 10_000:
        assert total.scored < 0.2 * total.met
