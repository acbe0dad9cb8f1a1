"""What is moved and stored: searches shuffle no pairs, texts stay where they are, nothing is cached on the way."""

import os
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.operators import bm25, chunking, embedding, vector
from ragspark.plans import catalog, retrieval
from ragspark.sources import versions
from ragspark.streaming import jobs

CHUNK = "chunk_id string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def texts(n, seed=5):
    rng = random.Random(seed)
    return [(f"c{i}", " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9))) or None) for i in range(n)]


@pytest.fixture(scope="module")
def words(spark):
    chunks = spark.createDataFrame(texts(300), CHUNK).repartition(5).cache()
    queries = spark.createDataFrame([(f"q{i}", t) for i, (_, t) in enumerate(texts(23, 6))], "query_id string, query string")
    yield chunks, queries
    chunks.unpersist()


def test_keyword_search_shuffles_no_pairs(spark, words, tmp_path):
    """Queries in blocks, by an index with and without rows by chunk: the rows of the join that a search was before."""
    chunks, queries = words
    index = bm25.build_index(chunks, path=str(tmp_path))
    asked = queries.select("query_id", F.explode(F.split("query", " ")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    met = index.postings.join(asked.join(index.terms, "term"), "term").crossJoin(index.statistics)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    want = {tuple(r) for r in vector.ranked(scored, 7, ["query_id"], [F.desc("score"), "chunk_id"]).collect()}
    assert len(want) == 7 * len({r[0] for r in want})
    for made in (index, index._replace(forward=None)):
        for sent in (4096, 5):
            assert {tuple(r) for r in bm25.search(made, queries, 7, sent_queries=sent).collect()} == want
    assert "Join" not in plan(bm25.search(index, queries, 7))


def test_vector_search_shuffles_no_vectors(spark, words):
    """More queries than are sent at once don't deal out the chunks; approximate hits are exact ones of common buckets."""
    chunks, queries = words
    known, asked = embedding.hash_embed(chunks, "chunk_id", "text", 16), embedding.hash_embed(queries, "query_id", "query", 16)
    exact = lambda n: vector.exact_top_k(asked, known, 300, sent_queries=n)
    want = {(r.query_id, r.chunk_id): r.score for r in exact(4096).collect()}
    assert {(r.query_id, r.chunk_id): r.score for r in exact(5).collect()} == want
    assert "CoGroup" not in plan(exact(5)) and "Join" not in plan(exact(5))
    near = vector.approximate_top_k(asked, known, 300, tables=2, bits=4, sent_queries=5)
    assert "Join" not in plan(near)
    rows = lambda df, c: {r[0]: r.vector for r in df.select(c, "vector").collect() if any(r.vector)}
    import numpy as np

    keys = lambda held: {i: vector.hyperplane_buckets(np.array([v]), 2, 4)[0] for i, v in held.items()}
    q, c = keys(rows(asked, "query_id")), keys(rows(known, "chunk_id"))
    assert {(r.query_id, r.chunk_id): r.score for r in near.collect()} == {p: s for p, s in want.items() if (q[p[0]] == c[p[1]]).any()}


def test_knowledge_is_stored_without_vectors_and_plain_texts_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(f"doc-{i}.txt", f"word{i} " * 300) for i in range(4)], "path string, text string")
    base = retrieval.build_knowledge(docs, path=str(tmp_path))
    assert not os.path.exists(tmp_path / "vectors") and base.children.columns == ["chunk_id", "parent_id", "text"]
    assert base.vectors.count() == base.children.count() > 4
    cut = chunking.parent_chunks(docs.repartition(3), id_col="path").select("doc_id", "parent_index", "text")
    rows = [(r.doc_id, r.parent_index) for r in cut.collect()]
    assert sorted(rows) == [(f"doc-{i}.txt", n) for i in range(4) for n in range(len(rows) // 4)]
    assert "Window" not in plan(chunking.chunk_sections(chunking._plain_sections(chunking._marked(docs, "path", "text")), 900, 150))


def test_rankings_need_no_second_search(spark, monkeypatch, tmp_path):
    """g1 and g3 take the variants, and don't run the whole retrieval for them."""
    monkeypatch.setattr(retrieval, "retrieve", lambda *a, **b: pytest.fail("retrieval"))
    assert catalog._qv(spark, "/root/testdata/sf0.001")[1].columns == ["qv", "query"]


def test_contexts_of_cases_leave_the_documents_where_they_are(spark):
    assert "SortMergeJoin" not in plan(catalog._known_contexts(spark, "/root/testdata/sf0.001"))


def test_ingest_caches_nothing(spark, tmp_path, monkeypatch):
    """Children and vectors of an ingest with repeated paths, with nothing persisted."""
    monkeypatch.setattr(DataFrame, "persist", lambda *a: pytest.fail("persisted"))
    path = str(tmp_path / "base")
    docs = spark.createDataFrame([("a.txt", "old", 1), ("a.txt", "some new text", 2), ("b.txt", None, 1)], "path string, text string, n int")
    jobs.ingest_batch(docs, path, 0, order_col="n")
    live = {n: jobs.current(spark, path, n).collect() for n in ("documents", "children", "vectors")}
    assert {(r.chunk_id, r.text) for r in live["children"]} == {("a.txt::parent-0::child-0", "some new text")}
    assert [(r.chunk_id, r.document_id, round(sum(x * x for x in r.vector), 6)) for r in live["vectors"]] == [(r.chunk_id, r.document_id, 1.0) for r in live["children"]]
    assert len({r.content_hash for r in live["documents"]}) == 2


def test_live_rows_by_few_and_by_many_stale_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = lambda ids: spark.createDataFrame([(i, f"row {i}") for i in ids], "k string, v string")
    told = lambda ids, s: spark.createDataFrame([(i, s) for i in ids], "k string, status string")
    steps = [(["a", "b", "c", None], ["a", "b", "c", None], "active"), (["b"], ["b"], "active"), ([], ["c"], "deleted"), (["d"], ["d"], "active")]
    held = {"number": 0, "tables": {"t": [0, 1, 2, 3], "records": [0, 1, 2, 3]}, "batches": {}}
    for n, (ids, keys, status) in enumerate(steps):
        versions.write_version(rows(ids), path, "t", n)
        versions.write_version(told(keys, status), path, "records", n)
    got = lambda: versions.live(spark, path, "t", "k", "records", held)
    want = [("a", 0), ("b", 1), ("d", 3)]
    assert sorted((r.k, r.version) for r in got().collect()) == want
    assert "SortMergeJoin" not in plan(got()).split("BroadcastExchange")[0]
    monkeypatch.setattr(versions, "SENT_STALE", 0)
    assert sorted((r.k, r.version) for r in got().collect()) == want
