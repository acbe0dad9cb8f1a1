"""Index segments against a full build; models kept by workers; events in two phases."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import bm25, embedding, rerank, rewrite, segments
from ragspark.operators.models import budgeted
from ragspark.sources import versions
from ragspark.streaming import jobs

CHUNK = "chunk_id long, text string"


def test_segments_equal_a_full_build(spark, tmp_path):
    """Add, change, delete, delete what is not there, bring back, compact: ranks and statistics stay those of a full build."""
    rng, path, now = random.Random(3), str(tmp_path / "i"), {}
    texts = lambda ids: [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))) or None) for i in ids]
    queries = spark.createDataFrame([(1, "a b c"), (2, "j j"), (3, "h"), (4, None)], "query_id long, query string")
    steps = [(texts(range(30)), []), (texts([4, 31]), [5]), ([], [31, 999]), (texts([31, 5]), [5]), (texts([5]), []), None]
    for step in steps:
        if step is None:
            segments.compact_index(spark, path)
        else:
            added, gone = step
            before = len(glob.glob(f"{path}/postings/version=*"))
            segments.update_index(spark, path, spark.createDataFrame(added, CHUNK) if added else None, spark.createDataFrame([(i,) for i in gone], "chunk_id long") if gone else None)
            assert len(glob.glob(f"{path}/postings/version=*")) == before + 1
            now |= {i: t for i, t in added}
            for i in gone:
                now.pop(i, None)
        whole = bm25.build_index(spark.createDataFrame(sorted(now.items()), CHUNK))
        index = segments.read_index(spark, path)
        assert tuple(index.statistics.first()) == pytest.approx(tuple(whole.statistics.first()))
        assert {(r.term, r.df) for r in index.terms.collect()} == {(r.term, r.df) for r in whole.terms.collect()}
        assert {tuple(r) for r in bm25.search(index, queries, 5).collect()} == {tuple(r) for r in bm25.search(whole, queries, 5).collect()}
    assert len(versions.manifest(spark, path)["tables"]["postings"]) == 1


def loader(folder):
    def load():
        with open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w"):
            pass
        return lambda texts: [[float(len(t))] for t in texts]

    return load


def test_a_worker_keeps_its_model(spark, tmp_path):
    """Twenty tasks of two jobs load it no more often than there are workers; each worker once."""
    folder = tmp_path / "loads"
    folder.mkdir()
    load, rows = loader(str(folder)), spark.range(0, 200, 1, 20).select("id", F.col("id").cast("string").alias("t"))
    for _ in range(2):
        got = embedding.embed_with(rows, "id", "t", load).collect()
        assert {(r.id, r.vector[0]) for r in got} == {(i, float(len(str(i)))) for i in range(200)}
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) <= 8
    assert [("ab", "c", "d" * 9)[s] for s in budgeted(["ab", "c", "d" * 9], 4)] == [("ab", "c"), ("d" * 9,)]
    assert list(budgeted([])) == []


def test_reranker_that_fails_for_one_question(spark):
    """That question goes by the heuristic, the others by the model."""
    rows = [(q, r, f"c{r}", f"text {r}", "query bad" if q == 2 else "query", 0.5, 0.1 * r, 1.0 * r, "h", "p") for q in (1, 2) for r in (1, 2, 3)]
    contexts = spark.createDataFrame(rows, "q int, rank int, chunk_id string, text string, query string, score double, vector_score double, bm25_score double, heading string, section_path string").repartition(6, "q", "rank")

    def load():
        def score(pairs):
            if any("bad" in q and "2" in t for q, t in pairs):
                raise ValueError("can't")
            return [-float(t[-1]) for _, t in pairs]

        return score

    found = {(r.q, r.chunk_id): (r.rank, r.reranker) for r in rerank.model_rerank(contexts, 3, ["q"], load).collect()}
    assert [found[1, f"c{i}"] for i in (1, 2, 3)] == [(1, "model"), (2, "model"), (3, "model")]
    assert [found[2, f"c{i}"] for i in (3, 2, 1)] == [(1, "heuristic"), (2, "heuristic"), (3, "heuristic")]
    said = rewrite.with_model(contexts.where("q = 1"), "text", "out", lambda: lambda prompts: [p.upper() for p in prompts]).collect()
    assert all(r.out == r.text.upper() and r.out_error is None for r in said)


def test_starts_are_logged_before_answers(spark, tmp_path):
    """A batch that fails leaves its starts; the retry has both, once each."""
    path, source = str(tmp_path / "events"), str(tmp_path / "in")
    spark.createDataFrame([(f"q{i}", "text") for i in range(5)], "query_id string, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("query_id string, text string").parquet(source)

    def answer(df):
        return df.select("query_id", F.lit("answer").alias("route"), F.upper("text").alias("answer"))

    def broken(df):
        return df.select("query_id", F.lit("answer").alias("route"), F.when(F.col("query_id") > "q2", F.raise_error(F.lit("down"))).otherwise(F.col("text")).alias("answer"))

    with pytest.raises(Exception, match="down"):
        jobs.stream_answers(stream, broken, path, str(tmp_path / "c")).awaitTermination()
    assert [(r.type, r.route) for r in jobs.read_events(spark, path).collect()] == [("start", None)] * 5
    jobs.stream_answers(stream, answer, path, str(tmp_path / "c")).awaitTermination()
    events = sorted((r.query_id, r.place, r.type, r.route, r.answer) for r in jobs.read_events(spark, path).collect())
    assert events == sorted(x for i in range(5) for x in ((f"q{i}", 1, "start", "answer", None), (f"q{i}", 2, "done", "answer", "TEXT")))
