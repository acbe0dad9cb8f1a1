"""The inverted file against exact search: recall, what it scores, and odd vectors."""

import os

import numpy as np
from pyspark.sql import functions as F

from ragspark.operators import ivf, vector

SF = os.environ.get("SPARK_GRAFT_SF_DIR", "/root/testdata/sf0.1")


def test_recall_over_all_rows(spark, tmp_path):
    """Every row is a query. Some half of the codes are looked at, since these vectors have no clusters; few pairs are scored."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    hits, counts = ivf.search_inverted_file(ivf.build_inverted_file(rows, f"{tmp_path}/i"), asked, 10, f"{tmp_path}/s")
    got = {(r.query_id, r.chunk_id): r.score for r in hits.collect()}
    want = {(r.query_id, r.chunk_id): r.score for r in vector.exact_top_k(asked, rows, 10).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) <= 1.1e-6 for p in got.keys() & want.keys())
    n, total = rows.count(), counts.agg(F.sum("seen").alias("seen"), F.sum("scored").alias("scored")).first()
    assert total.scored <= 0.1 * n * n and total.seen < 0.65 * n * n


def test_clusters_need_few_cells(spark, tmp_path):
    """Clustered vectors, with string ids, odd vectors and a cell in several tiles, probing a twentieth."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((20, 16)) * 3
    points = (centre[rng.integers(0, 20, 1500)] + rng.standard_normal((1500, 16)) * 0.4).tolist()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 3]
    rows = spark.createDataFrame([(f"c{i:04d}", v, "x") for i, v in enumerate(points + odd)], "chunk_id string, vector array<double>, cell string")
    asked = rows.where("chunk_id < 'c0100'").select(F.col("chunk_id").alias("query_id"), "vector").union(spark.createDataFrame([("odd", None), ("zero", [0.0] * 16)], "query_id string, vector array<double>"))
    before = ivf.TILE_ROWS
    ivf.TILE_ROWS = 5
    try:
        index = ivf.build_inverted_file(rows, f"{tmp_path}/i", cells_per_root=1.0)
    finally:
        ivf.TILE_ROWS = before
    assert index.codes.count() == 1500 and index.codes.agg(F.max("tile")).first()[0] > 0
    hits, counts = ivf.search_inverted_file(index, asked, 10, f"{tmp_path}/s", probe=0.1)
    got = {(r.query_id, r.chunk_id) for r in hits.collect()}
    want = {(r.query_id, r.chunk_id) for r in vector.exact_top_k(asked, rows.where("chunk_id < 'c1500'"), 10).collect()}
    assert len(got & want) >= 0.95 * len(want) and {q for q, _ in got}.isdisjoint({"odd", "zero"})
    assert counts.agg(F.sum("seen")).first()[0] < 0.25 * 100 * 1500


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert ivf.search_inverted_file(ivf.build_inverted_file(none, f"{tmp_path}/i"), asked, 3, f"{tmp_path}/s")[0].collect() == []
