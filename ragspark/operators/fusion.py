"""Fusing rankings: reciprocal ranks, collapse of children to parents, and fusion of query variants.

Rankings are tables with query_id (and variant where there are several), an id, rank and score; ids and scores only,
texts join after the last top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.operators.vector import ranked

LAST = 1_000_000_000


def result_key(chunk_id: Column, document_id: Column, chunk_index: Column) -> Column:
    """The chunk's id, or document and index where it has none."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text(chunk_id) != "", text(chunk_id)).otherwise(F.concat_ws(":", text(document_id), text(chunk_index)))


def fusion_key(parent_id: Column, chunk_id: Column, document_id: Column, chunk_index: Column) -> Column:
    """The parent's id if there is one, else result_key()."""
    return F.when(F.coalesce(parent_id.cast("string"), F.lit("")) != "", parent_id.cast("string")).otherwise(result_key(chunk_id, document_id, chunk_index))


def with_result_key(hits: DataFrame) -> DataFrame:
    """The hits with chunk_id as result_key() gives it, from chunk_id, document_id and chunk_index as far as they are there."""
    there = lambda n: F.col(n) if n in hits.columns else F.lit(None).cast("string")
    return hits.withColumn("chunk_id", result_key(there("chunk_id"), there("document_id"), there("chunk_index")))


def with_fusion_key(hits: DataFrame, name: str = "parent_id") -> DataFrame:
    """The hits with `name` as fusion_key() gives it, so that one without a parent is its own."""
    there = lambda n: F.col(n) if n in hits.columns else F.lit(None).cast("string")
    return hits.withColumn(name, fusion_key(there("parent_id"), there("chunk_id"), there("document_id"), there("chunk_index")))


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, k: int, by: list[str], vector_weight: float = 0.65, constant: int = 60, digits: int = 9) -> DataFrame:
    """by, chunk_id, score, vector_score, bm25_score, rank: the k best of two rankings by weight / (constant + rank).

    Ties go to the better vector rank, then the better keyword rank. A full outer join by (query, chunk).
    """
    side = lambda df, name: with_result_key(df).select(*by, "chunk_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
    both = side(vector, "vector").join(side(keyword, "bm25"), [*by, "chunk_id"], "full_outer")
    part = lambda name, w: F.coalesce(F.lit(w) / (constant + F.col(f"{name}_rank")), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("vector", vector_weight) + part("bm25", 1.0 - vector_weight), digits))
    order = [F.desc("score"), F.coalesce("vector_rank", F.lit(LAST)), F.coalesce("bm25_rank", F.lit(LAST)), "chunk_id"]
    return ranked(scored, k, by, order).select(*by, "chunk_id", "score", "vector_score", "bm25_score", "rank")


def collapse_parents(hits: DataFrame, k: int, by: list[str]) -> DataFrame:
    """One row a parent: hits (by, chunk_id, parent_id, score, vector_score, bm25_score, rank) grouped by parent; see
    with_fusion_key() for hits without one.

    score, vector_score and bm25_score are the largest, chunk_id is the best child (the first of equal ones),
    first_chunk_id the first one, whose heading counts; matched_child_ids are in order of rank, and
    matched_child_count counts hits. Order: score, count, first appearance.
    """
    first = F.struct("rank", "chunk_id")
    grouped = with_fusion_key(with_result_key(hits)).groupBy(*by, "parent_id").agg(
        F.max("score").alias("score"), F.max("vector_score").alias("vector_score"), F.max("bm25_score").alias("bm25_score"),
        F.max_by("chunk_id", F.struct("score", -F.col("rank"))).alias("chunk_id"), F.min(first).alias("first"), F.count("*").alias("matched_child_count"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["chunk_id"])).alias("matched_child_ids"))
    out = grouped.withColumns({"first_chunk_id": F.col("first.chunk_id"), "first_rank": F.col("first.rank")})
    order = [F.desc("score"), F.desc("matched_child_count"), "first_rank"]
    return ranked(out, k, by, order).drop("first", "first_rank")


def fuse_variants(hits: DataFrame, k: int, by: list[str], key: str = "parent_id", constant: int = 60, digits: int = 9) -> DataFrame:
    """One row a key over the rankings of a question's variants: score is the sum of 1 / (constant + rank).

    hits: by, variant, key, rank, score, vector_score, bm25_score and other columns, which come from the variant with
    the strictly largest score, as hybrid_score does; query_hits counts variants, vector_score and bm25_score are
    the largest. Order: score, query_hits, first appearance.
    """
    hits = with_fusion_key(hits, key) if key == "parent_id" else hits
    others = [c for c in hits.columns if c not in {*by, key, "variant", "rank", "score", "vector_score", "bm25_score"}]
    appears = F.struct("variant", "rank")
    best = F.struct(F.coalesce("score", F.lit(0.0)), -F.col("variant"), -F.col("rank"))
    grouped = hits.groupBy(*by, key).agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), digits).alias("multi"), F.count("*").alias("query_hits"),
        F.max("vector_score").alias("vector_score"), F.max("bm25_score").alias("bm25_score"), F.min(appears).alias("first"),
        F.max_by(F.struct(F.col("score").alias("hybrid_score"), *others), best).alias("best"))
    flat = grouped.select(*by, key, "best.*", F.col("multi").alias("score"), F.col("multi").alias("multi_query_score"), "query_hits", "vector_score", "bm25_score", "first")
    return ranked(flat, k, by, [F.desc("score"), F.desc("query_hits"), "first"]).drop("first")
