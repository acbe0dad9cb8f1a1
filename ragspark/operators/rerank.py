"""Reranking, and the gate that tells whether a question has strong contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.text import words
from ragspark.operators.models import budgeted, served
from ragspark.operators.vector import DIGITS, ranked


def min_max(score: Column, by: list[str]) -> Column:
    """The score on the scale from the least to the largest of its group; null counts as 0. In a group of equal
    scores positive ones are 1, others 0."""
    group = Window.partitionBy(*by)
    value = F.coalesce(score.cast("double"), F.lit(0.0))
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(low == high, (value > 0).cast("double")).otherwise((value - low) / (high - low))


def term_coverage(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that the text has."""
    asked = F.array_distinct(words(F.coalesce(query, F.lit(""))))
    return F.size(F.array_intersect(asked, words(F.coalesce(text, F.lit(""))))) / F.greatest(F.size(asked), F.lit(1))


def searchable(heading: Column, path: Column, text: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (heading, path, text)])


def heuristic_score(by: list[str], query_col: str = "query", weights: tuple[float, float, float] = (0.45, 0.35, 0.20), digits: int = DIGITS) -> Column:
    """The weighted sum of vector score and BM25 score, each on its group's scale, and term coverage, rounded."""
    v, b, t = weights
    cover = term_coverage(F.col(query_col), searchable(F.col("heading"), F.col("section_path"), F.col("text")))
    return F.round(v * min_max(F.col("vector_score"), by) + b * min_max(F.col("bm25_score"), by) + t * cover, digits)


def heuristic_rerank(contexts: DataFrame, k: int, by: list[str], query_col: str = "query", weights: tuple[float, float, float] = (0.45, 0.35, 0.20), digits: int = DIGITS) -> DataFrame:
    """The k best contexts of each group by vector score, BM25 score and term coverage; equal ones keep their order.

    contexts: by, query, rank, score, vector_score, bm25_score, heading, section_path, text. Adds rrf_score (the score
    before), rerank_score and the new score and rank.
    """
    value = heuristic_score(by, query_col, weights, digits)
    scored = contexts.withColumns({"rrf_score": F.col("score"), "rerank_score": value, "was": F.col("rank")}).withColumn("score", F.col("rerank_score"))
    return ranked(scored.drop("rank"), k, by, [F.desc("rerank_score"), "was"]).drop("was")


def model_rerank(contexts: DataFrame, k: int, by: list[str], load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query_col: str = "query", digits: int = DIGITS) -> DataFrame:
    """heuristic_rerank() with a model's scores of (query, text) pairs; load() runs once in a worker, see models.

    Pairs at which the model fails are tried one by one. Groups that a model which fails, or can't be loaded, leaves
    without a score go by the heuristic, each as a whole, where scores and headings that are not there count as
    missing; `reranker` says which ran.
    """
    schema, model = contexts.schema, served(load)

    def attempt(pairs: list[tuple[str, str]]) -> list[float | None]:
        try:
            scores = [float(x) for x in model()(pairs)]
            if len(scores) != len(pairs):
                raise ValueError("the model returned another number of scores than it got pairs")
            return scores
        except Exception:
            return [x for p in pairs for x in attempt([p])] if len(pairs) > 1 else [None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf[query_col].fillna(""), pdf["text"].fillna(""), strict=True))
            scores = [x for some in budgeted([q + t for q, t in pairs]) for x in attempt(pairs[some])]
            yield pdf.assign(rerank_score=pd.Series(scores, dtype="float64", index=pdf.index))

    scored = contexts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", rerank_score double")
    missing = F.col("rerank_score").isNull() | F.isnan("rerank_score")
    absent = [c for c in ("vector_score", "bm25_score", "heading", "section_path") if c not in contexts.columns]
    marked = scored.withColumns({"_failed": F.max(missing).over(Window.partitionBy(*by))} | {c: F.lit(None) for c in absent})
    value = F.when(F.col("_failed"), heuristic_score(by, query_col, digits=digits)).otherwise(F.round("rerank_score", digits))
    named = marked.withColumns({"reranker": F.when(F.col("_failed"), "heuristic").otherwise("model"), "rrf_score": F.col("score"), "was": F.col("rank"), "rerank_score": value})
    return ranked(named.withColumn("score", F.col("rerank_score")).drop("rank", "_failed", *absent), k, by, [F.desc("rerank_score"), "was"]).drop("was")


def strong_questions(questions: DataFrame, contexts: DataFrame, by: list[str], min_vector: float = 0.30, min_bm25: float = 2.0) -> DataFrame:
    """by and strong_context of every question: whether a context's vector or BM25 score reaches its minimum.

    A context with neither has its score taken as a vector score. Questions without contexts are not strong.
    """
    vector = F.when(F.col("vector_score").isNull() & F.col("bm25_score").isNull(), F.col("score")).otherwise(F.col("vector_score"))
    good = F.coalesce(vector >= min_vector, F.lit(False)) | F.coalesce(F.col("bm25_score") >= min_bm25, F.lit(False))
    found = contexts.groupBy(*by).agg(F.bool_or(good).alias("strong"))
    return questions.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("strong", F.lit(False)).alias("strong_context"))
