"""From documents to a knowledge base, and from a table of questions to contexts and answers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.operators import answers, bm25, chunking, conversations, embedding, fusion, guard, rerank, rewrite, vector
from ragspark.packs import Pack, Settings
from ragspark.sources.tables import stored


class Knowledge(NamedTuple):
    """parents (parent_id, source, heading, section_path, text), children (chunk_id, parent_id, text), vectors, BM25 index."""

    parents: DataFrame
    children: DataFrame
    vectors: DataFrame
    index: bm25.Index


def build_knowledge(docs: DataFrame, settings: Settings = Settings(), path_col: str = "path", text_col: str = "text", path: str | None = None) -> Knowledge:
    """All tables of the documents. With a path each is stored there once and read by what follows, but for the vectors,
    which are hashed from the stored children as they are read, as dense ones take as much disk as the documents; without
    one they are plans over the documents, for small tables, dealt out again at each, so that a task has few Python workers."""
    s = settings
    keep = (lambda df, name: stored(df, f"{path}/{name}")) if path else lambda df, name: df.repartition(df.columns[0])
    parents = keep(chunking.parent_records(docs, path_col, text_col, (s.parent_size, s.parent_overlap)), "parents")
    children = keep(chunking.child_records(parents, (s.child_size, s.child_overlap)).select("chunk_id", "parent_id", "text"), "children")
    vectors = embedding.hash_embed(children, "chunk_id", "text")
    return Knowledge(parents, children, vectors, bm25.build_index(children, path=path and f"{path}/index"))


class Retrieval(NamedTuple):
    """questions (query_id, question, history, allowed, reason, query, strong_context), variants, candidates, contexts."""

    questions: DataFrame
    variants: DataFrame
    candidates: DataFrame
    contexts: DataFrame


def hybrid(queries: DataFrame, base: Knowledge, k: int, by: str = "qv", settings: Settings = Settings()) -> DataFrame:
    """The k best parents of each query (qv, query) by fused vector and keyword ranks of their children."""
    wide = k * settings.fan_out
    near = vector.exact_top_k(embedding.hash_embed(queries, by, "query"), base.vectors, wide, query_id=by).withColumnRenamed("query_id", by)
    worded = bm25.search(base.index, queries, wide, query_id=by).withColumnRenamed("query_id", by)
    fused = fusion.reciprocal_rank_fusion(near, worded, wide, [by], settings.vector_weight, settings.rank_constant)
    return fusion.collapse_parents(fused.join(base.children.select("chunk_id", "parent_id"), "chunk_id"), k, [by])


def asked_variants(questions: DataFrame, settings: Settings = Settings(), pack: Pack = Pack()) -> tuple[DataFrame, DataFrame]:
    """The questions (query_id string, question, history) screened and rewritten, and the variants (qv, query_id, variant,
    query) of those that are allowed."""
    scoped = questions.withColumn("history", guard.safe_history(F.col("history"), pack)).withColumn("scope", guard.scope_decision(F.col("question"), F.col("history"), pack))
    query = rewrite.resolve_follow_up(rewrite.rule_rewrite(F.col("question"), pack), F.col("history"), pack)
    asked = scoped.select("query_id", "question", "history", "scope.allowed", "scope.reason", F.when(F.col("scope.allowed"), query).alias("query"))
    return asked, rewrite.expand(asked.where("allowed"), "query", settings.variants, pack).withColumn("qv", F.concat_ws("#", "query_id", "variant"))


def retrieve(questions: DataFrame, base: Knowledge, settings: Settings = Settings(), pack: Pack = Pack(), top_k: int | None = None, path: str | None = None) -> Retrieval:
    """Contexts of every question (query_id string, question, history): screened, rewritten, expanded, retrieved for each
    variant, fused, screened again, reranked and gated. Refused questions go no further than the scope decision.

    With a path the variants and the hits, which several of the results read, are stored there once.
    """
    keep = (lambda df, name: stored(df, f"{path}/{name}")) if path else lambda df, name: df
    k = conversations.checked_top_k(settings.top_k if top_k is None else top_k)
    many = k * settings.candidates
    asked, expanded = asked_variants(questions, settings, pack)
    variants = keep(expanded, "variants")
    found = keep(hybrid(variants.select("qv", "query"), base, many, settings=settings), "hits")
    split = found.withColumns({"query_id": F.regexp_extract("qv", "^(.*)#", 1), "variant": F.regexp_extract("qv", "#([0-9]+)$", 1).cast("int")}).drop("qv")
    fused = keep(fusion.fuse_variants(split, many, ["query_id"]), "fused")
    texts = base.parents.select("parent_id", "source", "heading", "section_path", "text")
    evidence = base.children.select(F.col("chunk_id"), F.col("text").alias("evidence_text"))
    cited = evidence.join(F.broadcast(fused.select("chunk_id").distinct()), "chunk_id", "left_semi")
    full = keep(texts.join(F.broadcast(fused), "parent_id").join(cited, "chunk_id", "left"), "candidates")
    safe, removed = guard.drop_poisoned(full, ["query_id"], pack)
    ready = safe.join(asked.select("query_id", "query"), "query_id")
    contexts = rerank.heuristic_rerank(ready, k, ["query_id"], "query", settings.rerank_weights)
    strong = rerank.strong_questions(asked, contexts, ["query_id"], settings.min_vector, settings.min_bm25)
    done = asked.join(strong, "query_id").join(removed, "query_id", "left").withColumn("unsafe_contexts_removed", F.coalesce("unsafe_contexts_removed", F.lit(0)))
    return Retrieval(done, variants, safe, contexts)


TRACED = ["chunk_id", "parent_id", "source", "heading", "section_path", "score", "vector_score", "bm25_score", "query_hits"]


def traces(found: Retrieval) -> DataFrame:
    """A row a question: what was asked, retrieved and selected, with the decisions on the way."""
    queries = found.variants.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("variant", "query"))).alias("v")).select("query_id", F.transform("v", lambda x: x["query"]).alias("retrieval_queries"))
    out = found.questions.drop("history").join(queries, "query_id", "left")
    out = out.join(answers.retrieval_trace(found.candidates, ["query_id"], TRACED, "retrieved_chunks"), "query_id", "left")
    return out.join(answers.retrieval_trace(found.contexts, ["query_id"], [*TRACED, "rerank_score"], "selected_chunks"), "query_id", "left")


def answer(found: Retrieval, pack: Pack = Pack(), load=None) -> DataFrame:
    """query_id, route, answer and sources of every question."""
    return answers.route_answers(found.questions, answers.citations(found.contexts, ["query_id"], pack), ["query_id"], load, pack)
