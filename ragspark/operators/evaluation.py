"""Evaluation: cases, retrieval and answer metrics, judge scores, summaries and gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.text import collapse, normalize
from ragspark.operators.models import served


def normalize_cases(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (case_id, question, reference, expected_terms, answer_terms) and rejects, from rows with a column pos and any
    of id, user_input, question, reference, reference_answer, expected_terms, answer_terms.

    Blank values count as missing; a case without an id is named by its position; one without question or reference is
    rejected with a reason. Answer terms default to the expected ones.
    """
    def either(*names: str) -> Column:
        there = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    terms = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("array<string>")
    expected = F.coalesce(terms("expected_terms"), F.array().cast("array<string>"))
    rows = raw.select(
        F.coalesce(either("id"), F.format_string("case_%04d", F.col("pos") + 1)).alias("case_id"), either("user_input", "question").alias("question"),
        either("reference", "reference_answer").alias("reference"), expected.alias("expected_terms"), F.coalesce(terms("answer_terms"), expected).alias("answer_terms"))
    reason = F.when(F.col("question").isNull(), "no question").when(F.col("reference").isNull(), "no reference")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("case_id", "reason")


def covers(text: Column, terms: Column) -> Column:
    """The share of the terms that the text holds, both normalised; 1 if there are none."""
    body = normalize(F.coalesce(text, F.lit("")))
    held = F.filter(terms, lambda t: F.contains(body, normalize(t)))
    return F.when(F.size(terms) > 0, F.size(held) / F.size(terms)).otherwise(F.lit(1.0))


def evidence(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """case_id, evidence_rank (of the first context that holds all expected terms), hit and reciprocal_rank."""
    full = contexts.join(cases.select("case_id", "expected_terms"), "case_id").where(covers(F.col("text"), F.col("expected_terms")) == 1.0)
    first = full.groupBy("case_id").agg(F.min("rank").alias("evidence_rank"))
    out = cases.select("case_id").join(first, "case_id", "left")
    return out.select("case_id", "evidence_rank", F.col("evidence_rank").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("evidence_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def citation_validity(answer: Column, valid: Column) -> Column:
    """1 if the answer cites and all its citations are valid, else 0."""
    ids = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return ((F.size(ids) > 0) & F.forall(ids, lambda x: F.array_contains(valid, F.coalesce(x, F.lit(-1))))).cast("double")


def score_cases(cases: DataFrame, contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """Every case with hit, reciprocal_rank, keyword_recall, citation_validity, answer_quality (0.8 recall + 0.2 validity)
    and error. answers: case_id, answer, valid (citation numbers), error. A failed or missing case scores zeros."""
    joined = cases.join(evidence(cases, contexts), "case_id").join(answers, "case_id", "left")
    failed = F.coalesce("error", F.when(F.col("answer").isNull(), F.lit("no answer")))
    recall, valid = covers(F.col("answer"), F.col("answer_terms")), citation_validity(F.col("answer"), F.coalesce("valid", F.array().cast("array<int>")))
    zero = lambda c: F.when(failed.isNull(), c).otherwise(0.0)
    return joined.select(
        "case_id", (F.col("hit") & failed.isNull()).alias("hit"), zero(F.col("reciprocal_rank")).alias("reciprocal_rank"), zero(recall).alias("keyword_recall"),
        zero(valid).alias("citation_validity"), zero(0.8 * recall + 0.2 * valid).alias("answer_quality"), failed.alias("error"))


def summarize(scored: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Means over the cases, and how many failed, in one aggregate; by: columns to slice by."""
    mean = lambda c, name: F.round(F.avg(c), digits).alias(name)
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), mean(F.col("hit").cast("double"), "hit_rate"), mean("reciprocal_rank", "mrr"), mean("keyword_recall", "mean_keyword_recall"),
        mean("citation_validity", "mean_citation_validity"), mean("answer_quality", "mean_answer_quality"), F.count("error").alias("errors"))


def gate(summary: DataFrame, least: dict[str, float]) -> DataFrame:
    """The summary with a column passed_X for each minimum, and passed for all of them and no errors."""
    out = summary.withColumns({f"passed_{k}": F.coalesce(F.col(k) >= v, F.lit(False)) for k, v in least.items()})
    every = F.col("errors") == 0
    for k in least:
        every = every & F.col(f"passed_{k}")
    return out.withColumn("passed", every)


def judge_samples(cases: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """case_id, question, response, retrieved_contexts (in order, without blank ones) and reference of every case."""
    texts = contexts.where(collapse(F.coalesce(F.col("text"), F.lit(""))) != "").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("t"))
    joined = cases.join(answers.select("case_id", F.col("answer").alias("response")), "case_id", "left").join(texts, "case_id", "left")
    return joined.select("case_id", "question", "response", F.coalesce(F.transform("t", lambda x: x["text"]), F.array().cast("array<string>")).alias("retrieved_contexts"), "reference")


#: The inputs that each judge metric sees.
METRIC_INPUTS = {
    "context_precision": ("question", "reference", "retrieved_contexts"),
    "context_recall": ("question", "reference", "retrieved_contexts"),
    "faithfulness": ("question", "response", "retrieved_contexts"),
    "answer_relevancy": ("question", "response"),
    "answer_correctness": ("question", "response", "reference"),
}


def judge(samples: DataFrame, load: Callable[[], Callable[[str, dict], float]], metrics: dict[str, tuple[str, ...]] = METRIC_INPUTS) -> DataFrame:
    """(case_id, metric, score, error): a row for each case and metric; a failure stays with its row, and scores that
    are not finite are null. load() runs once in a worker, see models, and returns score(metric, inputs)."""
    model = served(load)
    rows = samples.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    value, error = float(score(r["metric"], {k: r[k] for k in metrics[r["metric"]]})), None
                    if value in (float("inf"), float("-inf")) or value != value:
                        value, error = None, "score is not finite"
                except Exception as e:
                    value, error = None, f"{type(e).__name__}: {e}"
                out.append((r["case_id"], r["metric"], value, error))
            yield pd.DataFrame(out, columns=["case_id", "metric", "score", "error"]).astype({"score": "float64"})

    found = rows.mapInPandas(run, "case_id string, metric string, score double, error string")
    return found.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def judge_summary(scores: DataFrame, digits: int = 6) -> DataFrame:
    """One row: the mean of the metrics' means over valid scores, and how many cases have an error."""
    means = scores.groupBy("metric").agg(F.avg("score").alias("mean")).agg(F.round(F.avg("mean"), digits).alias("grand_mean"))
    failed = scores.agg(F.count_distinct(F.when(F.col("error").isNotNull(), F.col("case_id"))).alias("cases_with_errors"))
    return means.crossJoin(failed)


def judge_means(scores: DataFrame, digits: int = 6) -> DataFrame:
    return scores.groupBy("metric").agg(F.round(F.avg("score"), digits).alias("mean"), F.count("score").alias("valid"), F.count("error").alias("errors"))
