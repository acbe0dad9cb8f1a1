"""Citations, prompts, answers and traces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.text import SPACE, casefold, clean_legal, collapse, file_name, lines, strip, strip_chars
from ragspark.operators.rewrite import with_model
from ragspark.packs import Pack

UNITS = 12


# Fixed values that results depend on, in article() and units(): how a title and the marks of clauses and points look.


def article(heading: Column, path: Column, text: Column, pack: Pack = Pack()) -> Column:
    """The first article title in the heading, the path or the first eight lines, up to a ">" and 220 characters on."""
    found = lambda c: F.nullif(strip_chars(F.regexp_extract(clean_legal(c), rf"(?iU)(\b{pack.article}\s+\d+[a-zA-Z]?\s*[.:]?\s*[^>]{{0,220}})", 1), " .:"), F.lit(""))
    candidates = F.concat(F.array(F.coalesce(heading, F.lit("")), F.coalesce(path, F.lit(""))), F.slice(lines(F.coalesce(text, F.lit(""))), 1, 8))
    return F.get(F.filter(F.transform(candidates, found), lambda x: x.isNotNull()), F.lit(0))


def units(text: Column, marker: str) -> Column:
    """The distinct markers that start lines, in order, at most twelve; marker: a pattern with one group."""
    pattern = rf"(?m)^[{SPACE}]*(?:[-*][{SPACE}]*)?(?:\*\*)?{marker}[{SPACE}]+"
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: F.lower(x))), 1, UNITS)


def locator(art: Column, clauses: Column, points: Column, heading: Column, path: Column, pack: Pack = Pack()) -> Column:
    """Base and details: the article, else the heading, else the path's last part; then clauses and points."""
    full = lambda c: F.nullif(c, F.lit(""))
    base = F.coalesce(art, full(heading), full(F.element_at(F.split(path, " > "), -1)))
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name + " "), F.array_join(c, ", ")))
    details = full(F.concat_ws("; ", part(pack.clause, clauses), part(pack.point, points)))
    return F.when(base.isNotNull() & details.isNotNull(), F.concat(base, F.lit(" — "), details)).otherwise(F.coalesce(base, details))


def citations(contexts: DataFrame, by: list[str], pack: Pack = Pack()) -> DataFrame:
    """contexts with source_name, article, clauses, points, locator and citation_id.

    contexts: by, rank, source, heading, section_path, text, evidence_text. Contexts of a group with the same source,
    section and locator, without case, share a number; numbers go by first appearance, from 1.
    """
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    text = F.coalesce(F.nullif(F.col("evidence_text"), F.lit("")), F.col("text"), F.lit(""))
    step = contexts.withColumns({"source_name": file_name(F.col("source"), pack.default_source), "heading": clean("heading"), "section_path": clean("section_path"), "_text": text})
    step = step.withColumns({"article": article(F.col("heading"), F.col("section_path"), F.col("_text"), pack), "clauses": units(F.col("_text"), r"(\d{1,2})[.)]"), "_points": units(F.col("_text"), "([a-zđ])[.)]")})
    step = step.withColumn("points", F.when(F.col("article").isNotNull() | (F.size("clauses") > 0), F.col("_points")).otherwise(F.array().cast("array<string>"))).drop("_points")
    step = step.withColumn("locator", locator(F.col("article"), F.col("clauses"), F.col("points"), F.col("heading"), F.col("section_path"), pack))
    low = lambda c: casefold(F.coalesce(c, F.lit("")))
    section = F.when(F.col("section_path") != "", F.col("section_path")).otherwise(F.col("heading"))
    keyed = step.withColumn("_key", F.struct(low(F.col("source_name")).alias("a"), low(section).alias("b"), low(F.col("locator")).alias("c")))
    first = keyed.withColumn("_first", F.min("rank").over(Window.partitionBy(*by, "_key")))
    return first.withColumn("citation_id", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))).drop("_key", "_first", "_text")


CITATION = ("citation_id", "source_name", "heading", "section_path", "article", "clauses", "points", "locator")


def public_citations(cited: DataFrame, by: list[str]) -> DataFrame:
    """by and sources: an array of the distinct citations in order, each as its first context shows it."""
    once = cited.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "citation_id").orderBy("rank"))).where("_n = 1")
    return once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*CITATION))).alias("sources"))


def prompts(cited: DataFrame, questions: DataFrame, by: list[str], pack: Pack = Pack(), template: str | None = None) -> DataFrame:
    """by and prompt: numbered context blocks, the history and the question in a template with {history}, {contexts}
    and {question}. questions: by, question, history."""
    section = F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.nullif(F.col("heading"), F.lit("")), F.lit(pack.no_title))
    block = F.concat(F.lit("["), F.col("citation_id"), F.lit("] "), F.col("source_name"), F.lit("\n"), section, F.lit("\n"), F.coalesce("locator", section), F.lit("\n"), F.col("text"))
    joined = cited.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    turns = F.array_join(F.transform(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    whole = template or "History:\n{history}\n\nContexts:\n{contexts}\n\nQuestion: {question}\n\nAnswer from the contexts only and put [n] after what you take from them."
    values = {"{history}": turns, "{contexts}": F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n"), "{question}": F.col("question")}
    # The template is split once, so that what the values hold is never taken for a field.
    body = F.concat(*[values.get(part, F.lit(part)) for part in re.split(r"(\{history\}|\{contexts\}|\{question\})", whole) if part])
    return joined.join(questions, by).select(*by, body.alias("prompt"))


def extractive_answers(cited: DataFrame, by: list[str], pack: Pack = Pack(), count: int = 3, chars: int = 700) -> DataFrame:
    """by and answer: the starts of the first contexts, each with its citation number."""
    line = F.concat(F.lit("- "), F.substring(collapse(F.col("text")), 1, chars), F.lit(" ["), F.col("citation_id"), F.lit("]"))
    some = cited.where(F.col("rank") <= count).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))).alias("xs"))
    return some.select(*by, F.concat(F.lit(pack.extract_head + "\n"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n")).alias("answer"))


def clean_citations(answer: Column, valid: Column, pack: Pack = Pack()) -> Column:
    """The answer without numbers of no valid citation, and with the least valid one at the end if none is left.

    Refusals and blank answers get none. valid: an array of ints.
    """
    text = strip(F.coalesce(answer, F.lit("")))
    found = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))
    bad = F.array_except(F.array_distinct(found), F.transform(valid, lambda x: x.cast("string")))
    # numbers with leading zeros count by their value
    bad = F.filter(bad, lambda x: ~F.array_contains(valid, F.coalesce(x.try_cast("int"), F.lit(-1))))
    kept = strip(F.aggregate(bad, text, lambda s, x: F.replace(s, F.concat(F.lit("["), x, F.lit("]")), F.lit(""))))
    cites = kept.rlike(r"\[\d+\]")
    closed = F.when(kept.isin(pack.not_found, pack.refusal) | cites, kept).otherwise(F.concat(kept, F.lit(" ["), F.array_min(valid).cast("string"), F.lit("]")))
    return F.when((text == "") | (F.size(valid) <= 0), text).otherwise(closed)


def generate_answers(cited: DataFrame, questions: DataFrame, by: list[str], load: Callable | None = None, pack: Pack = Pack()) -> DataFrame:
    """by and answer: a model's, over the prompts, with its citations cleaned; without a model the extracts; and the
    no-context sentence for questions without contexts."""
    if load is None:
        made = extractive_answers(cited, by, pack)
    else:
        asked = with_model(prompts(cited, questions, by, pack), "prompt", "_raw", load)
        valid = cited.groupBy(*by).agg(F.array_sort(F.collect_set("citation_id")).alias("_valid"))
        made = asked.join(valid, by).select(*by, clean_citations(F.col("_raw"), F.col("_valid"), pack).alias("answer"))
    return questions.select(*by).join(made, by, "left").select(*by, F.coalesce("answer", F.lit(pack.no_context)).alias("answer"))


def route_answers(questions: DataFrame, cited: DataFrame, by: list[str], load: Callable | None = None, pack: Pack = Pack()) -> DataFrame:
    """by, route, answer and sources of every question (by, question, history, allowed, strong_context).

    Questions that are not allowed are refused, weak ones get the no-context sentence, and only the others reach the
    generator.
    """
    strong = questions.where("allowed and strong_context")
    mine = cited.join(strong.select(*by), by, "left_semi")
    answered = generate_answers(mine, strong, by, load, pack).join(public_citations(mine, by), by, "left").withColumn("route", F.lit("answer"))
    others = questions.where("not (allowed and strong_context)").select(
        *by, F.when(~F.col("allowed"), F.lit(pack.refusal)).otherwise(F.lit(pack.no_context)).alias("answer"), F.when(~F.col("allowed"), F.lit("refusal")).otherwise(F.lit("no_context")).alias("route"))
    return answered.unionByName(others, allowMissingColumns=True)


def retrieval_trace(contexts: DataFrame, by: list[str], fields: list[str], name: str) -> DataFrame:
    """by and `name`: JSON of the ranked contexts with the fields that are not null."""
    made = contexts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("x"))
    return made.select(*by, F.to_json("x").alias(name))
