"""Query rewriting and expansion by rules, and by models with the rules to fall back on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.text import LINE_BREAK, SPACE, casefold, collapse, strip_chars, words
from ragspark.operators.models import budgeted, served
from ragspark.packs import Pack

MAX_CHARS = 500


def rule_rewrite(question: Column, pack: Pack = Pack()) -> Column:
    """A compact query: case-folded, one opening phrase off, abbreviations spelled out, the polite end off.

    If nothing is left, the question with its white space collapsed.
    """
    text = collapse(casefold(question))
    text = F.regexp_replace(text, rf"(?U)^(?:{'|'.join(pack.prefixes)})[,:;.!?\s-]*", "")
    for short, long in pack.abbreviations:
        text = F.regexp_replace(text, rf"(?U)\b\Q{short}\E\b", long)
    for twice, once in pack.doubled:
        text = F.replace(text, F.lit(twice), F.lit(once))
    text = F.regexp_replace(text, "(?U)" + pack.tails, "")
    text = strip_chars(F.regexp_replace(text, f"[{SPACE}]+", " "), " ,:;.!?-")
    return F.when(text != "", text).otherwise(collapse(question))


def resolve_follow_up(query: Column, history: Column, pack: Pack = Pack()) -> Column:
    """A query that refers back, with the latest user turn that is not blank, rewritten, before it; cut at 500."""
    earlier = F.filter(history, lambda m: (m["role"] == "user") & (collapse(F.coalesce(m["content"], F.lit(""))) != ""))
    last = F.get(earlier, F.size(earlier) - 1)["content"]
    joined = F.substring(F.concat_ws(" ", rule_rewrite(last, pack), query), 1, MAX_CHARS)
    return F.when(query.rlike("(?U)" + pack.resolved) & last.isNotNull(), joined).otherwise(query)


def rule_variants(query: Column, pack: Pack = Pack()) -> Column:
    """The query without stop words, and the query with known phrases expanded if that changes it."""
    kept = F.array_join(F.filter(words(query), lambda w: ~w.isin(*pack.stop_words)), " ")
    expanded = query
    for phrase, longer in pack.expansions:
        expanded = F.when(query.contains(phrase), F.replace(expanded, F.lit(phrase), F.lit(longer))).otherwise(expanded)
    return F.when(expanded != query, F.array(kept, expanded)).otherwise(F.array(kept))


def unique_variants(questions: DataFrame, variants: Column, count: int = 3, id_col: str = "query_id") -> DataFrame:
    """(query_id, variant, query): the first `count` variants that differ without case, in order from 0, at most 500
    characters each, without blanks, quotes and dashes at the ends."""
    flat = questions.select(id_col, F.posexplode(variants).alias("pos", "raw")).withColumn("text", strip_chars(collapse(F.col("raw")), " `\"'-")).where("text <> ''")
    once = flat.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, casefold(F.col("text"))).orderBy("pos"))).where("_n = 1")
    order = Window.partitionBy(id_col).orderBy("pos")
    return once.withColumn("variant", F.row_number().over(order) - 1).where(F.col("variant") < count).select(id_col, "variant", F.substring("text", 1, MAX_CHARS).alias("query"))


def expand(questions: DataFrame, query_col: str = "query", count: int = 3, pack: Pack = Pack(), id_col: str = "query_id") -> DataFrame:
    """The query and its rule variants, unique."""
    return unique_variants(questions, F.concat(F.array(query_col), rule_variants(F.col(query_col), pack)), count, id_col)


def with_model(rows: DataFrame, prompt_col: str, out_col: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """rows with a column of a model's answers to prompts; null where it fails, with the error in out_col + "_error".

    load() runs once in a worker, see models, and returns generate(prompts), which gets some of bounded length at a time.
    If these fail, they are tried one by one.
    """
    model = served(load)

    def attempt(generate: Callable, prompts: list[str]) -> tuple[list, list]:
        try:
            texts = list(generate(prompts))
            if len(texts) != len(prompts):
                raise ValueError("the model returned another number of texts than it got prompts")
            return texts, [None] * len(prompts)
        except Exception:
            texts, errors = [], []
            for p in prompts:
                try:
                    texts.append(generate([p])[0])
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            return texts, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = model()
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").tolist()
            tried = [attempt(generate, prompts[some]) for some in budgeted(prompts)]
            texts, errors = ([x for t in tried for x in t[k]] for k in (0, 1))
            yield pdf.assign(**{out_col: pd.Series(texts, dtype=object, index=pdf.index), out_col + "_error": pd.Series(errors, dtype=object, index=pdf.index)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, `{out_col}` string, `{out_col}_error` string")


def model_rewrite(rows: DataFrame, prompt_col: str, fallback_col: str, load: Callable, out_col: str = "query") -> DataFrame:
    """A model's query on one line, at most 500 characters, without quotes around it; the rules' where it fails or is blank."""
    asked = with_model(rows, prompt_col, "_text", load)
    text = F.substring(collapse(strip_chars(collapse(F.col("_text")), "\"`")), 1, MAX_CHARS)
    return asked.withColumn(out_col, F.coalesce(F.nullif(text, F.lit("")), F.col(fallback_col))).drop("_text", "_text_error")


def model_variants(text: Column) -> Column:
    """The lines of a model's answer, without bullets and numbers before them."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: F.regexp_replace(x, rf"^[{SPACE}]*(?:[-*]|\d+[.)])[{SPACE}]*", ""))
