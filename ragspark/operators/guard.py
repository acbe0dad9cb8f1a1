"""Guardrails: injection screening and the scope decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.text import normalize, security_normalize
from ragspark.packs import Pack

UNICODE = "(?U)"


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found in the text: one alternation, with Unicode words and boundaries."""
    return text.rlike(UNICODE + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def contains_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the text holds any term, also inside a word."""
    return text.rlike("|".join(r"\Q" + t + r"\E" for t in terms)) if terms else F.lit(False)


def is_injection(text: Column, pack: Pack = Pack()) -> Column:
    """Whether the text holds a known injection pattern once obfuscation is undone; null: no."""
    return F.coalesce(matches_any(security_normalize(text), pack.injections), F.lit(False))


def scope_decision(question: Column, history: Column | None = None, pack: Pack = Pack()) -> Column:
    """struct(allowed, reason): the first of empty, injection, a blocked task, domain term, follow-up, outside.

    history: an array of (role, content) of the screened earlier turns. A follow-up is allowed if any earlier user
    turn has a domain term.
    """
    text = normalize(F.coalesce(question, F.lit("")))
    say = lambda ok, reason: F.struct(F.lit(ok).alias("allowed"), F.lit(reason).alias("reason"))
    out = F.when(text == "", say(False, pack.reasons["empty"])).when(is_injection(question, pack), say(False, pack.reasons["injection"]))
    for reason, pattern in pack.blocked:
        out = out.when(matches_any(text, (pattern,)), say(False, reason))
    out = out.when(contains_term(text, pack.domain_terms), say(True, pack.reasons["domain"]))
    if history is not None:
        earlier = F.exists(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda m: (m["role"] == "user") & contains_term(normalize(F.coalesce(m["content"], F.lit(""))), pack.domain_terms))
        out = out.when(matches_any(text, pack.follow_ups) & earlier, say(True, pack.reasons["follow_up"]))
    return out.otherwise(say(False, pack.reasons["outside"]))


def safe_history(history: Column, pack: Pack = Pack()) -> Column:
    """The turns without users' injections; other roles are kept."""
    return F.filter(history, lambda m: ~((m["role"] == "user") & is_injection(m["content"], pack)))


def drop_poisoned(contexts: DataFrame, by: list[str], pack: Pack = Pack(), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The contexts whose text is no injection, and how many were removed for each group."""
    marked = contexts.withColumn("_bad", is_injection(F.col(text_col), pack))
    return marked.where(~F.col("_bad")).drop("_bad"), marked.groupBy(*by).agg(F.count_if("_bad").alias("unsafe_contexts_removed"))
