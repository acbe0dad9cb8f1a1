"""Conversation tables: upsert, append, recent history, answer lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.text import SPACE, collapse, strip
from ragspark.operators.vector import ranked

TURNS = "array<struct<role:string,content:string>>"


def ensure_conversations(conversations: DataFrame, messages: DataFrame, title_chars: int = 80) -> DataFrame:
    """The conversations, and a new one for each conv_id of the messages (conv_id, turn, text) that has none.

    A new one's title is the start of its first message.
    """
    first = messages.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    new = first.join(conversations.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.substring("text", 1, title_chars).alias("title"))
    return conversations.unionByName(new, allowMissingColumns=True)


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The conversations with updated_at no earlier than their latest message's created_at."""
    latest = messages.groupBy("conv_id").agg(F.max("created_at").alias("_latest"))
    return conversations.join(latest, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_latest")).drop("_latest")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages and the new ones that are not there yet, by (conv_id, turn)."""
    return messages.unionByName(new.join(messages.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"))


def recent_messages(messages: DataFrame, limit: int = 6) -> DataFrame:
    """Of each conversation the newest `limit` messages, of which those of users and assistants are kept.

    The limit comes before the roles, so system turns use it up.
    """
    newest = ranked(messages, limit, ["conv_id"], [F.desc("turn")]).drop("rank")
    return newest.where(F.col("role").isin("user", "assistant"))


def limit_history(turns: Column, max_chars: int = 6000) -> Column:
    """The newest turns that fit into max_chars, oldest first; the one that overflows is cut to what is left.

    turns: array of (role, content), oldest first. Texts count without white space at their ends, and blank ones are
    left out. A cut text loses white space at its end, and what that frees is still left for the next older turn. A
    turn with nothing left is not there.
    """
    start = F.struct(F.lit(max_chars).alias("left"), F.array().cast(TURNS).alias("out"))

    def step(state: Column, m: Column) -> Column:
        text = strip(F.coalesce(m["content"], F.lit("")))
        cut = F.when(F.length(text) > state["left"], F.regexp_replace(F.substring(text, F.lit(1), state["left"]), f"[{SPACE}]+$", "")).otherwise(text)
        one = F.array(F.struct(m["role"].alias("role"), cut.alias("content"))).cast(TURNS)
        put = F.when((state["left"] > 0) & (cut != ""), F.concat(one, state["out"])).otherwise(state["out"])
        return F.struct((state["left"] - F.when(state["left"] > 0, F.length(cut)).otherwise(0)).alias("left"), put.alias("out"))

    return F.aggregate(F.reverse(turns), start, step, lambda s: s["out"])


def histories(messages: DataFrame, limit: int = 6, max_chars: int = 6000) -> DataFrame:
    """(conv_id, history): the recent turns of each conversation as one array, within the character budget."""
    recent = recent_messages(messages, limit)
    gathered = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return gathered.select("conv_id", limit_history(turns, max_chars).alias("history"))


def earlier_turns(messages: DataFrame, limit: int = 6, max_chars: int = 6000) -> DataFrame:
    """(conv_id, turn, text, history) of every user turn: the history as it stood before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-limit, -1)
    seen = messages.withColumn("_before", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)).where("role = 'user'")
    kept = F.filter(F.col("_before").cast(TURNS), lambda m: m["role"].isin("user", "assistant"))
    return seen.select("conv_id", "turn", "text", limit_history(kept, max_chars).alias("history"))


def answer_lineage(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """sources (message_id, chunk_id, score, excerpt) with chunk_id null where there is no such chunk (any more)."""
    known = chunks.select(F.col("chunk_id").alias("_known")).distinct()
    return sources.join(known, sources["chunk_id"] == known["_known"], "left").withColumn("chunk_id", F.col("_known")).drop("_known")


def current_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks whose document is there."""
    return chunks.join(documents.select("document_id"), "document_id", "left_semi")


def valid_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with text, and the rejected blank ones."""
    blank = collapse(F.coalesce(F.col("text"), F.lit(""))) == ""
    return messages.where(~blank), messages.where(blank)


def checked_top_k(top_k: int) -> int:
    if not 1 <= top_k <= 10:
        raise ValueError("top_k must be from 1 to 10")
    return top_k
