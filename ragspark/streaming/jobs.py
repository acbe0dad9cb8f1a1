"""Streaming jobs: incremental ingest, conversation memory, continuous answering, the event log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragspark.operators import chunking, embedding
from ragspark.sources import versions
from ragspark.sources.tables import document_records
from ragspark.streaming import events
from ragspark.streaming.events import read_events  # noqa: F401  read beside what writes them


def latest(rows: DataFrame) -> DataFrame:
    """Of each document the rows of its latest version in this table."""
    newest = rows.groupBy("document_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["document_id", "version"], "left_semi")


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of documents, children or vectors under path that belong to the latest version of a document that is there."""
    return versions.live(spark, path, name)


def _retried(change: Callable[[], None], times: int = 5) -> None:
    """The change, once more from the start if another was published before it."""
    for left in reversed(range(times)):
        try:
            return change()
        except versions.Conflict:
            if not left:
                raise


def remove_missing(present: DataFrame, path: str, version: int | None = None) -> None:
    """Mark the documents whose path is not in `present` (path) as deleted; current() leaves them out.

    The marks get the next number of the table's own log, as all changes do; `version`, which callers once gave, says
    nothing any more.
    """
    spark = present.sparkSession

    def change() -> None:
        held = versions.manifest(spark, path)
        old = versions.live(spark, path, "documents", at=held).drop("version")
        gone = old.join(present.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti")
        number = versions.claim(spark, path)
        versions.write_version(gone.select(*old.columns).withColumn("status", F.lit("deleted")), path, "documents", number)
        versions.publish(spark, path, held, held["tables"] | {"documents": [*held["tables"]["documents"], number]})

    _retried(change)


def ingest_batch(docs: DataFrame, path: str, batch: int, source: str = "", order_col: str | None = None, compact_every: int = 32) -> None:
    """Add what is new in a batch of (path, text) to documents, children and vectors under path, as one published version.

    Of several rows of one path that with the largest order_col counts, or without one that with the largest hash of its
    text; it alone is hashed, cut and stored. A document whose id and content hash are there is left alone; a
    changed one, or one that was removed, gets its rows with the next number of the table's log, see versions. A batch of
    a source that was published before is left out, whatever its number is in other sources. When so many versions
    have come together they are compacted. Nothing is cached: vectors are made from the children as they were stored.
    """
    spark = docs.sparkSession
    order = [F.desc(order_col)] if order_col else []
    one = Window.partitionBy("path").orderBy(*order, F.desc("_hash"))
    hashed = docs.withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    single = hashed.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("path", "text", "_hash")

    def change() -> None:
        held = versions.manifest(spark, path)
        if held["batches"].get(source, -1) >= batch:
            return
        records = document_records(single.withColumn("_text", F.col("text")), extra=("_text", "_hash")).withColumn("content_hash", F.col("_hash")).drop("_hash")
        if held["tables"]:
            old = versions.live(spark, path, "documents", at=held).select("document_id", "content_hash")
            records = records.join(old, ["document_id", "content_hash"], "left_anti")
        _, children = chunking.chunk_records(records.select(F.col("source_path").alias("path"), F.col("_text").alias("text")))
        number = versions.claim(spark, path)
        versions.write_version(children, path, "children", number)
        cut = spark.read.schema(children.schema).parquet(f"{path}/children/version={number}")
        versions.write_version(embedding.hash_embed(cut, "chunk_id", "text", carry=("document_id",)).select("chunk_id", "vector", "document_id"), path, "vectors", number)
        versions.write_version(records.drop("_text"), path, "documents", number)
        versions.publish(spark, path, held, {name: [*held["tables"].get(name, []), number] for name in ("children", "vectors", "documents")}, held["batches"] | {source: batch})

    _retried(change)
    if compact_every and len(versions.manifest(spark, path)["tables"].get("documents", [])) >= compact_every:
        _retried(lambda: versions.compact(spark, path))


def stream_ingest(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ingest a stream of (path, text), all that is available, then stop. Batches are known by the query's own id, so
    a new checkpoint, which numbers them from 0 again, is another source."""
    def each(df: DataFrame, i: int) -> None:
        ingest_batch(df, path, i, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_memory(turns: DataFrame, limit: int = 6, max_chars: int = 6000, idle_days: float | None = None) -> DataFrame:
    """A stream of (conv_id, turn, role, text) to self-contained questions: (conv_id, turn, text, history as JSON).

    The state of a conversation is its newest `limit` turns. Turns of a batch are taken in order; a late one is put in
    its place in the state, and what was emitted before stays as it was. With idle_days the state of a conversation
    without a turn for so long goes, so that it does not grow for ever: for streams that keep running. A run with
    trigger(availableNow) ends then only with spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, role, text in zip(new["turn"].tolist(), new["role"], new["text"], strict=True):
            if role == "user":
                left, kept = max_chars, []
                for _, r, t in reversed([h for h in held if h[0] < turn][-limit:]):
                    if r not in ("user", "assistant"):
                        continue
                    t = (t or "").strip()
                    t = t if len(t) <= left else t[:left].rstrip()
                    if left and t:
                        kept.insert(0, {"role": r, "content": t})
                        left -= len(t)
                out.append((key[0], turn, text, json.dumps(kept, ensure_ascii=False)))
            held = sorted([h for h in held if h[0] != turn] + [[turn, role, text]], key=lambda h: h[0])[-limit:]
        state.update((json.dumps(held),))
        if idle_days is not None:
            state.setTimeoutDuration(int(idle_days * 86_400_000))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "history"])

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, turn long, text string, history string", "held string", "append",
        GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_answers(
    questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, asked: Callable[[DataFrame], DataFrame] | None = None, source: str = "",
) -> StreamingQuery:
    """Answer a stream of questions a batch at a time with a batch plan, and log events under path, see events.

    A batch's starts are published before its answers are computed: asked(batch) gives their query_id, by default what
    answer(batch) says without its other columns. A batch that fails in between leaves starts alone, and its retry
    replaces them and adds the dones, so both count once. Streams with checkpoints of their own that share a log have a
    source each.
    """
    def each(df: DataFrame, i: int) -> None:
        events.write_events(events.starts((asked or answer)(df)), path, i, "start", source)
        events.write_events(events.dones(answer(df)), path, i, "done", source)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_events(answered: DataFrame, path: str, batch: int, source: str = "") -> None:
    """Both records of each question (query_id, route, answer); a batch that comes again replaces its own."""
    events.write_events(events.starts(answered), path, batch, "start", source)
    events.write_events(events.dones(answered), path, batch, "done", source)
