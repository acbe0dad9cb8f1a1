"""Streams give what the batch forms give."""

import json
import time

from pyspark.sql import functions as F

from ragspark.operators import conversations
from ragspark.streaming import jobs


def test_incremental_ingest(spark, tmp_path):
    base, docs = str(tmp_path / "base"), [("a.md", "# A\n\none"), ("b.md", "two")]
    jobs.ingest_batch(spark.createDataFrame(docs, "path string, text string"), base, 0)
    jobs.ingest_batch(spark.createDataFrame([("a.md", "# A\n\none"), ("b.md", "two changed"), ("c.md", "three")], "path string, text string"), base, 1)
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    assert sorted((r.source_path, r.version) for r in read("documents").collect()) == [("a.md", 0), ("b.md", 0), ("b.md", 1), ("c.md", 1)]
    assert sorted((r.source, r.text) for r in jobs.latest(read("children")).collect()) == [("a.md", "# A\n\none"), ("b.md", "two changed"), ("c.md", "three")]
    jobs.ingest_batch(spark.createDataFrame([("b.md", "two changed"), ("c.md", "three")], "path string, text string"), base, 1)  # the same batch again
    assert read("documents").count() == 4 and jobs.latest(read("vectors")).count() == 3
    jobs.remove_missing(spark.createDataFrame([("a.md",), ("c.md",)], "path string"), base, 2)
    for _ in range(2):
        assert {name: jobs.current(spark, base, name).count() for name in ("documents", "children", "vectors")} == {"documents": 2, "children": 2, "vectors": 2}
        assert {r.source for r in jobs.current(spark, base, "children").collect()} == {"a.md", "c.md"}
        jobs.remove_missing(spark.createDataFrame([("a.md",), ("c.md",)], "path string"), base, 3)
    jobs.ingest_batch(spark.createDataFrame([("b.md", "two changed")], "path string, text string"), base, 4)  # it is back as it was
    assert sorted(r.text for r in jobs.current(spark, base, "children").collect()) == ["# A\n\none", "three", "two changed"]


def test_idle_conversations_expire(spark, tmp_path, request):
    """After the idle time a conversation's earlier turns are no history any more."""
    schema, source = "conv_id long, turn long, role string, text string", str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        made = jobs.stream_memory(spark.readStream.schema(schema).parquet(source), idle_days=1 / 86_400)
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    request.addfinalizer(lambda: spark.conf.set(key, before))
    put((1, 0, "user", "first"))
    run()
    time.sleep(2)
    put((2, 0, "user", "other"))
    run()
    put((1, 1, "user", "late"))
    run()
    got = {(r.conv_id, r.turn): json.loads(r.history) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): [], (2, 0): [], (1, 1): []}


def test_memory_and_answers(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], f"text {c} {t} " + "x" * (t * 3)) for c in range(6) for t in range(9)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages.repartition(1).write.parquet(str(tmp_path / "in"))
    made = jobs.stream_memory(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in")), max_chars=40)
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.conv_id, r.turn): [(m["role"], m["content"]) for m in json.loads(r.history)] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.conv_id, r.turn): [(m.role, m.content) for m in r.history] for r in conversations.earlier_turns(messages, 6, 40).collect()}
    assert got == want

    def answer(df):
        return df.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.lit("answer").alias("route"), F.upper("text").alias("answer"))

    stream = spark.readStream.schema("conv_id long, turn long, text string, history string").parquet(str(tmp_path / "out"))
    jobs.stream_answers(stream, answer, str(tmp_path / "events"), str(tmp_path / "c2")).awaitTermination()
    jobs.log_events(answer(spark.read.parquet(str(tmp_path / "out"))), str(tmp_path / "events"), 0)  # the batch again
    events = jobs.read_events(spark, str(tmp_path / "events")).collect()
    assert len(events) == 2 * len(got) and {(r.type, r.place) for r in events} == {("start", 1), ("done", 2)}
    assert all((r.answer is None) == (r.type == "start") for r in events)
