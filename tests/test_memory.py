"""Conversation memory with list state: the batch form's rows, and turns that go after their age."""

import json
import time

import pytest

from ragspark.operators import conversations
from ragspark.streaming import memory

TURN = "conv_id long, turn long, role string, text string"


@pytest.fixture
def rocksdb(spark):
    """State in RocksDB; no batches without rows, which with an age would follow one another for ever."""
    keys = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
    before = [spark.conf.get(k) for k in keys]
    memory.rocksdb_state(spark)
    spark.conf.set(keys[1], "false")
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def run(spark, source, out, **options):
    made = memory.stream_turns(spark.readStream.schema(TURN).parquet(source), **options)
    made.writeStream.format("parquet").option("path", f"{out}/turns").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    return {(r.conv_id, r.turn): [(m["role"], m["content"]) for m in json.loads(r.history)] for r in spark.read.parquet(f"{out}/turns").collect()}


def test_same_as_the_batch_form(spark, tmp_path, rocksdb):
    """Over two batches, with null, blank and long texts and other roles, within a small budget."""
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], [f" text {c} {t} " + "x" * (t * 3), None, "  "][(c * t) % 7 % 3]) for c in range(6) for t in range(9)]
    source = str(tmp_path / "in")
    for part in ([r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]):
        spark.createDataFrame(part, TURN).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, tmp_path, max_chars=40)
    want = {(r.conv_id, r.turn): [(m.role, m.content) for m in r.history] for r in conversations.earlier_turns(spark.createDataFrame(rows, TURN), 6, 40).collect()}
    assert got == want


def test_turns_go_after_their_age(spark, tmp_path, rocksdb):
    source = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), TURN).coalesce(1).write.mode("append").parquet(source)
    put((1, 0, "user", "first"))
    run(spark, source, tmp_path, ttl_days=2 / 86_400)
    time.sleep(3)
    put((1, 1, "user", "late"), (2, 0, "user", "other"), (2, 1, "user", "soon"))
    got = run(spark, source, tmp_path, ttl_days=2 / 86_400)
    assert got == {(1, 0): [], (1, 1): [], (2, 0): [], (2, 1): [("user", "other")]}
