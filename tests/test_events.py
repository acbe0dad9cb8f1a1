"""The event log: published or not there, once each, whatever fails."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from ragspark.streaming import events, jobs

ROWS = "query_id string, route string, answer string"


def log(spark, path):
    return sorted((r.source, r.batch_id, r.query_id, r.place, r.type, r.route, r.answer) for r in events.read_events(spark, path).collect())


def failing(spark, n=40):
    """Answers over eight tasks, the last of which fails after others have written their files."""
    bad = F.when(F.col("id") == n - 1, F.raise_error(F.lit("down"))).otherwise(F.lit("text"))
    return spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("query_id"), F.lit("answer").alias("route"), bad.alias("answer"))


def test_an_aborted_phase_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    answered = spark.createDataFrame([(str(i), "answer", f"a{i}") for i in range(40)], ROWS)
    events.write_events(events.starts(answered), path, 3, "start")
    before = set(glob.glob(f"{path}/data/*"))
    with pytest.raises(Exception, match="down"):
        events.write_events(events.dones(failing(spark)), path, 3, "done")
    assert log(spark, path) == sorted(("", 3, str(i), 1, "start", None, None) for i in range(40))
    for _ in range(2):  # the retry, and once more
        jobs.log_events(answered, path, 3)
    want = sorted(x for i in range(40) for x in (("", 3, str(i), 1, "start", "answer", None), ("", 3, str(i), 2, "done", "answer", f"a{i}")))
    assert log(spark, path) == want
    assert events.vacuum(spark, path) >= len(before) and log(spark, path) == want
    named = {f for c in glob.glob(f"{path}/commits/*.json") for f in json.load(open(c))["files"]}
    assert named == {os.path.basename(f) for f in glob.glob(f"{path}/data/*")}


def test_sources_keep_their_batches_apart(spark, tmp_path):
    """Equal batch numbers of two sources don't replace one another; one id asked in both has its places in each."""
    path = str(tmp_path / "log")
    jobs.log_events(spark.createDataFrame([("q", "answer", "one"), ("q2", "refusal", None)], ROWS), path, 0, "a/b")
    jobs.log_events(spark.createDataFrame([("q", "answer", "two"), (None, None, "x")], ROWS), path, 0, "c")
    own = events.read_events(spark, path).where("query_id = 'q'").orderBy("source", "place").collect()
    assert [(r.source, r.place, r.type, r.answer) for r in own] == [("a/b", 1, "start", None), ("a/b", 2, "done", "one"), ("c", 1, "start", None), ("c", 2, "done", "two")]
    assert events.read_events(spark, path).count() == 8


def test_stream_into_the_log(spark, tmp_path):
    """A stream of starts goes in by batches; a run that fails publishes nothing of its batch, the next has it once."""
    path, source, c = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "c")
    assert events.read_events(spark, path).count() == 0
    spark.range(30).select(F.col("id").cast("string").alias("query_id")).repartition(3).write.parquet(source)
    asked = spark.readStream.schema("query_id string").parquet(source)
    broken = asked.withColumn("query_id", F.when(F.col("query_id") == "7", F.raise_error(F.lit("down"))).otherwise(F.col("query_id")))
    with pytest.raises(Exception, match="down"):
        events.stream_events(events.starts(broken), path, "start", c).awaitTermination()
    assert events.read_events(spark, path).count() == 0
    for _ in range(2):  # the second has nothing new
        events.stream_events(events.starts(asked), path, "start", c).awaitTermination()
    assert [r[2] for r in log(spark, path)] == sorted(map(str, range(30)))
    events.write_events(events.starts(spark.createDataFrame([], ROWS)), path, 9, "start")
    assert events.read_events(spark, path).count() == 30
