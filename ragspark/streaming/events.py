"""The event log: a sink with two phases, and its reader.

A task writes its events into a file of its own under `data`, which nobody reads yet. When all tasks have ended, the driver
publishes the files of the batch by one record under `commits`. A batch that comes again replaces its record, so its
events count once; files of tasks that failed, were repeated or ran on lost executors are in no record.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery

EVENT = "query_id string, route string, no int, type string, answer string"
COMMIT = "source string, batch_id long, phase string, files array<string>"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(f"file://{path}" if path.startswith("/") else path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class Sink:
    """What batch and stream writers do: a file a task, then a record of the files, or their removal."""

    def __init__(self, options: dict) -> None:
        self.path, self.phase, self.source = options["path"], options["phase"], options.get("source", "")
        self.batch = int(options.get("batch", -1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """All batches of a task as one Parquet file; none for a task without rows."""
        (fs, base), out, name = _at(self.path), None, f"{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if len(batch):
                if out is None:
                    fs.create_dir(f"{base}/data", recursive=True)
                    out = pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def publish(self, messages: list, batch: int) -> None:
        """The record of a batch, written aside and renamed, so that it is there as a whole or not at all."""
        fs, base = _at(self.path)
        record = {"source": self.source, "batch_id": batch, "phase": self.phase, "files": sorted(m.file for m in messages if m and m.file)}
        aside, own = f"{base}/_aside-{uuid.uuid4().hex}", f"{base}/commits/{quote(self.source, safe='')}-{batch}-{self.phase}.json"
        fs.create_dir(f"{base}/commits", recursive=True)
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps(record).encode())
        fs.move(aside, own)

    def discard(self, messages: list) -> None:
        """Delete the files of the tasks that did end."""
        fs, base = _at(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{base}/data/{m.file}")


class BatchSink(Sink, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.discard(messages)


class StreamSink(Sink, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.discard(messages)


class EventLog(DataSource):
    """Format `event_log`, to write to; options: path, phase (start or done), source, and batch for tables that are no stream."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return EVENT

    def writer(self, schema, overwrite: bool) -> BatchSink:
        return BatchSink(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamSink:  # noqa: N802
        return StreamSink(self.options)


def _events(rows: DataFrame, no: int, kind: str) -> DataFrame:
    own = {"route": F.lit(None), "answer": F.lit(None), **({c: F.col(c) for c in ("route", "answer")} if kind == "done" else {})}
    return rows.select(
        F.col("query_id").cast("string").alias("query_id"), own["route"].cast("string").alias("route"), F.lit(no).alias("no"),
        F.lit(kind).alias("type"), own["answer"].cast("string").alias("answer"))


def starts(questions: DataFrame) -> DataFrame:
    """A start record for each question (query_id)."""
    return _events(questions, 0, "start")


def dones(answered: DataFrame) -> DataFrame:
    """A done record for each question (query_id, route, answer)."""
    return _events(answered, 1, "done")


def write_events(events: DataFrame, path: str, batch: int, phase: str, source: str = "") -> None:
    """The events of one phase of a batch, published together; those of the same source, batch and phase are replaced."""
    events.sparkSession.dataSource.register(EventLog)
    events.write.format("event_log").options(path=path, phase=phase, batch=str(batch), source=source).mode("append").save()


def stream_events(events: DataFrame, path: str, phase: str, checkpoint: str, source: str = "") -> StreamingQuery:
    """A stream of events straight into the log, a batch published at a time; all that is available, then it stops."""
    events.sparkSession.dataSource.register(EventLog)
    out = events.writeStream.format("event_log").options(path=path, phase=phase, source=source).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All published events with source and batch_id, in order (place) within each question of a batch.

    A start has the route of its done, null as long as there is none. Files without a record are not looked at; a log
    without records is empty. Of the log only names of files meet the records; neither goes through the driver.
    """
    (fs, base), none = _at(path), f"{EVENT}, source string, batch_id long"
    if fs.get_file_info(f"{base}/commits").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], f"{none}, place int")
    listed = spark.read.schema(COMMIT).json(f"{path}/commits").select("source", "batch_id", F.explode("files").alias("file"))
    if fs.get_file_info(f"{base}/data").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], f"{none}, place int")
    rows = spark.read.schema(EVENT).parquet(f"{path}/data").withColumn("file", F.col("_metadata.file_name")).join(listed, "file").drop("file")
    own = Window.partitionBy("query_id", "source", "batch_id")
    return rows.withColumn("route", F.coalesce("route", F.max("route").over(own))).withColumn("place", F.row_number().over(own.orderBy("no")))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files that no record names, and say how many; only while nothing is being written."""
    fs, base = _at(path)
    found = spark.read.format("binaryFile").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    listed = spark.read.schema(COMMIT).json(f"{path}/commits").select(F.explode("files").alias("file"))
    gone = [r.file for r in found.join(listed, "file", "left_anti").toLocalIterator()]
    for name in gone:
        fs.delete_file(posixpath.join(base, "data", name))
    return len(gone)
