"""Versioned tables: replacement in one step, pinned readers, removal and return of documents, compaction."""

import pytest
from pyspark.sql import functions as F

from ragspark.sources import tables, versions
from ragspark.streaming import jobs

DOC = "path string, text string"


def test_replacement_is_one_step(spark, tmp_path):
    """If the second table fails, both old ones are read; a reader that holds a manifest keeps its pair."""
    path, frame = str(tmp_path / "kb"), lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    tables.replace_tables(path, a=frame(1, 2), b=frame(3))
    held = versions.manifest(spark, path)
    broken = frame(5).select(F.when(F.col("x") > 0, F.raise_error(F.lit("no"))).otherwise(1).alias("x"))
    with pytest.raises(Exception, match="no"):
        tables.replace_tables(path, a=frame(9), b=broken)
    read = lambda name, at=None: sorted(r.x for r in versions.read_table(spark, path, name, at).collect())
    assert (read("a"), read("b")) == ([1, 2], [3])
    tables.replace_tables(path, a=frame(7), b=frame(8))
    assert (read("a"), read("b"), read("a", held), read("b", held)) == ([7], [8], [1, 2], [3])
    assert versions.vacuum(spark, path) >= 3 and (read("a"), read("b")) == ([7], [8])
    tables.replace_tables(path, a=frame(1))
    with pytest.raises(FileNotFoundError):
        read("b")


def test_two_writers(spark, tmp_path):
    """Of two changes of one parent the second is refused; no two changes get one number."""
    path = str(tmp_path / "kb")
    tables.replace_tables(path, a=spark.range(1))
    parent = versions.manifest(spark, path)
    assert len({versions.claim(spark, path) for _ in range(4)}) == 4
    versions.publish(spark, path, parent, parent["tables"])
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, parent, {})
    assert versions.manifest(spark, path)["tables"] == parent["tables"]


def texts(spark, path):
    return sorted((r.source, r.text) for r in jobs.current(spark, path, "children").collect())


def test_removed_documents_come_back(spark, tmp_path):
    """Whatever numbers callers gave, and in whatever batch a document comes again."""
    path = str(tmp_path / "kb")
    jobs.ingest_batch(spark.createDataFrame([("a.md", "one"), ("b.md", "two")], DOC), path, 0)
    jobs.remove_missing(spark.createDataFrame([("a.md",)], "path string"), path, 5)
    assert texts(spark, path) == [("a.md", "one")]
    jobs.ingest_batch(spark.createDataFrame([("b.md", "two")], DOC), path, 1)
    assert texts(spark, path) == [("a.md", "one"), ("b.md", "two")]
    jobs.ingest_batch(spark.createDataFrame([("c.md", "x")], DOC), path, 0, "another stream")  # numbers start again
    jobs.ingest_batch(spark.createDataFrame([("c.md", "never")], DOC), path, 0, "another stream")  # published before
    assert texts(spark, path) == [("a.md", "one"), ("b.md", "two"), ("c.md", "x")]


def test_rows_of_one_path(spark, tmp_path):
    """One row of a path is stored, with its own hash, and is then known."""
    rows = [("x.md", "first"), ("x.md", "second"), ("y.md", None)]
    for k, order in enumerate((None, "n")):
        path = str(tmp_path / f"kb{k}")
        frame = spark.createDataFrame([(p, t, -i) for i, (p, t) in enumerate(rows)], DOC + ", n int")
        jobs.ingest_batch(frame, path, 0, order_col=order)
        hashed = {r.source_path: r.content_hash for r in jobs.current(spark, path, "documents").collect()}
        (own,) = [t for s, t in texts(spark, path) if s == "x.md"]
        assert order is None or own == "first"
        assert hashed["x.md"] == spark.range(1).select(F.sha2(F.lit(own), 256).alias("h")).first().h
        before = versions.read_table(spark, path, "documents").count()
        jobs.ingest_batch(spark.createDataFrame([("x.md", own)], DOC), path, 1)
        assert versions.read_table(spark, path, "documents").count() == before == 2


def test_compaction_bounds_reads(spark, tmp_path):
    path = str(tmp_path / "kb")
    for i in range(4):
        jobs.ingest_batch(spark.createDataFrame([("a.md", f"text {i}"), (f"b{i}.md", "same")], DOC), path, i)
    jobs.remove_missing(spark.createDataFrame([("a.md",), ("b0.md",)], "path string"), path)
    want = texts(spark, path)
    assert want == [("a.md", "text 3"), ("b0.md", "same")]
    versions.compact(spark, path)
    assert texts(spark, path) == want
    assert {n: versions.read_table(spark, path, n).count() for n in ("documents", "children", "vectors")} == {"documents": 2, "children": 2, "vectors": 2}
    jobs.ingest_batch(spark.createDataFrame([("b1.md", "same"), ("a.md", "text 3")], DOC), path, 9, compact_every=2)
    assert [s for s, _ in texts(spark, path)] == ["a.md", "b0.md", "b1.md"]
    assert len(versions.manifest(spark, path)["tables"]["documents"]) == 1 and versions.vacuum(spark, path) > 0
    assert len(texts(spark, path)) == 3


def test_stream_with_a_new_checkpoint(spark, tmp_path):
    """Batches of a new checkpoint are numbered from 0 again, and still count."""
    path, source = str(tmp_path / "kb"), str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(f"{i}.md", f"text {i}")], DOC).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DOC).parquet(source)
        jobs.stream_ingest(stream, path, str(tmp_path / f"c{i}")).awaitTermination()
    assert texts(spark, path) == [("0.md", "text 0"), ("1.md", "text 1")]
    assert len(versions.manifest(spark, path)["batches"]) == 2
