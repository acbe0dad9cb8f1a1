"""A BM25 index that grows by segments: postings and mergeable statistics for each ingest, deletes, merged as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.operators.bm25 import EPSILON, Index, forward, term_weights
from ragspark.sources import versions

TABLES = ("records", "forward", "postings", "frequencies", "sizes")


def _terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, terms): the distinct terms of each chunk with their counts, as an array."""
    pair = lambda x: F.struct(x["terms"].alias("term"), x["tfs"].cast("long").alias("tf"))
    return forward(chunks).select("chunk_id", "dl", F.transform(F.arrays_zip("terms", "tfs"), pair).alias("terms"))


def _difference(added: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the change adds to df by term, and to the number of chunks and of tokens."""
    signed = added.select("dl", "terms", F.lit(1).alias("sign")).union(gone.select("dl", "terms", F.lit(-1)))
    df = signed.select("sign", F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("sign").alias("df")).where("df <> 0")
    return df, signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).cast("long").alias("tokens"))


def update_index(spark: SparkSession, path: str, chunks: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """Add or change chunks (chunk_id, text), take others (chunk_id) away, and publish that as one segment; its number.

    Only the segment is written: the postings of the chunks given, and the differences that they and what they replace
    make to df, the number of chunks and of tokens. What is replaced is looked up by its ids in the stored term lists; no
    text is tokenised again, and older segments stay as they are. Of several rows of one id that with the largest hash of
    its text counts; an id that is also removed is removed. See read_index(), versions.compact() and vacuum().
    """
    held = versions.manifest(spark, path)
    given = chunks if chunks is not None else spark.createDataFrame([], "chunk_id string, text string")
    kind = given.schema["chunk_id"].dataType.simpleString() if chunks is not None else (removed.schema["chunk_id"].dataType.simpleString() if removed is not None else "string")
    ids = (removed.select("chunk_id") if removed is not None else spark.createDataFrame([], f"chunk_id {kind}")).distinct()
    one = Window.partitionBy("chunk_id").orderBy(F.desc(F.sha2(F.coalesce("text", F.lit("")), 256)))
    new = given.select(F.col("chunk_id").cast(kind).alias("chunk_id"), "text").withColumn("_n", F.row_number().over(one)).where("_n = 1").join(ids, "chunk_id", "left_anti")
    number = versions.claim(spark, path)
    versions.write_version(_terms(new), path, "forward", number)
    made = spark.read.parquet(f"{path}/forward/version={number}")
    touched = made.select("chunk_id").union(ids)
    if held["tables"]:
        gone = versions.live(spark, path, "forward", "chunk_id", "records", held).drop("version").join(touched, "chunk_id", "left_semi").select(*made.columns)
    else:
        gone = made.limit(0)
    df, sizes = _difference(made, gone)
    postings = made.select(F.explode("terms").alias("t"), "chunk_id", "dl").select("t.term", "chunk_id", "t.tf", "dl")
    records = made.select("chunk_id", F.lit("active").alias("status")).union(ids.join(gone, "chunk_id", "left_semi").select("chunk_id", F.lit("deleted")))
    for name, rows in (("postings", postings), ("frequencies", df), ("sizes", sizes), ("records", records)):
        versions.write_version(rows, path, name, number)
    versions.publish(spark, path, held, {name: [*held["tables"].get(name, []), number] for name in TABLES})
    return number


def read_index(spark: SparkSession, path: str, epsilon: float = EPSILON) -> Index:
    """The index of what is live, for bm25.search(): as if it were built anew from all chunks.

    Statistics are sums over the segments' differences; postings of chunks that changed or went are left out by one join.
    """
    held = versions.manifest(spark, path)
    listed = versions.live(spark, path, "forward", "chunk_id", "records", held).select("chunk_id", "dl", F.col("terms.term").alias("terms"), F.col("terms.tf").alias("tfs"))
    postings = versions.live(spark, path, "postings", "chunk_id", "records", held).select("term", "chunk_id", "tf", "dl")
    total = versions.read_table(spark, path, "sizes", held).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    statistics = total.select("n", (F.col("tokens") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
    df = versions.read_table(spark, path, "frequencies", held).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return Index(postings, term_weights(df, statistics, epsilon, counted=True), statistics, listed)


def compact_index(spark: SparkSession, path: str) -> None:
    """All segments as one: live rows, and the statistics' sums."""
    held = versions.manifest(spark, path)
    number = versions.claim(spark, path)
    sums = {
        "frequencies": versions.read_table(spark, path, "frequencies", held).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"),
        "sizes": versions.read_table(spark, path, "sizes", held).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")),
    }
    for name in TABLES:
        rows = sums[name] if name in sums else versions.live(spark, path, name, "chunk_id", "records", held).drop("version")
        versions.write_version(rows, path, name, number)
    versions.publish(spark, path, held, {name: [number] for name in TABLES})
