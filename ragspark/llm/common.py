"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space of the word and line rules: [\x20\x09-\x0D].
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

_own_dirs: dict[str, str] = {}
_stored: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one of setCheckpointDir(); in local runs that name
    none a temporary one. Raises RuntimeError on a cluster that names none, where executors would write to their own disks."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, and a lost executor loses nothing.

    The table stays until discard(), release() or the end of the process.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _stored.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    try:
        fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        fs.delete_dir(base)
    except (OSError, pa.ArrowInvalid):
        pass  # gone already, or a file system that only Spark knows: its own clean-up has to do it


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _stored.discard(df.stored_at)


def release() -> None:
    """Delete all tables that materialize() wrote in this process; DataFrames over them can't be read afterwards."""
    for path in list(_stored):
        _delete(path)
    _stored.clear()


atexit.register(release)


def in_task(spark: SparkSession, work: Callable, *args):
    """work(*args), run in one task: for linear algebra on a bounded model. A driver whose BLAS threads were lost when
    it started the JVM may wait for them for ever; Spark gives the workers one thread each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(*args))] * len(batch), pa.binary())], ["made"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "made binary").first()["made"])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays in the tens of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def key_hash(*cols: Column) -> Column:
    """A stable hash of 60 bits of the columns' text; the same in any engine with md5. Null counts as the empty text."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def gapless_rank(df: DataFrame, by: list[str], hash_col: str, order: list[str], name: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each group of `by` from 0 without gaps, in the order of (hash_col, *order).

    hash_col holds uniform 60-bit hashes, so equal ranges of it are buckets of about rows_per_bucket rows at
    most, and at least as many as a shuffle has partitions, so that a large group is dealt to all; the rows are sorted within (group, bucket) only, and a table with one count for each of those gives
    the offsets. df should be materialized: it is read twice. Rows equal in hash_col share a bucket.
    """
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_bucket))
    bucketed = df.withColumn("_bucket", F.floor(F.col(hash_col) / F.lit(float(1 << 60)) * F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*by, "_bucket").count()
        .select(*by, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(hash_col, *order)
    return (
        bucketed.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_base")
    )


def tiled(df: DataFrame, key: list[str], ident: str, limit: int) -> DataFrame:
    """Deal the rows of each key into tiles of about `limit` rows and repeat each row for every pair of tiles it is in.

    Adds _tile, _ti <= _tj. All pairs of rows of a key meet in exactly one (_ti, _tj) or, within a tile, also in
    (_tile, _tile) only; a key with up to `limit` rows has the one tile 0. A hot key becomes many bounded tasks.
    """
    large = (
        df.groupBy(*key).count().where(F.col("count") > limit)
        .select(*key, F.ceil(F.col("count") / limit).cast("int").alias("_tiles"))
    )
    n = F.coalesce(F.col("_tiles"), F.lit(1))
    own = F.col("_tile")
    return (
        df.join(large, key, "left")
        .withColumn("_tile", F.pmod(F.xxhash64(ident), n).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("_ti", F.least(own, F.col("_o"))).withColumn("_tj", F.greatest(own, F.col("_o")))
        .drop("_tiles", "_o")
    )


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node of edges (a, b), both long; component is the smallest node reachable.

    Alternating large-star and small-star rounds on the edge table, a logarithmic number of them, each written
    to the shared folder. Only joins and minimums with map-side combination; a hot node is a skewed join key,
    which adaptive execution splits. Self-loops keep their node; an empty table gives an empty one.
    """
    nodes = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    now = materialize(
        edges.where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b")).distinct()
        )
        after = materialize(small, tag)
        discard(now)
        now, was, seen = after, seen, mark(after)
        if seen == was:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).union(nodes).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.union(roots.select("node", F.col("node").alias("component")))
