"""Versioned tables: every change writes fresh folders and is published by one manifest, which readers pin."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_log"
#: Versions that count no more, of all keys, which are sent to the rows at most.
SENT_STALE = 250_000


class Conflict(RuntimeError):
    """Another change was published first; start again from what there is now."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, suffix: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/{LOG}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(suffix)) for n in names if n.endswith(suffix))


def claim(spark: SparkSession, path: str) -> int:
    """A version number that no other change has had or gets: the next free one, taken by creating its file."""
    fs, folder = _fs(spark, f"{path}/{LOG}")
    fs.mkdirs(folder)
    number = max(_numbers(spark, path, ".claim"), default=-1) + 1
    while True:
        try:
            fs.create(_fs(spark, f"{path}/{LOG}/{number:012d}.claim")[1], False).close()
            return number
        except Py4JJavaError as e:
            if "Exist" not in str(e.java_exception.getClass().getName()):
                raise
            number += 1


def manifest(spark: SparkSession, path: str, at: int | None = None) -> dict:
    """The latest manifest, or that of number `at`: number, the versions of each table, and the last batch of each source."""
    numbers = _numbers(spark, path, ".json")
    if at is None and not numbers:
        return {"number": -1, "tables": {}, "batches": {}}
    number = numbers[-1] if at is None else at
    return json.loads(spark.read.text(f"{path}/{LOG}/{number:012d}.json", wholetext=True).first().value)


def publish(spark: SparkSession, path: str, parent: dict, tables: dict[str, list[int]], batches: dict[str, int] | None = None) -> dict:
    """Make `tables` what readers see, in one rename that fails if another manifest follows the parent already."""
    made = {"number": parent["number"] + 1, "tables": tables, "batches": parent["batches"] if batches is None else batches}
    fs, draft = _fs(spark, f"{path}/{LOG}/{uuid.uuid4().hex}.draft")
    fs.mkdirs(draft.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    final = _fs(spark, f"{path}/{LOG}/{made['number']:012d}.json")[1]
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "Exist" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"manifest {made['number']} of {path} is there already") from None
        raise
    return made


def write_version(df: DataFrame, path: str, name: str, version: int) -> None:
    """The rows of one table in one version; readers don't see them before they are published."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/version={version}")


def read_table(spark: SparkSession, path: str, name: str, at: dict | None = None) -> DataFrame:
    """All rows of a table's versions in a manifest (the latest if none is given), with their `version`.

    A reader that keeps the manifest reads the same rows of all its tables, whatever is published meanwhile.
    """
    held = at or manifest(spark, path)
    if not held["tables"].get(name):
        raise FileNotFoundError(f"{path} has no table {name}")
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/version={v}" for v in held["tables"][name]])


def replace_all(path: str, tables: dict[str, DataFrame]) -> dict:
    """Put all these tables in the place of those under path, in one step: if one can't be written, none is replaced."""
    spark = next(iter(tables.values())).sparkSession
    parent, version = manifest(spark, path), claim(spark, path)
    for name, df in tables.items():
        write_version(df, path, name, version)
    return publish(spark, path, parent, {name: [version] for name in tables})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the folders of versions that none of the newest `keep` manifests names; how many. Not while others write."""
    numbers = _numbers(spark, path, ".json")[-keep:]
    used: dict[str, set[int]] = {}
    for n in numbers:
        for name, versions in manifest(spark, path, n)["tables"].items():
            used.setdefault(name, set()).update(versions)
    gone = 0
    fs, root = _fs(spark, path)
    for table in [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName() != LOG]:
        for folder in [s.getPath() for s in fs.listStatus(table) if s.getPath().getName().startswith("version=")]:
            if int(folder.getName().removeprefix("version=")) not in used.get(table.getName(), set()):
                fs.delete(folder, True)
                gone += 1
    return gone


def live(spark: SparkSession, path: str, name: str, key: str = "document_id", records: str = "documents", at: dict | None = None) -> DataFrame:
    """The rows of a table that belong to the latest version of a record that is there, merged as they are read.

    Records (key, status) tell of each change of a key: its newest one counts, and says that it is there or `deleted`. As
    every version of a key has its record, up to SENT_STALE that count no more are sent to the rows, which stay where they
    are; with more, the rows are joined with the newest ones.
    """
    held = at or manifest(spark, path)
    told, rows = read_table(spark, path, records, held).select(key, "version", "status"), read_table(spark, path, name, held)
    newest = told.groupBy(key).agg(F.max("version").alias("version"), F.max_by("status", "version").alias("_status")).where("_status <> 'deleted'").select(key, "version")
    stale = told.select(key, "version").distinct().join(newest, [key, "version"], "left_anti")
    if stale.limit(SENT_STALE + 1).count() > SENT_STALE:
        return rows.join(newest, [key, "version"], "left_semi")
    return rows.where(F.col(key).isNotNull()).join(F.broadcast(stale), [key, "version"], "left_anti")


def compact(spark: SparkSession, path: str, key: str = "document_id", records: str = "documents") -> dict:
    """Write the live rows of all tables as one version and publish that alone: reads are bounded by what is live again."""
    held = manifest(spark, path)
    if not held["tables"]:
        return held
    version = claim(spark, path)
    for name in held["tables"]:
        write_version(live(spark, path, name, key, records, held).drop("version"), path, name, version)
    return publish(spark, path, held, {name: [version] for name in held["tables"]})
