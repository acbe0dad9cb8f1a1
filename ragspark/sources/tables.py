"""Reading corpora and evaluation cases, writing knowledge tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.text import file_name
from ragspark.sources.versions import replace_all

WRAPPERS = ("data", "samples", "cases", "questions")
CASE = ("struct<id:string,user_input:string,question:string,reference:string,reference_answer:string,expected_terms:array<string>,answer_terms:array<string>>")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_corpus(spark: SparkSession, folder: str, suffixes: str = "md|txt") -> DataFrame:
    """(path, text): a row for each file under the folder with one of the suffixes, in any case; a missing folder is empty."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(F.col("path").rlike(rf"(?i)\.({suffixes})$"))


def document_records(docs: DataFrame, path_col: str = "path", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """document_id and content_hash (SHA-256 of path and text), source_path, title, file_type, status, and the extra columns."""
    name = file_name(F.col(path_col), "")
    return docs.select(
        F.sha2(F.col(path_col), 256).alias("document_id"), F.col(path_col).alias("source_path"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("title"),
        F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1)).alias("file_type"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content_hash"), F.lit("active").alias("status"), *extra)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The rows of evaluation files, with pos, their place in the file: a JSON array of objects; an object that holds one
    under data, samples, cases or questions; or either in a fenced block of a Markdown file. Items that are no
    objects are rows of nulls, which normalize_cases() rejects."""
    raw = spark.read.text(path, wholetext=True)
    fenced = F.regexp_extract("value", r"(?s)```(?:json)?\s*\n(.*?)\n\s*```", 1)
    body = F.trim(F.when(F.trim("value").rlike(r"^[\[{]"), F.col("value")).otherwise(fenced))
    wrapped = F.from_json(body, "struct<" + ",".join(f"{w}:array<{CASE}>" for w in WRAPPERS) + ">")
    cases = F.when(body.startswith("["), F.from_json(body, f"array<{CASE}>")).otherwise(F.coalesce(*[wrapped[w] for w in WRAPPERS]))
    return raw.select(F.posexplode(cases).alias("pos", "c")).select("pos", "c.*")


def replace_tables(path: str, **tables: DataFrame) -> None:
    """Put the tables in the place of all that were under path, in one step, see versions.replace_all(); read them with
    versions.read_table(). A job that fails on the way leaves the old ones as they were."""
    replace_all(path, tables)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The table, written under path and read again."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rebuild_vectors(chunks: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """The table of embeddings, written anew under path: chunk_id, vector and the chunk's other columns, a row for each
    chunk that is there and has a vector. Vectors of chunks that are gone go, and so does what was under path."""
    return stored(chunks.join(vectors.select("chunk_id", "vector"), "chunk_id"), path)


#: Columns of a hit and what stands for a missing one; null stays null.
HIT = {
    "source": ("string", ""), "source_name": ("string", ""), "document_id": ("string", ""), "chunk_id": ("string", ""), "heading": ("string", ""),
    "heading_level": ("int", None), "section_path": ("string", ""), "chunk_index": ("int", 0), "text": ("string", ""),
}
CHILD_HIT = {"parent_index": ("int", 0), "child_index": ("int", 0), "chunk_type": ("string", "child")}


def project_hits(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits (by, score, rank and any columns of a chunk) with all the columns of HIT and CHILD_HIT, typed, and defaults for
    what is missing; parent_text is the text where a child has none. Hits without a parent have null in its columns."""
    def one(name: str, kind: str, default: object) -> Column:
        c = F.col(name).cast(kind) if name in hits.columns else F.lit(None).cast(kind)
        return c if default is None else F.coalesce(c, F.lit(default).cast(kind))

    parent = F.nullif(F.col("parent_id").cast("string"), F.lit("")) if "parent_id" in hits.columns else F.lit(None).cast("string")
    whole = one("parent_text", "string", None)
    child = {n: F.when(parent.isNotNull(), one(n, *v)).alias(n) for n, v in CHILD_HIT.items()}
    return hits.select(
        *by, *[one(n, *v).alias(n) for n, v in HIT.items()], F.col("score").cast("double").alias("score"), "rank", parent.alias("parent_id"), *child.values(),
        F.when(parent.isNotNull(), F.coalesce(whole, one("text", "string", ""))).alias("parent_text"))


def chunk_snapshot(chunks: DataFrame) -> DataFrame:
    """The chunks' columns with what is missing filled in: a chunk without a parent is its own."""
    there = lambda name, default: F.coalesce(F.col(name), default) if name in chunks.columns else default
    return chunks.select(
        "chunk_id", "text", "chunk_index", there("heading", F.lit("")).alias("heading"), there("section_path", F.lit("")).alias("section_path"),
        there("parent_id", F.col("chunk_id")).alias("parent_id"), there("parent_index", F.col("chunk_index")).alias("parent_index"),
        there("child_index", F.lit(0)).alias("child_index"), there("parent_text", F.col("text")).alias("parent_text"), there("chunk_type", F.lit("child")).alias("chunk_type"))


def ingest_counts(documents: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row: how many documents, parents and children there are."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(documents, "documents").crossJoin(one(parents, "parents")).crossJoin(one(children, "children"))


def write_report(summary: DataFrame, cases: DataFrame, path: str) -> None:
    """summary and cases as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    cases.write.mode("overwrite").json(f"{path}/cases")
