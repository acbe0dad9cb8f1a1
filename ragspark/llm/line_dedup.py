"""Dropping lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.common import materialize, small_batches


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case (bytes methods touch ASCII only)."""
    return line.strip().lower()


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes of XXH3-128 of the line's key; None if the key has fewer than min_chars code points."""
    key = line_key(line)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [{h for x in _lines(t) if (h := line_hash(x, min_chars))} for t in texts]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            both = np.frombuffer(b"".join(h for x in found for h in x), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("bare").take(at), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "bare", "h1", "h2"])

    return run


def _rebuild(min_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("_text").to_pylist(), batch.column("_drop").to_pylist(), strict=True):
                lines = _lines(text)
                gone = set(drop or ())
                left = [x for x in lines if line_hash(x, min_chars) not in gone] if gone else lines
                kept.append(b"\n".join(left).decode() if gone else text or "")
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop the lines whose key is in at least min_docs documents, except in the largest id that holds it.

    Texts are split at line feeds; a key is a line without ASCII white space at its ends and with A-Z in lower
    case, and keys of fewer than min_chars code points are left alone. Returns _row (a struct of all input
    columns, so no name clashes), kept_text (the remaining lines in their order), n_lines and n_dropped (before
    and dropped). A null or empty text is one empty line. Rows of equal ids are one document: a key counts once
    for them and stays or goes in all of them. A row without id counts for no key and loses every shared one; such rows are told by their texts.

    Only 128-bit hashes of distinct lines are shuffled to find the shared keys, first by (hash, id), then with
    map-side combination by hash, so a line that a third of all documents hold is no hot group. The texts move
    once, by id, to meet the list of what they lose.
    """
    small_batches(docs.sparkSession)
    bare = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    pair = docs.select(F.col(id_col).alias("doc_id"), bare.alias("bare"), F.col(text_col).alias("text"))
    kind = pair.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("bare", T.StringType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    distinct = materialize(pair.mapInArrow(_occurrences(min_chars), schema), "lines").distinct()
    shared = (
        distinct.where("doc_id is not null").groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_keep"))
        .where(F.col("_n") >= min_docs).drop("_n")
    )
    lost = (
        distinct.join(shared, ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("_keep")))
        .select(F.col("doc_id").alias("_id"), F.col("bare").alias("_none"), F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))).alias("_h"))
        .groupBy("_id", "_none").agg(F.collect_list("_h").alias("_drop"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), bare.alias("_bare"), F.col(text_col).alias("_text"))
    joined = rows.join(lost, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_bare").eqNullSafe(F.col("_none")), "left").select("_row", "_text", "_drop")
    out = T.StructType([joined.schema["_row"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rebuild(min_chars, out.names), out)
