"""Embeddings: signed feature hashing, normalisation, and models plugged in as batch functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.text import spaced
from ragspark.operators.models import budgeted, served


#: Rows of the dense matrix that a task holds at once.
ROWS = 1024


def _places(tokens: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token its dimension and sign, from its SHA-256; the different tokens of a batch are hashed once."""
    coded = tokens.dictionary_encode()
    digests = b"".join(hashlib.sha256(t).digest()[:5] for t in coded.dictionary.cast(pa.binary()).to_pylist())
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 5).astype(np.int64)
    own, code = raw[:, :4] @ (1 << np.array([24, 16, 8, 0])) % dimensions, coded.indices.to_numpy()
    return own[code], (1 - 2 * (raw[:, 4] % 2))[code]


def _hashed(docs: DataFrame, ids: tuple[str, ...], text_col: str, dimensions: int, out: Callable[[list[pa.Array], np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """out(ids, matrix of unit rows) of ROWS rows at a time: the signs summed by place in the flat matrix, no loop over rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            dim, sign = _places(lists.flatten(), dimensions)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                here, n = slice(at[lo], at[lo + len(part)]), len(part)
                row = np.repeat(np.arange(n), np.diff(at[lo : lo + n + 1]))
                m = np.bincount(row * dimensions + dim[here], sign[here], n * dimensions).reshape(n, dimensions)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                yield out([part.column(c) for c in ids], m / np.where(norm == 0, 1, norm))

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    tokens = spaced(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("tokens")
    return docs.select(*ids, tokens).mapInArrow(run, f"{kinds}, {schema}")


def hash_embed_sparse(docs: DataFrame, id_col: str, text_col: str, dimensions: int = 384) -> DataFrame:
    """(id, dim, weight): the unit-length sums of the signs by dimension; dimensions that cancel out have no row.

    Texts without tokens give no row. Made within each row, so nothing is shuffled.
    """
    def sparse(ids: list[pa.Array], m: np.ndarray) -> pa.RecordBatch:
        row, dim = np.nonzero(m)
        return pa.RecordBatch.from_arrays([ids[0].take(pa.array(row)), pa.array(dim, pa.int32()), pa.array(m[row, dim])], [id_col, "dim", "weight"])

    return _hashed(docs, (id_col,), text_col, dimensions, sparse, "dim int, weight double")


def hash_embed(docs: DataFrame, id_col: str, text_col: str, dimensions: int = 384, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, vector): the same as a dense array; zeros for a text without tokens. One row in, one row out, with its
    columns in carry."""
    def dense(ids: list[pa.Array], m: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.arange(0, m.size + 1, dimensions), pa.int32())
        return pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(at, pa.array(m.ravel()))], [id_col, *carry, "vector"])

    return _hashed(docs, (id_col, *carry), text_col, dimensions, dense, "vector array<double>")


def l2_normalize(vector: Column) -> Column:
    """The vector at unit length; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def embed_with(docs: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(id, vector) by a model: load() runs once in a worker, see models, and returns embed(texts); order and rows are kept."""
    kind, model = docs.schema[id_col].dataType.simpleString(), served(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = model()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vectors = [v for some in budgeted(texts) for v in embed(texts[some])]
            if len(vectors) != len(pdf):
                raise ValueError("the model returned another number of vectors than it got texts")
            yield pd.DataFrame({id_col: pdf[id_col], "vector": [[float(x) for x in v] for v in vectors]})

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, vector array<double>")
