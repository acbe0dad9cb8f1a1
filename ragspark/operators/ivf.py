"""Approximate vector top-k by an inverted file: k-means cells, residual codes of a byte a dimension, exact last scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.operators.vector import DIGITS, _matrix, ranked
from ragspark.sources.tables import stored

#: Bounds of the model: cells, and vectors that each is fitted on; and rows of a cell that are searched in one task.
MOST_CELLS, FITTED, TILE_ROWS = 4096, 64, 32_768


class InvertedFile(NamedTuple):
    """cells (cell, centroid, rows, tiles; at most MOST_CELLS rows), codes (cell, tile, chunk_id, scale, code), vectors."""

    cells: DataFrame
    codes: DataFrame
    vectors: DataFrame


def _arrow_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()


def _centroids(cells: pa.Table) -> np.ndarray:
    return np.array(cells["centroid"].to_pylist()) if len(cells) else np.zeros((0, 1))


def _means(n_cells: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.chunked_array([b.column("v") for b in batches], pa.list_(pa.float64())).combine_chunks()
        dim = int(np.diff(lists.offsets.to_numpy()).max(initial=0)) if len(lists) else 0
        rows, _ = _matrix(lists, dim) if dim else (np.zeros((0, 0)), None)
        if not len(rows):
            return
        rng = np.random.default_rng(7)
        centre = rows[rng.choice(len(rows), min(n_cells, len(rows)), replace=False)]
        for _ in range(rounds):
            own = np.concatenate([(rows[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
            sums, counts = np.zeros_like(centre), np.bincount(own, minlength=len(centre))
            np.add.at(sums, own, rows)
            norm = np.sqrt((sums * sums).sum(axis=1))
            full = (counts > 0) & (norm > 0)
            centre = np.where(full[:, None], sums / np.where(full, norm, 1)[:, None], centre)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centre), dtype=np.int32)), pa.array(centre.tolist(), pa.list_(pa.float64()))], ["cell", "centroid"])

    return run


def _coded(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for batch in batches:
            rows, place = _matrix(batch.column("v"), centre.shape[1]) if len(batch) and len(centre) else (np.zeros((0, 1)), np.zeros(0, int))
            if not len(rows):
                continue
            own = (rows @ centre.T).argmax(axis=1)
            rest = rows - centre[own]
            scale = np.abs(rest).max(axis=1) / 127
            code = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            ids = batch.column("c").take(pa.array(place)).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), ids, pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "chunk_id", "scale", "code"])

    return run


def build_inverted_file(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", vector_col: str = "vector", cells_per_root: float = 4.0, rounds: int = 10) -> InvertedFile:
    """The index of all chunks' unit vectors, stored under path.

    The cells, cells_per_root times the root of the number of rows and at most MOST_CELLS, are the spherical k-means of at
    most FITTED rows for each, taken by the hash of their ids, in one task; so beyond a million rows cells grow in
    size, not in number. Every row is then put into its nearest cell, with the rest of its vector as one signed byte a
    dimension. Cells of over TILE_ROWS rows are cut into tiles. Vectors that are null, zero, not finite or of another
    length than the fitted ones are in no cell, and so are found by no search.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col(chunk_id).alias("c"), F.col(vector_col).cast("array<double>").alias("v"))
    n = rows.count()
    n_cells = max(1, min(MOST_CELLS, round(cells_per_root * math.sqrt(n))))
    sample = rows.orderBy(F.xxhash64("c"), "c").limit(n_cells * FITTED).select("v").coalesce(1)
    fitted = stored(sample.mapInArrow(_means(n_cells, rounds), "cell int, centroid array<double>"), f"{path}/centroids")
    centre = _centroids(fitted.orderBy("cell").toArrow())
    kind = rows.schema["c"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centre)
    coded = stored(rows.mapInArrow(_coded(shared, _arrow_type(kind)), f"cell int, chunk_id {kind}, scale float, code binary"), f"{path}/coded")
    sizes = coded.groupBy("cell").agg(F.count("*").alias("rows")).withColumn("tiles", F.ceil(F.col("rows") / TILE_ROWS).cast("int"))
    cells = stored(fitted.join(sizes, "cell"), f"{path}/cells")
    codes = coded.join(F.broadcast(cells.select("cell", "tiles")), "cell").withColumn("tile", F.pmod(F.xxhash64("chunk_id"), F.col("tiles")).cast("int"))
    codes = stored(codes.select("cell", "tile", "chunk_id", "scale", "code").repartition("cell", "tile").sortWithinPartitions("cell"), f"{path}/codes")
    return InvertedFile(cells, codes, stored(rows.select(F.col("c").alias("chunk_id"), F.col("v").alias("vector")), f"{path}/vectors"))


def _probes(shared, probe: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centre, rows, tiles = shared.value
        for batch in batches:
            own, place = _matrix(batch.column("v"), centre.shape[1]) if len(batch) and len(centre) else (np.zeros((0, 1)), np.zeros(0, int))
            if not len(own):
                continue
            near = own @ centre.T
            order = np.argsort(-near, axis=1, kind="stable")
            before = np.cumsum(rows[order], axis=1) - rows[order]
            q, j = np.nonzero(before < probe * rows.sum())
            cell = order[q, j]
            times = tiles[cell]
            tile = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            q, cell = np.repeat(q, times), np.repeat(cell, times)
            ids = batch.column("q").take(pa.array(place)).cast(kind)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(q)), pa.array(numbers[cell].astype(np.int32)), pa.array(tile.astype(np.int32)), pa.array(near[q, cell]), pa.array([r.tobytes() for r in own[q].astype(np.float32)], pa.binary()),
            ], ["query_id", "cell", "tile", "base", "unit"])

    return run


def _scan(kinds: tuple[str, str], keep: int) -> Callable:
    types = [_arrow_type(k) for k in kinds]

    def run(key: tuple, asked: pa.Table, codes: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        schema = pa.schema([("query_id", types[0]), ("chunk_id", types[1]), ("near", pa.float64()), ("seen", pa.int64())])
        if len(asked) and len(codes):
            rest = np.frombuffer(b"".join(codes["code"].to_pylist()), np.int8).reshape(len(codes), -1).astype(np.float32) * codes["scale"].to_numpy()[:, None]
            ids = codes["chunk_id"].combine_chunks()
            for at in range(0, len(asked), 256):
                some = asked.slice(at, 256)
                unit = np.frombuffer(b"".join(some["unit"].to_pylist()), np.float32).reshape(len(some), -1)
                near = some["base"].to_numpy()[:, None] + unit @ rest.T
                top = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if len(codes) > keep else np.tile(np.arange(len(codes)), (len(some), 1))
                q = np.repeat(np.arange(len(some)), top.shape[1])
                seen = np.where(np.arange(top.size) % top.shape[1] == 0, len(codes), 0)  # once for each query
                out.append(pa.RecordBatch.from_arrays([some["query_id"].combine_chunks().take(pa.array(q)), ids.take(pa.array(top.ravel())), pa.array(near[q, top.ravel()].astype(np.float64)), pa.array(seen)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def search_inverted_file(index: InvertedFile, queries: DataFrame, k: int, path: str, query_id: str = "query_id", vector_col: str = "vector", probe: float = 0.55, keep: int = 6, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank), and (query_id, seen, scored): codes looked at and pairs scored exactly.

    A query probes its nearest cells until they hold the share `probe` of all rows, meets their codes in tasks by cell, and
    the keep * k best by code are scored exactly on the vectors themselves; equal scores go by the chunk's id. Only
    cells move to the queries' tasks and back; the hits by code are stored under path. The default share is what
    vectors without clusters need for a recall of 0.9; clustered ones need far less.
    """
    spark = queries.sparkSession
    cells = index.cells.orderBy("cell").toArrow()
    shared = spark.sparkContext.broadcast((cells["cell"].to_numpy(), _centroids(cells), cells["rows"].to_numpy(), cells["tiles"].to_numpy()))
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    kinds = asked.schema["q"].dataType.simpleString(), index.codes.schema["chunk_id"].dataType.simpleString()
    probes = asked.mapInArrow(_probes(shared, probe, _arrow_type(kinds[0])), f"query_id {kinds[0]}, cell int, tile int, base double, unit binary")
    scan = _scan(kinds, keep * k)
    near = stored(probes.groupBy("cell", "tile").cogroup(index.codes.groupBy("cell", "tile")).applyInArrow(scan, f"query_id {kinds[0]}, chunk_id {kinds[1]}, near double, seen long"), f"{path}/near")
    best = ranked(near, keep * k, ["query_id"], [F.desc("near"), "chunk_id"]).drop("rank")
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)))
    pairs = best.select("query_id", "chunk_id").join(index.vectors, "chunk_id").join(asked.select(F.col("q").alias("query_id"), "v"), "query_id")
    dot = F.aggregate(F.zip_with(unit(F.col("vector")), unit(F.col("v")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    hits = ranked(pairs.select("query_id", "chunk_id", F.round(dot, digits).alias("score")), k, ["query_id"], [F.desc("score"), "chunk_id"])
    counts = near.groupBy("query_id").agg(F.sum("seen").alias("seen"), F.least(F.count("*"), F.lit(keep * k)).alias("scored"))
    return hits, counts
