"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import connected_components, materialize, tiled
from ragspark.llm.simhash import forest

#: Added to squared-distance bounds, far above rounding errors of unit vectors and far below any bound used.
SLACK = 1e-9


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A fixed random rotation, which spreads what a few coordinates hold over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[int]:
    return [dim * i // blocks for i in range(blocks + 1)]


def prefix_bitmaps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, and for k = 0, 1, ... the bitmap of the places of the k least."""
    n, words = len(values), -(-len(values) // 64)
    order = np.argsort(values, kind="stable")
    maps = np.zeros((n + 1, words), np.uint64)
    maps[np.arange(1, n + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
    return values[order], np.bitwise_or.accumulate(maps, axis=0, out=maps)


def range_join(left: np.ndarray, right: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of left and right that differ by at most `reach` in every coordinate.

    For each coordinate the rows of right in reach of a row of left are a range in the order of that coordinate, so
    two prefix bitmaps tell them, 64 rows a word; the ranges of all coordinates are ANDed.
    """
    alive = None
    for d in range(left.shape[1]):
        values, maps = prefix_bitmaps(right[:, d])
        own = maps[np.searchsorted(values, left[:, d] + reach, "right")]
        own ^= maps[np.searchsorted(values, left[:, d] - reach, "left")]
        alive = own if alive is None else np.bitwise_and(alive, own, out=alive)
    i, word = np.nonzero(alive)
    bit = np.unpackbits(alive[i, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, place = np.nonzero(bit)
    return i[cell], word[cell] * 64 + place


def block_candidates(left: np.ndarray, right: np.ndarray, edges: list[int], share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, i, j) of the pairs of rows whose squared distance in a block is at most `share`; a pair may come in several blocks."""
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):  # noqa: B905
        i, j = range_join(left[:, lo:hi], right[:, lo:hi], share**0.5)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            d = left[x, lo:hi] - right[y, lo:hi]
            near = (d * d).sum(axis=1) <= share
            yield b, x[near], y[near]


def _compare(blocks: int, budget: float, least: float, rows: int = 4096):
    """Links within a tile pair of a label: counts and a spanning forest; a pair counts in the first block that holds it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(group["vector"].to_numpy()).astype(np.float64)
        norm = np.sqrt((raw * raw).sum(axis=1))
        turned = raw / norm[:, None] @ rotation(raw.shape[1])
        m = min(blocks, raw.shape[1])
        edges, share = block_edges(raw.shape[1], m), budget / m + SLACK
        node, copies, tile = (group[c].to_numpy() for c in ("node", "copies", "_tile"))
        ti, tj = int(group["_ti"].iloc[0]), int(group["_tj"].iloc[0])
        left, right = np.nonzero(tile == ti)[0], np.nonzero(tile == tj)[0]
        count, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
        for p in range(0, len(left), rows):
            for q in range(p if ti == tj else 0, len(right), rows):
                mine, other = left[p : p + rows], right[q : q + rows]
                for b, i, j in block_candidates(turned[mine], turned[other], edges, share):
                    if ti == tj and p == q:
                        i, j = i[i < j], j[i < j]
                    x, y = mine[i], other[j]
                    link = (raw[x] * raw[y]).sum(axis=1) / (norm[x] * norm[y]) >= least
                    x, y = x[link], y[link]
                    first = np.ones(len(x), bool)
                    for k in range(b):
                        d = turned[x, edges[k] : edges[k + 1]] - turned[y, edges[k] : edges[k + 1]]
                        first &= (d * d).sum(axis=1) > share
                    x, y = x[first], y[first]
                    np.add.at(count, x, copies[y])
                    np.add.at(count, y, copies[x])
                    label = forest(len(raw), x, y, label)
        some = count > 0
        return pd.DataFrame({"node": node[some], "n": count[some], "root": node[label[some]]})

    return run


def embedding_components(vectors: DataFrame, least: float = 0.93, blocks: int = 8, tile: int = 32_768, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Two vectors link if their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least `least`. n_links counts the other vectors linked directly, component_id is the smallest
    id reachable, kept tells whether that is the vector's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Rows of equal ids count as vectors of their own, and their id gets
    one row for each; a null id is never a component_id. Columns other than these three are not looked at. An empty
    table gives an empty one.

    Equal vectors of a label, as told by 128 bits of hash, are one node with a number of copies, so copies cost
    nothing more. Unit vectors link if their squared distance is at most 2 - 2 * least, so in one of the blocks of
    their rotated coordinates it is at most that over the number of blocks. A label's vectors meet in tiles, so a hot
    label is many bounded tasks and a vector moves once for each tile of its label. There each block has a range join
    over all its coordinates, see range_join(), whose pairs are held against the block's budget; what passes is
    verified by the cosine. A pair counts in the first block that holds it, so the union has each pair once and no
    pair leaves the task: only counts and a spanning forest do.
    """
    budget = 2 - 2 * least
    number = lambda x: x.cast("double")
    usable = (
        F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
        & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vector_col, lambda x: number(x) != 0), F.lit(False))
    )
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(usable, F.col(vector_col)).alias("vector"))
    key = ["label", "h1", "h2"]
    rows = kept.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second seed"), "vector").alias("h2"), F.monotonically_increasing_id().alias("row"))
    nodes = materialize(
        rows.where("vector is not null").groupBy(*key).agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector")), "nodes")
    placed = nodes.select("label", F.size("vector").alias("dim"), "node", "copies", "vector")
    dealt = tiled(placed, ["label", "dim"], "node", tile)
    found = materialize(dealt.groupBy("label", "dim", "_ti", "_tj").applyInPandas(_compare(blocks, budget, least), "node long, n long, root long"), "links")
    roots = materialize(connected_components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = (
        nodes.select(*key, F.col("node").alias("_node"), "copies", "least_id").join(links, F.col("_node") == links["node"], "left").drop("node")
        .join(roots, F.col("_node") == roots["node"], "left").drop("node")
        .select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least_id", F.coalesce("component", "_node").alias("root"))
    )
    least_ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_vector = named.join(least_ids, "root").select(*key, "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("vector is not null").select("vec_id", *key).join(by_vector, key).select("vec_id", "n_links", "component_id")
    return linked.unionAll(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
