"""BM25 top-k by dynamic pruning: postings in blocks with bounds, read while they can still reach the k-th score."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.text import words
from ragspark.operators.bm25 import EPSILON, K1, B, corpus_statistics, term_weights
from ragspark.operators.vector import DIGITS, ranked
from ragspark.sources.tables import stored

#: Chunks of a part, chunks of a block, and queries that meet a part in one task, about so many.
PART_ROWS, BLOCK_ROWS, QUERIES = 32_768, 64, 2048
#: From so many parts on, every sixteenth is searched first, for a threshold that the others start from.
WAVES = 32


class BlockIndex(NamedTuple):
    """blocks (part, block, term, nos, tfs, max_tf, min_dl), members (part, block, chunk_ids, dls), terms (term, df, idf)
    and one row of statistics (n, avgdl)."""

    blocks: DataFrame
    members: DataFrame
    terms: DataFrame
    statistics: DataFrame


def build_blocks(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", epsilon: float = EPSILON, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> BlockIndex:
    """The tables, stored under path. Chunks are dealt into parts by the hash of their ids; in a part they are numbered by
    length, so that the chunks of a block are alike in it and a block's largest tf and least length bound its scores
    well, for any mean length. A common term has one row in each block, so it is no hot key. Ids are distinct."""
    parts = max(1, -(-chunks.count() // part_rows))
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    dealt = tokens.select(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), "chunk_id", F.size("tokens").alias("dl"), "tokens")
    order = Window.partitionBy("part").orderBy("dl", "chunk_id")
    numbered = stored(dealt.withColumn("no", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("no") / block_rows).cast("int")), f"{path}/numbered")
    flat = numbered.select("part", "block", "no", "dl", F.explode("tokens").alias("term")).repartition("part", "block", "term")
    counted = flat.groupBy("part", "block", "term", "no", "dl").agg(F.count("*").cast("int").alias("tf"))
    made = counted.groupBy("part", "block", "term").agg(F.array_sort(F.collect_list(F.struct("no", "tf"))).alias("p"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    blocks = stored(made.select("part", "block", "term", F.col("p.no").alias("nos"), F.col("p.tf").alias("tfs"), "max_tf", "min_dl").sortWithinPartitions("term", "part"), f"{path}/blocks")
    members = stored(numbered.groupBy("part", "block").agg(F.array_sort(F.collect_list(F.struct("no", "chunk_id", "dl"))).alias("m")).select("part", "block", F.col("m.chunk_id").alias("chunk_ids"), F.col("m.dl").alias("dls")), f"{path}/members")
    statistics = stored(corpus_statistics(chunks, text_col), f"{path}/statistics")
    df = blocks.select("term", F.size("nos").alias("k")).groupBy("term").agg(F.sum("k").alias("df"))
    return BlockIndex(blocks, members, stored(term_weights(df, statistics, epsilon, counted=True), f"{path}/terms"), statistics)


class Part:
    """The posting blocks of the asked terms in one part, for searches in memory."""

    def __init__(self, blocks: pa.Table, members: pa.Table, avgdl: float, k1: float, b: float):
        members = members.sort_by("block")
        self.ids = members["chunk_ids"].combine_chunks().flatten()
        self.norm = k1 * (1 - b + b * members["dls"].combine_chunks().flatten().to_numpy().astype(np.float64) / avgdl)
        self.k1, sizes = k1, np.diff(members["chunk_ids"].combine_chunks().offsets.to_numpy())
        self.block_of, self.n_blocks = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        place = np.full(int(members["block"].to_numpy().max(initial=-1)) + 1, -1)
        place[members["block"].to_numpy()] = np.arange(len(sizes))
        blocks = blocks.sort_by([("term", "ascending"), ("block", "ascending")])
        self.block = place[blocks["block"].to_numpy()]
        nos = blocks["nos"].combine_chunks()
        self.start, self.nos, self.tfs = nos.offsets.to_numpy(), nos.values.to_numpy(), blocks["tfs"].combine_chunks().values.to_numpy()
        top, least = blocks["max_tf"].to_numpy().astype(np.float64), blocks["min_dl"].to_numpy()
        self.bound = top * (k1 + 1) / (top + k1 * (1 - b + b * least / avgdl))
        self.rows: dict[str, tuple[int, int]] = {}
        for at, term in enumerate(blocks["term"].to_pylist()):
            lo, _ = self.rows.get(term, (at, at))
            self.rows[term] = lo, at + 1

    def search(self, terms: list[str], weights: list[float], k: int, digits: int, floor: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Numbers and rounded scores of the chunks that can be among the k best, the postings scored, and all there are.

        Blocks go by the sum of their bounds, a few first, then ever more, while that reaches the running threshold: the
        k-th score so far, at first the floor. In a block terms go by bound for each posting, rare ones first; a chunk
        enters with one of them only where this and the later terms can still reach the threshold, and leaves as
        soon as what it has and the later bounds don't. Nothing that could tie with the k-th after rounding is left out.
        """
        known = [(t, w) for t, w in zip(terms, weights, strict=True) if t in self.rows]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        slack, spans = 2 * 10.0**-digits, [self.rows[t] for t, _ in known]
        counts = [int(self.start[hi] - self.start[lo]) for lo, hi in spans]
        best = [float(self.bound[lo:hi].max()) * max(w, 0.0) / c for (lo, hi), (_, w), c in zip(spans, known, counts, strict=True)]
        order = sorted(range(len(known)), key=lambda j: -best[j])
        later = np.zeros((len(order) + 1, self.n_blocks))
        for j in reversed(range(len(order))):
            lo, hi = spans[order[j]]
            later[j] = later[j + 1]
            later[j, self.block[lo:hi]] += self.bound[lo:hi] * max(known[order[j]][1], 0.0)
        queue = np.argsort(-later[0], kind="stable")
        score, dead, found, scored = np.zeros(len(self.norm)), np.zeros(len(self.norm), bool), [], 0
        at, step, least, values = 0, 4, floor - slack, np.zeros(0)
        while at < len(queue):
            some = queue[at : at + step]
            at, step = at + step, step * 2
            some = some[later[0, some] >= least]
            if not len(some):
                break
            active, alive = np.zeros(self.n_blocks, bool), np.zeros(len(self.norm), bool)
            active[some] = True
            for j, o in enumerate(order):
                rows = np.arange(*spans[o])
                rows = rows[active[self.block[rows]]]
                if not len(rows):
                    continue
                times = self.start[rows + 1] - self.start[rows]
                where = np.repeat(self.start[rows] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                no = self.nos[where]
                enters = np.repeat(later[j, self.block[rows]] >= least, times)
                keep = (enters | alive[no]) & ~dead[no]
                no, tf = no[keep], self.tfs[where[keep]]
                scored += len(no)
                score[no] += known[o][1] * tf * (self.k1 + 1) / (tf + self.norm[no])
                alive[no] = True
                held = np.nonzero(alive)[0]
                gone = held[score[held] + later[j + 1, self.block_of[held]] < least]
                alive[gone], dead[gone] = False, True
            held = np.nonzero(alive)[0]
            held = held[score[held] >= least]
            found.append(held)
            values = np.concatenate([values, score[held]])
            if len(values) >= k:
                values = np.partition(values, len(values) - k)[len(values) - k :]
                least = max(least, values.min() - slack)
        no = np.concatenate(found) if found else np.zeros(0, np.int64)
        value = np.round(score[no], digits)
        keep = value > 0
        return no[keep], value[keep], scored, sum(counts)


def _searcher(k: int, k1: float, b: float, digits: int, avgdl: float, schema: pa.Schema) -> Callable:
    def run(key: tuple, postings: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in schema.names}
        is_block = postings["term"].is_valid()
        part = Part(postings.filter(is_block), postings.filter(pa.compute.invert(is_block)), avgdl, k1, b)
        own: dict = {}
        for q, term, w, floor in zip(*(asked[c].to_pylist() for c in ("query_id", "term", "weight", "floor")), strict=True):
            own.setdefault(q, ([], [], floor))
            own[q][0].append(term)
            own[q][1].append(w)
        for q, (terms, weights, floor) in own.items():
            no, value, scored, met = part.search(terms, weights, k, digits, floor)
            hits = sorted(zip((-value).tolist(), part.ids.take(pa.array(no)).to_pylist(), strict=True))[:k]
            for score, chunk in [*hits, (None, None)]:  # the last row has the counts
                counts = (scored, met) if chunk is None else (None, None)
                for name, x in zip(schema.names, (q, chunk, None if score is None else -score, *counts), strict=True):
                    out[name].append(x)
        return pa.table(out, schema)

    return run


def _hits(index: BlockIndex, asked: DataFrame, k: int, k1: float, b: float, digits: int, chosen: str, parts: int, blocks: int) -> DataFrame:
    """Hits of the parts that `chosen` selects. asked: (query_id, term, weight, floor)."""
    kinds = asked.schema["query_id"].dataType, index.members.schema["chunk_ids"].dataType.elementType
    avgdl = index.statistics.first().avgdl or 1.0
    dealt = lambda: asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    ids = index.members.schema["chunk_ids"].dataType.simpleString()
    empty = lambda kind: F.lit(None).cast(kind)
    posts = index.blocks.where(chosen).join(dealt().select("term", "group").distinct(), "term").select("part", "group", "block", "term", "nos", "tfs", "max_tf", "min_dl", empty(ids).alias("chunk_ids"), empty("array<int>").alias("dls"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    members = index.members.where(chosen).select("part", groups.alias("group"), "block", empty("string").alias("term"), *(empty("array<int>").alias(c) for c in ("nos", "tfs")), *(empty("int").alias(c) for c in ("max_tf", "min_dl")), "chunk_ids", "dls")
    everywhere = dealt().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(chosen)
    types = [pa.string() if t.simpleString() == "string" else pa.int64() if t.simpleString() == "bigint" else pa.int32() for t in kinds]
    schema = pa.schema([("query_id", types[0]), ("chunk_id", types[1]), ("score", pa.float64()), ("scored", pa.int64()), ("met", pa.int64())])
    said = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double, scored long, met long"
    left, right = posts.union(members).groupBy("part", "group"), everywhere.groupBy("part", "group")
    return left.cogroup(right).applyInArrow(_searcher(k, k1, b, digits, avgdl, schema), said)


def search_blocks(index: BlockIndex, queries: DataFrame, k: int, path: str, query_id: str = "query_id", query_col: str = "query", k1: float = K1, b: float = B, digits: int = DIGITS, waves: int = WAVES, group_queries: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """The rows of bm25.search(), and (query_id, scored, met): the postings that were scored, and those that there are.

    Each part meets the queries in tasks of about group_queries of them, or fewer if there are too few parts for all cores, with the posting blocks of the terms that they ask
    for and nothing else. With `waves` parts or more, every sixteenth part is searched first; its k-th score is the floor
    of the others. Hits are stored under path. Queries without a known term have no row in either table.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(words(F.coalesce(F.col(query_col), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = stored(asked.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), f"{path}/asked")
    parts = (index.members.agg(F.max("part")).first()[0] or 0) + 1
    groups = max(1, -(-asked.select("query_id").distinct().count() // group_queries), -(-asked.sparkSession.sparkContext.defaultParallelism // parts))
    zero = asked.withColumn("floor", F.lit(0.0))
    if parts < waves:
        found = stored(_hits(index, zero, k, k1, b, digits, "true", parts, groups), f"{path}/hits")
    else:
        first = stored(_hits(index, zero, k, k1, b, digits, "part % 16 = 0", parts, groups), f"{path}/first")
        best = ranked(first.where("chunk_id is not null"), k, ["query_id"], [F.desc("score")])
        floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor"))
        raised = asked.join(floors, "query_id", "left").na.fill(0.0, ["floor"])
        found = first.union(stored(_hits(index, raised, k, k1, b, digits, "part % 16 <> 0", parts, groups), f"{path}/second"))
    hits = ranked(found.where("chunk_id is not null").select("query_id", "chunk_id", "score"), k, ["query_id"], [F.desc("score"), "chunk_id"])
    return hits, found.where("chunk_id is null").groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("met").alias("met"))
