"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import ASCII_SPACE, key_hash, materialize

HASH_BITS, LEVEL_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row a source: its size, and its target by weight and cap.

    sizes: (source, size), a row a document. The sources, by code point with null last, have the weights in turn,
    repeating. They share the sum of all sizes by weight; none gets more than cap times its size, and what is over
    goes to the others by weight until none is above. In closed form: in the order of cap * size / weight, a first
    run of sources is capped, and the others share the rest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source: the dimension, not the documents
    ranked = by_source.withColumn("weight", F.element_at(listed, (F.row_number().over(order) - 1) % len(weights) + 1))
    most = F.col("source_size") * F.lit(float(cap))
    up = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last())
    below, all_rows = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    shared = (
        ranked.withColumn("_most", most)
        .withColumn("_rest", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_most").over(below), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.col("_weights"))
        .withColumn("_free", F.col("_most") / F.col("weight") >= F.col("_level"))
        .withColumn("_level", F.min(F.when(F.col("_free"), F.struct((F.col("_most") / F.col("weight")).alias("x"), F.col("_level").alias("level")))).over(all_rows)["level"])
    )
    target = F.least(F.col("_most"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_most")))
    return shared.select("source", "weight", "source_size", target.alias("target"))


def _level(rows: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """Of each source the boundary bucket at this level: the first whose running sum passes what is left."""
    part = F.shiftrightunsigned(F.col("hash"), HASH_BITS - LEVEL_BITS * (level + 1))
    running = Window.partitionBy("source").orderBy("_part")
    return (
        rows.groupBy("source", part.alias("_part")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_docs"), F.min("hash").alias("_low"), F.max("hash").alias("_high"))
        .withColumn("_to", F.sum("_sum").over(running))
        .join(bounds.select(F.col("source").alias("_source"), "rest", "base"), F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("base") + F.col("_to") > F.col("rest"))
        .groupBy("source", "rest").agg(F.min_by(F.struct("_part", "_sum", "_low", "_high", (F.col("base") + F.col("_to") - F.col("_sum")).alias("_from")), "_part").alias("b"))
        .select("source", "rest", F.col("b._from").alias("base"), F.col("b._part").alias("part"), F.col("b._sum").alias("sum"), F.col("b._low").alias("low"), F.col("b._high").alias("high"))
    )


def mix_plan(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """_source, source_size, target, whole and threshold: documents are taken `whole` times, and once more below threshold.

    sized: materialized (doc_id, source, size, hash). Histograms of sizes by source and hash bucket: the running sums
    give a boundary bucket, and only the documents in it are summed again by the next LEVEL_BITS of the hash, until
    it holds one hash. Nothing is sorted. The documents of that hash are taken if that comes nearer to the target.
    """
    targets = source_targets(sized.select("source", "size"), weights, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = materialize(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    bounds = targets.select("source", "rest", F.lit(0).cast("long").alias("base"))
    rows, done = sized, []
    for level in range(HASH_BITS // LEVEL_BITS):
        bounds = materialize(_level(rows, bounds, level), "bounds")
        done.append(bounds.where("low = high"))
        if not bounds.where("low < high").limit(1).count():
            break
        open_ = bounds.where("low < high").select(F.col("source").alias("_source"), "part")
        part = F.shiftrightunsigned(F.col("hash"), HASH_BITS - LEVEL_BITS * (level + 1))
        rows = materialize(rows.join(open_, F.col("source").eqNullSafe(F.col("_source")) & (part == F.col("part"))).select("source", "size", "hash"), "boundary")
        bounds = bounds.where("low < high")
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    nearer = F.col("base") + F.col("sum") - F.col("rest") < F.col("rest") - F.col("base")
    ends = ends.select(F.col("source").alias("_source"), (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    none = F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))  # all documents together stay below the target
    return targets.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "whole", F.coalesce("threshold", none).alias("threshold"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key_hash(F.col(id_col)).alias("hash")), "sizes")


def _copies(hash_: Column) -> Column:
    return (F.col("whole") + F.when(hash_ < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often the mix takes each document, so that each source comes near its target.

    Returns doc_id, source, size (words), source_size, target, copies (0 to ceil(cap)) and taken (copies * size); see
    source_targets() and mix_plan(). A document's hash depends on its id alone, so reruns agree and rows of equal
    ids go together. Null texts have no words, null sources are a source, an empty table gives an empty one.
    """
    sized = _sized(docs, id_col, source_col, text_col)
    return (
        sized.join(mix_plan(sized, weights, cap), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target", _copies(F.col("hash")).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def take_mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, each as often as mix_sources() takes it.

    The texts meet the plan, a row a source, in a join that Spark broadcasts if it is small, and else splits where a
    source is hot; they are read twice.
    """
    plan = mix_plan(_sized(docs, id_col, source_col, text_col), weights, cap)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source_col).cast("string").alias("_of"), key_hash(F.col(id_col)).alias("_hash"))
    taken = rows.join(plan, F.col("_of").eqNullSafe(F.col("_source"))).withColumn("_copies", _copies(F.col("_hash"))).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
