"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import gapless_rank, key_hash, materialize


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, with the best score for the key.

    A shard's score is -weight / ln(u), with u in (0, 1) from a hash of key and shard number alone, so a key
    takes each shard with a probability in proportion to its weight, and a further shard takes keys only into
    itself. Null keys count as the empty text. Raises ValueError unless there is a weight and all are positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    scores = [
        F.struct((F.lit(-float(w)) / F.log((key_hash(key, F.lit(j)) + F.lit(0.5)) / F.lit(float(1 << 60)))).alias("score"), F.lit(-j).alias("j"))
        for j, w in enumerate(weights)
    ]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["j"]


def assign_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard by its key alone (law `key`) and number the rows of each shard.

    Returns id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (unsigned; null text: 0), law, shard, slot (from 0
    in each shard, without gaps) and grown_shard (the shard with one more shard of the mean weight). Rows that are
    equal throughout get different slots; a null key is a key like any other; an empty table gives an empty one.
    Other columns, whatever their names, are not looked at. The texts are read once and never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    grown = [*weights, sum(weights) / max(1, len(weights))]
    rows = materialize(
        docs.select(
            key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
            rendezvous_shard(key, weights).cast("int").alias("shard"), rendezvous_shard(key, grown).cast("int").alias("grown_shard"),
            key_hash(key, F.crc32(text)).alias("_hash"),
        ), "shards")
    ranked = gapless_rank(rows, ["shard"], "_hash", ["doc_id", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
