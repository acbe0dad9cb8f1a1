"""Exact canonical fingerprints of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import key_hash, materialize

#: Hashes that are broadcast at most; more of them meet the texts in a shuffled join.
BROADCAST_ROWS = 200_000
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(text: Column) -> Column:
    """The text in compatibility composition (NFKC), case-folded, each run of white space one blank, none at the ends.

    Null is the empty text. ASCII texts are composed as they are, and folding them is lower case. Folding may undo
    composition, so other texts are composed again after it.
    Composition and folding are static methods of the ICU library that Spark ships, called by reflect().
    """
    text = F.coalesce(text, F.lit(""))
    composed = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True)))
    return F.trim(F.regexp_replace(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded), SPACES, " "))


def wide_hash(text: Column, bits: int = 128) -> Column:
    """XXH64 of the text from two seeds, as 32 hex digits. Fewer bits are for tests: they make texts collide."""
    first, second = F.xxhash64(text), F.xxhash64(F.lit("second seed"), text)
    if bits < 64:
        return F.lpad(F.lower(F.hex(F.shiftrightunsigned(first, 64 - bits))), 32, "0")
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def bounded_broadcast(keys: DataFrame) -> DataFrame:
    """The materialized keys, marked for broadcast if they are at most BROADCAST_ROWS."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def resolve_collisions(texts: DataFrame) -> DataFrame:
    """(hash, canonical, variant) of the hashes that different canonical texts share, variants from 0 in text order.

    texts: hash, canonical. Equal buckets are compared byte by byte: grouping by (hash, canonical) compares whole
    texts, with map-side combination, so a text that a third of the rows have moves once a task. Buckets with one
    distinct text, in practice all, give no row.
    """
    distinct = texts.groupBy("hash", "canonical").count().drop("count")
    counts = distinct.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1")
    order = Window.partitionBy("hash").orderBy("canonical")
    return distinct.join(counts, "hash").withColumn("variant", F.row_number().over(order) - 1).drop("_n")


def fingerprint_columns(rows: DataFrame, columns: dict[str, str], keep: list[str], texts: Callable[[DataFrame], DataFrame] | None = None, repeats: tuple[str, ...] = (), bits: int = 128) -> DataFrame:
    """The columns in `keep` and a fingerprint column for each text column; columns: fingerprint name by text column.

    Fingerprints are equal where the canonical texts are equal, and different elsewhere: a 128-bit hash of the
    canonical text, with a suffix for the second and later texts of a bucket in which byte comparison finds
    several. Only texts whose hash occurs more than once are read for that. They come from rows again, or from
    texts(), which gets the table of hashes (`keep` and a column _hash_X for each text column X) with those rows that
    have a repeated hash, and returns a column `text` that holds all their texts. Text columns in `repeats` hold
    only texts that other columns hold too, and are not compared again. Null texts are empty.
    """
    marked = rows.select(*keep, *[canonical(F.col(c)).alias(f"_text_{c}") for c in columns]).select(
        "*", *[wide_hash(F.col(f"_text_{c}"), bits).alias(f"_hash_{c}") for c in columns])
    hashed = materialize(marked.select(*keep, *[f"_hash_{c}" for c in columns]), "hashes")
    own = [c for c in columns if c not in repeats]
    every = reduce(DataFrame.unionAll, [hashed.select(F.col(f"_hash_{c}").alias("hash")) for c in own])
    repeated = bounded_broadcast(materialize(every.groupBy("hash").count().where("count > 1").select("hash"), "repeated"))
    if texts:
        found = texts(repeated, hashed).select(canonical(F.col("text")).alias("canonical")).withColumn("hash", wide_hash(F.col("canonical"), bits))
    else:
        found = reduce(DataFrame.unionAll, [marked.select(F.col(f"_text_{c}").alias("canonical"), F.col(f"_hash_{c}").alias("hash")) for c in own])
    clashes = materialize(resolve_collisions(found.join(repeated, "hash", "left_semi")), "clashes")
    if not clashes.limit(1).count():
        return hashed.select(*keep, *[F.col(f"_hash_{c}").alias(name) for c, name in columns.items()])
    for c, name in columns.items():
        found = clashes.select(F.col("hash").alias(f"_hash_{c}"), F.col("canonical").alias(f"_text_{c}"), F.col("variant").alias("_variant"))
        suffix = F.when(F.coalesce("_variant", F.lit(0)) > 0, F.concat(F.lit("-"), "_variant")).otherwise("")
        marked = marked.join(found, [f"_hash_{c}", f"_text_{c}"], "left").withColumn(name, F.concat(f"_hash_{c}", suffix)).drop("_variant")
    return marked.select(*keep, *columns.values())


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """doc_id and fingerprint of every row; no shuffle of texts but of those whose hashes are equal."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fingerprint_columns(rows, {"text": "fingerprint"}, ["doc_id"], bits=bits)


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (rounded down) of code points replaced by the first as many of the following one."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128, rows_per_range: int = 4096) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one; see with_next() and edited().

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint. To compare texts of equal
    hashes, originals are read from docs, unmoved, and edited texts are made again from the few texts they need, which
    are told by their MD5: repeated and null ids multiply nothing.
    """
    names = {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"}
    rows = with_next(docs, id_col, text_col, rows_per_range).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})

    def texts(repeated: DataFrame, hashed: DataFrame) -> DataFrame:
        own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        pairs = materialize(hashed.join(repeated, F.col("_hash_edited") == F.col("hash"), "left_semi").select("key", "next_key").distinct(), "pairs")
        keys = bounded_broadcast(materialize(pairs.select("key").union(pairs.select("next_key")).distinct().toDF("_one"), "keys"))
        some = own.withColumn("_key", text_key(F.col("_text"))).join(keys, F.col("_key") == F.col("_one"), "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))
        first = pairs.join(some.toDF("_a", "_first"), F.col("key") == F.col("_a"))
        both = first.join(some.toDF("_b", "_second"), F.col("next_key") == F.col("_b"))
        return own.select(F.col("_text").alias("text")).unionAll(both.select(edited(F.col("_first"), F.col("_second")).alias("text")))

    rows = rows.withColumns({"key": text_key(F.col("text")), "next_key": text_key(F.col("next_text"))})
    marked = fingerprint_columns(rows, names, ["doc_id", "key", "next_key", "n_chars", "edited_sha256"], texts, ("next_text",), bits)
    return marked.drop("key", "next_key")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value; found in two steps of about sqrt(len(bounds)) each."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    listed, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::step]))
    block = F.greatest(F.size(F.filter(coarse, lambda x: x <= value)) - 1, F.lit(0))
    return block * step + F.size(F.filter(F.slice(listed, block * step + 1, step), lambda x: x <= value))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4096, max_ranges: int = 10_000) -> DataFrame:
    """doc_id, text, next_id, next_text of every row: the row with the next smaller id; after the last, the first.

    The ids alone give range bounds: quantiles, one for each rows_per_range rows, or max_ranges bounds of larger
    ranges. Each range is sorted by itself, and its last row meets the next range's first one, of which there is one a
    range; what follows what is found on range numbers alone. Rows of equal ids are in one range and follow each other
    in the order of their texts. Null ids come last, in as many ranges of their texts' hashes as their number takes,
    by text within each. A single row is its own next one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = rows.agg(F.count("doc_id").alias("n"), F.count("*").alias("all")).first()
    ranges = min(max_ranges, max(1, -(-counts["n"] // rows_per_range)))
    bare = max(1, -(-(counts["all"] - counts["n"]) // rows_per_range))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("doc_id", steps, 100 * ranges).alias("b")).first()["b"] if steps else None
    by_hash = -1 - F.floor(key_hash(F.col("text")) / F.lit(float(1 << 60)) * F.lit(bare)).cast("int")
    part = F.when(F.col("doc_id").isNull(), by_hash if bare > 1 else F.lit(-1)).otherwise(_range_number(F.col("doc_id"), sorted(set(bounds or []))))
    placed = rows.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "text")
    follow = placed.select("*", F.lead(F.struct("doc_id", "text")).over(inside).alias("next"))
    first = materialize(placed.groupBy("part").agg(F.max("doc_id").alias("_first")), "firsts")
    heads = (
        placed.withColumnRenamed("part", "_part").join(F.broadcast(first), (F.col("_part") == F.col("part")) & F.col("doc_id").eqNullSafe(F.col("_first")))
        .groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    )
    order = Window.orderBy(F.desc("part"))  # a row a range, without its text
    after = first.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("_part"))
    heads = after.join(heads.select(F.col("part").alias("_part"), F.struct("doc_id", "text").alias("head")), "_part").drop("_part")
    following = F.coalesce("next", "head")
    return follow.join(heads, "part", "left").select("doc_id", "text", following["doc_id"].alias("next_id"), following["text"].alias("next_text"))
