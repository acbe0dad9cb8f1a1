"""Near-duplicates by SimHash fingerprints and a bit-sliced Hamming join."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import connected_components, discard, materialize, small_batches, tiled

SEED = 42
#: Planes between two looks for dead cells, and query fingerprints compared at once.
STRIDE, QUERIES = 8, 128


def fingerprint(text: str | None, width: int = 3, bits: int = 64, chunk: int = 1 << 15) -> bytes:
    """The SimHash of the text's word shingles, big-endian; all bits 0 without words.

    Words are runs of anything but ASCII white space after A-Z are lowered; fewer than `width` words are one
    shingle. A bit is 1 if it is set in over half of the shingles' hashes, repeats included: XXH64 for 64 bits,
    XXH3-128 from as many seeds as needed for a multiple of 128.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(bits // 8)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[len(words) - n :] - 1).tolist()
    ones = np.zeros(bits, np.int64)
    for at in range(0, n, chunk):
        shingles = [joined[a:b] for a, b in zip(starts[at : at + chunk], stops[at : at + chunk], strict=True)]
        if bits == 64:
            hashes = [xxhash.xxh64_digest(s, SEED) for s in shingles]
        else:
            hashes = [xxhash.xxh3_128_digest(s, seed) for s in shingles for seed in range(SEED, SEED + bits // 128)]
        ones += np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def shingle_set(text: str | None, width: int) -> set[bytes]:
    """The distinct word shingles of fingerprint()'s words; none without words."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def set_fingerprint(shingles: set[bytes], bits: int = 256, chunk: int = 1 << 15) -> tuple[bytes, bytes]:
    """The SimHash of a set of shingles by XXH3-128, and a sum of their hashes that stands for the set."""
    ones, total, some = np.zeros(bits, np.int64), np.zeros(2, np.uint64), list(shingles)
    for at in range(0, len(some), chunk):
        hashes = b"".join([xxhash.xxh3_128_digest(s, seed) for s in some[at : at + chunk] for seed in range(SEED, SEED + bits // 128)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
        total += np.frombuffer(hashes, np.uint64).reshape(-1, bits // 64)[:, :2].sum(axis=0, dtype=np.uint64)
    return np.packbits(2 * ones > len(some)).tobytes(), total.tobytes()


def unpacked(prints: Sequence[bytes]) -> np.ndarray:
    """A row of bits for each fingerprint."""
    return np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1)


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints, 64 of them a word; the last word is padded with zeros."""
    padded = np.pad(bits, ((0, -len(bits) % 64), (0, 0)))
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, value) of rows of bits that differ in at most `radius` places.

    The planes are XORed with the queries' bits one after the other, and the differences go into carry-save
    counters: one word of counter bits for 64 values. The counters start at 2^k - 1 - radius, so the carry out
    of the top one marks distances over the radius. Cells of 64 values that are all marked are left out of
    the further planes.
    """
    planes, k = bit_planes(values), max(1, radius.bit_length())
    full, words = ~np.uint64(0), planes.shape[1]
    valid = np.full(words, full)
    if len(values) % 64:
        valid[-1] = np.uint64((1 << len(values) % 64) - 1)
    start = (1 << k) - 1 - radius
    for at in range(0, len(queries), QUERIES):
        flips = np.where(queries[at : at + QUERIES].T > 0, full, np.uint64(0))
        n = flips.shape[1]
        q, w = np.repeat(np.arange(n), words), np.tile(np.arange(words), n)
        over = ~valid[w]
        counters = [np.full(len(q), full if start >> i & 1 else np.uint64(0)) for i in range(k)]
        for plane in range(len(planes)):
            carry = planes[plane][w] ^ flips[plane][q]
            for i in range(k):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            if plane % STRIDE == STRIDE - 1:
                alive = over != full
                if not alive.all():
                    q, w, over, counters = q[alive], w[alive], over[alive], [c[alive] for c in counters]
                    if not len(q):
                        break
        if len(q):
            hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, bit = np.nonzero(hits)
            yield at + q[cell], w[cell] * 64 + bit


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels (least index reachable) of n nodes with links (a[i], b[i]), joined to earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def exact_bands(bits: int, radius: int, n: int) -> list[list[int]]:
    """Bit positions such that fingerprints which differ in at most radius bits agree in all of one band.

    Of k blocks of bits such a pair agrees in k - radius at least, so a band is one choice of as many blocks, of which
    the leading bits count: more for more fingerprints, so that a bucket stays near 1024 of them. There are no more
    blocks than that takes: radius + 1 up to some ten million fingerprints, and more, in longer bands, beyond.
    """
    need, blocks = max(1, (n // 1024).bit_length()), radius + 1
    while need > bits // blocks * (blocks - radius) and 2 * blocks < bits:
        blocks += 1
    width, agree = bits // blocks, blocks - radius
    lead = min(width, -(-need // agree))
    return [[width * i + j for i in chosen for j in range(lead)] for chosen in combinations(range(blocks), agree)]


def likely_bands(bits: int, share: float, n: int, recall: float, seed: int = 11) -> list[list[int]]:
    """Random bit positions such that a pair which differs in that share of all bits agrees in a band, with that chance.

    A band has more bits for more fingerprints, so that a bucket stays near 512 of them as long as 24 bits allow it,
    and there are more bands for longer ones.
    """
    width = min(24, max(4, (n // 512).bit_length()))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** width))
    rng = np.random.default_rng(seed)
    return [rng.choice(bits, width, replace=False).tolist() for _ in range(count)]


def threshold_bands(bits: int, share: float, radius: int, n: int, recall: float, seed: int = 11) -> list[list[int]]:
    """As likely_bands(), for a pair each of whose bits differs with the chance `share`: it agrees in a band and differs
    in at most radius bits, with that chance over its binomial distance."""
    width = min(24, max(4, (n // 512).bit_length()))
    d = np.arange(radius + 1)
    law = np.array([math.comb(bits, int(i)) * share**i * (1 - share) ** (bits - i) for i in d])
    if law.sum() <= recall:
        raise ValueError("the radius is too small for that recall")
    miss, count = 1 - (1 - d / bits) ** width, 1
    while (law * (1 - miss**count)).sum() < recall:
        count += 1
    rng = np.random.default_rng(seed)
    return [rng.choice(bits, width, replace=False).tolist() for _ in range(count)]


def _keys(bands: list[list[int]]):
    weight = [1 << np.arange(len(b), dtype=np.int64) for b in bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bits = unpacked(batch.column("fp").to_pylist())
            for i, band in enumerate(bands):
                key = bits[:, band].astype(np.int64) @ weight[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), i, np.int32)), pa.array(key), batch.column("node"), batch.column("fp")], ["band", "key", "node", "fp"])

    return run


def _links(radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits, tile, node = unpacked(group["fp"].tolist()), group["_tile"].to_numpy(), group["node"].to_numpy()
        left, right = np.nonzero(tile == group["_ti"].iloc[0])[0], np.nonzero(tile == group["_tj"].iloc[0])[0]
        label = np.arange(len(bits))
        for q, v in within(bits[left], bits[right], radius):
            label = forest(len(bits), left[q], right[v], label)
        joined = label != np.arange(len(bits))
        return pd.DataFrame({"a": node[joined], "b": node[label[joined]]})

    return run


def hamming_links(prints: DataFrame, bands: list[list[int]], radius: int, tile: int = 4096) -> DataFrame:
    """Links (a, b) that join the nodes which chains of Hamming distances up to radius join within a bucket.

    prints: node (long) and fp, distinct fingerprints. Fingerprints with equal bits in a band are a bucket. Its values
    meet bit-sliced, a pair of tiles a task if it is large. A task returns a spanning forest of the links it found,
    at most a row for each value it has read.
    """
    keyed = prints.select("node", "fp").mapInArrow(_keys(bands), "band int, key long, node long, fp binary")
    pairs = tiled(keyed, ["band", "key"], "node", tile)
    return pairs.groupBy("band", "key", "_ti", "_tj").applyInPandas(_links(radius), "a long, b long")


def _prints(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width, bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return run


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 64, radius: int = 3, recall: float | None = None) -> DataFrame:
    """doc_id, fingerprint (hex digits) and component_id of every row.

    component_id is the smallest id reachable over fingerprints that differ in at most radius bits (equal ones
    included). The search is exact by exact_bands() if recall is None, which suits a small radius; for a large one,
    likely_bands() find a pair at the radius with that chance at least, and nearer pairs more surely.
    Null and empty texts have fingerprint zero and link like others. Rows without id take part, are returned, and
    are never a component_id, which is null if a component has no id. Equal fingerprints are one value in the
    search, so copies cost nothing more. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(pair.mapInArrow(_prints(width, bits), "doc_id long, fp binary"), "prints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    bands = exact_bands(bits, radius, n) if recall is None else likely_bands(bits, radius / bits, n, recall)
    links = materialize(hamming_links(distinct, bands, radius).distinct(), "links")
    roots = materialize(connected_components(links), "roots").withColumnRenamed("node", "_node")
    named = distinct.join(roots, distinct["node"] == roots["_node"], "left").select("fp", "least", F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.select(F.col("fp").alias("_fp"), "root").join(least, "root").select("_fp", "component_id")
    return marked.join(by_print, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _set_prints(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_fingerprint(shingle_set(t, width), bits) for t in batch.column("text").to_pylist()]
            made = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made], ["doc_id", "hash", "fp", "sum"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in shingle_set(t, width)], np.uint64).view(np.int64)) for t in batch.column("text").to_pylist()]
            sizes = pa.array([len(x) for x in found], pa.int64())
            lists = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), sizes, lists], ["group", "node", "size", "shingles"])

    return run


def _verified(similarity: float):
    """Links between the guests and the hosts of a tile, or among the hosts if there are no guests: a spanning forest of
    the pairs of unlike labels that are similar enough, by counts over an inverted index of the hosts' shingles."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        node, guest, size = table["node"].to_numpy(), table["guest"].to_numpy(bool), table["size"].to_numpy()
        code = np.unique(np.concatenate(table["shingles"].tolist()), return_inverse=True)[1]
        ends, owner, host = np.cumsum(size), np.repeat(np.arange(len(node)), size), np.nonzero(~guest)[0]
        mine = ~guest[owner]
        order = np.argsort(code[mine], kind="stable")
        holder, first = owner[mine][order], np.searchsorted(code[mine][order], np.arange(len(code) + 2))
        label = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        a, b = [], []
        for x in np.nonzero(guest)[0] if guest.any() else host:
            other = label[host] != label[x]
            if not other.any():
                continue
            own = code[ends[x] - size[x] : ends[x]]
            n = first[own + 1] - first[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holder[at], minlength=len(node))[host]
            hits = host[other & (common / np.maximum(1, size[x] + size[host] - common) >= similarity)]
            met, place = np.unique(label[hits], return_index=True)
            a += [node[x]] * len(met)
            b += node[hits[place]].tolist()
            label[np.isin(label, met)] = label[x]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def jaccard_links(sets: DataFrame, similarity: float, tile: int = 1024, tile_shingles: int = 4_000_000) -> DataFrame:
    """Links (a, b) that join what chains of pairs of one group join whose Jaccard similarity is at least that.

    sets: group, node, size, shingles (hashes of the distinct shingles), materialized. Groups are dealt into tiles of
    about `tile` nodes and tile_shingles hashes, and the nodes of each tile are compared with one another. In groups of
    several tiles that this has not joined, every node outside the group's largest class then visits all tiles,
    where it meets the nodes of other classes. So a group of copies moves twice, not once for each pair of tiles.
    """
    tiles = sets.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / tile_shingles)).cast("int").alias("_tiles")).where("_tiles > 1")
    n = F.coalesce(F.col("_tiles"), F.lit(1))
    placed = sets.join(tiles, "group", "left").withColumn("_tile", F.pmod(F.xxhash64("node"), n).cast("int"))
    inside = placed.withColumns({"guest": F.lit(False), "label": F.col("node")})
    columns = ["group", "_tile", "node", "size", "guest", "label", "shingles"]
    links = materialize(inside.select(columns).groupBy("group", "_tile").applyInPandas(_verified(similarity), "a long, b long"), "links")
    if tiles.isEmpty():
        return links
    wide = placed.where("_tiles > 1")
    classes = connected_components(links).withColumnRenamed("node", "_node")
    labelled = materialize(wide.join(classes, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("component", "node")).drop("_node", "component"), "classes")
    largest = (
        labelled.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("_major"), F.count("*").alias("_classes"))
        .where("_classes > 1").drop("_classes")
    )
    open_ = labelled.join(largest, "group").withColumn("guest", F.lit(False))
    guests = open_.where(F.col("label") != F.col("_major")).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumn("guest", F.lit(True))
    across = open_.select(columns).unionByName(guests.select(columns)).groupBy("group", "_tile").applyInPandas(_verified(similarity), "a long, b long")
    return materialize(links.unionAll(across), "links")


def jaccard_components(docs: DataFrame, text_col: str, distinct: DataFrame, width: int, similarity: float, bits: int, recall: float) -> DataFrame:
    """distinct (node, fp, hash: MD5 of a text of docs) with root: the component over pairs that are `similarity` alike.

    The bit-sliced join of the fingerprints finds candidates: pairs up to three standard deviations over the distance to
    expect at that similarity. Chains of them make groups, and only within a group are the sets of shingles compared,
    by the counts of their 64-bit hashes. Texts outside groups, in practice most, are not read again.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(share * bits + 3 * math.sqrt(bits * share * (1 - share)))
    bands = threshold_bands(bits, share, radius, distinct.count(), recall)
    near = materialize(hamming_links(distinct, bands, radius).distinct(), "near")
    groups = materialize(connected_components(near).withColumnRenamed("component", "group"), "groups")
    wanted = materialize(groups.join(distinct.select("node", "hash"), "node"), "wanted")
    texts = docs.select(text_hash(text_col).alias("hash"), F.col(text_col).alias("text")).join(wanted, "hash").dropDuplicates(["node"]).select("group", "node", "text")
    sets = materialize(texts.mapInArrow(_sets(width), "group long, node long, size long, shingles array<long>"), "sets")
    links = jaccard_links(sets, similarity)
    roots = materialize(connected_components(links), "roots").withColumnRenamed("node", "_node")
    for done in (near, groups, wanted, sets, links):
        discard(done)
    return distinct.join(roots, distinct["node"] == roots["_node"], "left").withColumn("root", F.coalesce("component", "node")).drop("_node", "component")


def text_hash(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bits: int = 256, recall: float = 0.99) -> DataFrame:
    """The rows of docs, all columns as they are, of which one document of each group of near-duplicates stays.

    A group are the texts that chains of pairs join whose sets of shingles are `similarity` alike by Jaccard at
    least, as counted on the whole texts. `recall` is the chance that the search by fingerprints meets a pair at the
    very threshold. Texts without words are alike. The row with the least (id, MD5 of the text) of a group stays, one
    without id only if no row of its group has one. Ids don't join texts: rows with the same id or none stay if
    they are in different groups.
    """
    small_batches(docs.sparkSession)
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    marked = materialize(some.mapInArrow(_set_prints(width, bits), "doc_id long, hash binary, fp binary, sum binary"), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "hash")
    distinct = materialize(marked.groupBy("fp", "sum").agg(F.min(place).alias("least"), F.min("hash").alias("hash")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = jaccard_components(docs, text_col, distinct, width, similarity, bits, recall)
    stay = found.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_stay"), F.col("least.hash").alias("_kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_doc"), text_hash(text_col).alias("_hash"))
    mine = (F.col("_hash") == F.col("_kept")) & F.col("_doc").eqNullSafe(F.col("_stay"))
    return rows.join(stay, mine, "left_semi").dropDuplicates(["_doc", "_hash"]).select("_row.*")
