"""Aligning the tokens of two tokenizers over the same texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import materialize, small_batches
from ragspark.llm.tokens import Encoder, encoder, share_tokenizer

#: Texts of about so many bytes are aligned at once; one longer text by itself.
CHUNK_BYTES = 1 << 20
#: Up to so many pairs the table of pair counts is sent to all tasks (17 bytes each); beyond it is joined.
SENT_PAIRS, SALTS = 2_000_000, 16
_pairs: dict[tuple[int, int], Pair] = {}


def default_model() -> str:
    """The file of the sentence-piece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value of short the place of the first value in long that is not less.

    Both rise, and long ends with a value no less than any of short. Each search starts at its guess, doubles its step
    until it has passed the value, and halves what lies between: all searches take their steps together.
    """
    low, high = guess.copy(), guess.copy()
    step, right = 1, np.nonzero(long[guess] < short)[0]
    while len(right):
        low[right] = high[right] + 1
        high[right] = np.minimum(high[right] + step, len(long) - 1)
        right = right[long[high[right]] < short[right]]
        step *= 2
    step, left = 1, np.nonzero((low == guess) & (guess > 0) & (long[guess] >= short))[0]
    while len(left):
        below = np.maximum(high[left] - step, 0)
        less = long[below] < short[left]
        low[left] = np.where(less, below + 1, below)
        high[left] = np.where(less, high[left], below)
        left = left[~less & (below > 0)]
        step *= 2
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = long[middle] < short
        low, high = np.where(less & (low < high), middle + 1, low), np.where(less, high, middle)
    return high


def common_ends(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ends that both have, in the lists of a and in those of b put together.

    a, b: for each text the rising ends of its tokens, both with the text's own end last. The list with fewer ends drives
    a galloping search into the other.
    """
    counts = [np.array([len(x) for x in ends], np.int64) for ends in (a, b)]
    shift = np.cumsum([0] + [int(x[-1]) for x in a])
    flat = [np.concatenate([x + s for x, s in zip(ends, shift, strict=False)]) if ends else np.zeros(0, np.int64) for ends in (a, b)]
    less = int(len(flat[1]) < len(flat[0]))
    short, long = flat[less], flat[1 - less]
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = [np.cumsum(c) - c for c in counts]
    own = np.repeat(np.arange(len(a)), counts[less])
    inside = np.arange(len(short)) - starts[less][own]
    at = gallop(short, long, starts[1 - less][own] + inside * counts[1 - less][own] // counts[less][own])
    met = np.nonzero(long[at] == short)[0]
    return (met, at[met]) if less == 0 else (at[met], met)


class Pair:
    """A byte-level tokenizer A and a sentence-piece model B, with the bytes of each of their tokens."""

    def __init__(self, a: Encoder, model: bytes):
        self.a, self.b = a, sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in a.letters.items()} | {chr(b): b for b in range(256) if b not in a.letters}
        vocabulary = a.tokenizer.get_vocab()
        entries = [""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            entries[i] = text
        self.bytes_a = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # An id with the sign after it, by its kind: inside a group or at its end, first all of A, then all of B.
        self.marked = [b"%d%b" % (i, sign) for n, ends in ((len(entries), (b",", b"|")), (len(pieces), (b",", b";"))) for sign in ends for i in range(n)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text in A (with a blank before it) and B; none if they don't spell a blank and the text."""
        out = []
        for text, a, b in zip(texts, self.a.encode([" " + (t or "") for t in texts]), self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            raw = (" " + text).encode() if text else b""
            same = bool(raw) and all(b"".join(map(t.__getitem__, ids)) == raw for t, ids in ((self.bytes_a, a.tolist()), (self.bytes_b, b)))
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return out

    def spelled(self, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """Places in `marked`, group by group: the ids of A, then those of B."""
        end_a, end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        end_a[ia], end_b[ib] = True, True
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], ib + 1])[group_a]] = a + end_a * len(self.size_a)
        out[np.arange(len(b)) + ia[group_b] + 1] = b + 2 * len(self.size_a) + end_b * len(self.size_b)
        return out


def _pair(shared: Broadcast, model: Broadcast) -> Pair:
    """This worker's tokenizers, kept from task to task."""
    key = hash(shared.value), hash(model.value)
    if key not in _pairs:
        _pairs[key] = Pair(encoder(shared, plain=True), model.value)
    return _pairs[key]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about CHUNK_BYTES together."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("_text").cast(pa.large_binary())], np.int64)
    part = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(part)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0] + [len(v) for v in values])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _aligned(shared: Broadcast, model: Broadcast, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, seen = _pair(shared, model), TaskContext.get().partitionId() << 33
        for batch in (part for b in batches for part in _chunks(b)):
            ids = pair.encode(batch.column("_text").to_pylist())
            full = [(a, b) for a, b in ids if len(a)]
            ia, ib = common_ends([np.cumsum(pair.size_a[a]) for a, _ in full], [np.cumsum(pair.size_b[b]) for _, b in full])
            n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
            last = np.cumsum(n_a)
            groups = np.searchsorted(ia, last) - np.searchsorted(ia, last - n_a)
            a, b = (np.concatenate([x[i] for x in ids]) for i in (0, 1))
            cut = np.cumsum(groups)[:-1]
            if not digest:
                spans = [np.split(np.diff(x, prepend=-1), cut) for x in (ia, ib)]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), *(_lists([x[i] for x in ids], pa.int32()) for i in (0, 1)), *(_lists(x, pa.int32()) for x in spans)], ["_row", "a_ids", "b_ids", "a_counts", "b_counts"])
                continue
            flat, stop = pair.spelled(a, b, ia, ib), np.cumsum(n_a + n_b)
            said = [b"".join(map(pair.marked.__getitem__, flat[e - n : e].tolist()))[:-1] for e, n in zip(stop.tolist(), (n_a + n_b).tolist(), strict=True)]
            links = np.split(a[ia] * len(pair.size_b) + b[ib], cut)
            row = np.arange(len(ids)) + seen
            seen += len(ids)
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), pa.array(row), pa.array(n_a), pa.array(n_b), pa.array(groups.astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in said]), _lists(links, pa.int64()),
            ], ["_row", "row", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, model: str) -> tuple[DataFrame, str, Broadcast, Broadcast]:
    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        content = f.read()
    rows = docs.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_text"))
    return rows, rows.schema["_row"].dataType.simpleString(), share_tokenizer(docs.sparkSession, tokenizer), docs.sparkSession.sparkContext.broadcast(content)


def align_documents(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the ids of both tokenizers (a_ids, b_ids), and for each group how many of them it has (a_counts, b_counts).

    A encodes a blank and the text, B the text, to which it adds the blank. A group ends where tokens of both end, so its
    tokens cover the same bytes, and their overlaps lie within it. Texts that are null or empty, or that a tokenizer
    changes, have no tokens. Rows of equal ids are aligned each by itself; nothing is shuffled.
    """
    rows, kind, a, b = _rows(docs, id_col, text_col, tokenizer, model)
    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_counts", "b_counts"))
    return rows.mapInArrow(_aligned(a, b, False), f"_row {kind}, {lists}").withColumnRenamed("_row", "doc_id")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array(links), pa.array(times)], ["link", "n"])
    for batch in batches:
        new, n = np.unique(batch.column("links").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        links, at = np.unique(np.concatenate([links, new]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, n]), minlength=len(links)).astype(np.int64)
        if len(links) > 1 << 20:
            yield out()
            links, times = links[:0], times[:0]
    yield out()


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(link, n, best) of every pair of ids that ends together somewhere: how often, and whether no pair of its B has more.

    A task counts what it reads before anything is shuffled, so a pair that is everywhere is one row a task.
    """
    counts = materialize(aligned.select("links").mapInArrow(_count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.pmod(F.col("link"), F.lit(size_b))
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", of_b).join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def _look_up(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = shared.value
        for batch in batches:
            own = batch.column("links")
            at = np.searchsorted(links, own.flatten().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            totals = [np.zeros(len(own), np.int64) for _ in range(2)]
            for total, value in zip(totals, (best, n), strict=True):
                np.add.at(total, row, value[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, totals)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    return run


def link_statistics(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row, see align_documents().

    A link is an occurrence of an A and a B token that end together; a pair's count is how many links of all documents
    hold it. n_best: links whose pair no other pair of the same B exceeds; count_sum: the counts of all links. Texts are
    encoded once; ids of links are stored in the shared folder, and read for the counts and again for the sums. Up to
    sent_pairs different pairs, counted first, go to the tasks; more are joined, a document's equal links as one row
    and dealt over salts, so that a pair that all documents hold is no hot key. Rows of null or repeated ids stay apart.
    """
    spark = docs.sparkSession
    rows, kind, a, b = _rows(docs, id_col, text_col, tokenizer, model)
    columns = "n_a long, n_b long, n_groups long, groups_sha256 string"
    aligned = materialize(rows.mapInArrow(_aligned(a, b, True), f"_row {kind}, row long, {columns}, links array<long>"), "links", "zstd")
    size_b = sentencepiece.SentencePieceProcessor(model_proto=b.value).get_piece_size()
    pairs = materialize(pair_counts(aligned, size_b), "counts")
    if pairs.count() <= sent_pairs:
        held = pairs.orderBy("link").toArrow()
        shared = spark.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("link", "n", "best")))
        done = aligned.select("_row", "row", *[c.split()[0] for c in columns.split(", ")], "links").mapInArrow(_look_up(shared), f"_row {kind}, row long, {columns}, n_best long, count_sum long")
    else:
        own = aligned.select("row", F.explode("links").alias("link")).groupBy("row", "link").agg(F.count("*").alias("k"))
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["link", "salt"])
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        done = aligned.drop("links").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return done.select(F.col("_row").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
