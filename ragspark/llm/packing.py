"""Packing documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import gapless_rank, key_hash, materialize, small_batches
from ragspark.llm.tokens import encoder, share_tokenizer

#: Up to 1 / SHARE of the capacity a piece is small; the larger ones are rounded in so many groups.
SHARE, GROUPS = 3, 512
Run = tuple[list[int], int]  # the lengths in a sequence, and how many sequences have them


def _worthiest(s: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of sizes s worth most, and its worth: a knapsack over the room that is left.

    With one more item a step, the first of which is a running maximum; the last needs the whole capacity only.
    """
    most, n = capacity // int(s.min()), len(s)
    best, taken = np.zeros(capacity + 1), []
    for step in range(most):
        rooms = np.array([capacity]) if step == most - 1 else np.arange(capacity + 1)
        if step == 0 and most > 1:
            at = np.full(capacity + 1, -1)
            order = np.argsort(s, kind="stable")
            top = np.maximum.accumulate(price[order])
            held = np.searchsorted(s[order], rooms, "right") - 1
            first = order[np.maximum.accumulate(np.where(price[order] >= top, np.arange(n), 0))]
            some = held >= 0
            value = np.where(some, top[np.maximum(held, 0)], 0.0)
            at[some] = first[held[some]]
            at[value <= 0] = -1
        else:
            left = rooms[:, None] - s[None, :]
            worth = np.where(left >= 0, best[np.maximum(left, 0)] + price[None, :], -1.0)
            item = worth.argmax(axis=1)
            value = worth[np.arange(len(rooms)), item]
            at = np.where(value > best[rooms] + 1e-12, item, -1)
            value = np.maximum(value, best[rooms])
        taken.append(at if len(rooms) > 1 else {capacity: at[0]})
        if len(rooms) > 1:
            best = np.maximum(best, value)
    column, room = np.zeros(n), capacity
    for at in reversed(taken):
        if at[room] >= 0:
            column[at[room]] += 1
            room -= int(s[at[room]])
    return float((column * price).sum()), column


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots, in vector operations alone.

    The plan is made on the driver, where a BLAS whose threads were lost when the JVM was forked never returns; so
    nothing here calls it, neither for this nor for products.
    """
    n = len(basis)
    both = np.hstack([basis.astype(float), np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        if pivot != i:
            both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        rows = np.nonzero(both[:, i])[0]
        rows = rows[rows != i]
        both[rows] -= both[rows, i, None] * both[i]
    return both[:, n:]


def best_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (copies of each size in a sequence) and how often to use each, together at most the demand.

    The linear program over all configurations, by column generation: the duals price sizes, a knapsack over them
    finds the configuration worth most, and it enters the basis while it is worth more than a sequence. The
    solution has at most one configuration for each size and is rounded down. The simplex steps end after 50 for
    each size at the latest, far more than were ever seen; what a program that is not at its best leaves is packed
    by the next grouping or best fit, so nothing is lost.
    """
    s, d = np.array(sizes), np.array(demand, float)
    n = len(s)
    basis = np.diag(capacity // s).astype(float)
    inverse, x = np.diag(1 / (capacity // s)), d * (1 / (capacity // s))
    for step in range(50 * n):
        if step % 64 == 63:
            inverse = inverse_of(basis)
            x = (inverse * d).sum(axis=1)
        worth, column = _worthiest(s, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        change = (inverse * column).sum(axis=1)
        ratio = np.full(n, np.inf)
        ratio[change > 1e-9] = np.maximum(x[change > 1e-9], 0) / change[change > 1e-9]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse -= change[:, None] * row
        inverse[out] = row
        x = x - change * ratio[out]
        x[out] = ratio[out]
    x = (inverse_of(basis) * d).sum(axis=1)
    return [(basis[:, j].astype(int), int(np.floor(x[j] + 1e-9))) for j in range(n) if x[j] >= 1 - 1e-9]


class Bins:
    """Runs of equal sequences by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.open = capacity, defaultdict(list), np.zeros(capacity + 1, bool)

    def add(self, lengths: list[int], copies: int) -> None:
        if copies:
            room = self.capacity - sum(lengths)
            self.runs[room].append((lengths, copies))
            self.open[room] = True

    def place(self, length: int, count: int) -> None:
        """Best fit: each piece goes where least room is left that holds it; a new sequence if there is none."""
        while count:
            rooms = np.nonzero(self.open[length:])[0]
            if not len(rooms):
                each = self.capacity // length
                self.add([length] * each, count // each)
                self.add([length] * (count % each), 1 if count % each else 0)
                return
            room = length + int(rooms[0])
            lengths, copies = self.runs[room].pop()
            self.open[room] = bool(self.runs[room])
            each = room // length
            full = min(copies, count // each)
            if full:
                self.add(lengths + [length] * each, full)
            else:
                full, each = 1, count
                self.add(lengths + [length] * each, 1)
            self.add(lengths, copies - full)
            count -= full * each


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = GROUPS, share: int = SHARE) -> list[Run]:
    """Runs of sequences that hold counts[length] pieces of each length (1 to capacity).

    Linear grouping, see grouped_sequences(), packs the pieces longer than capacity / share. What is left of them is
    grouped again, ever more finely as it shrinks, until no whole configuration comes out; that rest, and then the
    small pieces, go in by best fit, longest first. All of it works on runs of equal lengths, so its cost depends on
    the capacity, not on the number of pieces.
    """
    bins = Bins(capacity)
    bins.add([capacity], counts.get(capacity, 0))
    rest = {n: c for n, c in counts.items() if capacity // share < n < capacity and c}
    while rest:
        runs, after = grouped_sequences(rest, capacity, groups)
        for lengths, copies in runs:
            bins.add(lengths, copies)
        if not runs:
            break
        rest = after
    for n, c in counts.items():
        if n <= capacity // share and n < capacity:
            rest[n] = c
    for n in sorted(rest, reverse=True):
        bins.place(n, rest[n])
    return [run for room in sorted(bins.runs) for run in bins.runs[room]]


def grouped_sequences(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[Run], dict[int, int]]:
    """Sequences of the pieces in counts by linear grouping, and the pieces that they leave.

    The pieces are sorted by length and cut into groups of equal numbers, and each is rounded up to its group's
    longest. best_configurations() packs the few rounded lengths; the actual pieces of a group then take its places,
    longest first, so that nothing overflows.
    """
    total = sum(counts.values())
    k = min(groups, total)
    edges = deque(total * (i + 1) // k for i in range(k))
    parts, at = [deque()], 0
    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            part = min(c, edges[0] - at)
            parts[-1].append([n, part])
            at, c = at + part, c - part
            if at == edges[0] and len(edges) > 1:
                edges.popleft()
                parts.append(deque())
    merged: dict[int, deque] = defaultdict(deque)  # groups that are rounded to the same length are one
    for g in parts:
        merged[g[0][0]].extend(g)
    sizes = sorted(merged, reverse=True)
    left, out = [merged[n] for n in sizes], []
    for column, copies in best_configurations(sizes, [sum(c for _, c in g) for g in left], capacity):
        slots = [g for g in np.nonzero(column)[0] for _ in range(column[g])]
        free = [sum(c for _, c in left[g]) // column[g] for g in set(slots)]
        copies = min([copies, *free])
        filled = []
        for g in slots:
            need, runs = copies, []
            while need:
                part = min(need, left[g][0][1])
                runs.append((left[g][0][0], part))
                need -= part
                left[g][0][1] -= part
                if not left[g][0][1]:
                    left[g].popleft()
            filled.append(runs)
        start = 0
        for cut in sorted({e for runs in filled for e in np.cumsum([c for _, c in runs]).tolist()}):
            out.append(([_at(runs, start) for runs in filled], cut - start))
            start = cut
    rest: dict[int, int] = defaultdict(int)
    for g in left:
        for n, c in g:
            rest[n] += c
    return out, dict(rest)


def _at(runs: list[tuple[int, int]], place: int) -> int:
    for n, c in runs:
        if place < c:
            return n
        place -= c
    raise IndexError(place)


def places(plan: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the ranks from which each place of the plan holds, the sequence of the first rank, and the offset."""
    found, ranks, base = defaultdict(list), defaultdict(int), 0
    for lengths, copies in plan:
        offset = 0
        for n in lengths:
            found[n].append((ranks[n], base, offset))
            ranks[n] += copies
            offset += n
        base += copies
    return {n: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for n, v in found.items()}


def _cut(shared, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids = np.append(ids.astype("<u4"), np.array([end_id], "<u4"))
                first = len(ids) % capacity or capacity
                stops = range(first, len(ids) + 1, capacity)
                for i, stop in enumerate(stops):
                    start = stop - (capacity if i else first)
                    out.append((doc, i, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _assign(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.nonzero(length == n)[0]
                starts, bases, offsets = table[int(n)]
                k = np.searchsorted(starts, rank[own], "right") - 1
                sequence[own], offset[own] = bases[k] + rank[own] - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A document's tokens are its whole text's ids and end_id; one with more than `capacity` is cut into pieces of
    that many, of which the first may be shorter. Null and empty texts have the end id only. Rows of equal ids
    are packed each by itself; an empty table gives an empty one.

    Only the histogram of piece lengths, at most `capacity` rows, goes to the driver. The plan it makes names runs of
    sequences, at most some thousands, whatever the number of pieces; a piece finds its place by its length and its
    rank among the pieces of that length, which is counted in hash buckets, so a common length is no hot group.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = share_tokenizer(spark, tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(rows.mapInArrow(_cut(shared, end_id, capacity), schema), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = places(plan_sequences(counts, capacity))
    hashed = pieces.withColumn("_hash", key_hash(F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    ranked = gapless_rank(hashed, ["length"], "_hash", ["doc_id", "piece"], "_rank")
    wanted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return wanted.mapInArrow(_assign(table), schema + ", sequence_id long, offset long")
