"""Grouping spelling variants: words of a corpus that are one inserted, deleted or replaced letter apart."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import materialize, small_batches

#: Words a task counts before it passes them on, and words of an index at most.
HELD, INDEXED = 400_000, 50_000
PREFIX, SUFFIX = 0, 1


def _count(least: int, every: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                found = runs.findall((text or "").encode().lower().decode())  # bytes: only A-Z change
                total.update(found)
                start = zlib.crc32(f"{name}:".encode())
                for word in set(found) if every else ():
                    if (h := zlib.crc32(word.encode(), start)) % every == 0:
                        k, at = found.count(word), h % len(word)
                        total[word] -= k
                        total[word[:at] + word[at + 1 :]] += k
            if len(total) > HELD:
                yield out(total)
                total = Counter()
        yield out(total)

    return run


def word_counts(docs: DataFrame, least: int = 6, least_count: int = 5, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lowered, of `least` letters and more, that
    occur least_count times and more.

    every: plants known misspellings: in one of so many documents of a word, by the CRC-32 of `<id>:<word>`, all its
    occurrences lose the letter at that CRC modulo the length; 0 plants none. A task counts what it reads, so a common
    word is one row a task. Null texts have no words; a null id counts as the empty text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    counted = rows.mapInArrow(_count(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least))


class FmIndex:
    """Suffix ranks over a list of distinct words, each ended by a delimiter, for searches from right to left.

    Suffixes are sorted up to their delimiter, equal ones by the order of the words; `before` has the letter before each
    (0: the suffix is a whole word). An interval of ranks holds the words' places where what was matched so far occurs;
    a letter to its left narrows it by two counts in that letter's bit vector.
    """

    def __init__(self, words: list[str]):
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        sizes = np.array([len(c) for c in codes], np.int64)
        self.words, total = len(words), int(sizes.sum()) + len(words)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.letters = np.unique(flat)
        text = np.zeros(total, np.int64)
        self.word_at = np.repeat(np.arange(len(words)), sizes + 1)
        starts = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(total, bool)
        inside[starts + sizes] = False
        text[inside] = np.searchsorted(self.letters, flat) + 1
        left = (starts + sizes)[self.word_at] - np.arange(total)  # letters from here to the delimiter
        rank, step, order = text, 1, np.argsort(text, kind="stable")
        while step <= int(left.max(initial=0)):  # ranks by the first `step` letters give those by twice as many
            key = rank * (total + 2) + np.where(left >= step, np.roll(rank, -step), -1) + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(total, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            step *= 2
        self.order = order
        before = np.where(np.isin(order, starts), 0, text[order - 1]) if total else text
        self.whole = np.nonzero(before == 0)[0]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.letters) + 1))]).astype(np.int64)
        lanes = -(-(total + 1) // 64)
        self.bits = np.zeros((len(self.letters) + 1, lanes), np.uint64)
        for c in range(1, len(self.letters) + 1):
            own = np.zeros(lanes * 64, np.uint8)
            own[:total] = before == c
            self.bits[c] = np.packbits(own, bitorder="little").view(np.uint64)
        self.counts = np.zeros((len(self.letters) + 1, lanes + 1), np.int64)
        np.cumsum(np.bitwise_count(self.bits), axis=1, out=self.counts[:, 1:])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All letters of the words in a row as codes (0: no word of the index has the letter), and each word's length."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, flat), max(0, len(self.letters) - 1))
        known = self.letters[at] == flat if len(self.letters) else np.zeros(len(flat), bool)
        return np.where(known, at + 1, 0), np.array([len(w) for w in words], np.int64)

    def count(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        lane, bit = rank >> 6, (rank & 63).astype(np.uint64)
        return self.counts[letter, lane] + np.bitwise_count(self.bits[letter, lane] & ((np.uint64(1) << bit) - np.uint64(1)))

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with that letter to the left; empty for letters that no word has."""
        base = self.first[letter]
        low, high = base + self.count(letter, low), base + self.count(letter, high)
        return np.where(letter > 0, low, 0), np.where(letter > 0, high, 0)

    def one_error(self, words: list[str], exact: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): for each of `words` those of the index that end with its last `exact` letters and differ before
        them by exactly one inserted, deleted or replaced letter. Pairs may come more than once."""
        found = [self._search(words[i : i + block], exact[i : i + block], i) for i in range(0, len(words), block)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def _search(self, words: list[str], exact: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        text, sizes = self.encode(words)
        start = np.cumsum(sizes) - sizes
        query, left = np.arange(len(words)), sizes.copy()
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.words, np.int64)
        for step in range(int(exact.max(initial=0))):
            on = np.nonzero((exact[query] > step) & (low < high))[0]
            left[on] -= 1
            low[on], high[on] = self.extend(text[start[query[on]] + left[on]], low[on], high[on])
        keep = low < high
        free = query[keep], left[keep], low[keep], high[keep]  # no error so far
        spent, done = [np.zeros(0, np.int64)] * 4, []
        n = len(self.letters)
        while len(free[0]) or len(spent[0]):
            q, p, lo, hi = spent
            done.append((q[p == 0], lo[p == 0], hi[p == 0]))
            q, p, lo, hi = (x[p > 0] for x in spent)
            lo, hi = self.extend(text[start[q] + p - 1], lo, hi)
            new = [[x[lo < hi] for x in (q, p - 1, lo, hi)]]
            q, p, lo, hi = free
            letters = np.tile(np.arange(1, n + 1), len(q))
            wide = [np.repeat(x, n) for x in free]
            wlo, whi = self.extend(letters, wide[2], wide[3])
            own = np.repeat(np.where(p > 0, text[np.minimum(start[q] + np.maximum(p - 1, 0), max(0, len(text) - 1))] if len(text) else 0, -1), n)
            some = wlo < whi
            new.append([x[some] for x in (wide[0], wide[1], wlo, whi)])  # inserted: the query's letters all remain
            other = some & (own >= 0) & (letters != own)
            new.append([x[other] for x in (wide[0], wide[1] - 1, wlo, whi)])  # replaced
            rest = p > 0
            new.append([q[rest], p[rest] - 1, lo[rest], hi[rest]])  # deleted
            same = some & (letters == own)
            free = tuple(x[same] for x in (wide[0], wide[1] - 1, wlo, whi))
            spent = [np.concatenate([x[k] for x in new]) for k in range(4)]
        q, lo, hi = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        a, b = np.searchsorted(self.whole, lo), np.searchsorted(self.whole, hi)
        times = b - a
        rows = np.repeat(a, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(q, times) + base, self.word_at[self.order[self.whole[rows]]]


def one_edit_pairs(asked: list[str], known: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in asked, in known) of the words one edit apart where the edit is in the second half of the asked word and the
    first is shared (side PREFIX), or in the first half only (side SUFFIX); each pair once over both sides. known: distinct.

    A word of L letters has a first half of L // 2. Words and queries go into the index backwards for the prefix side,
    so that both sides match their half exactly from the right and extend to the left.
    """
    turned = (lambda ws: [w[::-1] for w in ws]) if side == PREFIX else lambda ws: ws
    exact = np.array([len(w) // 2 if side == PREFIX else len(w) - len(w) // 2 for w in asked], np.int64)
    q, k = FmIndex(turned(known)).one_error(turned(asked), exact)
    pairs = np.unique(q * max(1, len(known)) + k)
    q, k = pairs // max(1, len(known)), pairs % max(1, len(known))
    if side == SUFFIX:
        fresh = np.array([known[j][: len(asked[i]) // 2] != asked[i][: len(asked[i]) // 2] for i, j in zip(q.tolist(), k.tolist(), strict=True)], bool)
        q, k = q[fresh], k[fresh]
    return q, k


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    side = key[0].as_py()
    words, n, asks = (table.column(c).to_pylist() for c in ("word", "n", "asks"))
    known = {w: c for w, c, a in zip(words, n, asks, strict=True) if not a}
    names = list(known)
    asked = [w for w, a in zip(words, asks, strict=True) if a]
    q, k = one_edit_pairs(asked, names, side) if names and asked else (np.zeros(0, int), np.zeros(0, int))
    counts = list(known.values())
    return pa.table({"word": pa.array([asked[i] for i in q], pa.string()), "near": pa.array([names[j] for j in k], pa.string()), "near_n": pa.array([counts[j] for j in k], pa.int64())})


def near_words(words: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """(word, near, near_n): each ordered pair of words one edit apart, once. words: (word, n), distinct, stored.

    One edit leaves one half of a word as it is, so each word asks twice, by its first half and by its second, and each
    word is there for those who may ask: under the prefixes and suffixes as long as a half of a word of its length, or of
    one letter more or less. Halves are dealt into groups of about `indexed` such entries, each an index of its own.
    A half that more entries than that share is cut into tiles, of which every pair of entries meets in one.
    """
    size = F.length("word")
    half = lambda length: F.floor(length / 2).cast("int")
    lengths = F.array(size - 1, size, size + 1)
    part = lambda side, k: F.when(side == PREFIX, F.substring(F.col("word"), F.lit(1), k)).otherwise(F.substring(F.col("word"), size - k + 1, k))

    def entries(side: int, asks: bool) -> DataFrame:
        own = (lambda length: half(length)) if side == PREFIX else lambda length: (length - half(length)).cast("int")
        k = F.array(own(size)) if asks else F.array_distinct(F.transform(lengths, own))
        return words.withColumn("k", F.explode(k)).select(F.lit(side).alias("side"), part(F.lit(side), F.col("k")).alias("half"), "word", "n", F.lit(asks).alias("asks"))

    known = entries(PREFIX, False).union(entries(SUFFIX, False))
    groups = max(1, -(-4 * words.count() // indexed))
    large = materialize(known.groupBy("side", "half").count().where(F.col("count") > indexed).select("side", "half", F.ceil(F.col("count") / indexed).cast("int").alias("tiles")), "halves")
    every = known.union(entries(PREFIX, True)).union(entries(SUFFIX, True)).join(large, ["side", "half"], "left")
    own, others = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"), F.sequence(F.lit(0), F.col("tiles") - 1)
    small = F.pmod(F.xxhash64("side", "half"), F.lit(groups)).cast("string")
    dealt = (
        every.withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(others)))
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .select("side", F.when(F.col("tiles").isNull(), small).otherwise(F.col("half")).alias("part"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("j"), "word", "n", "asks")
    )
    return dealt.groupBy("side", "part", "i", "j").applyInArrow(_meet, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int, ratio: int, least_count: int) -> DataFrame:
    """(word, root) of the words in forms (word, form): the end of the way from form to form.

    Each step multiplies the count by ratio, so a way has at most log(most / least_count) steps and doubling it a few
    times, once a round, gets to its end.
    """
    steps = max(1, math.floor(math.log(max(most, least_count) / least_count, ratio)) + 1) if ratio > 1 else 64
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps))):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = materialize(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return now


def spelling_variants(docs: DataFrame, least: int = 6, least_count: int = 5, ratio: int = 5, every: int = 0, id_col: str = "doc_id", text_col: str = "text", indexed: int = INDEXED) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word of word_counts().

    n_near: how many of the words are one edit away. form: the one of them with the largest count (then the least in
    code-point order), if that is at least ratio times the word's own; form_n its count. root: where the way from form to
    form ends, the word itself if it has none. Tables without words give an empty one.
    """
    words = materialize(word_counts(docs, least, least_count, every, id_col, text_col), "words")
    most = words.agg(F.max("n")).first()[0] or 0
    near = near_words(words, indexed).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    full = words.join(near, "word", "left")
    enough: Column = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    judged = materialize(full.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(judged.where(F.col("form").isNotNull()), most, ratio, least_count)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
