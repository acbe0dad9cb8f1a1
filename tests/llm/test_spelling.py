"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ragspark.llm.spelling import PREFIX, SUFFIX, FmIndex, near_words, one_edit_pairs, spelling_variants

SCHEMA = "doc_id long, text string, word string, n string, half int, side string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(rng, letters, n, low, high):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}, key=lambda w: hash(w) % 97)


@pytest.mark.parametrize("letters,n,low,high", [("ab", 200, 6, 10), ("abcé", 400, 6, 9), ("a", 12, 6, 40), ("abcdefgh", 150, 6, 7), ("xyß÷", 200, 6, 8)])
def test_search_schemes(letters, n, low, high):
    words = some_words(random.Random(2), letters, n, low, high)
    pairs = [(words[i], words[j]) for side in (PREFIX, SUFFIX) for i, j in zip(*one_edit_pairs(words, words, side), strict=True)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_index_counts_occurrences():
    words = ["banana", "bandana", "ananas"]
    index = FmIndex(words)
    low, high = np.array([0]), np.array([3])
    for letter, want in (("a", 2), ("n", 2), ("a", 2), ("d", 1)):
        code, _ = index.encode([letter])
        low, high = index.extend(code, low, high)
        assert high[0] - low[0] == want
    assert index.encode(["éa"])[0][0] == 0
    assert FmIndex([]).words == 0


@pytest.mark.parametrize("indexed", [50_000, 16])
def test_near_words(spark, indexed):
    """In groups, and with halves that many words share cut into tiles."""
    rng = random.Random(4)
    words = some_words(rng, "abc", 150, 6, 8) + ["inter" + w for w in some_words(rng, "ab", 60, 2, 5)] + ["b" * 2000, "b" * 1999]
    rows = [(w, i + 5) for i, w in enumerate(dict.fromkeys(words))]
    got = Counter(tuple(r) for r in near_words(spark.createDataFrame(rows, "word string, n long"), indexed).collect())
    assert got == Counter((a, b, n) for a, _ in rows for b, n in rows if one_edit(a, b))


def brute(rows, every):
    total = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            total[low[: h % len(low)] + low[h % len(low) + 1 :] if every and h % every == 0 else low] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n, len(near[w]), words.get(form.get(w))] += 1
    return out


@pytest.mark.parametrize("every", [0, 7])
def test_variants(spark, every):
    """Null and repeated ids, null, empty and very long texts, ties, words in capitals, and ways of several steps."""
    rng = random.Random(6)
    base = ["garden", "gardens", "gardenx", "Öffnung", "öffnung", "straße", "strasse", "Recieve", "receive", "relieve", "naïveté", "naivete", "short", "kitten", "sitten", "mitten"]
    rows = [(rng.choice([None, 5, i]), " ".join(rng.choice(base) for _ in range(rng.randint(0, 25))) + rng.choice(["", ".", "1x\n"]), "w", "n", 1, "s") for i in range(150)]
    steps = [("aaaaaaaaaa", 5), ("aaaaaaaaab", 30), ("aaaaaaaabb", 160), ("aaaaaaabbb", 900), ("aaaaaabbbb", 4600)]
    rows += [(900 + i, f"{w} " * n, "w", "n", 1, "s") for i, (w, n) in enumerate(steps)]
    rows += [(1, None, None, None, None, None), (2, "", "", "", 0, ""), (3, "Wörterbuch-" * 30_000, "w", "n", 1, "s"), (4, "equals eqvals " * 5, "w", "n", 1, "s"), (4, "eqwals " * 5 + "equalss " * 25, "w", "n", 1, "s")]
    got = Counter(tuple(r) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA), every=every, indexed=40).collect())
    assert got == brute(rows, every)
    if not every:
        assert any(k[0] == "aaaaaaaaaa" and k[2] == "aaaaaabbbb" for k in got)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
