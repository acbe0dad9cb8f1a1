"""The corpus operators against brute force, on small tables with nulls, copies, clashing names and odd texts."""

import hashlib
import io
import os
import random
import re
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragspark.llm import catalog, dac, embeddings, simhash
from ragspark.llm.common import connected_components, gapless_rank, materialize, tiled
from ragspark.llm.embeddings import embedding_components
from ragspark.llm.fingerprints import fingerprint_documents, fingerprint_edits, with_next
from ragspark.llm.language import infer_languages, select_languages, train_languages
from ragspark.llm.line_dedup import dedup_lines
from ragspark.llm.mixing import mix_sources, take_mix
from ragspark.llm.packing import GROUPS, SHARE, grouped_sequences, inverse_of, pack_documents, plan_sequences
from ragspark.llm.quality import FALSE_ALARMS, LABELLERS, OTHER_KIND, OWN_KIND, filter_quality, fit_labellers, score_quality
from ragspark.llm.sharding import assign_shards
from ragspark.llm.simhash import drop_near_duplicates, simhash_components
from ragspark.llm.tokens import Encoder, default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _hash int, count string, node string"
SPACE = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, "z", "n") for r in rows], SCHEMA)


def prose(rng, n, words=None):
    words = words or ["river", "stone", "Ab", "light", "über", "garten", "é", "walk", "under", "morning", "x1", "and", "the", "of"]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = ["This line is shared by very many documents.", "  THIS LINE IS shared by very many documents.\t", "short line", "exactly twenty chars"]
    out = []
    for i in range(60):
        lines = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 4))] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(lines)
        out.append((i * 7 % 61 + 100, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])))
    out += [(500, None, "en", None), (501, "", None, "a"), (502, "\n\n", "en", "a"), (503, "word " * 30_000, "en", "a"), (504, out[3][1], "en", "b"), (505, out[3][1], "de", "a"), (506, "\x0b \x0c", "en", "b")]
    return out


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (900, 900)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_rank_and_tiles(spark):
    df = materialize(spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("h")), "t")
    got = gapless_rank(df, ["g"], "h", ["id"], "r", rows_per_bucket=37).collect()
    for g in range(3):
        own = sorted((r.h, r.id, r.r) for r in got if r.g == g)
        assert [r for *_, r in own] == list(range(len(own)))
    pairs = defaultdict(set)
    for r in tiled(df.where("g = 0 or id < 40"), ["g"], "id", 50).collect():
        pairs[r.g, r._ti, r._tj].add((r._tile, r.id))
    met = Counter()
    for (g, ti, tj), own in pairs.items():
        a, b = [i for t, i in own if t == ti], [i for t, i in own if t == tj]
        met.update((g, x, y) for x in a for y in b if ti < tj or x < y)
    zero = sum(1 for i in range(1000) if i % 3 == 0)
    assert sum(v for k, v in met.items() if k[0] == 0) == zero * (zero - 1) // 2 and set(met.values()) == {1}


def test_sharding(spark, rows):
    more = rows + [rows[0], rows[0], (None, "q", None, None), (None, None, None, None)]
    got = assign_shards(frame(spark, more), [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in more)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and {r.law for r in got} == {"key"}
    assert assign_shards(frame(spark, []), [1.0, 2.0]).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in assign_shards(many, [1.0, 3.0]).collect())
    assert 0.22 < n[0] / 20_000 < 0.28
    with pytest.raises(ValueError):
        assign_shards(many, [])


def brute_lines(rows, least=20, docs=3):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(ASCII_LOWER)
    holds = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and d is not None:
                holds[key(x)].add(d)
    gone = {k: max(v) for k, v in holds.items() if len(v) >= docs}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in gone or gone[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


def test_line_dedup(spark, rows):
    more = rows + [rows[5], (None, rows[5][1], None, None)]
    got = dedup_lines(frame(spark, more)).collect()
    assert Counter((r._row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(more)
    assert any(r.n_dropped for r in got) and {r._row["count"] for r in got} == {"z"}
    assert dedup_lines(frame(spark, [])).count() == 0


def brute_targets(size, cap=3.0):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = float(sum(size.values())), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if cap * size[s] < level * weight[s] - 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: cap * size[s] for s in over}
        free -= over
    return target


def test_mixing(spark, rows):
    more = rows + [(None, "a b c", None, "tiny"), (None, "a b", None, "tiny"), (900, None, None, "empty")] + [rows[2]]
    got = mix_sources(frame(spark, more)).collect()
    words = lambda t: len(re.findall(SPACE, t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, *_ in more)
    size = Counter()
    for _, t, _, s in more:
        size[s] += words(t)
    target = brute_targets(size)
    for s in size:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * (1 + target[s]) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max([1, *(r.size for r in own)])
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = mix_sources(frame(spark, more)).collect()
    assert Counter(got) == Counter(again)
    repeated = Counter(r.doc_id for r in take_mix(frame(spark, more)).collect())
    wanted = Counter()
    for r in got:
        wanted[r.doc_id] += r.copies
    assert repeated == +wanted
    assert mix_sources(frame(spark, [])).count() == 0


def brute_print(text, width=3):
    words = re.findall(SPACE, (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    ones = [0] * 64
    for h in (xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles):
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(ids, linked):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in zip(ids, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def test_simhash_components(spark, rows):
    rng = random.Random(3)
    near = [(700 + i, " ".join(w if rng.random() < 0.98 else "swap" for w in rows[10][1].split()), None, None) for i in range(12)]
    more = rows + near + [(None, "", None, None), (None, "only here", None, None), rows[0]]
    prints = [brute_print(t) for _, t, *_ in more]
    want = brute_components([d for d, *_ in more], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = Counter(map(tuple, simhash_components(frame(spark, more)).collect()))
    assert got == Counter((d, f"{p:016x}", c) for (d, *_), p, c in zip(more, prints, want, strict=True))
    assert simhash_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("bits", "radius"), [(64, 0), (64, 3), (64, 5), (256, 40)])
def test_bit_sliced_comparison(bits, radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2, (150, bits)).astype(np.uint8)
    b = np.concatenate([a[:70] ^ (rng.random((70, bits)) < radius / bits), rng.integers(0, 2, (131, bits))]).astype(np.uint8)
    got = {(int(i), int(j)) for q, v in simhash.within(a, b, radius) for i, j in zip(q, v, strict=True)}
    distance = (a[:, None, :] != b[None, :, :]).sum(axis=2)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= radius)), strict=True)) and got


def test_near_duplicates_stay_once(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((g * 10, " ".join(base), "en", "a"))
        for k in range(1, 4):
            changed = list(base)
            for _ in range(k):
                changed[rng.randrange(300)] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(changed), "en", "a"))
    rows.append(rows[0])
    got = sorted(r.doc_id for r in drop_near_duplicates(frame(spark, rows)).collect())
    assert got == [g * 10 for g in range(40)]
    assert drop_near_duplicates(frame(spark, [])).count() == 0


def brute_shingles(text, width=5):
    words = re.findall(SPACE, (text or "").translate(ASCII_LOWER))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_near_duplicates_are_decided_by_jaccard(spark):
    """Pairs on both sides of 0.8, a chain, and texts that share a passage repeated over and over."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(404)]
        cut = 339 - g % 16 if g % 2 else 340 + g % 16
        texts += [" ".join(base), " ".join(base[:cut] + [rng.choice(words) for _ in range(20)])]
    chain = [rng.choice(words) for _ in range(600)]
    texts += [" ".join(chain[i : i + 400]) for i in range(0, 200, 35)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts += [" ".join([passage] * 40 + [rng.choice(words) for _ in range(200)]) for _ in range(6)]
    texts += [" ".join(["x", passage, *chain[:200]]), " ".join(["x", *[passage] * 30, *chain[:200]])]
    sets = [brute_shingles(t) for t in texts]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    near = [share(2 * g, 2 * g + 1) for g in range(60)]
    assert sum(0.7 < x < 0.8 for x in near) > 10 and sum(0.8 <= x < 0.88 for x in near) > 10
    want = sorted(set(brute_components(list(range(len(texts))), lambda i, j: share(i, j) >= 0.8)))
    got = sorted(r.doc_id for r in drop_near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect())
    assert got == want


def test_jaccard_links_over_tiles(spark):
    """One group of several tiles: chains around the threshold, a class of copies, and nodes that nothing joins."""
    rng = random.Random(23)
    base = rng.sample(range(1 << 40), 60)
    sets = [set(base[:50]) | {rng.randrange(1 << 40)} for _ in range(40)]
    for _ in range(60):
        sets.append((set(rng.sample(base, 48)) | set(rng.sample(range(1 << 40), rng.randint(0, 14)))))
    rows = [(7, i, len(s), sorted(s)) for i, s in enumerate(sets)] + [(8, 500, 2, [1, 2]), (8, 501, 2, [1, 2]), (8, 502, 2, [1, 3])]
    df = spark.createDataFrame(rows, "group long, node long, size long, shingles array<long>")
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = brute_components(list(range(len(sets))), lambda i, j: share(i, j) >= 0.8)
    assert 1 < len(set(want)) < 70
    for tile, shingles in ((1000, 1 << 30), (9, 1 << 30), (1000, 400)):
        found = {r.node: r.component for r in connected_components(simhash.jaccard_links(df, 0.8, tile, shingles)).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == want
        assert found[501] == 500 and 502 not in found


@pytest.mark.parametrize("n", [10, 1 << 20, 1 << 30, 1 << 40])
def test_exact_bands_miss_nothing(n):
    bands = simhash.exact_bands(64, 3, n)
    assert len({len(b) for b in bands}) == 1 and min(30, (n // 1024).bit_length()) <= len(bands[0])
    rng = np.random.default_rng(9)
    for _ in range(300):
        flipped = set(rng.choice(64, 3, replace=False).tolist())
        assert any(not flipped & set(b) for b in bands)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(3000)]
    a, b, c, d, e, f = (" ".join(rng.choice(words) for _ in range(100)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b + " end"), (None, c), (3, c + " end"), (3, d), (5, c), (5, e), (5, e), (None, f), (None, f), (7, None), (None, "")]
    got = Counter((r.doc_id, r.text) for r in drop_near_duplicates(frame(spark, [(*r, "en", "a") for r in rows])).collect())
    kept = [x for x in got if x[1] in (b, b + " end")]
    assert len(kept) == 1 and got == Counter([(None, a), kept[0], (3, c + " end"), (3, d), (5, e), (None, f), (7, None)])


def test_fingerprints(spark, rows):
    texts = [t for _, t, *_ in rows] + ["Café  au lait ", "café AU lait", "ﬁn Straße", "FIN STRASSE", "fin", None]
    more = [(i, t, None, None) for i, t in enumerate(texts)]
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip()
    for bits in (128, 6):  # six bits make most buckets hold several texts
        got = {r.doc_id: r.fingerprint for r in fingerprint_documents(frame(spark, more), bits=bits).collect()}
        for i, a in enumerate(texts):
            for j in range(i):
                assert (got[i] == got[j]) == (canon(a) == canon(texts[j])), (a, texts[j])
    assert fingerprint_documents(frame(spark, [])).count() == 0


def test_fingerprints_of_edits(spark, rows):
    more = rows + [(200 + i, "same text of a hot group", None, None) for i in range(20)]
    order = sorted(more, key=lambda r: -r[0])
    texts = {}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, u = a[1] or "", b[1] or ""
        k = len(t) // 3
        texts[a[0]] = (t, t[: len(t) - k] + u[:k], u)
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()
    for bits in (128, 5):
        got = fingerprint_edits(frame(spark, more), bits=bits, rows_per_range=9).collect()
        by_print, by_text = defaultdict(set), defaultdict(set)
        for r in got:
            for p, t in zip((r.fingerprint, r.edited_fingerprint, r.next_fingerprint), texts[r.doc_id], strict=True):
                by_print[p].add(canon(t))
                by_text[canon(t)].add(p)
            assert r.edited_sha256 == hashlib.sha256(texts[r.doc_id][1].encode()).hexdigest()
        assert len(got) == len(more) and {len(v) for v in by_print.values()} == {len(v) for v in by_text.values()} == {1}
    assert fingerprint_edits(frame(spark, [])).count() == 0


def test_next_documents(spark, rows):
    for size in (7, 1000):
        got = {r.doc_id: r for r in with_next(frame(spark, rows), rows_per_range=size).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        assert len(got) == len(rows)
        for a, b in zip(order, order[1:] + order[:1], strict=True):
            assert (got[a[0]].next_id, got[a[0]].next_text) == (b[0], b[1] or "")
    assert with_next(frame(spark, [(None, "a", None, None)])).collect()[0].next_text == "a"
    assert with_next(frame(spark, [])).count() == 0


def test_edits_with_null_and_repeated_ids(spark):
    """Each row's next one is one row, whatever the ids are; null ids are split by hash."""
    rng = random.Random(41)
    rows = [(None, prose(rng, 5 + i % 7), "en", "a") for i in range(40)] + [(9, prose(rng, 6), "en", "a") for _ in range(12)] + [(i, prose(rng, 8), "en", "a") for i in range(20)] + [(None, None, "en", "a")] * 3
    df = frame(spark, rows).withColumns({"key": F.lit(1), "next_key": F.lit(2), "part": F.lit(3), "next": F.lit(4)})
    chained = with_next(df, rows_per_range=10).collect()
    text = lambda r: r[1] or ""
    assert Counter((r.doc_id, r.text) for r in chained) == Counter((r[0], text(r)) for r in rows) == Counter((r.next_id, r.next_text) for r in chained)
    ids = sorted((r.doc_id for r in chained if r.doc_id is not None), reverse=True)
    assert Counter((r.doc_id, r.next_id) for r in chained if r.doc_id is not None) == Counter(zip(ids, [*ids[1:], None], strict=True))
    got = fingerprint_edits(df, rows_per_range=10).collect()
    edits = lambda a, b: a[: len(a) - len(a) // 3] + b[: len(a) // 3]
    want = Counter((r.doc_id, len(r.text), hashlib.sha256(edits(r.text, r.next_text).encode()).hexdigest()) for r in chained)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    collide = fingerprint_edits(df, rows_per_range=10, bits=4).collect()
    by = defaultdict(set)
    for r in collide:
        by[r.edited_fingerprint].add(r.edited_sha256)
    assert len(collide) == len(rows) and len(by) > 16


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def test_encoder_equals_library(tokenizer):
    with open(default_tokenizer(), encoding="utf-8") as f:
        own = Encoder(f.read())
    rng = random.Random(2)
    texts = ["", " ", "a ", "a  b", "a \nb", "a\n b", "don't we'll", "x <|endoftext|> y", "日本 語 b", "\x1c a", "\0 b", " \0", "a \0b c", "a\n\0", "a　b", "ÀÉ ß"]
    texts += ["".join(rng.choice(" \n\tab'slt.1é,A  $ñ") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert own.splits
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    own.splits = False
    assert [x.tolist() for x in own.encode(texts[:50])] == [e.ids for e in tokenizer.encode_batch(texts[:50], add_special_tokens=False)]
    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    with open(default_tokenizer(), encoding="utf-8") as f:
        assert [x.tolist() for x in Encoder(f.read(), plain=True).encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, rows, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "FILE_IDS", 500)
    more = rows + [rows[0]]
    got = sorted(map(tuple, dac.read_tokens(dac.write_tokens(frame(spark, more), default_tokenizer(), str(tmp_path / "t"))).collect()))
    at, want = 0, []
    for d, t, *_ in sorted(more, key=lambda r: (r[0], r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert dac.read_tokens(dac.write_tokens(frame(spark, []), default_tokenizer())).count() == 0


@pytest.mark.parametrize("top", [200, 60_000, 1 << 20, 1 << 31])
def test_directly_addressable_codes(top):
    rng = np.random.default_rng(top)
    ids = np.where(rng.random(3000) < 0.5, rng.integers(0, min(256, top), 3000), rng.integers(0, top, 3000)).astype(np.uint32)
    reader = dac.Reader(io.BytesIO(dac.encode(ids, np.array([0, 0, 700, 700, 3000]))))
    assert [reader.token(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    for a, b in ((0, 3000), (5, 6), (1023, 2049), (700, 700), (511, 513)):
        assert reader.slice(a, b).tolist() == ids[a:b].tolist()
    assert [len(reader.document(k)) for k in range(4)] == [0, 700, 0, 2300]
    with pytest.raises(ValueError):
        dac.Reader(io.BytesIO(b"x" * 40))


def test_one_token_reads_few_bytes():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 1_000_000).astype(np.uint32)

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            self.seen += n
            return super().read(n)

    file = Counted(dac.encode(ids, np.arange(0, 1_000_001, 1000)))
    reader, opened = dac.Reader(file), file.seen
    assert opened <= 100
    for place in [0, 999_999, *rng.integers(0, 1_000_000, 50).tolist()]:
        before = file.seen
        assert reader.token(place) == ids[place] and file.seen - before <= 160
    before = file.seen
    assert reader.document(500).tolist() == ids[500_000:501_000].tolist() and file.seen - before < 4000


def test_packing_plan():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 101, 500), rng.integers(30, 38, 4000), np.array([100] * 7 + [1]), rng.integers(1, 12, 900)):
        counts = Counter(lengths.tolist())
        plans = [plan_sequences(dict(counts), 100, groups, share) for share, groups in ((SHARE, GROUPS), (4, 128), (2, 64), (8, 16))]
        for plan in plans:
            placed = Counter()
            for run, copies in plan:
                assert sum(run) <= 100 and copies > 0
                for n in run:
                    placed[n] += copies
            assert placed == counts
        decreasing = []  # best fit, longest first, piece by piece
        for n in sorted(lengths.tolist(), reverse=True):
            room = [x for x in decreasing if x >= n]
            if room:
                decreasing.remove(min(room))
            decreasing.append((min(room) if room else 100) - n)
        assert sum(c for _, c in plan_sequences(dict(counts), 100)) <= len(decreasing)
    assert plan_sequences({}, 100) == []


def test_configurations_hold_several_pieces():
    """The grouped pieces come out in whole configurations, two or more of them where two fit."""
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(690, 1340, 3000).tolist())
    runs, rest = grouped_sequences(dict(counts), 2048, GROUPS)
    placed = Counter(rest)
    for lengths, copies in runs:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] += copies
    assert placed == counts and sum(rest.values()) < 0.2 * 3000
    assert np.average([len(lengths) for lengths, _ in runs], weights=[c for _, c in runs]) > 1.9
    total = sum(c for _, c in plan_sequences(dict(counts), 2048))
    assert total <= 1.01 * max(1500, sum(n * c for n, c in counts.items()) / 2048)
    mixed = Counter(np.minimum(2048, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1).tolist())
    assert sum(c for _, c in plan_sequences(dict(mixed), 2048)) <= 1.001 * sum(n * c for n, c in mixed.items()) / 2048 + 1


def test_packing_plan_beside_a_session():
    """A plan of hundreds of sizes ends in a process that has started a JVM, where BLAS may not return."""
    code = """
from pyspark.sql import SparkSession
SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import numpy as np
from collections import Counter
from ragspark.llm.packing import plan_sequences
counts = Counter(np.random.default_rng(1).integers(690, 1340, 3000).tolist())
print(sum(c for _, c in plan_sequences(dict(counts), 2048)))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=root, check=True)
    assert int(done.stdout.split()[-1]) <= 1520


def test_inverse_by_elimination():
    rng = np.random.default_rng(2)
    basis = rng.integers(0, 3, (40, 40)).astype(float) + np.diag(np.arange(1, 41))[::-1]
    assert np.allclose(inverse_of(basis) @ basis, np.eye(40), atol=1e-6)


def test_packing(spark, rows, tokenizer):
    more = rows + [rows[0], rows[0]]
    got = pack_documents(frame(spark, more), default_tokenizer(), capacity=64).collect()
    want = Counter()
    for d, t, *_ in more:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert pack_documents(frame(spark, []), default_tokenizer()).count() == 0


def test_tokens_and_pieces_with_odd_ids(spark, tokenizer, tmp_path):
    """Null and repeated ids, clashing columns: every row is there, null ids first in the files."""
    rows = [(None, "no id", "en", "a"), (None, None, "en", "a"), (3, "one text", "en", "a"), (3, "another text", "en", "a"), (2, "b " * 400, "en", "a")]
    df = frame(spark, rows).withColumns({"file": F.lit(1), "part": F.lit(2), "piece": F.lit(3), "_rank": F.lit(4), "length": F.lit(5)})
    count = lambda t, end: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    got = sorted(map(tuple, dac.read_tokens(dac.write_tokens(df, default_tokenizer(), str(tmp_path / "t"))).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 2, 3, 3] and Counter((r[0], r[2]) for r in got) == Counter((d, count(t, 2)) for d, t, *_ in rows)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    pieces = pack_documents(df, default_tokenizer(), capacity=64).collect()
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    want = Counter()
    for d, t, *_ in rows:
        want[d] += count(t, 0)
    assert total == want and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def brute_vectors(rows, least=0.93):
    good = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, lab, v in rows]

    def linked(i, j):
        if not (good[i] and good[j]) or rows[i][1] != rows[j][1] or len(rows[i][2]) != len(rows[j][2]):
            return False
        a, b = np.array(rows[i][2], float), np.array(rows[j][2], float)
        return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))) >= least

    n = [sum(linked(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    return [(r[0], k, c) for r, k, c in zip(rows, n, brute_components([r[0] for r in rows], linked), strict=True)]


def test_embedding_components(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((25, 16))
    rows = []
    for i in range(160):
        v = base[i % 25] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3, 1.0])
        rows.append((i * 37 % 997, int(i % 3), [float(np.float32(x)) for x in v]))
    rows += [(1000, 1, None), (1001, None, rows[0][2]), (1002, 0, [0.0] * 16), (1003, 0, [float("nan")] + [1.0] * 15), (1004, 0, rows[0][2][:8]), (1005, 0, [None] + rows[0][2][1:]), (1006, 0, rows[0][2]), (1007, 0, [2 * x for x in rows[0][2]]), (1008, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want = {(d, n, c, d == c) for d, n, c in brute_vectors(rows)}
    for tile, blocks in ((1024, 8), (9, 4), (50, 16)):
        assert {tuple(r) for r in embedding_components(df, tile=tile, blocks=blocks).collect()} == want
    assert embedding_components(df.limit(0)).count() == 0


def test_range_join_prunes():
    """The candidates of all blocks together are a small part of the pairs, and hold every pair within the budget."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((900, 64))
    x[450:] = x[:450] + 0.03 * rng.standard_normal((450, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    turned, edges, budget = x @ embeddings.rotation(64), embeddings.block_edges(64, 8), 2 - 2 * 0.93
    compared, held = 0, set()
    for lo, hi in zip(edges, edges[1:], strict=False):
        i, j = embeddings.range_join(turned[:, lo:hi], turned[:, lo:hi], (budget / 8) ** 0.5)
        assert (np.abs(turned[i, lo:hi] - turned[j, lo:hi]) <= (budget / 8) ** 0.5 + 1e-12).all()
        compared += int((i < j).sum())
    for _, i, j in embeddings.block_candidates(turned, turned, edges, budget / 8 + 1e-9):
        held |= set(zip(i.tolist(), j.tolist(), strict=True))
    cosine = x @ x.T
    assert held >= set(zip(*np.nonzero(cosine >= 0.93), strict=True))
    assert compared < 0.1 * 900 * 899 / 2


def test_embeddings_with_odd_rows(spark):
    v = [0.5, -0.5, 1.0]
    rows = [(None, 1, v, "a"), (5, 1, v, "b"), (5, 1, [-x for x in v], "c"), (5, 1, [2 * x for x in v], "d"), (9, 2, v, "e")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, node string").withColumns({"copies": F.lit("x"), "_tile": F.lit("y"), "h1": F.lit(1)})
    got = Counter(tuple(r) for r in embedding_components(df).collect())
    assert got == Counter([(None, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (5, 2, 5, True), (9, 0, 9, True)])


def test_language(spark):
    rng = random.Random(6)
    parts = {"aa": ["ka", "ri", "to", "na"], "bb": ["sch", "ung", "ber", "ä"], "cc": ["eau", "oi", "é", "tre"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40), lang, None) for i, lang in enumerate([*parts] * 40)]
    names, model = train_languages(frame(spark, rows).where("lang is not null"))
    assert names == ["aa", "bb", "cc"]
    tests = [(i, text(lang, 25), lang, None) for i, lang in enumerate([*parts] * 20)] + [(900, None, None, None), (901, "12 %% ", None, None), (902, text("aa", 60) + " " + text("bb", 30), "aa", None)]
    got = {r._row.doc_id: r for r in infer_languages(frame(spark, tests), names, model, [F.col("doc_id")]).collect()}
    assert np.mean([got[d].lang_pred == lang for d, _, lang, _ in tests[:60]]) == 1.0
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert set(got[902].shares) == {"aa", "bb"} and 0.5 < got[902].score < 0.85
    assert infer_languages(frame(spark, tests), [], model[:0], [F.col("doc_id")]).where("lang_pred <> 'und'").count() == 0
    with np.errstate(all="raise"):
        assert select_languages(np.array([[0.5, 0.1], [0.5, 0.9]]), np.array([10, 0]), 2.0).sum() == pytest.approx(1)


def plain_em(likelihood, counts, rounds=3000):
    share = [1 / len(likelihood)] * len(likelihood)
    for _ in range(rounds):
        new = [0.0] * len(share)
        for g, n in enumerate(counts):
            mix = sum(s * row[g] for s, row in zip(share, likelihood, strict=True))
            for k, row in enumerate(likelihood):
                new[k] += n * share[k] * row[g] / mix
        share = [x / sum(counts) for x in new]
    return share, sum(n * np.log(sum(s * row[g] for s, row in zip(share, likelihood, strict=True))) for g, n in enumerate(counts))


def test_language_sets_against_all_subsets():
    """The set chosen has the largest penalised likelihood of all subsets, each fitted by a plain EM."""
    rng = np.random.default_rng(14)
    model = rng.dirichlet(np.full(12, 0.4), 4) + 1e-3
    model /= model.sum(axis=1, keepdims=True)
    sizes = Counter()
    for case in range(24):
        mix = rng.dirichlet(np.ones(1 + case % 3))
        who = rng.choice(4, len(mix), replace=False)
        counts = rng.multinomial(60 + 40 * case, mix @ model[who])
        keep = counts > 0
        like, n = model[:, keep], counts[keep]
        chosen = select_languages(like, n, 2.0)
        best = {}
        for size in (1, 2, 3, 4):
            for own in combinations(range(4), size):
                share, fit = plain_em(like[list(own)].tolist(), n.tolist(), 400)
                best[own] = (fit - 2.0 * size * np.log(n.sum() + 1), share)
        top = max(best, key=lambda own: best[own][0])
        mine = tuple(np.nonzero(chosen)[0].tolist())
        assert best[mine][0] >= best[top][0] - 0.5
        assert np.abs(chosen[list(mine)] - best[mine][1]).max() < 0.03
        sizes[len(mine)] += 1
    assert len(sizes) == 3


def test_language_query(spark, tmp_path):
    """The query's split: nothing is learned from held-out rows or rows without a language, and every row is predicted."""
    rng = random.Random(16)
    parts = {"aa": ["ka", "ri", "to", "na"], "bb": ["sch", "ung", "ber", "ä"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = [(i, text(lang, 30), lang if not held(i) else "zz", "a") for i, lang in enumerate(["aa", "bb"] * 50)]
    rows += [(200, text("aa", 30), None, "a"), (201, "12 %% 😀😀😀 😎", "aa", "a"), (202, None, "bb", "a"), (203, "𐐨𐐩𐐪 𐐫𐐬", None, "a"), (204, text("bb", 40_000), "bb", "a"), (None, rows[0][1], "aa", None), rows[3], rows[3]]
    frame(spark, rows).withColumns({"_row": F.lit(1), "_text": F.lit("x"), "lang_pred": F.lit("q")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.op2_language(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == held("" if r.doc_id is None else r.doc_id) for r in got) and {r.lang_pred for r in got} == {"aa", "bb", "und"}
    assert all(by[i].lang_pred == ["aa", "bb"][i % 2] for i in range(100)) and by[204].lang_pred == "bb"
    assert (by[200].lang_pred, by[201].lang_pred, by[202].lang_pred, by[203].lang_pred != "und") == ("aa", "und", "und", True)
    assert all(0 <= r.score <= 1 for r in got)
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert catalog.op2_language(spark, str(tmp_path / "none")).count() == 0


def plain_labeller_em(patterns, rounds=500):
    """The same model, a document and a labeller at a time."""
    k = len(LABELLERS)
    cast_votes = [1 + sum(p[j] != "-" for p in patterns) for j in range(k)]
    member = []
    for p in patterns:
        accusers = [j for j in range(k) if p[j] == "0"] or list(range(k))
        bad = 0.95 if "0" in p else 0.02
        member.append([1 - bad] + [bad / len(accusers) if j in accusers else 0.0 for j in range(k)])
    for _ in range(rounds):
        share = [(1 + sum(m[c] for m in member)) / (len(patterns) + k + 1) for c in range(k + 1)]
        rate = []
        for c in range(k + 1):
            row = []
            for j in range(k):
                yes, no = [x * cast_votes[j] for x in FALSE_ALARMS] if c == 0 else OWN_KIND if c == j + 1 else OTHER_KIND
                said = sum(m[c] for m, p in zip(member, patterns, strict=True) if p[j] == "0")
                voted = sum(m[c] for m, p in zip(member, patterns, strict=True) if p[j] != "-")
                row.append((said + yes) / (voted + yes + no))
            rate.append(row)
        member = []
        for p in patterns:
            like = [share[c] * np.prod([rate[c][j] if p[j] == "0" else 1 - rate[c][j] for j in range(k) if p[j] != "-"]) for c in range(k + 1)]
            member.append([x / sum(like) for x in like])
    return {p: m[0] for p, m in zip(patterns, member, strict=True)}


@pytest.mark.parametrize("share", [0.1, 0.7])
def test_labellers_against_plain_em(share):
    """Few and most documents bad; labellers that overlap and abstain."""
    rng = np.random.default_rng(15)
    bad = rng.random(300) < share
    kind = rng.integers(0, 3, 300)
    fires = np.where(bad[:, None], rng.random((300, 8)) < np.where(np.arange(8)[None, :] // 2 == kind[:, None], 0.8, 0.02), rng.random((300, 8)) < 0.004)
    quiet = rng.random((300, 8)) < 0.1
    patterns = ["".join("-" if q else "0" if f else "1" for f, q in zip(a, b, strict=True)) for a, b in zip(fires, quiet, strict=True)]
    got, rates = fit_labellers(dict(Counter(patterns)), 40)
    want = plain_labeller_em(patterns, 40)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in want)
    assert np.mean([(got[p] < 0.5) == b for p, b in zip(patterns, bad, strict=True)]) > 0.93
    votes = lambda rows: np.array([[c == "0" for c in p] for p in rows]).sum(axis=0) / np.array([[c != "-" for c in p] for p in rows]).sum(axis=0)
    for side, column in ((bad, 0), (~bad, 1)):
        assert np.abs(rates[:, column] - votes([p for p, b in zip(patterns, side, strict=True) if b])).max() < 0.12


def test_quality_with_odd_rows(spark):
    rows = [(None, "A plain line of text that says little.", "en", "a"), (None, None, "en", "a"), (4, "!!! " * 50_000, "en", "a"), (5, "Some other words in a row.", "en", "a"), (5, "Some other words in a row.", "en", "a"), (6, "word " * 60_000, "en", "a")]
    rows += [(10 + i, prose(random.Random(i), 30).capitalize() + ".", "en", "a") for i in range(60)]
    df = frame(spark, rows).withColumns({"doc": F.lit(1), "hash": F.lit(2), "votes": F.lit("v"), "index": F.lit(3), "_row": F.lit(4), "_text": F.lit("t")})
    got = score_quality(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted(r.keep for r in got if r.doc_id is None) == [False, True] and {r.keep for r in got if r.doc_id == 5} == {True}
    assert not any(r.keep for r in got if r.doc_id in (4, 6))
    kept = filter_quality(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.keep)


def test_quality_against_labels(spark):
    """The labels of the test data, which the classifier does not see."""
    sf = "/root/testdata/sf0.01"
    got = catalog.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] >= 0.99 and kept[0] <= 0.05


def test_quality(spark):
    rng = random.Random(7)
    rows, bad = [], set()
    for i in range(400):
        t = prose(rng, rng.randint(8, 80)).capitalize() + "."
        kind = i % 20
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind == 1:
            t = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split())
        elif kind == 2:
            t = " ".join(x for w in t.split()[:12] for x in [w] * 6)
        elif kind == 3:
            t = " | ".join(t.split())
        if kind < 4:
            bad.add(i)
        rows.append((i, t, "en", "a"))
    rows += [(500, None, None, None), (501, " \n", None, None)]
    got = {r.doc_id: r for r in score_quality(frame(spark, rows)).collect()}
    assert not any(got[i].keep for i in bad | {500, 501})
    assert all(got[i].keep and 0.5 <= got[i].score <= 1 for i in range(400) if i not in bad)
    kept = filter_quality(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].keep}
    assert score_quality(frame(spark, [])).count() == 0 and filter_quality(frame(spark, [])).count() == 0


def test_edited_texts(spark):
    """op7's digest columns, on the smallest tables."""
    from ragspark.llm.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, d).collect()}
    for (i, t), (j, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_next == float(got[i].fingerprint == got[j].fingerprint)
