"""Cross-tokenizer alignment against a plain walk over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ragspark.llm.alignment import align_documents, common_ends, default_model, gallop, link_statistics
from ragspark.llm.tokens import default_tokenizer

SCHEMA = "doc_id long, text string, row long, links string, n_a string, _row int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["river", "Stones", "über", "garten", "antidisestablishment", "1,234.5", "don't", "😀", "ßé", "x" * 40, "你好", "é", "\t", "naïve"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return out + [None, "", " ", "  lead", "trail  ", "a\n\n\nb", "\r\n", "\x00", "plain <|endoftext|> text", "<s> </s> <unk> <0x41>", "held ▁ mark", "▁", "word " * 20_000, out[0], out[0], "ﬁ ﬀ", "  x"]


def spelled(text):
    """The ids of both with their bytes, straight from the libraries' own entries; none if they spell something else."""
    if not text:
        return [], []
    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=default_model())
    signs, n = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            signs[chr(byte)] = byte
        else:
            signs[chr(256 + n)] = byte
            n += 1
    left = [(i, bytes(signs[c] for c in t)) for i, t in zip(*(lambda e: (e.ids, e.tokens))(a.encode(" " + text, add_special_tokens=False)), strict=True)]
    right = [(i, bytes([i - 3]) if 3 <= i < 259 else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in t) == want for t in (left, right)) else ([], [])


def brute(text):
    left, right = spelled(text)
    ends = []
    for side in (left, right):
        at, found = 0, []
        for i, raw in side:
            at += len(raw)
            found.append((at, i))
        ends.append(found)
    both = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
    groups, was = [], 0
    for e in sorted(both):
        groups.append([[i for at, i in side if was < at <= e] for side in ends])
        was = e
    return len(left), len(right), groups


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 5), (20, 200), (300, 310), (1, 400)):
        long = np.cumsum(rng.integers(1, 9, m))
        short = np.unique(np.append(rng.integers(1, long[-1] + 1, n), long[-1]))
        for guess in (np.zeros(len(short), int), np.full(len(short), m - 1), rng.integers(0, m, len(short))):
            assert gallop(short, long, guess).tolist() == np.searchsorted(long, short).tolist()
    ends = [[np.cumsum(rng.integers(1, 6, k)) for k in ks] for ks in ((3, 40, 1, 200), (60, 2, 9, 5))]
    for a, b in zip(*ends, strict=True):
        top = max(a[-1], b[-1]) + 1
        a[-1] = b[-1] = top
    ia, ib = common_ends(*ends)
    shift = np.cumsum([0] + [x[-1] for x in ends[0]])[:-1]
    flat = [np.concatenate([x + s for x, s in zip(e, shift, strict=True)]) for e in ends]
    assert flat[0][ia].tolist() == flat[1][ib].tolist() == sorted(set(flat[0].tolist()) & set(flat[1].tolist()))
    assert [x.tolist() for x in common_ends([], [])] == [[], []]


def test_groups(spark, texts):
    rows = [(i, t, 7, "x", "y", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in align_documents(spark.createDataFrame(rows, SCHEMA), default_tokenizer(), default_model()).collect()}
    for i, t in enumerate(texts):
        n_a, n_b, groups = brute(t) if len(t or "") < 50_000 else (None, None, None)
        r = got[i]
        if n_a is None:
            assert sum(r.a_counts) == len(r.a_ids) and sum(r.b_counts) == len(r.b_ids)
            continue
        assert (len(r.a_ids), len(r.b_ids)) == (n_a, n_b)
        assert [len(a) for a, _ in groups] == r.a_counts and [len(b) for _, b in groups] == r.b_counts
        assert [i for a, _ in groups for i in a] == r.a_ids and [i for _, b in groups for i in b] == r.b_ids


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_link_statistics(spark, texts, sent):
    """With the counts sent to the tasks, and joined; ids are null and repeated."""
    some = [t for t in texts if len(t or "") < 50_000]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(some))]
    frame = spark.createDataFrame([(d, t, 7, "x", "y", 1) for d, t in zip(ids, some, strict=True)], SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in link_statistics(frame, default_tokenizer(), default_model(), sent_pairs=sent).collect())
    made = [brute(t) for t in some]
    pairs = Counter((a[-1], b[-1]) for _, _, groups in made for a, b in groups)
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    want = Counter()
    for d, (n_a, n_b, groups) in zip(ids, made, strict=True):
        links = [(a[-1], b[-1]) for a, b in groups]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want[d, n_a, n_b, len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""] += 1
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert link_statistics(empty, default_tokenizer(), default_model()).collect() == []
    assert align_documents(empty, default_tokenizer(), default_model()).collect() == []
    assert public_tokenizers.path("piece_bpe_32k.model") == default_model()
