"""The pipeline's stages against brute force on a small fixture."""

import random
from collections import Counter

import numpy as np
from test_corpus import brute_lines, brute_targets, frame
from tokenizers import Tokenizer

import corpus_pipeline
from ragspark.llm.tokens import default_tokenizer

WORDS = [f"{a}{b}{c}" for a in ("ka", "mi", "ro", "te", "su", "lo") for b in ("na", "re", "vi", "do") for c in ("s", "n", "", "lt", "ra")]


def fixture():
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    notice = "All rights to this text are reserved by its owners."
    rows, junk, groups = [], set(), []
    for i in range(120):
        text = "\n".join(line(rng.randint(20, 60)) for _ in range(3))
        if i % 10 == 0:
            text += "\n" + notice
        if i % 12 == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
            junk.add(i)
        rows.append((i, text, "en", f"s{i % 4}"))
    for g in range(8):
        base = [rng.choice(WORDS) for _ in range(250)]
        near = list(base)
        near[rng.randrange(250)] = "changed"
        groups.append((200 + 2 * g, 201 + 2 * g))
        rows += [(200 + 2 * g, " ".join(base), "en", "s0"), (201 + 2 * g, " ".join(near), "en", "s1")]
    return rows, junk, groups


def test_stages(spark, tmp_path):
    rows, junk, groups = fixture()
    docs, kept = frame(spark, rows), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    quality, lines, near, mixed, packed = kept
    columns = frame(spark, rows).columns
    assert all(x.columns == columns for x in (quality, lines, near, mixed))
    assert {r.doc_id for r in quality.collect()} == {r[0] for r in rows} - junk
    left = [(r.doc_id, r.text, None, r.source) for r in quality.collect()]
    assert {(r.doc_id, r.text, r.n_chars) for r in lines.collect()} == {(d, t, len(t)) for d, _, _, t in brute_lines(left)}
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in lines.collect()} - {b for _, b in groups}
    size = Counter()
    taken = Counter()
    words = {r.doc_id: len(r.text.split()) for r in near.collect()}
    for r in near.collect():
        size[r.source] += words[r.doc_id]
    for r in mixed.collect():
        taken[r.source] += words[r.doc_id]
    target = brute_targets(size)
    assert all(abs(taken[s] - target[s]) <= max(words.values()) for s in size)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    tok = Tokenizer.from_file(default_tokenizer())
    tokens = [len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect()]
    pieces = packed.collect()
    assert sum(r.length for r in pieces) == sum(tokens)
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= np.ceil(sum(tokens) / 2048) + 1


def test_empty(spark, tmp_path):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
