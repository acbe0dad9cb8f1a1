"""Toxicity: the label model against a plain one, lexicons against counting, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ragspark.llm import catalog
from ragspark.llm.quality import fit_logistic
from ragspark.llm.toxicity import ABSTAIN, VOTERS, Lexicon, association, fit_label_model, learn_lexicon, look, score_toxicity, term_counts

SCHEMA = "doc_id long, text string, votes string, toxic string, _hash int, index string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def planted():
    """Two languages, each with toxic words of its own; a few labels are wrong, and long clean texts hold one such word."""
    rng = random.Random(8)
    plain = {"a": ["meadow", "stone", "under", "quiet", "window", "yellow", "paper"], "b": ["garten", "lichtung", "bäume", "straße", "unter", "gelbes"]}
    bad = {"a": ["blarg", "snork", "grumphed"], "b": ["zefflich", "zeffkeit", "zeffbar", "zefften", "zeffung", "zeffer", "zeffig"]}
    docs, toxic = [], {}
    for d in range(600):
        lang, y = rng.choice("aab"), int(rng.random() < 0.2)
        n = rng.choice([12, 40, 300])
        words = [rng.choice(bad[lang]) if y and rng.random() < 0.1 else rng.choice(plain[lang]) for _ in range(n)]
        if y and not set(words) & set(bad[lang]):
            words[0] = bad[lang][0]
        if not y and n == 300 and rng.random() < 0.2:
            words[5] = rng.choice(bad[lang])
        docs.append((d, " ".join(words)))
        toxic[d] = y
    return docs, toxic


def plain_em(patterns, counts, rounds=3000):
    """The same model without dependencies, pattern by pattern."""
    n = len(patterns[0])
    q = {p: (0.95 if p[-1] == "1" else 0.05) if p[-1] != "-" else 0.9 if p[:-1].count("1") >= 2 else 0.05 for p in patterns}
    for _ in range(rounds):
        mass = [sum(counts[p] * (q[p] if y else 1 - q[p]) for p in patterns) for y in (0, 1)]
        rate = [[[0, 0] for _ in range(n)] for _ in (0, 1)]
        for y in (0, 1):
            for j in range(n):
                for v in (0, 1):
                    held = sum(counts[p] * (q[p] if y else 1 - q[p]) for p in patterns if p[j] == str(v))
                    rate[y][j][v] = held + ((196 if v == y else 4) if j == n - 1 else 4 if v == y else 1)
                rate[y][j] = [x / sum(rate[y][j]) for x in rate[y][j]]
        prior = (mass[1] + 1) / (sum(mass) + 2)
        for p in patterns:
            w = [math.log(1 - prior), math.log(prior)]
            for y in (0, 1):
                w[y] += sum(math.log(rate[y][j][int(c)]) for j, c in enumerate(p) if c != "-")
            q[p] = 1 / (1 + math.exp(w[0] - w[1]))
    return q


def test_label_model_without_dependencies_is_plain():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = "".join("-" if rng.random() < 0.3 else str(int(y ^ (rng.random() > right))) for right in (0.9, 0.8, 0.7, 0.85))
        counts[votes + (str(int(y)) if rng.random() < 0.1 else "-")] += 1
    found, model = fit_label_model(counts, rounds=3000, least_gain=99.0)
    want = plain_em(sorted(counts), counts, 300)
    assert model.parent == [-1] * 5
    assert max(abs(found[p] - want[p]) for p in counts) < 1e-3
    assert np.allclose(model.rates[1, :4, 1], (0.9, 0.8, 0.7, 0.85), atol=0.06)


def test_label_model_finds_correlations():
    """Three copies of one weak voter do not outvote a good one."""
    rng = random.Random(2)
    counts = Counter()
    for _ in range(20_000):
        y = rng.random() < 0.3
        weak = y ^ (rng.random() < 0.35)
        votes = [y ^ (rng.random() < 0.1), y ^ (rng.random() < 0.12), weak, weak ^ (rng.random() < 0.02), weak ^ (rng.random() < 0.02)]
        counts["".join(str(int(v)) for v in votes) + (str(int(y)) if rng.random() < 0.05 else "-")] += 1
    found, model = fit_label_model(counts)
    linked = {frozenset((j, i)) for j, i in enumerate(model.parent) if i >= 0}
    assert {frozenset((2, 3)), frozenset((2, 4))} <= linked or {frozenset((2, 3)), frozenset((3, 4))} <= linked or {frozenset((2, 4)), frozenset((3, 4))} <= linked
    assert 0.25 < model.prior < 0.35 and found["00111-"] < 0.5 < found["11000-"]
    alone, _ = fit_label_model(counts, least_gain=99.0)
    assert found["00111-"] < alone["00111-"]
    assert fit_label_model({})[0] == {}


def test_lexicon_and_votes(spark, planted):
    docs, toxic = planted
    rows = [(toxic[d], t) for d, t in docs]
    lexicon = learn_lexicon(spark.createDataFrame(rows, "toxic int, _text string"), 512)
    assert {"blarg", "snork", "grumphed", "zeff*"} <= set(lexicon.terms) and not {"meadow", "garten", "stone"} & set(lexicon.terms)
    n = [sum(1 for y, _ in rows if y == k) for k in (0, 1)]
    for term in ("blarg", "zeff*"):
        k = [sum(1 for y, t in rows if y == c and term_counts(t)[0][term] >= 0.004 * max(1, term_counts(t)[1])) for c in (0, 1)]
        total = sum(k) / sum(n)
        want = 2 * sum(a * math.log(a / m / total) * (a > 0) + (m - a) * math.log((1 - a / m) / (1 - total)) for a, m in zip(k, n, strict=True) if a)
        want += sum(2 * m * math.log(1 / (1 - total)) for a, m in zip(k, n, strict=True) if not a)
        from pyspark.sql import functions as F

        got = spark.range(1).select(association(F.lit(k[1]), F.lit(k[0]), n[1], n[0]).alias("g")).first().g
        assert got == pytest.approx(want, rel=1e-6)
    assert learn_lexicon(spark.createDataFrame([], "toxic int, _text string"), 9) == Lexicon({})
    own = Lexicon({"snork": 0, "zeff*": 1})
    votes, found = look("Snork zeffig, zeffbar! one two three four five six seven", own)
    names = [v for v, *_ in VOTERS]
    assert found[0] == found[1] == 1.0 and votes[names.index("starts4")] == "1" and votes[names.index("insults")] == "0"
    assert look(None, own) == (ABSTAIN * len(VOTERS), {}) == look(" 12 . ", own)
    assert look("snork " * 50_000, own)[1][0] == 1.0


def test_held_out_accuracy(spark, planted):
    """Documents whose labels were never seen are told; wrong labels of a few don't carry over."""
    docs, toxic = planted
    known = [(d, int(y ^ (d % 50 == 7))) for d, y in toxic.items() if d % 3]
    got = {r.doc_id: r for r in score_toxicity(frame(spark, docs), spark.createDataFrame(known, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    right = [got[d].predicted == y for d, y in toxic.items() if d % 3 == 0]
    assert sum(right) >= 0.98 * len(right)
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())


@pytest.fixture(scope="module")
def leaning():
    """Two languages, one with thrice the share of toxic documents; those hold one or two toxic words, however long they are."""
    rng = random.Random(5)
    often = {"a": ["to", "a", "was", "the", "of"], "b": ["der", "ein", "zu", "von", "und"]}
    rare = {"a": [f"on{x}th{y}" for x in "abcdefgh" for y in "aeiou"], "b": [f"ge{x}en{y}" for x in "abcdefgh" for y in "äeiöü"]}
    bad = {"a": ["blarg", "snork", "grumphed", "wexer"], "b": ["zefflich", "zeffkeit", "zeffbar", "zefften"]}
    docs, toxic = [], {}
    for d in range(3000):
        lang = rng.choice("aaabb")
        y = int(rng.random() < (0.18 if lang == "a" else 0.06))
        words = [rng.choice(often[lang] if rng.random() < 0.4 else rare[lang]) for _ in range(rng.choice([30, 60, 600]))]
        for _ in range(rng.choice([1, 2]) if y else 0):
            words[rng.randrange(len(words))] = rng.choice(bad[lang])
        docs.append((d, " ".join(words)))
        toxic[d] = y
    return docs, toxic


def test_words_of_a_language_are_no_terms(spark, leaning):
    """Words that all documents of one language hold lean to its class, surely so, but tell nothing of a document."""
    docs, toxic = leaning
    lexicon = learn_lexicon(spark.createDataFrame([(toxic[d], t) for d, t in docs], "toxic int, _text string"), 512)
    assert {"blarg", "snork", "grumphed", "wexer", "zeff*"} <= set(lexicon.terms)
    assert not {"to", "a", "was", "the", "of", "der", "ein"} & set(lexicon.terms)
    assert set(lexicon.odds) == set(lexicon.terms) and lexicon.odds["blarg"] > 4
    names = [v for v, *_ in VOTERS]
    votes, _ = look("blarg " + "to " * 2000, lexicon)
    assert votes[names.index("strongest")] == "1" and look("to " * 9, lexicon)[0][names.index("strongest")] == "0"


def test_toxic_words_in_long_texts_and_leaning_languages(spark, leaning):
    """One toxic word in a text of 600 is found; the language with more toxic documents is not taken for the class."""
    docs, toxic = leaning
    known = [(d, y) for d, y in toxic.items() if d % 3]
    got = {r.doc_id: r.predicted for r in score_toxicity(frame(spark, docs), spark.createDataFrame(known, "doc_id long, toxic int")).collect()}
    caught = [got[d] for d, y in toxic.items() if d % 3 == 0 and y]
    marked = [got[d] for d, y in toxic.items() if d % 3 == 0 and not y]
    assert sum(caught) >= 0.97 * len(caught) and sum(marked) <= 0.02 * len(marked)


@pytest.mark.parametrize("share", [0.3, 0.02])
def test_labels_hold_the_class(share):
    """Votes that agree on something else, a language, can't make that the class, however few documents have labels."""
    rng = random.Random(3)
    counts = Counter()
    for _ in range(40_000):
        y, lang = rng.random() < 0.1, rng.random() < 0.5
        votes = [lang ^ (rng.random() < 0.02) for _ in range(5)] + [y ^ (rng.random() < 0.02)]
        counts["".join(str(int(v)) for v in votes) + (str(int(y)) if rng.random() < share else "-")] += 1
    found, model = fit_label_model(counts, anchored=True)
    assert 0.07 < model.prior < 0.13 and found["000001-"] > 0.5 > found["111110-"]


def test_fit_counts_rows_by_their_weights():
    rng = random.Random(4)
    rows = [([0], [float(rng.random() < 0.5)], float(rng.random() < 0.4)) for _ in range(300)]
    twice = fit_logistic([r for r in rows for _ in range(1 + int(r[2]))], 1, -4.0, ridge=0.0)
    assert np.allclose(fit_logistic(rows, 1, -4.0, ridge=0.0, weights=[7.0 * (1 + r[2]) for r in rows]), twice, atol=1e-6)


def test_query_learns_from_its_own_labels_only(spark, tmp_path, planted):
    """Labels of held-out documents, and languages, sources and ids, change nothing."""
    docs, toxic = planted
    out = []
    for k in (0, 1):
        rows = [(d, t, f"{k}", f"s{k * d % 3}") for d, t in docs]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels = [(d, 1, (1 - y if k else y) if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in toxic.items()]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        out.append({r.doc_id: r for r in catalog.op11_toxicity(spark, f"{tmp_path}/{k}").collect()})
    assert all(out[0][d].score == pytest.approx(out[1][d].score, abs=1e-9) for d in out[0])
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in out[0].items())
    right = [r.predicted == toxic[d] for d, r in out[0].items() if r.held_out]
    assert sum(right) >= 0.97 * len(right)


def test_odd_rows(spark, planted):
    """Null and repeated ids, null and empty texts, labels that are null, repeated or of no document, empty tables."""
    docs, toxic = planted
    odd = docs[:200] + [(None, docs[0][1]), (None, None), (7000, ""), (7001, " \n"), (7002, "blarg " * 30_000), docs[3], docs[3]]
    labels = [(d, y) for d, y in toxic.items()] + [(7000, None), (99_999, 1), (3, toxic[3])]
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_toxicity(frame(spark, odd), given).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in odd)
    empty = {r.score for r in got if r.doc_id in (7000, 7001)}
    assert len(empty) == 1 and max(empty) < 0.3
    assert len({r.score for r in got if r.doc_id == docs[3][0]}) == 1
    assert score_toxicity(frame(spark, []), given).collect() == []
    none = score_toxicity(frame(spark, docs[:20]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 20 and not any(r.predicted for r in none)
