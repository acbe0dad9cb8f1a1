"""Toxicity scores by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import in_task, key_hash, materialize, small_batches
from ragspark.llm.quality import fit_logistic

CLEAN, TOXIC, ABSTAIN = "0", "1", "-"
#: Word starts of these lengths are terms beside whole words, which are dealt into so many lexicons.
STARTS, LEXICONS = (4, 5, 6, 7), 4
#: Words of a general English insult list that need no labels.
INSULTS = frozenset("idiot idiots stupid moron morons dumb loser losers scum trash garbage pathetic disgusting worthless clown clowns jerk fool fools".split())
#: Each voter: from which value on it votes toxic and up to which clean. Lexicons: the share of words that are terms;
#: strongest: the logarithm of the odds ratio of the most telling term, however rare it is in the text.
VOTERS = (
    *((f"words{i}", 0.006, 0.002) for i in range(LEXICONS)), *((f"starts{k}", 0.008, 0.003) for k in STARTS),
    ("insults", 0.006, 0.001), ("shouting", 0.60, 0.30), ("exclaims", 0.40, 0.10),
    ("strongest", 3.0, 1.0),
)
LABEL = len(VOTERS)  # the place of the label among the votes
WORD = re.compile(r"[^\W\d_]+")
#: A term may be toxic if it has so many toxic documents and so many times the odds of all, counting those that hold
#: it or those where it is such a share of the words. Words that merely lean to a class, as those of a language do, don't.
LEAST_DOCS, LEAST_ODDS, LEAST_SHARE = 3, 6.0, 0.004
#: What a term's share counts for, up to 1; for measures that are no shares, by what they are multiplied and up to what.
#: One rare but telling term has to outweigh all shares that are near zero in a long text.
SCALE = 50.0
SCALES = {"shouting": (1.0, 1.0), "exclaims": (1.0, 1.0), "strongest": (0.5, 3.0)}


class Lexicon(NamedTuple):
    """The place of each term among the features, a word start ending in an asterisk, and the logarithm of its odds ratio."""

    terms: dict[str, int]
    odds: dict[str, float] = {}

    @property
    def size(self) -> int:
        return len(self.terms) + len(VOTERS)


def term_counts(text: str | None) -> tuple[Counter, int, str]:
    """How often each word and each longer word's starts occur in the lowered whole text; its words; the text."""
    text = text or ""
    words = Counter(WORD.findall(text.lower()))
    terms = Counter(words)
    for word, n in words.items():
        for k in STARTS:
            if len(word) > k:
                terms[word[:k] + "*"] += n
    return terms, sum(words.values()), text


def _mine(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                terms, n, _ = term_counts(text)
                for term, c in terms.items():
                    own = found.setdefault(term, [0, 0, 0, 0])
                    own[toxic] += 1
                    if c >= least * n:
                        own[2 + toxic] += 1
            if len(found) > 400_000:
                yield _mined(found)
                found = {}
        yield _mined(found)

    return run


#: A term's clean and toxic documents: all that hold it, and those where it is a large share.
COUNTS = ("clean", "toxic", "often_clean", "often_toxic")


def _mined(found: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([f[i] for f in found.values()], pa.int64()) for i in range(len(COUNTS)))], ["term", *COUNTS])


def association(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """G2 of a term's documents against the class, positive where the term is commoner in toxic ones."""
    both = (toxic + clean) / (n_toxic + n_clean)
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(F.lit(0.0))
    rates = toxic / n_toxic, clean / n_clean
    value = 2 * sum(
        (part(k, r, both) + part(n - k, 1 - r, 1 - both) for k, r, n in ((toxic, rates[0], n_toxic), (clean, rates[1], n_clean))), F.lit(0.0))
    return F.when(rates[0] > rates[1], value).otherwise(-value)


def odds_ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """How many times the odds of all documents those with the term have to be toxic, each count half a document more."""
    return (toxic + 0.5) / (clean + 0.5) * (n_clean / n_toxic)


def learn_lexicon(labelled: DataFrame, size: int) -> Lexicon:
    """The terms most associated with toxic documents, at most `size`. labelled: (toxic 0/1, _text).

    Of m terms that are looked at in two ways, about one is as associated by chance as the least that is taken: a G2 of
    2 ln 2m. A term counts in the way in which it is more associated, and needs the odds of LEAST_ODDS besides. What a
    shorter word start tells as surely comes last.
    """
    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Lexicon({})
    counted = labelled.mapInArrow(_mine(LEAST_SHARE), "term string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS))
    ways = []
    for clean, toxic in (COUNTS[:2], COUNTS[2:]):
        odds = odds_ratio(F.col(toxic), F.col(clean), totals[1], totals[0])
        g2 = F.round(association(F.col(toxic), F.col(clean), totals[1], totals[0]), 6)
        ways.append(F.when((F.col(toxic) >= LEAST_DOCS) & (odds >= LEAST_ODDS), F.struct(g2.alias("g2"), F.log(odds).alias("odds"))))
    looked = materialize(counted.where(F.col("toxic") >= LEAST_DOCS).select("term", F.greatest(*ways).alias("way")), "terms")
    best = looked.where(F.col("way.g2") >= 2 * math.log(max(1, 2 * looked.count()))).orderBy(F.desc("way.g2"), "term").limit(4 * size)
    odds = {r["term"]: r["odds"] for r in best.select("term", "way.odds").toArrow().to_pylist()}
    told = lambda t: any(odds.get(t[:k] + "*", -1.0) >= odds[t] for k in STARTS if k < len(t.rstrip("*")))
    kept = sorted(odds, key=told)[:size]  # a stable sort: by association otherwise
    return Lexicon({t: i for i, t in enumerate(kept)}, {t: odds[t] for t in kept})


def look(text: str | None, lexicon: Lexicon) -> tuple[str, dict[int, float]]:
    """The votes on a whole text, a letter a voter, and its features: terms by their share of the words, and the measures."""
    terms, n, text = term_counts(text)
    values = dict.fromkeys((name for name, *_ in VOTERS), 0.0)
    found: dict[int, float] = {}
    for term in terms.keys() & lexicon.terms.keys():
        share = terms[term] / n
        found[lexicon.terms[term]] = min(1.0, SCALE * share)
        values[f"starts{len(term) - 1}" if term[-1] == "*" else f"words{xxhash.xxh64_intdigest(term) % LEXICONS}"] += share
        values["strongest"] = max(values["strongest"], lexicon.odds.get(term, 0.0))
    if n:
        values["insults"] = sum(terms[w] for w in INSULTS if w in terms) / n
        letters = sum(map(str.isalpha, text))
        values["shouting"] = sum(map(str.isupper, text)) / max(1, letters)
        values["exclaims"] = text.count("!") / n
    for i, (name, *_) in enumerate(VOTERS):
        if values[name]:
            scale, most = SCALES.get(name, (SCALE, 1.0))
            found[len(lexicon.terms) + i] = min(most, values[name] * scale)
    votes = "".join(ABSTAIN if not n else TOXIC if values[name] >= bad else CLEAN if values[name] <= good else ABSTAIN for name, bad, good in VOTERS)
    return votes, found


def _look(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            seen = [look(t, lexicon) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("_hash"), pa.array([v for v, _ in seen], pa.string()),
                pa.array([list(f) for _, f in seen], pa.list_(pa.int32())), pa.array([list(f.values()) for _, f in seen], pa.list_(pa.float32())),
            ], ["doc_id", "hash", "votes", "index", "value"])

    return run


class LabelModel(NamedTuple):
    """What fit_label_model() estimates: the share of toxic documents, each voter's votes given the class (rates[class,
    voter, vote]), the voter each depends on (-1: none) and its votes given that one's (pairs[class, voter, its vote, vote])."""

    prior: float
    rates: np.ndarray
    parent: list[int]
    pairs: np.ndarray


def _spanning_tree(gain: np.ndarray, least: float) -> list[int]:
    """Each node's parent in the tree of largest gains, -1 for roots; edges under `least` are left out."""
    n, parent, seen = len(gain), [-1] * len(gain), set()
    for root in range(n):
        if root in seen:
            continue
        seen.add(root)
        while True:
            edges = [(gain[i, j], i, j) for i in seen for j in range(n) if j not in seen and gain[i, j] >= least]
            if not edges:
                break
            _, i, j = max(edges)
            parent[j] = i
            seen.add(j)
    return parent


def _likelihood(model: LabelModel, votes: np.ndarray) -> np.ndarray:
    """The logarithm of a pattern's probability with each class; abstentions say nothing."""
    out = np.log(np.array([1 - model.prior, model.prior]))[None, :].repeat(len(votes), 0)
    for j, i in enumerate(model.parent):
        cast = votes[:, j] < 2
        own = np.minimum(votes[:, j], 1)
        alone = np.log(model.rates[:, j, own]).T
        if i >= 0:
            other = np.minimum(votes[:, i], 1)
            alone = np.where((votes[:, i] < 2)[:, None], np.log(model.pairs[:, j, other, own]).T, alone)
        out += np.where(cast[:, None], alone, 0.0)
    return out


def fit_label_model(counts: dict[str, int], rounds: int = 200, weight: float = 1.0, least_gain: float = 0.002, anchored: bool = False) -> tuple[dict[str, float], LabelModel]:
    """Expectation-maximisation over vote patterns: the posterior that each pattern's documents are toxic, and the model.

    counts: documents by pattern; a pattern is a vote of each voter and the label, if any, as one more voter with
    errors of its own. Given the class, votes are not independent: each voter's vote depends on that of one other,
    along the spanning tree of the largest conditional mutual informations, found again as posteriors settle. So two
    lexicons that always agree don't count twice. Beliefs of fixed weight: a vote is right four times in five, a label
    49 times in 50. Starts from the labels, and from two or more toxic votes where there is none.

    anchored: where many votes agree on something else, such as the language, that would become the class. So the start is
    from labelled documents alone, others weigh as much as those at most, and the belief in labels as many documents.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, LabelModel(0.5, np.full((2, 0, 2), 0.5), [], np.full((2, 0, 2, 2), 0.5))
    votes = np.array([[(CLEAN, TOXIC, ABSTAIN).index(c) for c in p] for p in patterns])
    mass, n = np.array([counts[p] for p in patterns], float), votes.shape[1]
    label = votes[:, -1]
    labelled = mass[label < 2].sum() if anchored else 0.0
    if labelled:
        mass = np.where(label < 2, mass, mass * min(1.0, labelled / max(1.0, mass[label == 2].sum())))
    toxic = np.where(label < 2, np.where(label == 1, 0.95, 0.05), np.where((votes[:, :-1] == 1).sum(axis=1) >= 2, 0.9, 0.05))
    hot = np.stack([votes == v for v in (0, 1)], axis=2).reshape(len(votes), 2 * n).astype(float)
    belief = np.array([[0.8, 0.2], [0.2, 0.8]])[:, None, :].repeat(n, 1) * 5 * weight
    belief[:, -1] = np.array([[0.98, 0.02], [0.02, 0.98]]) * max(200.0, labelled) * weight
    parent: list[int] = []
    for step in range(rounds):
        seen = mass * (label < 2) if labelled and not step else mass
        held = np.stack([seen * (1 - toxic), seen * toxic])
        both = np.stack([hot.T @ (hot * h[:, None]) for h in held]).reshape(2, n, 2, n, 2)
        own = np.stack([both[:, j, :, j, :].diagonal(axis1=1, axis2=2) for j in range(n)], axis=1) + belief
        rates = own / own.sum(axis=2, keepdims=True)
        if step % 10 == 0 and step < 60:
            joint = both + 0.5
            joint = joint / joint.sum(axis=(2, 4), keepdims=True)
            mutual = (joint * np.log(joint / joint.sum(axis=2, keepdims=True) / joint.sum(axis=4, keepdims=True))).sum(axis=(2, 4))
            shared = both.sum(axis=(2, 4)) / held.sum()  # how many cast both votes
            gain = (mutual * shared).sum(axis=0)
            gain[-1, :] = gain[:, -1] = 0.0  # the label depends on the class alone
            parent = _spanning_tree(gain, least_gain)
        # Votes given the parent's: shrunk towards the voter's own rates, by a fixed weight.
        pairs = np.stack([both[:, i, :, j, :] if i >= 0 else np.zeros((2, 2, 2)) for j, i in enumerate(parent)], axis=1) + 2 * weight * rates[:, :, None, :]
        pairs /= pairs.sum(axis=3, keepdims=True)
        model = LabelModel(float((held[1].sum() + weight) / (held.sum() + 2 * weight)), rates, parent, pairs)
        log = _likelihood(model, votes)
        after = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        done = np.abs(after - toxic).max() < 1e-6 and step > 60
        toxic = after
        if done:
            break
    return dict(zip(patterns, toxic.tolist(), strict=True)), model


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = batch.column("index"), batch.column("value")
            at = np.repeat(np.arange(len(index)), np.diff(index.offsets.to_numpy()))
            z = np.bincount(at, weights[index.flatten().to_numpy()] * value.flatten().to_numpy(), minlength=len(index)) + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("votes"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "votes", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_rows: int = 16_384, fit_rows: int = 8192, terms: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes (a letter a voter), score and predicted (1 from the threshold on) of every row of docs.

    labels: (doc_id, toxic 0/1), what may be learned from; at most label_rows of them by the hash of their ids, several of
    one document as the largest. From the documents they name come the terms of the lexicons, at most `terms`. Then all
    documents are voted on, and the label model estimates accuracies and correlations from the counts of vote patterns
    of all documents, at most 3 to the number of voters. The scorer, linear on term shares and measures, is fitted
    on the labels, then the posterior labels, of at most fit_rows documents, half of them toxic where there are so many,
    weighted so that either half counts as in all documents. Ids, sources and
    languages are no input. Texts are read twice and never shuffled; null and empty texts are scored by the bias alone.
    Rows of equal or null ids are scored each by itself; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(key_hash(F.col("doc_id")), "doc_id").limit(label_rows)
    chosen = F.broadcast(materialize(chosen, "labels"))  # at most label_rows
    rows = docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col), F.md5(F.col(text_col))).alias("_hash"), F.col(text_col).alias("_text"))
    lexicon = learn_lexicon(rows.join(chosen, "doc_id").select("toxic", "_text"), terms)
    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = materialize(rows.mapInArrow(_look(spark.sparkContext.broadcast(lexicon)), f"doc_id {kind}, hash long, votes string, index array<int>, value array<float>"), "votes")
    marked = seen.join(chosen, "doc_id", "left").withColumn("pattern", F.concat("votes", F.coalesce(F.col("toxic").cast("string"), F.lit(ABSTAIN)))).drop("toxic")
    counts = {r["pattern"]: r["count"] for r in marked.groupBy("pattern").count().toArrow().to_pylist()}
    posterior, _ = in_task(spark, fit_label_model, counts, 200, 1.0, 0.002, True)
    target = {p: float(p[-1]) if p[-1] != ABSTAIN else v for p, v in posterior.items()}
    sample, weights = [], []
    for side in (True, False):
        own = [p for p, v in target.items() if (v >= 0.5) == side]
        if own:
            listed = F.broadcast(spark.createDataFrame([(p,) for p in own], "pattern string"))  # at most 3 ** voters
            got = marked.join(listed, "pattern").orderBy(F.col("pattern").endswith(ABSTAIN), "hash", "doc_id").limit(fit_rows // 2).select("pattern", "index", "value").toArrow().to_pylist()
            sample += got
            weights += [sum(counts[p] for p in own) / max(1, len(got))] * len(got)  # the sides as large as in all documents
    weights = in_task(spark, fit_logistic, [(r["index"], r["value"], target[r["pattern"]]) for r in sample], lexicon.size, -4.0, 25, 1e-4, weights)
    scored = seen.select("doc_id", "votes", "index", "value").mapInArrow(_score(weights), f"doc_id {kind}, votes string, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
