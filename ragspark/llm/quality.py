"""A quality classifier from weak labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.common import in_task, key_hash, materialize, small_batches

BAD, GOOD, ABSTAIN = "0", "1", "-"
#: Each labeller: the measure it looks at, the words it needs, and from where it votes bad and up to where good.
LABELLERS = (
    ("symbols", 3, 0.10, 0.03),
    ("shouting", 5, 0.60, 0.30),
    ("exclaims", 5, 0.40, 0.10),
    ("bars", 5, 0.20, 0.05),
    ("repeats", 5, 0.35, 0.15),
    ("stale_trigrams", 20, 0.50, 0.30),
    ("odd_lengths", 5, 0.80, 0.30),
    ("controls", 1, 0.10, 0.01),
)
MEASURES = tuple(name for name, *_ in LABELLERS)
_CLASSES = bytes(
    120 if 97 <= b <= 122 or b >= 128 else 88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
_shapes: dict[bytes, int] = {}


def measures(text: str | None) -> tuple[dict[str, float], Counter, int]:
    """The measures of the whole text, its word shapes with their counts, and its number of words."""
    text = text or ""
    raw = text.encode()
    words, shape = raw.split(), raw.translate(_CLASSES)
    n = len(words)
    lower, upper = shape.count(b"x"), shape.count(b"X")
    # Two bytes of a letter beyond ASCII count as lower-case ones unless the text says otherwise.
    if len(text) != len(raw):
        letters = [c for c in text if c >= "\x80"]
        beyond = sum(map(str.isupper, letters))
        lower, upper = lower - (len(raw) - len(text)) - beyond, upper + beyond
    symbols = sum(raw.count(c) for c in (b"#", b"$", b"%", b"&", b"*", b"@", b"~", b"^", b"=", b"<", b">"))
    controls = sum(raw.count(bytes([c])) for c in (*range(9), *range(14, 32), 127))
    trigrams = max(1, n - 2)
    found = {
        "symbols": symbols / max(1, len(text)),
        "shouting": upper / max(1, lower + upper),
        "exclaims": raw.count(b"!") / max(1, n),
        "bars": raw.count(b"|") / max(1, n),
        "repeats": sum(map(eq, words, words[1:])) / max(1, n),
        "stale_trigrams": 1 - len(set(zip(words, words[1:], words[2:]))) / trigrams if n > 2 else 0.0,  # noqa: B905
        "odd_lengths": sum(len(w) > 40 for w in words) / max(1, n),
        "controls": controls / max(1, len(text)),
    }
    return found, Counter(shape.split()), n


def votes(found: dict[str, float], n: int) -> str:
    """A letter for each labeller; too few words, or a value in between: it abstains."""
    return "".join(
        ABSTAIN if n < least else BAD if found[name] >= bad else GOOD if found[name] <= good else ABSTAIN for name, least, bad, good in LABELLERS
    )


def features(found: dict[str, float], shapes: Counter, n: int, buckets: int) -> tuple[list[int], list[float]]:
    """Hashed features: the root of the share of each word shape (runs of a class are one), and each measure."""
    values: dict[int, float] = {}
    for shape, count in shapes.items():
        if (h := _shapes.get(shape)) is None:
            h = xxhash.xxh64_intdigest(_RUNS.sub(rb"\1", shape))
            if len(_shapes) < 100_000:
                _shapes[shape] = h
        values[h % buckets] = values.get(h % buckets, 0.0) + count / n
    rooted = {k: v**0.5 for k, v in values.items()}
    for name in MEASURES:
        h = xxhash.xxh64_intdigest("measure " + name) % buckets
        rooted[h] = rooted.get(h, 0.0) + 4 * min(1.0, found[name])
    return list(rooted), list(rooted.values())


def _look(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            voted, index, value = [], [], []
            for text in batch.column("_text").to_pylist():
                found, shapes, n = measures(text)
                i, v = features(found, shapes, n, buckets)
                voted.append(votes(found, n) if n else None)
                index.append(i)
                value.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_hash"), pa.array(voted, pa.string()), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "hash", "votes", "index", "value"])

    return run


#: Believed beforehand: bad and other votes of a labeller on good documents, as a share of all votes it casts; on bad ones
#: of its own kind, and of another kind; and a document of each class.
FALSE_ALARMS, OWN_KIND, OTHER_KIND = (0.0002, 0.0998), (4.0, 1.0), (0.2, 0.8)


def fit_labellers(counts: dict[str, int], rounds: int = 500) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over vote patterns: the posterior that each pattern's documents are good, and rates.

    counts: documents by pattern, at most 3 ** labellers of them. A document is good or of one of several bad kinds, as
    many as labellers, for junk comes in kinds that have little to do with one another. Given its class, labellers
    are independent. Each class has a share of the documents, and in it each labeller a rate of bad votes among votes
    cast; all of these are estimated and none is bounded. Votes alone can't tell what one labeller alone accuses
    from its false alarms: the beliefs say that it is bad. Starts from "bad if any labeller says so", of their kinds.
    rates: a row a labeller, for bad documents (its sensitivity) and for good ones (its false alarms).
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((len(LABELLERS), 2))
    cast = np.array([[c != ABSTAIN for c in p] for p in patterns], float)
    bad = np.array([[c == BAD for c in p] for p in patterns], float)
    weight = np.array([counts[p] for p in patterns], float)
    kinds, votes_cast = len(LABELLERS), weight @ cast + 1
    yes, no = (np.vstack([FALSE_ALARMS[i] * votes_cast, np.where(np.eye(kinds) > 0, OWN_KIND[i], OTHER_KIND[i])]) for i in (0, 1))
    accused = np.where(bad.any(axis=1), 0.95, 0.02)[:, None]
    share = np.where(bad.any(axis=1, keepdims=True), bad, 1.0)
    member = np.hstack([1 - accused, accused * share / share.sum(axis=1, keepdims=True)])  # of good, then of each kind
    for _ in range(rounds):
        held = (weight[:, None] * member).T
        rates = (held @ bad + yes) / (held @ cast + yes + no)
        prior = (held.sum(axis=1) + 1) / (weight.sum() + kinds + 1)
        log = bad @ np.log(rates).T + (cast - bad) @ np.log1p(-rates).T + np.log(prior)
        after = np.exp(log - log.max(axis=1, keepdims=True))
        after /= after.sum(axis=1, keepdims=True)
        done = np.abs(after - member).max() < 1e-6
        member = after
        if done:
            break
    sensitivity = prior[1:] @ rates[1:] / prior[1:].sum()
    return dict(zip(patterns, member[:, 0].tolist(), strict=True)), np.stack([sensitivity, rates[0]], axis=1)


def fit_logistic(rows: list[tuple[list[int], list[float], float]], size: int, constant: float, rounds: int = 25, ridge: float = 1e-3, weights: list[float] | None = None) -> np.ndarray:
    """Weights (bias last) of a logistic scorer over sparse rows (places, values, target), by Newton steps. Rows count
    alike or by their weights, whose scale says nothing.

    Targets of one class only, or no rows, give a constant: `constant`, or its opposite if all are of the other class.
    """
    x = np.zeros((len(rows), size + 1))
    x[:, -1] = 1
    for i, (index, value, _) in enumerate(rows):
        x[i, index] = value
    y = np.array([target for *_, target in rows])
    w = np.zeros(size + 1)
    if not len(rows) or y.min() > 0.5 or y.max() < 0.5:
        w[-1] = constant if not len(rows) or (y.min() > 0.5) == (constant > 0) else -constant
        return w
    used = np.nonzero(x.any(axis=0))[0]
    x = x[:, used]
    v = np.zeros(len(used))
    c = np.ones(len(rows)) if weights is None else np.array(weights) / np.mean(weights)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (c * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * len(rows) * np.eye(len(used)), x.T @ (c * (y - p)) - ridge * len(rows) * v)
        v += step
        if np.abs(step).max() < 1e-5:
            break
    w[used] = v
    return w


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = batch.column("index"), batch.column("value")
            at = np.repeat(np.arange(len(index)), np.diff(index.offsets.to_numpy()))
            flat, offset = index.flatten().to_numpy(), value.flatten().to_numpy()
            z = np.bincount(at, weights[flat] * offset, minlength=len(index)) + weights[-1]
            none = batch.column("votes").is_null().to_numpy(zero_copy_only=False)
            score = np.where(none, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("votes"), pa.array(score)], ["doc_id", "votes", "score"])

    return run


def _filter(weights: np.ndarray, threshold: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text in batch.column("_text").to_pylist():
                found, shapes, n = measures(text)
                index, value = features(found, shapes, n, len(weights) - 1)
                z = float(weights[index] @ np.array(value)) + weights[-1]
                kept.append(bool(n) and 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold)
            own = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([own.column("_row")], names)

    return run


def fit_quality(docs: DataFrame, fit_rows: int = 4096, buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, float], np.ndarray]:
    """The votes and features of all documents (a table in the shared folder), the posterior by votes, and the scorer.

    The labellers measure whole texts; their accuracies are estimated on all documents, from the counts of vote
    patterns, of which there are few whatever the number of documents. The scorer is fitted on at most fit_rows
    documents, half of them with a posterior under 0.5 where there are so many, those with the least hashes of
    their ids and texts. Both are fitted in a task of their own, see in_task(). One pass over the texts; none is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col), F.md5(F.col(text_col))).alias("_hash"), F.col(text_col).alias("_text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, hash long, votes string, index array<int>, value array<float>"
    seen = materialize(rows.mapInArrow(_look(buckets), schema), "votes")
    counts = {r["votes"]: r["count"] for r in seen.where("votes is not null").groupBy("votes").count().collect()}
    good, _ = in_task(docs.sparkSession, fit_labellers, counts)
    sample = []
    for side in (True, False):
        own = [p for p, v in good.items() if (v >= 0.5) == side]
        if own:
            sample += seen.where(F.col("votes").isin(own)).orderBy("hash", "doc_id").limit(fit_rows // 2).select("votes", "index", "value").toArrow().to_pylist()
    return seen, good, in_task(docs.sparkSession, fit_logistic, [(r["index"], r["value"], good[r["votes"]]) for r in sample], buckets, 4.0)


def score_quality(docs: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, votes (a letter a labeller), posterior (of the votes), score and keep (score >= threshold) of every row.

    fit: arguments of fit_quality(). A text that is null or has no words has no votes, posterior and score 0 and
    is not kept. Rows of equal ids are scored each by itself; an empty table gives an empty one.
    """
    seen, good, weights = fit_quality(docs, **fit)
    schema = f"doc_id {seen.schema['doc_id'].dataType.simpleString()}, votes string, score double"
    scored = seen.select("doc_id", "votes", "index", "value").mapInArrow(_score(weights), schema)
    posterior = F.coalesce(F.create_map(*[F.lit(x) for pair in good.items() for x in pair])[F.col("votes")], F.lit(0.0)) if good else F.lit(0.0)
    return scored.select("doc_id", "votes", posterior.alias("posterior"), "score", (F.col("score") >= threshold).alias("keep"))


def filter_quality(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", **fit) -> DataFrame:
    """The rows of docs, all columns as they are, that score_quality() keeps; the texts are read twice, never moved."""
    _, _, weights = fit_quality(docs, text_col=text_col, **fit)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    out = T.StructType([rows.schema["_row"]])
    return rows.mapInArrow(_filter(weights, threshold, out.names), out).select("_row.*")
