"""Language proportions of documents by mixture inference over character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import small_batches

UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: whether it is a letter, that is of a Unicode category L*."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _letters[0]


def gram_counts(text: str | None, buckets: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of the lowered text, words bounded by a blank: the buckets that occur, and how often.

    Everything but letters counts as a blank; trigrams with a blank in the middle do not count. No letters: nothing
    occurs.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(points), chunk):
        part = np.concatenate([points[at - 1 : at] if at else [32], points[at : at + chunk + 1], [] if at + chunk < len(points) else [32]]).astype(np.uint32)
        part = np.where(letter_table()[part], part, 32).astype(np.uint64)
        middle = part[1:-1] != 32
        mixed = (part[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ part[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ part[2:] * np.uint64(0x165667B19E3779F9))[middle]
        total += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    found = np.nonzero(total)[0]
    return found, total[found]


def mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = 100, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the languages' shares of the counted n-grams: shares, and the log-likelihood."""
    share = np.full(len(likelihood), 1 / len(likelihood))
    weight = counts / counts.sum()
    for _ in range(rounds if len(share) > 1 else 0):
        joint = share[:, None] * likelihood
        after = (joint / joint.sum(axis=0)) @ weight
        done = np.abs(after - share).max() < close
        share = after
        if done:
            break
    return share, float(np.log(share @ likelihood) @ counts)


def best_fit_bound(likelihood: np.ndarray, counts: np.ndarray, share: np.ndarray, fit: float) -> float:
    """What no shares' log-likelihood exceeds, from the gradient at shares with log-likelihood `fit`."""
    slope = (likelihood / (share @ likelihood)) @ counts / counts.sum()
    return fit + float(counts.sum()) * max(0.0, float(slope.max()) - 1)


def select_languages(likelihood: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of all languages, of which a penalised likelihood keeps some and gives the others 0.

    The shares over all languages order them. The first 1, 2, ... of that order are fitted again, and the set with
    the largest log-likelihood less penalty * ln(n-grams) for each language counts. Every such set is looked at but
    those that can't win: no set fits better than the bound over all languages.
    """
    share, fit = mixture(likelihood, counts)
    bound, cost = best_fit_bound(likelihood, counts, share, fit), penalty * np.log(counts.sum() + 1)
    order = np.argsort(-share, kind="stable")
    best, chosen = -np.inf, share
    for k in range(1, len(order) + 1):
        if bound - cost * k <= best:
            break
        own = order[:k]
        part, fit = mixture(likelihood[own], counts)
        if fit - cost * k > best:
            best, chosen = fit - cost * k, np.zeros(len(share))
            chosen[own] = part
    return chosen


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, n = gram_counts(text, buckets)
                totals.setdefault(lang, np.zeros(buckets, np.int64))[found] += n
        for lang, total in totals.items():
            found = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(total[found])], ["lang", "bucket", "n"])

    return run


def train_languages(labelled: DataFrame, buckets: int = 1 << 14) -> tuple[list[str], np.ndarray]:
    """The language values and the n-gram probabilities of each, from all rows of labelled (lang, text; no null lang).

    A task counts what it reads and passes on one row for each language and bucket; the sums, a row for each of
    those, go to the driver. Both are bounded by the number of languages, not by the documents.
    """
    small_batches(labelled.sparkSession)
    sums = labelled.select("lang", "text").mapInArrow(_count(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    counts = np.full((len(names), buckets), 0.5)
    for i, lang in enumerate(names):
        own = sums[sums["lang"] == lang]
        counts[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return names, counts / counts.sum(axis=1, keepdims=True)


def _infer(shared, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            pred, score, shares = [], [], []
            for text in batch.column("_text").to_pylist():
                found, n = gram_counts(text, model.shape[1])
                if not len(found) or not names:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    shares.append([])
                    continue
                share = select_languages(model[:, found], n, penalty)
                top = int(share.argmax())
                pred.append(names[top])
                score.append(min(1.0, float(share[top])))
                shares.append([(names[i], float(share[i])) for i in np.nonzero(share)[0]])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["_row", "lang_pred", "score", "shares"])

    return run


def infer_languages(docs: DataFrame, names: list[str], model: np.ndarray, keep: list[Column], text_col: str = "text", penalty: float = 2.0) -> DataFrame:
    """_row (a struct of the columns in keep), lang_pred, score and shares (language to proportion) of every document.

    lang_pred is the language with the largest share, score that share. Texts that are null or have no letter are
    `und` with score 0 and no shares, and so is everything if no language was learned. Rows of equal or null ids are
    inferred each by itself. The model, languages times buckets, is broadcast; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((names, model))
    return rows.mapInArrow(_infer(shared, penalty), f"_row {kind}, lang_pred string, score double, shares map<string,double>")
