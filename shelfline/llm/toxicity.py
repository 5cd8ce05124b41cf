"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers are trained in numpy from confirmed toxic texts (P) and unlabelled texts (U).
With class prior c and the logistic loss, the risk is

    c R_P(+) + max(0, R_U(-) - c R_P(-))

where the second part estimates the risk on clean texts; once it falls below zero, the step goes
the other way, so that a classifier cannot profit from calling unlabelled texts clean beyond what
the prior allows. The score is the mean of the classifiers' probabilities.

A text's features are which words and which word beginnings it holds; how often does not count,
so neither long texts nor repeated words add weight by themselves. Only features that are
significantly more frequent in P than in U, or less, are used: most words are rare, and a
classifier over all of them would learn the confirmed texts by heart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import emptied_after_tasks, map_arrow, unit_uniform

BEGINNING = 4
_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. At most `positives` confirmed toxic texts and `unlabelled`
    texts of any kind are read, those with the smallest hashes; they bound the driver's memory."""

    positives: int = 4000
    unlabelled: int = 12000
    features: int = 256
    least_texts: int = 3
    significance: float = 4.0
    classifiers: int = 3
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 0


@dataclass(frozen=True)
class Classifiers:
    """The weights of each feature in each classifier, and their biases."""

    weights: dict[int, np.ndarray]
    biases: np.ndarray

    def probability(self, text: str | None) -> float:
        margins = self.biases.copy()
        for feature in features(text) & self.weights.keys():
            margins += self.weights[feature]
        return float(np.mean(1 / (1 + np.exp(-np.clip(margins, -30, 30)))))


class _WordFeatures(dict):
    """Features of words, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        found = (zlib.crc32(word.encode()),)
        if len(word) > BEGINNING:
            found += (zlib.crc32(("^" + word[:BEGINNING]).encode()),)
        self[word] = found
        return found


_word_features = emptied_after_tasks(_WordFeatures())


def features(text: str | None) -> set[int]:
    """The features of a text, as 32-bit numbers; none for an empty or null text."""
    found: set[int] = set()
    for word in set(_WORDS.findall((text or "").lower())):
        found.update(_word_features[word])
    return found


def _significant(positive: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray], how: Training) -> np.ndarray:
    values, where = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    n_p, n_u = len(positive), len(unlabelled)
    split = sum(map(len, positive))
    in_p = np.bincount(where[:split], minlength=len(values))
    in_u = np.bincount(where[split:], minlength=len(values))
    share = (in_p + in_u) / (n_p + n_u)
    spread = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12
    score = np.abs(in_p / n_p - in_u / n_u) / spread
    score[(in_p < how.least_texts) & (in_u < how.least_texts)] = 0
    best = np.lexsort((values, -score))[: how.features]
    return np.sort(values[best[score[best] >= how.significance]])


def _matrix(texts: Sequence[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    found = np.zeros((len(texts), len(chosen)), np.float32)
    for row, text in enumerate(texts):
        found[row, np.isin(chosen, text)] = 1
    return found


def fit(
    positive: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray], prior: float, how: Training
) -> Classifiers:
    """Classifiers from the features of P and U; without either every score is the prior."""
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Classifiers({}, np.array([start]))
    chosen = _significant(positive, unlabelled, how)
    all_p, all_u = _matrix(positive, chosen), _matrix(unlabelled, chosen)
    weights, biases = [], []
    for turn in range(how.classifiers):
        rng = np.random.default_rng([how.seed, turn])
        p = all_p[rng.integers(0, len(all_p), len(all_p))]
        u = all_u[rng.integers(0, len(all_u), len(all_u))]
        w = np.zeros(len(chosen) + 1)
        w[-1] = start
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, how.steps + 1):
            p_toxic = 1 / (1 + np.exp(-np.clip(p @ w[:-1] + w[-1], -30, 30)))
            u_toxic = 1 / (1 + np.exp(-np.clip(u @ w[:-1] + w[-1], -30, 30)))
            clean = -np.log(1 - u_toxic).mean() + prior * np.log(1 - p_toxic).mean()
            # The slopes of the two parts of the risk by each text's margin.
            p_slope, u_slope = -prior * p_toxic / len(p), u_toxic / len(u)
            if clean >= 0:
                p_slope = p_slope - prior * (1 - p_toxic) / len(p)
            else:
                p_slope, u_slope = -p_slope, -u_slope
            slope = np.append(p_slope @ p + u_slope @ u, p_slope.sum() + u_slope.sum())
            slope[:-1] += how.decay * w[:-1]
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            w -= how.rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights.append(w[:-1])
        biases.append(w[-1])
    by_feature = np.array(weights).T
    return Classifiers({int(c): by_feature[i] for i, c in enumerate(chosen)}, np.array(biases))


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Classifiers:
    """Classifiers from the rows of `docs` that are not held out.

    The prior is the share of toxic rows among all labelled ones that are not held out, half a
    row added to either side. Rows with a null text count as empty texts; rows with a null id or
    without a label are unlabelled. Repeated label rows count once, toxic if any of them is.
    """
    known = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
    )
    toxic, clean = known.agg(
        F.count(F.when(F.col("_toxic") == 1, 1)), F.count(F.when(F.col("_toxic") != 1, 1))
    ).first()
    prior = (toxic + 0.5) / (toxic + clean + 1)
    texts = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    at = unit_uniform(F.lit(how.seed), "doc_id")
    # The smallest hashes are taken: a share a little above the bound first, then exactly it.
    confirmed = known.filter("_toxic = 1").select("doc_id")
    confirmed = confirmed.filter(at < _share(how.positives, toxic))
    confirmed = confirmed.orderBy(at, "doc_id").limit(how.positives)
    total = texts.count()
    others = texts.filter(at < _share(how.unlabelled, total))
    # At most how.positives ids are broadcast.
    positive = _read(texts.join(F.broadcast(confirmed), "doc_id", "left_semi"), how.positives, at)
    unlabelled = _read(others, how.unlabelled, at)
    return fit(positive, unlabelled, prior, how)


def _share(bound: int, total: int) -> float:
    return 1.1 * bound / max(total, 1)


def _read(texts: DataFrame, most: int, at: Column) -> list[np.ndarray]:
    """The features of the `most` texts that are first by `at`. Their order depends on the texts
    alone."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [
            np.fromiter(features(t.as_py()), np.uint32).tobytes() for t in batch.column("text")
        ]
        return {"_features": pa.array(made, pa.binary())}

    rows = map_arrow(texts, ["doc_id", "text"], run, {"_features": "binary"})
    rows = rows.select("doc_id", "_features").orderBy(at, "doc_id", "_features").limit(most).collect()
    found = sorted(((r[0], bytes(r[1])) for r in rows))
    return [np.frombuffer(f, np.uint32) for _, f in found]


def toxicity_scores(
    docs: DataFrame,
    models: Classifiers,
    keep: list[str],
    text: str = "text",
    score: str = "score",
) -> DataFrame:
    """The columns `keep` and a score between 0 and 1 for every whole text.

    An empty or null text has no features and gets the classifiers' bias. The column `score`
    takes the place of one of that name. What is broadcast has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        scores = [shared.value.probability(t.as_py()) for t in batch.column(text)]
        return {score: pa.array(scores, pa.float64())}

    return map_arrow(docs, list(dict.fromkeys([*keep, text])), run, {score: "double"}).select(
        *[c for c in keep if c != score], score
    )
