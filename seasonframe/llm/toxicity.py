"""Toxicity by subword bags.

A word is the mean of the vectors of its character n-grams, a document the mean of its words, and a linear softmax on that
mean times the number of words tells the classes apart; n-gram vectors and softmax are trained jointly in numpy, over the
bags of whole documents. Misspelt or unseen words score through the n-grams that they share with seen ones. Only n-grams
that stand clearly more or less often in one class than chance has it carry a vector: the others would learn
their documents by heart. The document's logit is turned into a score by a logistic curve fitted on rows that were
not used for the vectors, at a share of toxic rows of ``CURVE_SHARE``.

Defined results: null and empty texts score 0; a training set that lacks a class gives that class's share to every
text; repeated rows score alike; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, quoted

#: The share of toxic rows that the curve reckons with: a missed one costs more than a false alarm.
CURVE_SHARE = 0.3
_SIZES = (3, 4, 5, 6)
_BITS = 18
#: Bytes of words whose scores a task keeps.
_CACHE_BYTES = 32 << 20


def _ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one word after another, and the number of each: n-grams and the whole word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(data))
    owner = np.repeat(np.arange(len(words)), lengths)
    mixed = np.zeros(len(data), np.uint64)
    found, of = [], []
    for n in range(1, max(_SIZES) + 1):
        # the hash of the n bytes from each place on; those over the word's end are dropped
        mixed = mixed[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :]
        if n in _SIZES:
            inside = place[: len(mixed)] + n <= ends[: len(mixed)]
            code = mixed[inside] ^ (mixed[inside] >> np.uint64(29))
            found.append(((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS)).astype(np.int64))
            of.append(owner[: len(mixed)][inside])
        if not len(mixed):
            break
    owner, bucket = np.concatenate(of), np.concatenate(found)
    whole = np.fromiter((zlib.crc32(w) & ((1 << _BITS) - 1) for w in words), np.int64, len(words))
    owner, bucket = np.append(owner, np.arange(len(words))), np.append(bucket, whole)
    return bucket[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class ToxicityModel:
    """One number a bucket (vector times softmax weights), and the logistic curve on a document's logit."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Each word's share in the logit: the mean over its n-grams."""
        bucket, count = _ngrams(words)
        total = np.bincount(np.repeat(np.arange(len(words)), count), self.weights[bucket], minlength=len(words))
        return total / np.maximum(count, 1)

    def probability(self, mean: float, n_words: int) -> float:
        """The score of a document of n words with that mean of word scores."""
        logit = n_words * mean + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -500, 500))))


def _fit_curve(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on one score, by damped Newton steps."""
    shift, scale = float(score.mean()), float(score.std()) or 1.0
    x = np.stack([(score - shift) / scale, np.ones(len(score))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - label)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0] / scale), float(w[1] - w[0] * shift / scale)


def _ngrams_in_parts(words: list[bytes], part: int = 10_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, buckets, counts) of some words at a time: n-grams take far more memory than their words."""
    for at in range(0, len(words), part):
        yield (at, *_ngrams(words[at : at + part]))


def telling_ngrams(words: list[bytes], counts: np.ndarray, least: float, most: int) -> np.ndarray:
    """The buckets of n-grams whose words stand in one class more often than chance, by ``least`` standard deviations; of
    more than ``most``, those with the greatest deviation.

    ``counts``: how often each word stands in the two classes.
    """
    seen = np.zeros((2, 1 << _BITS))
    for at, bucket, count in _ngrams_in_parts(words):
        for c in (0, 1):
            seen[c] += np.bincount(bucket, np.repeat(counts[c][at : at + len(count)], count), minlength=1 << _BITS)
    share = counts[1].sum() / counts.sum()
    chance = seen.sum(axis=0) * np.array([[1 - share], [share]])
    # the root of the deviance: fair to rare n-grams whatever the classes' shares
    far = np.sqrt(np.maximum(2 * (seen * np.log(np.maximum(seen, 1e-9) / np.maximum(chance, 1e-9))).sum(axis=0), 0))
    return np.sort(np.argsort(-far, kind="stable")[: min(most, int((far > least).sum()))])


def _bags(docs: list[np.ndarray], words: list[bytes], grams: np.ndarray) -> np.ndarray:
    """Documents by n-grams: a document's mean over its words' means, times its number of words."""
    column = np.full(1 << _BITS, -1, np.int32)
    column[grams] = np.arange(len(grams))
    owners, grams_of, counts = [], [], []
    for at, bucket, count in _ngrams_in_parts(words):
        here = column[bucket]
        owners.append(np.repeat(np.arange(at, at + len(count)), count)[here >= 0])
        grams_of.append(here[here >= 0])
        counts.append(count)
    word, gram, count = np.concatenate(owners), np.concatenate(grams_of), np.concatenate(counts)
    first = np.searchsorted(word, np.arange(len(words) + 1))
    out = np.zeros((len(docs), len(grams)), np.float32)
    for k, doc in enumerate(docs):
        w, times = np.unique(doc, return_counts=True)
        n = first[w + 1] - first[w]
        spot = np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[k] = np.bincount(gram[spot], np.repeat(times / count[w], n), minlength=len(grams))
    return out


def fit_numpy(texts: list[str], labels: np.ndarray, prior: float, dim: int = 8, epochs: int = 400, rate: float = 0.3, seed: int = 7, least: float = 5.0, most: int = 2048) -> ToxicityModel:
    """Train on whole sampled texts; ``prior`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(1 << _BITS)
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in _split(t)], np.int64) for t in texts]
    use = np.array([k for k, d in enumerate(docs) if len(d)], np.int64)
    if not len(use) or len(set(labels[use].tolist())) < 2:
        return ToxicityModel(weights, 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    words = list(ids)
    held = rng.random(len(use)) < 0.25
    if len(set(labels[use[held]].tolist())) < 2 or len(set(labels[use[~held]].tolist())) < 2:
        held[:] = False
    fit = ~held
    y = labels[use].astype(np.int64)
    counts = np.stack([np.bincount(np.concatenate([docs[k] for k in use[fit & (y == c)]]), minlength=len(ids)) for c in (0, 1)])
    grams = telling_ngrams(words, counts, least, most)
    soft, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    if len(grams):
        bags = _bags([docs[k] for k in use[fit]], words, grams)
        vectors = rng.normal(0, 0.1, (len(grams), dim))
        values = [vectors, soft, bias]
        seen = [np.full(v.shape, 1e-8) for v in values]
        target = y[fit]
        for _ in range(epochs):
            bag = bags @ vectors.astype(np.float32)
            logit = bag @ soft + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(target)), target] -= 1
            p /= len(target)
            grads = [bags.T @ (p @ soft.T).astype(np.float32), bag.T @ p, p.sum(axis=0)]
            for value, grad, total in zip(values, grads, seen, strict=True):
                total += grad.astype(float) ** 2
                value -= rate * grad / np.sqrt(total)
        weights[grams] = vectors @ (soft[:, 1] - soft[:, 0])
    model = ToxicityModel(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    scores = np.concatenate([model.word_scores(words[at : at + 10_000]) for at in range(0, len(words), 10_000)])
    known = held if held.any() else fit
    logit = np.array([scores[docs[k]].sum() for k in use[known]]) + model.bias
    label = y[known].astype(float)
    share = label.mean()
    weight = np.where(label > 0, CURVE_SHARE / share, (1 - CURVE_SHARE) / (1 - share))
    slope, offset = _fit_curve(logit, label, weight)
    return ToxicityModel(weights, model.bias, slope, offset)


def train_toxicity(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1500, sample_bytes: int = 16 << 20) -> ToxicityModel:
    """Train on a bounded sample: about ``per_class`` labelled rows of each class, with their whole texts.

    Keys are drawn by hash from all labelled ones, at a rate set by the class counts over all of them; a key with
    several labels counts with the largest. If the texts drawn have more than ``sample_bytes``, fewer rows of both
    classes are drawn, by the same hash.
    """
    known = labels.filter(quoted(label).isNotNull() & quoted(key).isNotNull())
    if trainable is not None:
        known = known.filter(trainable)
    known = known.groupBy(quoted(key).alias("__key")).agg(F.max(quoted(label)).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    whole = 1 << 40
    rate = F.when(F.col("y") == 1, F.lit(whole * per_class // max(1, counts.get(1, 0)) + 1)).otherwise(F.lit(whole * per_class // max(1, total - counts.get(1, 0)) + 1))
    place = F.pmod(F.xxhash64(F.col("__key"), F.lit("sample")), F.lit(whole))
    drawn = known.filter(place < rate)
    # a few thousand keys at most, by the bound above
    sample = docs.join(F.broadcast(drawn), quoted(key) == F.col("__key")).select("__key", "y", F.coalesce(quoted(text), F.lit("")).alias("t"))
    # keys of the first hashes, relative to their class's rate, whose texts fit in
    least = place / F.least(rate, F.lit(whole))
    sizes = sample.groupBy("__key", "y").agg(F.max(F.octet_length("t")).alias("n"))
    room, share = sample_bytes, 1.0
    for r in sorted(sizes.select(least.alias("h"), "n").collect()):
        room -= r["n"]
        if room < 0:
            share = r["h"]
            break
    if share < 1:
        sample = sample.filter(least < share)
    sample = sample.groupBy("__key", "y").agg(F.min("t").alias("t"))  # one text a key, however often it is repeated
    rows = sorted((r["__key"], r["y"], r["t"]) for r in sample.collect())
    return fit_numpy([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), counts.get(1, 0) / total)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) to every row, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 numbers

    def make():
        model = shared.value
        cache: dict[bytes, float] = {}
        held = 0

        def compute(texts):
            nonlocal cache, held
            split = [_split(t) if t else [] for t in texts]
            if held > _CACHE_BYTES:
                cache, held = {}, 0
            new = [w for w in {w for ws in split for w in ws} if w not in cache]
            if new:
                cache.update(zip(new, model.word_scores(new).tolist(), strict=True))
                held += sum(map(len, new)) + 100 * len(new)  # a word, its number and its place
            out = [model.probability(sum(map(cache.__getitem__, words)) / len(words), len(words)) if words else 0.0 for words in split]
            return [out, [int(s >= threshold) for s in out]]

        return compute

    return map_columns(docs, [text], "score double, predicted int", make, keep)
